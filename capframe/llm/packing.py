"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capframe.llm.common import materialize

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 96  # cost of a sequence, in tokens, beside its length
ATTENTION = 8192  # length at which the cost that grows with the square equals the one that grows with the length
SHARD_TOKENS = 4_000_000
SHARD_PIECES = 50_000


def word_count(text: Column) -> Column:
    """Tokens of a text, counted as words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def sequence_cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    """Cost of one sequence, padding included: a fixed part, its length, and its length squared."""
    return overhead + capacity + capacity * capacity / attention


def smallest(size: int, capacities: tuple[int, ...]) -> int:
    """The smallest capacity that holds ``size``."""
    return capacities[bisect_left(capacities, size)]


def expected_fill(at: int, capacity: int, falling: list[int]) -> int:
    """Tokens a bin opened by piece ``at`` would hold if it took, each time, the largest later piece that fits.

    ``falling`` holds the sizes with their sign turned, in rising order.
    """
    free, k = capacity + falling[at], at + 1
    while free and (k := bisect_left(falling, -free, k)) < len(falling):
        free += falling[k]
        k += 1
    return capacity - free


def fill_bins(sizes: list[int], capacities: tuple[int, ...], opening: Callable[[int], int]):
    """[(bin, offset)] for sizes in falling order, and the final capacity of each bin.

    Each piece goes into the fullest open bin that has room (the oldest of equals); without one, a
    bin of capacity ``opening(index)`` opens. At the end every bin shrinks to the smallest capacity
    that holds its contents.
    """
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # heaps of bins by free room, and a bit for each length in use
    mask, placed, filled = 0, [], []
    for i, size in enumerate(sizes):
        free = mask >> size
        if free:
            left = size + (free & -free).bit_length() - 1
            k = heappop(room[left])
            if not room[left]:
                mask ^= 1 << left
        else:
            k, left = len(filled), opening(i)
            filled.append(0)
        placed.append((k, filled[k]))
        filled[k] += size
        if left > size:
            heappush(room[left - size], k)
            mask |= 1 << (left - size)
    return placed, [smallest(f, capacities) for f in filled]


def best_fit(
    sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION
):
    """[(bin, offset)] for sizes in falling order, and the final capacity of each bin: the cheapest of several packings.

    The first opens, for each piece without room, the capacity of least cost per token it can expect
    to hold, judged by the pieces still to come and the length it would shrink to. The others open
    at least one capacity each throughout. So the total cost never exceeds that of any single opening
    size. Of equals the first stays.
    """
    falling = [-s for s in sizes]

    def cheapest(i: int) -> int:
        def per_token(capacity: int) -> tuple[float, int]:
            held = expected_fill(i, capacity, falling)
            return sequence_cost(smallest(held, capacities), overhead, attention) / held, capacity

        return min(capacities[bisect_left(capacities, sizes[i]) :], key=per_token)

    def at_least(floor: int) -> Callable[[int], int]:
        return lambda i: smallest(max(sizes[i], floor), capacities)

    packings = (fill_bins(sizes, capacities, o) for o in (cheapest, *map(at_least, capacities)))
    return min(packings, key=lambda p: sum(sequence_cost(c, overhead, attention) for c in p[1]))


def pieces(docs: DataFrame, tokens: Column, largest: int) -> DataFrame:
    """(doc_id, piece, start, n_tokens, salt): documents cut into pieces of ``largest`` tokens and a rest.

    A document without tokens is one empty piece, so that no row is lost. ``salt`` differs between
    rows of one id: by their text, and for copies by the partition that reads them.
    """
    told_apart = [c for c in ("doc_id", "text") if c in docs.columns]
    salt = F.xxhash64(*told_apart, F.spark_partition_id())
    counted = docs.select("doc_id", tokens.alias("n"), salt.alias("salt"))
    places = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)))
    cut = counted.select("doc_id", "n", "salt", F.explode(places).alias("piece"))
    start = F.col("piece") * largest
    return cut.select(
        "doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(largest)).cast("long").alias("n_tokens"), "salt"
    )


def pack(
    docs: DataFrame,
    tokens: Column | None = None,
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = OVERHEAD,
    shard_tokens: int = SHARD_TOKENS,
    attention: int = ATTENTION,
) -> DataFrame:
    """Where every piece of every document goes.

    doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_capacity, bin_tokens. Texts are read
    once; the sizes are written to the shared folder and dealt to shards of about ``shard_tokens``
    tokens, as many as the input needs. Each shard is packed on its own, so no task sees more than
    its shard. Pieces are dealt by id, text, piece and reading partition: rows that repeat an id, or
    have none, spread over the shards, and copies of a whole row are together only as far as one
    partition holds them. Only sizes are shuffled, never texts. Pieces without tokens have a null
    bin and are not dealt. Rows that repeat a doc_id are packed one by one; null doc_ids too. An
    empty table gives no rows; a very long text is cut into pieces of the largest capacity.
    """
    tokens = word_count(F.col("text")) if tokens is None else tokens
    capacities = tuple(sorted(capacities))
    cut = materialize(pieces(docs, tokens, capacities[-1]), "pieces")
    full = cut.where("n_tokens > 0")
    n, total = full.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    shards = max(1, -(-total // shard_tokens), -(-n // SHARD_PIECES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece long, start long, n_tokens long, bin_id string, bin_offset long, bin_capacity long, bin_tokens long"

    def packed(key, table):
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = table["n_tokens"].to_pylist()
        placed, ends = best_fit(sizes, capacities, overhead, attention)
        used = [0] * len(ends)
        for size, (k, _) in zip(sizes, placed):
            used[k] += size
        shard = key[0].as_py()
        added = {
            "bin_id": pa.array([f"{shard}-{k}" for k, _ in placed], pa.string()),
            "bin_offset": pa.array([at for _, at in placed], pa.int64()),
            "bin_capacity": pa.array([ends[k] for k, _ in placed], pa.int64()),
            "bin_tokens": pa.array([used[k] for k, _ in placed], pa.int64()),
        }
        kept = {c: table[c] for c in ("doc_id", "piece", "start", "n_tokens")}
        return pa.table(kept | added)

    shard = F.pmod(F.xxhash64("salt", "piece"), F.lit(shards)).alias("shard")
    dealt = full.select("doc_id", "piece", "start", "n_tokens", shard)
    without = cut.where("n_tokens = 0").select(
        "doc_id", "piece", "start", "n_tokens", F.lit(None).cast("string").alias("bin_id"),
        *[F.lit(None).cast("long").alias(c) for c in ("bin_offset", "bin_capacity", "bin_tokens")],
    )
    return dealt.groupBy("shard").applyInArrow(packed, schema).unionByName(without)

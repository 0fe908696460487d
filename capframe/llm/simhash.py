"""SimHash near-duplicates found by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate, combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capframe.llm.common import materialize, summed_products
from capframe.llm.components import components

BITS = 64
SHINGLE = 3
MAX_BITS = 3
SEED = 42
PROBE_COST = 30.0  # one shuffled row, in verified candidates


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles' XXH64; 0 without words. A bit is 1 if set in over half the hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # on bytes: A-Z only, white space of ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    spans = zip(starts, ends[shingle - 1 :]) if len(words) >= shingle else [(0, ends[-1])]
    hashes = np.array([xxh64_intdigest(line[s : e - 1], SEED) for s, e in spans], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for block in range(0, len(hashes), 65_536):
        part = hashes[block : block + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long. A null text has no words."""

    def batches(frames: Iterable):
        import pandas as pd

        for frame in frames:
            bits = np.array([fingerprint(t, shingle) for t in frame["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": bits.view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(batches, f"doc_id {kind}, fp long")


def _bit_matrix(frame) -> np.ndarray:
    raw = frame["fp"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(raw, axis=1, bitorder="little").astype(float)
    return np.hstack([bits, np.ones((len(bits), 1))])


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of like size; each starts at the bit most tied to others and takes its closest bits."""
    ties, left, groups = np.abs(correlation), set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        pool = sorted(left)
        group = [max(pool, key=lambda b: (ties[b, pool].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (ties[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = units of least total cost, by dynamic programming.

    ``costs[i][u]`` is the cost of threshold u - 1 in partition i; u = 0 leaves the partition out.
    """
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * units
    for cost in costs:
        best = [
            min(((best[s - u][0] + cost[u], [*best[s - u][1], u - 1]) for u in range(s + 1)), key=lambda x: x[0])
            for s in range(units + 1)
        ]
    return best[units]


def _within(differ: np.ndarray, most: int) -> np.ndarray:
    """P(at most t of the bits differ) for t = 0..most, bits taken as independent."""
    p = np.zeros(most + 2)
    p[0] = 1
    for q in differ:
        p[1:] = p[1:] * (1 - q) + p[:-1] * q
        p[0] *= 1 - q
    return np.cumsum(p)[: most + 1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def plan_partitions(fps: DataFrame, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, from counts over all distinct fingerprints.

    For 2 to max_bits + 1 partitions: correlated bits are grouped; a partition's candidates at
    threshold 0 are its collisions, counted exactly, and those at larger thresholds follow from the
    shares of differing bits; dynamic programming allots the thresholds. The cheapest layout wins.
    """
    sums = summed_products(fps, _bit_matrix, BITS + 1)
    n = sums[-1, -1]
    share = sums[-1, :BITS] / max(n, 1)
    spread = np.sqrt(np.clip(share * (1 - share), 1e-12, None))
    correlation = (sums[:BITS, :BITS] / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    layouts = [group_bits(correlation, m) for m in range(min(2, max_bits + 1), max_bits + 2)]
    masks = [(a, i, _signed(sum(1 << b for b in g))) for a, layout in enumerate(layouts) for i, g in enumerate(layout)]
    values = F.explode(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(m).alias("v")) for a, i, m in masks])
    )
    same = fps.select(values.alias("x")).groupBy("x").agg(F.count("*").cast("double").alias("c"))
    pairs = {
        (a, i): c for a, i, c in same.groupBy("x.a", "x.i").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).collect()
    }
    found = []
    for a, layout in enumerate(layouts):
        costs = []
        for i, group in enumerate(layout):
            within = _within(2 * share[group] * (1 - share[group]), max_bits)
            exact, cost = pairs.get((a, i), 0.0), [0.0]
            for t in range(max_bits + 1):
                candidates = min(max(exact, 1.0) * within[t] / max(within[0], 1e-300), n * n / 2)
                cost.append(candidates + PROBE_COST * n * sum(comb(len(group), s) for s in range(t + 1)))
            costs.append(cost)
        total, thresholds = allocate(costs, max_bits + 1)
        found.append((total, [(g, t) for g, t in zip(layout, thresholds) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _flipped(part: int, value: Column):
    return lambda flip: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(flip).alias("value"))


def similar_fingerprints(fps: DataFrame, plan: list[tuple[list[int], int]], max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints that differ in at most ``max_bits`` bits.

    Two such fingerprints differ in at most t_i bits of some partition i, as sum(t_i + 1) =
    max_bits + 1. Each is filed under its partition values and probes with every value in reach;
    the distance is checked inside the join, so only true links leave it.
    """
    filed, probes = [], []
    for i, (group, most) in enumerate(plan):
        value = F.col("fp").bitwiseAND(_signed(sum(1 << b for b in group)))
        flips = [
            _signed(sum(1 << b for b in chosen)) for t in range(most + 1) for chosen in combinations(group, t)
        ]
        filed.append(F.struct(F.lit(i).alias("part"), value.alias("value")))
        probes.append(F.transform(F.array(*map(F.lit, flips)), _flipped(i, value)))
    index = fps.select(F.col("fp").alias("b"), F.explode(F.array(*filed)).alias("k")).select("b", "k.part", "k.value")
    probe = fps.select(F.col("fp").alias("a"), F.explode_outer(F.concat(*probes)).alias("k")).select("a", "k.part", "k.value")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    left, right = probe.alias("p"), index.alias("x")
    same = (F.col("p.part") == F.col("x.part")) & (F.col("p.value") == F.col("x.value"))
    return left.join(right.hint("merge"), same & near).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row of ``docs``.

    Rows with one fingerprint are one class; classes are linked by distance. Repeated doc_ids give
    a row each. A null doc_id is never a component_id; a component of null ids only has none.
    An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    plan = plan_partitions(classes.select("fp"), max_bits)
    parts = components(similar_fingerprints(classes.select("fp"), plan, max_bits))
    linked = parts.withColumnRenamed("id", "fp").join(classes, "fp")
    roots = linked.groupBy("component").agg(F.min("least").alias("root"))
    named = materialize(
        linked.select("fp", "component").join(roots, "component").select("fp", "root"), "simhash-components"
    )
    ids = classes.join(named, "fp", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    return rows.join(ids.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each near-duplicate group, all columns: the one with the smallest doc_id.

    Of rows that repeat that doc_id one stays; rows with a null doc_id all stay. Whole rows are told
    apart by the ids that go or repeat, a narrow table; only rows that repeat an id are gathered.
    """
    rows = near_duplicates(docs, shingle, max_bits).where("doc_id is not null")
    ids = rows.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    odd = materialize(ids.where("not stays or n > 1").select("doc_id", "stays"), "odd-ids")
    named = docs.where("doc_id is not null")
    single = named.join(odd.select("doc_id"), "doc_id", "left_anti")
    repeated = named.join(odd.where("stays").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    nameless = docs.where("doc_id is null")
    return single.select(docs.columns).unionByName(repeated.select(docs.columns)).unionByName(nameless)

"""Exact top-k by integer inner product: no-random-access aggregation over sorted lists.

Vectors are dealt into shards of bounded size. A task sorts one list a component for its shard and
reads all lists together, in equal steps, from the end that serves the sign of a query's component.
What was read and how far the lists have come bounds every score from below and above. Reading ends
for a query when too few outsiders can still qualify; their scores are then resolved exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
SHARD = 4096  # vectors of one task's lists
QUERIES = 2048  # queries a task answers
BLOCK = 256  # queries bounded together
STEPS = 8  # reads of a list from start to end
RESOLVE = 64  # outsiders whose scores are resolved rather than bounded further


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null for a vector that is null or holds null, nan or infinity.

    Products beyond 64 bits are held at the largest or smallest long.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class Lists:
    """One descending list a component, and what has been read of them from either end.

    ``upper`` and ``lower`` bound each component of each vector: its value once read, else the value
    the list has come to, or the list's worst. The first half of the columns serves positive
    components of a query (read from the top), the second half negative ones (read from the bottom).
    """

    def __init__(self, x: np.ndarray, number: type):
        self.x = x
        self.n, self.d = x.shape
        self.order = np.argsort(-x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)
        self.depth = 0
        first, last = self.sorted[:1], self.sorted[-1:]
        self.upper = np.repeat(np.hstack([first, last]), self.n, axis=0).astype(number)
        self.lower = np.repeat(np.hstack([last, first]), self.n, axis=0).astype(number)
        self.seen = np.zeros((self.n, 2 * self.d), dtype=bool)

    def read(self, entries: int) -> None:
        """The next ``entries`` of every list, from both ends."""
        to = min(self.n, self.depth + entries)
        for half, rows, values, come in (
            (slice(0, self.d), self.order[self.depth : to], self.sorted[self.depth : to], self.sorted[to - 1]),
            (slice(self.d, None), self.order[::-1][self.depth : to], self.sorted[::-1][self.depth : to], self.sorted[self.n - to]),
        ):
            for table in (self.upper, self.lower):
                np.put_along_axis(table[:, half], rows, values.astype(table.dtype), axis=0)
            np.put_along_axis(self.seen[:, half], rows, True, axis=0)
            part = self.upper[:, half]
            np.copyto(part, come.astype(part.dtype), where=~self.seen[:, half])
        self.depth = to


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate rows, scores): the k highest of each query, ties to smaller ids, own id left out."""
    n, d = x.shape
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) * max(d, 1)
    exact = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    lists = Lists(x.astype(object) if exact is object else x, exact) if d else None
    wide = x.astype(exact)
    ask = np.hstack([np.maximum(q, 0), np.minimum(q, 0)]).astype(exact)
    open_ = np.arange(len(q))
    out = []
    step = max(1, -(-n // STEPS))
    while len(open_):
        if lists is not None and n > RESOLVE:
            lists.read(step)
        last = lists is None or lists.depth >= n or n <= RESOLVE
        left = []
        for at in range(0, len(open_), BLOCK):
            part = open_[at : at + BLOCK]
            mine = ids[None, :] == own[part][:, None]
            if last:
                keep = ~mine
            else:
                lower, upper = ask[part] @ lists.lower.T, ask[part] @ lists.upper.T
                if exact is not object:
                    lower[mine] = -np.inf
                    kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(part), -np.inf)
                else:
                    kth = np.array([sorted(row[~m], reverse=True)[k - 1] if (~m).sum() >= k else -(2**200) for row, m in zip(lower, mine)], dtype=object)
                keep = (upper >= kth[:, None]) & ~mine
            few = np.ones(len(part), dtype=bool) if last else keep.sum(axis=1) <= RESOLVE
            left.append(part[~few])
            for row, query in zip(np.flatnonzero(few), part[few]):
                rows = np.flatnonzero(keep[row])
                scores = wide[rows] @ q[query].astype(exact)
                top = np.lexsort((ids[rows], -scores))[:k]
                out.append((int(query), rows[top], scores[top]))
        open_ = np.concatenate(left)
    return out


def search(queries: DataFrame, vectors: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of every query (vec_id, embedding).

    Components count as floor(scale * x). Ties go to the smaller vec_id, ranks run from 1 and are
    unique. Rows with a null vec_id, null vectors and vectors with null or non-finite components take
    no part; vectors meet only those of their own length (an empty one scores 0). A query's own rows
    are all of its vec_id. Rows that repeat a vec_id are candidates of their own; equal query rows
    answer once, different vectors of one query id each answer. Scores beyond 64 bits are held there.
    """

    def usable(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias(name), integers(F.col("embedding"), scale).alias("x"))
        return rows.where(F.col(name).isNotNull() & F.col("x").isNotNull())

    asked = usable(queries, "query_id").distinct().withColumn("query", F.xxhash64("x"))
    table = usable(vectors, "vec_id")
    shards = max(1, -(-table.count() // SHARD))
    blocks = max(1, -(-asked.count() // QUERIES))
    # A row's place in its file is part of the hash: rows of one id spread over the shards.
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))
    right = table.withColumn("shard", spread).withColumn("block", each(blocks))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        lambda a, b: _answers(a, b, k), "query_id long, query long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _answers(asked, table, k: int):
    """The best of one shard for one block of queries."""
    import pandas as pd

    parts = []
    sizes = table["x"].map(len).to_numpy() if len(table) else np.zeros(0, int)
    for size, block in asked.groupby(asked["x"].map(len)) if len(asked) else []:
        rows = np.flatnonzero(sizes == size)
        if not len(rows):
            continue
        ids = table["vec_id"].to_numpy()[rows]
        x = np.array([*table["x"].iloc[rows]], dtype=np.int64).reshape(len(rows), size)
        q = np.array([*block["x"]], dtype=np.int64).reshape(len(block), size)
        own, key = block["query_id"].to_numpy(), block["query"].to_numpy()
        for at, top, scores in best(x, ids, q, own, k):
            score = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in scores], dtype=np.int64)
            parts.append((np.full(len(top), own[at]), np.full(len(top), key[at]), ids[top], score))
    columns = [np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(4)]
    return pd.DataFrame(dict(zip(("query_id", "query", "vec_id", "score"), columns)))

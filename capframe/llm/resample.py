"""Importance resampling towards a target: documents drawn by how much their words favour the target's.

Features are hashed into buckets and counted on both sides; a document's weight is the sum of its
features' gains, read from one array. With a random term from the id, the highest scores make an
exact draw without replacement. A quantile sketch brackets the cutoff score; exact counts outside
the bracket confirm it or widen it, and only the rows inside are sorted to find the last one drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capframe.llm.common import materialize
from capframe.llm.words import ascii_lower_words
from capframe.operators.ranking import global_row_number

BUCKETS = 10_000
RUN = 1  # most words of a feature
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
SKETCH = 2048  # size of the quantile sketch: ranks within some 0.2 percent
BRACKET = 0.005  # ranks to either side of the cutoff, at first


class Buckets(dict):
    """Bucket of a feature, remembered; emptied when it has grown large."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[feature] = value = zlib.crc32(feature) % self.buckets
        return value

    def of(self, text: str | None, run: int) -> tuple[int, np.ndarray]:
        """Words of a text, and the buckets of all runs of 1 to ``run`` words."""
        words = ascii_lower_words(text)
        features = words
        for n in range(2, run + 1):
            features = features + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        return len(words), np.fromiter(map(self.__getitem__, features), dtype=np.int64, count=len(features))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Features of all texts by bucket: tasks count their own, Spark adds up; one array reaches the driver."""

    def partial(frames: Iterable):
        import pandas as pd

        hashed, total = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for frame in frames:
            found = [hashed.of(text, run)[1] for text in frame["text"]]
            total += np.bincount(np.concatenate(found), minlength=buckets) if found else 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype("int32"), "n": total[at]})

    sums = texts.select("text").mapInPandas(partial, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed shares' ratio, by bucket."""
    n = len(corpus)
    ratio = (target + 1.0) * float(corpus.sum() + n) / ((corpus + 1.0) * float(target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def luck(doc_id: Column, seed: str = SEED) -> Column:
    """The random term of a document, from its id (a null id counts as empty text): a Gumbel draw in thousandths."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, run: int = RUN, seed: str = SEED) -> DataFrame:
    """doc_id, words, n_features, weight, score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(frames: Iterable):
        import pandas as pd

        hashed = Buckets(len(gain))
        for frame in frames:
            rows = []
            for text in frame["text"]:
                words, at = hashed.of(text, run)
                rows.append((words, len(at), int(gain[at].sum())))
            table = np.array(rows, dtype=np.int64).reshape(-1, 3)
            yield pd.DataFrame({"row": frame["row"], "words": table[:, 0], "n_features": table[:, 1], "weight": table[:, 2]})

    # The id goes through as text, so that null ids don't turn whole numbers into fractions.
    rows = docs.select(F.col("doc_id").cast("string").alias("row"), "text")
    weighed = rows.mapInPandas(weigh, "row string, words long, n_features long, weight long")
    doc_id = F.col("row").cast(kind)
    return weighed.select(doc_id.alias("doc_id"), "words", "n_features", "weight", (F.col("weight") + luck(doc_id, seed)).alias("score"))


def bracket(rows: DataFrame, wanted: int, total: int, sketch: bytes, width: float = BRACKET) -> tuple[int, int, int]:
    """(low, high, above): scores between which the ``wanted``-th highest lies, and how many lie above.

    The sketch names the ends; exact counts of the rows outside confirm them, or they move apart.
    """
    held = rows.sparkSession.createDataFrame([(bytearray(sketch),)], "s binary")
    while True:
        ranks = [min(1.0, max(0.0, 1 - wanted / total + side * width)) for side in (-1, 1)]
        low, high = held.select(*[F.kll_sketch_get_quantile_bigint("s", F.lit(r)) for r in ranks]).first()
        above, reached = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)).first()
        if above < wanted <= reached:
            return low, high, above
        width = 2 * width if width < 1 else 1.0
        if width >= 1:  # the ends of the sketch are not exact ends of the scores
            low, high = rows.agg(F.min("score"), F.max("score")).first()
            return low, high, 0


def draw(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    run: int = RUN,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text); rank is null if not drawn.

    Of the rows with at least ``least_words`` words, floor(percent / 100 of them) are drawn: the
    highest scores, ties to the smaller doc_id, null ids last. Null texts are empty and have weight 0.
    Rows that repeat a doc_id are documents of their own with the same random term; of rows equal in
    id and score either may get either rank. ``target`` (text) may be empty.
    """
    gain = gains(bucket_counts(docs, buckets, run), bucket_counts(target, buckets, run))
    table = materialize(scored(docs, gain, run, seed), "scored")
    fit = table.where(F.col("words") >= least_words)
    total, sketch = fit.agg(F.count("*"), F.kll_sketch_agg_bigint("score", F.lit(SKETCH))).first()
    wanted = percent * total // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return table.select(*columns, F.lit(None).cast("long").alias("rank"))
    low, high, above = bracket(fit, wanted, total, bytes(sketch))
    order = ["down", "gone", "id"]
    kind = docs.schema["doc_id"].dataType
    keys = [
        (-F.col("score")).alias("down"),
        F.col("doc_id").isNull().alias("gone"),
        F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"),
    ]
    inside = fit.where(F.col("score").between(low, high)).select(*keys)
    last = global_row_number(inside, *order).where(F.col("rn") == wanted - above).first()
    kinds = ["long", "boolean", kind]
    cut = F.struct(*[F.lit(last[name]).cast(k).alias(name) for name, k in zip(order, kinds)])
    drawn = (F.col("words") >= least_words) & (F.struct(*keys) <= cut)
    numbered = global_row_number(table.where(drawn).select(*columns, *keys), *order)
    rank = F.when(F.col("rn") <= wanted, F.col("rn"))  # rows equal to the last one may follow it
    rest = table.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return numbered.select(*columns, rank.cast("long").alias("rank")).unionByName(rest)

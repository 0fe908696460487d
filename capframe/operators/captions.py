"""Caption presence, reports and exploration of the training split."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from capframe.functions.text import is_missing

SKETCH = 800  # size parameter of a sketch of lengths
SKETCH_ERROR = 0.01  # of its ranks, twice what that size promises at 99 percent


def split_by_caption(df: DataFrame, caption: str = "caption") -> tuple[DataFrame, DataFrame]:
    """Rows without a caption (empty string) and all others."""
    missing = is_missing(F.col(caption))
    return df.where(missing), df.where(~missing)


def drop_incomplete(df: DataFrame, path: str = "image_path", caption: str = "caption") -> DataFrame:
    """Rows that have both a path and a caption."""
    return df.dropna(subset=[path, caption])


def _report(caption: str, broken: Column | None) -> list[Column]:
    c = F.col(caption)
    broken = F.lit(False) if broken is None else broken
    kept = ~broken
    return [
        F.count("*").alias("rows"),
        F.count_if(broken).alias("broken"),
        F.count_if(kept).alias("kept"),
        F.count_if(kept & is_missing(c)).alias("without_caption"),
        F.count_if(kept & ~is_missing(c)).alias("with_caption"),
        F.count_if(kept & c.isNull()).alias("null_caption"),
    ]


def caption_report(df: DataFrame, caption: str = "caption", broken: Column | None = None) -> DataFrame:
    """All row counts of the preparation in one pass; ``broken`` marks rows without a readable image."""
    return df.agg(*_report(caption, broken))


def with_report(df: DataFrame, caption: str = "caption", broken: Column | None = None) -> tuple[DataFrame, Observation]:
    """``df``, and the counts of ``caption_report`` that its first complete pass, such as a write, brings along."""
    counts = Observation()
    return df.observe(counts, *_report(caption, broken)), counts


def taken(counts: Observation, df: DataFrame) -> dict[str, int]:
    """The counts of ``with_report`` on ``df`` after that pass; counted now if the plan left the rows out unread."""
    try:
        return counts.get
    except Py4JJavaError:  # no rows can come, so Spark dropped what would have counted them
        return caption_report(df).first().asDict()


def length_sketches(df: DataFrame, by: Sequence[str], tokens: str = "tokens", size: int = SKETCH) -> DataFrame:
    """``by..., sketch`` of caption lengths in tokens: small, and mergeable over any of the groups."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.size(tokens).cast("long"), F.lit(size)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of fewer groups, from those of more."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Rows ``share, length, n`` of every sketch: a length whose rank is within ``SKETCH_ERROR`` of ``share`` of n."""
    asked = F.array(*[F.lit(float(s)) for s in shares])
    found = F.kll_sketch_get_quantile_bigint("sketch", asked)
    pair = F.explode(F.arrays_zip(asked.alias("share"), found.alias("length"))).alias("q")
    by = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*by, F.kll_sketch_get_n_bigint("sketch").alias("n"), pair).select(*by, "q.share", "q.length", "n")


def class_balance(df: DataFrame, label: str = "label", tokens: str = "tokens", caption: str = "caption") -> DataFrame:
    """Rows, missing captions and mean caption length per class."""
    missing = is_missing(F.col(caption)) | F.col(caption).isNull()
    return df.groupBy(label).agg(
        F.count("*").alias("rows"),
        F.avg(missing.cast("double")).alias("missing_rate"),
        F.avg(F.size(tokens).cast("double")).alias("mean_tokens"),
        F.max(F.size(tokens)).alias("max_tokens"),
    )


def length_histogram(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Number of captions per token count."""
    return df.groupBy(F.size(tokens).alias("n_tokens")).agg(F.count("*").alias("rows"))


def top_words(df: DataFrame, k: int, label: str = "label", tokens: str = "tokens") -> DataFrame:
    """The ``k`` most frequent words of each class, in alphabetical order on ties.

    Words are counted before the window, and the rank limit is applied per task before its
    shuffle, so a class with most of the words sends ``k`` rows per task.
    """
    words = df.select(label, F.explode_outer(tokens).alias("word")).where(F.col("word").isNotNull())
    counts = words.groupBy(label, "word").agg(F.count("*").alias("freq"))
    order = W.partitionBy(label).orderBy(F.desc("freq"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

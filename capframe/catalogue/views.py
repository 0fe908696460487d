"""The given tables read as photos, predictions, model output and training logs.

Where missing captions are the matter (``captions``), one source delivers none (null) and three
deliver empty ones; everything else reads whole texts (``texts``). Very short texts carry no label. Predictions come from rules on the
whole text, so they are right and wrong as the text has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capframe.functions.text import image_path

FOLDER = "images/"
NULL_SOURCE = "src3"
EMPTY_SOURCES = ["src1", "src7", "src12"]
LABELLED_FROM = 40
LANGS = ["de", "en", "es", "fr", "it"]

# Function words per language, in the order they are tried.
WORDS = {"en": "the|and", "de": "der|und", "fr": "le|et", "es": "el|y"}


#: Names of photo files, by id; ``#id`` stands for the id.
FILE_NAMES = ["#id", "p #id", "a[#id]", "#id%20", "é#id", "#id+x", "q?*#id", "{#id}&"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    caption = (
        F.when(F.col("source") == NULL_SOURCE, F.lit(None).cast("string"))
        .when(F.col("source").isin(*EMPTY_SOURCES), F.lit(""))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("photo_id"),
        F.col("doc_id").alias("ord"),
        caption.alias("caption"),
        F.when(F.col("n_chars") >= LABELLED_FROM, F.col("lang")).alias("label"),
        "source",
        image_path(F.col("doc_id"), FOLDER).alias("image_path"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that all have a caption, the whole text: for what reads captions, not their absence."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("photo_id"),
        F.col("doc_id").alias("ord"),
        F.col("text").alias("caption"),
        F.when(F.col("n_chars") >= LABELLED_FROM, F.col("lang")).alias("label"),
        "source",
        image_path(F.col("doc_id"), FOLDER).alias("image_path"),
    )


def _hits(text: Column) -> Column:
    """The function words that occur in the text, found in one scan."""
    words = "|".join(WORDS.values())
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z])(?:{words})(?![a-z])"), F.lit(0)))


def guess(hits: Column, langs: list[str], otherwise: str) -> Column:
    """Language whose function words occur, first of the list."""
    found = F.when(F.lit(False), F.lit(otherwise))
    for lang in langs:
        words = F.array(*[F.lit(w) for w in WORDS[lang].split("|")])
        found = found.when(F.arrays_overlap(hits, words), F.lit(lang))
    return found.otherwise(F.lit(otherwise))


VARIANTS = {
    "all_words": (["en", "de", "fr", "es"], "unknown"),
    "reversed": (["es", "fr", "de", "en"], "unknown"),
    "english_first": (["en"], "fr"),
}


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("photo_id"),
        F.when(F.col("n_chars") >= LABELLED_FROM, F.col("lang")).alias("label"),
        _hits(F.col("text")).alias("hits"),
    )


def predictions(spark: SparkSession, sf_dir: str, variant: str = "all_words") -> DataFrame:
    return _judged(spark, sf_dir).select("photo_id", "label", guess(F.col("hits"), *VARIANTS[variant]).alias("pred"))


def all_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row once per configuration, in one scan."""
    answers = F.array(
        *[F.struct(F.lit(v).alias("config"), guess(F.col("hits"), *VARIANTS[v]).alias("pred")) for v in VARIANTS]
    )
    return _judged(spark, sf_dir).select("photo_id", "label", F.explode(answers).alias("a")).select("photo_id", "label", "a.*")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("photo_id"), F.col("embedding").cast("array<double>").alias("vector"), "label"
    )


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training batches: a run per user, an epoch per day."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.dayofmonth("ts").alias("epoch"),
        (F.col("value") / 100).alias("pred_loss"),
        (F.regexp_extract("props", "[0-9]+", 0).cast("double") / 100).alias("contrastive_loss"),
    )


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score per run and epoch: the mean event value as a share of 500."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("run"), F.dayofmonth("ts").alias("epoch")).agg(
        F.round(F.avg("value") / 500, 12).alias("score")
    )


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 colour images: blue is the value, green its complement, red its triple."""
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    level = lambda x: F.floor((x + 1) * 127.5).cast("long")
    pixel = lambda v: F.concat(byte(v), byte(255 - v), byte(3 * v % 256))
    return embeddings(spark, sf_dir).select(
        "photo_id",
        F.unhex(F.array_join(F.transform(F.transform("vector", level), pixel), "")).alias("data"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(3).alias("n_channels"),
    )


# The same views in SQL.
CAPTIONS_SQL = f"""captions AS (
  SELECT doc_id AS photo_id, doc_id AS ord,
         CASE WHEN source = '{NULL_SOURCE}' THEN NULL
              WHEN source IN ('src1', 'src7', 'src12') THEN '' ELSE text END AS caption,
         CASE WHEN n_chars >= {LABELLED_FROM} THEN lang END AS label, source,
         '{FOLDER}' || doc_id || '.jpg' AS image_path
  FROM documents)"""


TEXTS_SQL = f"""texts AS (
  SELECT doc_id AS photo_id, doc_id AS ord, text AS caption,
         CASE WHEN n_chars >= {LABELLED_FROM} THEN lang END AS label, source,
         '{FOLDER}' || doc_id || '.jpg' AS image_path
  FROM documents)"""


def guess_sql(langs: list[str], otherwise: str, text: str = "text") -> str:
    cases = " ".join(
        f"WHEN regexp_matches(lower({text}), '(^|[^a-z])({WORDS[lang]})([^a-z]|$)') THEN '{lang}'" for lang in langs
    )
    return f"CASE {cases} ELSE '{otherwise}' END"


def predictions_sql(variant: str = "all_words") -> str:
    return f"""predictions AS (
  SELECT doc_id AS photo_id, CASE WHEN n_chars >= {LABELLED_FROM} THEN lang END AS label,
         {guess_sql(*VARIANTS[variant])} AS pred FROM documents)"""


def all_predictions_sql() -> str:
    selects = " UNION ALL ".join(
        f"""SELECT doc_id AS photo_id, CASE WHEN n_chars >= {LABELLED_FROM} THEN lang END AS label,
         '{v}' AS config, {guess_sql(*VARIANTS[v])} AS pred FROM documents"""
        for v in VARIANTS
    )
    return f"predictions AS ({selects})"


EMBEDDINGS_SQL = """vectors AS (
  SELECT vec_id AS photo_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector, label FROM embeddings)"""

BATCH_LOG_SQL = """batch_log AS (
  SELECT user_id AS run, CAST(dayofmonth(ts) AS INTEGER) AS epoch, value / 100 AS pred_loss,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 100 AS contrastive_loss FROM events)"""

EPOCH_LOG_SQL = """epoch_log AS (
  SELECT user_id AS run, CAST(dayofmonth(ts) AS INTEGER) AS epoch, round(avg(value) / 500, 12) AS score
  FROM events GROUP BY 1, 2)"""

PICTURES_SQL = """pictures AS (
  SELECT photo_id, CAST(channel AS INTEGER) AS channel,
         list_transform(level, lambda v: CASE channel WHEN 0 THEN 3 * v % 256 WHEN 1 THEN 255 - v ELSE v END) AS px
  FROM (SELECT vec_id AS photo_id, unnest([0, 1, 2]) AS channel,
               list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT)) AS level
        FROM embeddings))"""

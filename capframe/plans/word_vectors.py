"""Token vectors learned from the captions themselves, as the table that lookups read."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capframe.fixed_values import EMB_DIM, PAD_ID, SEED
from capframe.operators.embeddings import lookup_vectors, mean_by_group
from capframe.operators.vocabulary import Vocabulary
from capframe.session import materialize

MOST_BYTES = 1 << 30  # of vectors, which training holds on the driver and sends to every task
ROWS = 200_000  # captions one training partition should hold


def learn_token_vectors(
    coded: DataFrame,
    ids: str,
    vocab: Vocabulary,
    dim: int = EMB_DIM,
    window: int = 5,
    rounds: int = 3,
    partitions: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``id, vector`` of every id of the vocabulary, by skip-gram over the id lists of ``coded``.

    Words not kept share the id of unknown words, so they are learned together. Padding is no word:
    it is left out of the training and has the zero vector, as has an id that occurs nowhere. The
    vocabulary bounds what reaches the driver, and a vocabulary of more than ``MOST_BYTES`` fails.
    """
    if 8 * dim * vocab.size > MOST_BYTES:
        raise ValueError(f"{vocab.size} words of {dim} values are more than {MOST_BYTES} bytes: raise min_freq")
    words = F.transform(F.filter(ids, lambda x: x != PAD_ID), lambda x: x.cast("string"))
    rows = coded.select(words.alias("words")).where(F.size("words") > 0)
    table = coded.sparkSession.range(vocab.size)
    zero = F.array_repeat(F.lit(0.0), dim)
    count = rows.count()
    if not count:
        return table.select("id", zero.alias("vector"))
    model = Word2Vec(
        vectorSize=dim, minCount=0, windowSize=window, maxIter=rounds, seed=seed, inputCol="words", outputCol="mean",
        numPartitions=partitions or -(-count // ROWS),
    ).fit(rows)
    learned = model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("vector"))
    return materialize(
        table.join(learned, "id", "left").select("id", F.coalesce("vector", zero).alias("vector")), "token-vectors"
    )


def text_vectors(coded: DataFrame, key: str, ids: str, vectors: DataFrame, dim: int = EMB_DIM) -> DataFrame:
    """``key, text_vector``: the mean of the vectors of all places of a row, padding included."""
    places = coded.select(key, F.col(ids).cast("array<bigint>").alias("ids"))
    found = lookup_vectors(places, key, "ids", vectors)
    return mean_by_group(found, key, "vector", dim).select(key, F.col("mean").alias("text_vector"))

"""From raw photo records to the encoded, labelled table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capframe.fixed_values import MAX_LEN, MIN_FREQ, SEED
from capframe.functions.text import tokenize
from capframe.operators.captions import taken, with_report
from capframe.operators.labels import label_ids, with_label_id
from capframe.operators.ranking import split_column
from capframe.operators.vocabulary import Vocabulary, build_vocabulary, encode
from capframe.session import materialize, read_from_files
from capframe.sources.images import keep_valid


@dataclass(frozen=True)
class Prepared:
    table: DataFrame
    labels: DataFrame
    vocabulary: Vocabulary
    counts: dict[str, int]


def prepare(
    photos: DataFrame,
    valid: DataFrame | None = None,
    ord: str = "ord",
    max_len: int = MAX_LEN,
    min_freq: int = MIN_FREQ,
    vocab_scope: str = "all",
    seed: int = SEED,
) -> Prepared:
    """Photos with ``tokens``, ``label_id``, ``token_ids`` and ``split``.

    Broken images (not in ``valid``) go first, so they count neither for labels nor for words.
    Completed data comes without ``valid``. The rows kept are stored unless they come straight from
    files, so images are checked and joins of the caller made once, and ``counts`` are taken along
    (empty where nothing is stored). The vocabulary is built on all rows, or with
    ``vocab_scope="train"`` on the training split only.
    """
    if vocab_scope not in ("all", "train"):
        raise ValueError(f"unknown vocab_scope {vocab_scope}")
    kept, counts = _stored(photos, valid)
    split = split_column(kept, ["photo_id"], seed)
    rows = kept.withColumn("tokens", tokenize(F.col("caption"), max_len)).withColumn("split", split)
    scope = rows if vocab_scope == "all" else rows.where(F.col("split") == "train")
    vocabulary = build_vocabulary(scope, "tokens", ord, min_freq)
    labels = label_ids(kept)
    encoded = encode(with_label_id(rows, labels), "tokens", vocabulary, "photo_id", max_len)
    return Prepared(encoded, labels, vocabulary, counts)


def _stored(photos: DataFrame, valid: DataFrame | None) -> tuple[DataFrame, dict[str, int]]:
    """The rows to prepare, and their counts if they had to be written."""
    if valid is None and read_from_files(photos):
        return photos, {}
    if valid is None:
        kept, counts = with_report(photos)
        stored = materialize(kept, "kept")
        return stored, taken(counts, stored)
    every, before = with_report(photos)
    kept, after = with_report(keep_valid(every, valid))
    stored = materialize(kept, "valid")
    rows, counts = taken(before, photos)["rows"], taken(after, stored)
    return stored, {**counts, "rows": rows, "broken": rows - counts["rows"]}

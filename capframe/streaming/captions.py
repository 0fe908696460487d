"""Caption encoding on a stream with a finished vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capframe.fixed_values import MAX_LEN
from capframe.functions.text import tokenize
from capframe.operators.vocabulary import Vocabulary, encode_by_place, fits_by_place


def encode_captions(
    stream: DataFrame, vocab: Vocabulary, caption: str = "caption", max_len: int = MAX_LEN, out: str = "token_ids"
) -> DataFrame:
    """Stream with ``tokens`` and their ids; keeps no state, since no row depends on another."""
    if not fits_by_place(vocab, max_len):
        raise ValueError("vocabulary or sequence too long for stateless encoding")
    rows = stream.withColumn("tokens", tokenize(F.col(caption), max_len))
    return encode_by_place(rows, "tokens", vocab.table, max_len, out)


def write_encoded(
    stream: DataFrame, vocab: Vocabulary, out: str, checkpoint: str, caption: str = "caption", max_len: int = MAX_LEN
) -> None:
    """Encode all that has come to a stream so far into Parquet files, then end.

    ``checkpoint`` keeps what was read: started again, also after a failure, it goes on with what is
    new, and the file sink's own log keeps every row once.
    """
    coded = encode_captions(stream, vocab, caption, max_len)
    writer = coded.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()

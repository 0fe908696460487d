"""Word frequencies, vocabulary and caption encoding."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capframe.fixed_values import MAX_LEN, MIN_FREQ, PAD_ID, UNK_ID
from capframe.functions.sequences import pad_right
from capframe.operators.lookup import BROADCAST_ROWS, HOT_KEYS, lookup, share
from capframe.operators.ranking import global_row_number
from capframe.session import materialize

_JOINS = 16  # longest sequence encoded by one broadcast join per place


def word_counts(df: DataFrame, tokens: str, ord: str) -> DataFrame:
    """``word, freq, first``: how often a word occurs, and its first place (row, then position in its list)."""
    # The outer form: the inner one filters on the size of the list first, which would tokenize twice.
    words = df.select(F.col(ord).cast("long").alias("_ord"), F.posexplode_outer(tokens).alias("_pos", "word"))
    place = F.struct("_ord", "_pos")
    return (
        words.where(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.count("*").alias("freq"), F.min(place).alias("first"))
    )


@dataclass(frozen=True)
class Vocabulary:
    """``word, freq, id`` of the kept words, the number of ids (reserved ones included), the sum of ``freq``."""

    table: DataFrame
    size: int
    occurrences: int


def build_vocabulary(
    df: DataFrame, tokens: str, ord: str, min_freq: int = MIN_FREQ
) -> Vocabulary:
    """Words that occur often enough, numbered from 2 by first appearance in the order of ``ord``."""
    kept = word_counts(df, tokens, ord).where(F.col("freq") >= min_freq)
    numbered = global_row_number(kept, "first")
    table = materialize(numbered.select("word", "freq", (F.col("rn") + UNK_ID).cast("int").alias("id")), "vocabulary")
    words, occurrences = table.agg(F.count("*"), F.coalesce(F.sum("freq"), F.lit(0))).first()
    return Vocabulary(table, words + 2, occurrences)


def fits_by_place(vocab: Vocabulary, max_len: int, broadcast_rows: int = BROADCAST_ROWS) -> bool:
    """Whether the vocabulary may be broadcast and the sequence is short enough for a join per place."""
    return vocab.size - 2 <= broadcast_rows and max_len <= _JOINS


def encode_by_place(
    df: DataFrame, tokens: str, table: DataFrame, max_len: int, out: str, unknown: int | None = UNK_ID
) -> DataFrame:
    """One broadcast join per place, all on the same broadcast: rows are neither exploded nor shuffled."""
    columns, wide = df.columns, df
    ids = []
    for i in range(max_len):
        words = table.select(F.col("word").alias(f"_w{i}"), F.col("id").alias(f"_i{i}"))
        wide = wide.join(F.broadcast(words), F.get(tokens, F.lit(i)) == F.col(f"_w{i}"), "left")
        here = F.size(F.coalesce(tokens, F.array().cast("array<string>"))) > i
        ids.append(F.when(here, F.coalesce(f"_i{i}", F.lit(unknown).cast("int"))).otherwise(F.lit(PAD_ID)))
    return wide.select(*columns, F.array(*ids).alias(out))


def _encode_head_and_tail(
    df: DataFrame, tokens: str, vocab: Vocabulary, key: str, max_len: int, out: str, broadcast_rows: int
) -> DataFrame:
    """The frequent words by place; only the tokens left over meet the rest of the vocabulary in a shuffle.

    Words with at least one in ``broadcast_rows`` of all kept occurrences are frequent: there are
    at most ``broadcast_rows`` of them, and they are most of any text. No other word is hot in the
    rows the vocabulary was counted on; in other rows one may be, so hot words are counted there and
    answered apart.
    """
    frequent = F.col("freq") >= share(vocab.occurrences, broadcast_rows)
    probed = encode_by_place(df, tokens, vocab.table.where(frequent), max_len, "_ids", unknown=None)
    left_over = F.exists("_ids", lambda x: x.isNull())
    partial = probed.where(left_over)
    placed = F.transform(tokens, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    open_places = F.filter(placed, lambda p: F.get("_ids", p["pos"]).isNull())
    missing = partial.select(key, F.explode_outer(open_places).alias("p")).select(key, "p.*")
    missing = materialize(missing, "left_over")
    found = lookup(missing, vocab.table.where(~frequent).select("word", "id"), "word", [key, "pos"], broadcast_rows)
    entry = F.struct("pos", F.coalesce("id", F.lit(UNK_ID)))
    fills = found.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("_fill"))
    filled = F.transform("_ids", lambda x, i: F.coalesce(x, F.try_element_at("_fill", i)))
    done = probed.where(~left_over).select(*df.columns, F.col("_ids").alias(out))
    return done.unionByName(partial.join(fills, key).select(*df.columns, filled.alias(out)))


def _encode_by_word(
    df: DataFrame, tokens: str, vocab: Vocabulary, key: str, max_len: int, out: str, broadcast_rows: int
) -> DataFrame:
    """One row per token, looked up and gathered again per ``key``."""
    words = df.select(key, F.posexplode_outer(tokens).alias("_pos", "word"))
    table = vocab.table.select("word", "id")
    # Words with at least one in HOT_KEYS of the kept occurrences: HOT_KEYS of them at most.
    hot = vocab.table.where(F.col("freq") >= share(vocab.occurrences, HOT_KEYS)).select("word")
    found = lookup(words, table, "word", [key, "_pos"], broadcast_rows, hot)
    pair = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("id", F.lit(UNK_ID)).alias("id")))
    ids = found.groupBy(key).agg(F.sort_array(F.collect_list(pair)).alias("_pairs"))
    padded = pad_right(F.transform("_pairs", lambda p: p["id"]), max_len)
    return df.join(ids.select(key, padded.alias(out)), key)


def _ids_in_place(vocab: Vocabulary, tokens: str) -> Column:
    """The list of ids of a list of tokens: the vocabulary is broadcast to the Python workers, a batch looked up at once."""
    table = vocab.table.select("word", "id").toArrow()
    known = vocab.table.sparkSession.sparkContext.broadcast(
        (table["word"].combine_chunks(), table["id"].combine_chunks())
    )

    @F.arrow_udf("array<int>")
    def ids(lists: pa.Array) -> pa.Array:
        words, numbers = known.value
        flat = lists.flatten()
        places = pc.index_in(flat, value_set=words.cast(flat.type))
        starts = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.list_value_length(lists))])
        return pa.ListArray.from_arrays(starts, pc.fill_null(numbers.take(places), UNK_ID))

    return ids(F.coalesce(tokens, F.array().cast("array<string>")))


def _encode_lists(
    df: DataFrame, tokens: str, vocab: Vocabulary, key: str, max_len: int, out: str, broadcast_rows: int
) -> DataFrame:
    """Lists of any length encoded in their rows while the vocabulary may be broadcast, else by word.

    Rows that share a key, found from the keys alone, go by word, which takes them as one list; rows
    without a key are left out there and here.
    """
    if vocab.size - 2 > broadcast_rows:
        return _encode_by_word(df, tokens, vocab, key, max_len, out, broadcast_rows)
    keyed = df.where(F.col(key).isNotNull())
    repeated = keyed.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    repeated = materialize(repeated, "repeated")
    shared = not repeated.isEmpty()
    alone = keyed.join(repeated, key, "left_anti") if shared else keyed
    others = [c for c in df.columns if c != key]
    encoded = alone.select(key, *others, pad_right(_ids_in_place(vocab, tokens), max_len).alias(out))
    if not shared:
        return encoded
    return encoded.unionByName(
        _encode_by_word(keyed.join(repeated, key, "left_semi"), tokens, vocab, key, max_len, out, broadcast_rows)
    )


def encode_whole(
    df: DataFrame, tokens: str, vocab: Vocabulary, key: str, out: str = "ids", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Ids of all tokens of a list, however long, without padding; ``key`` must be unique."""
    return _encode_lists(df, tokens, vocab, key, 0, out, broadcast_rows)


def encode(
    df: DataFrame,
    tokens: str,
    vocab: Vocabulary,
    key: str,
    max_len: int = MAX_LEN,
    out: str = "token_ids",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Ids of the tokens, 1 for words not kept, padded with 0 to ``max_len``; ``key`` must be unique.

    The vocabulary is broadcast while it has at most ``broadcast_rows`` words; of a larger one, the
    most frequent words are.
    """
    if vocab is None:
        raise ValueError("a vocabulary is needed")
    if fits_by_place(vocab, max_len, broadcast_rows):
        return encode_by_place(df, tokens, vocab.table, max_len, out)
    if max_len <= _JOINS:
        return _encode_head_and_tail(df, tokens, vocab, key, max_len, out, broadcast_rows)
    return _encode_lists(df, tokens, vocab, key, max_len, out, broadcast_rows)

"""One query per operator of the library, each over its whole tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capframe.catalogue import views as D
from capframe.fixed_values import EMB_DIM, MAX_LEN, MODALITY_WEIGHTS, SEED
from capframe.functions import prompts as P
from capframe.functions import sequences as S
from capframe.functions import text as T
from capframe.functions import vectors as V
from capframe.functions.draws import gaussian, whole
from capframe.operators import captions as C
from capframe.operators import compare, embeddings, images, labels, metrics, ranking, trainlog, vocabulary
from capframe.plans import baselines, examples, inference, network, word_vectors
from capframe.plans.prepare import prepare
from capframe.session import materialize, scratch_dir, ship_package
from capframe.sources import images as image_files
from capframe.sources import photo_files, photos, reports
from capframe.streaming import captions as captions_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _six(c: Column) -> Column:
    return F.round(c, 6)


def _joined(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def _md5(ids: str) -> Column:
    """Digest of a long id list, under its name."""
    return F.md5(_joined(ids)).alias(ids)


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.texts(spark, sf_dir).withColumn("tokens", T.tokenize(F.col("caption")))


def _vocabulary(spark: SparkSession, sf_dir: str) -> vocabulary.Vocabulary:
    return vocabulary.build_vocabulary(_tokens(spark, sf_dir), "tokens", "ord")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir)
    return vocabulary.encode(rows, "tokens", vocabulary.build_vocabulary(rows, "tokens", "ord"), "photo_id")


# Captions: presence, paths, tokens.


@query
def caption_presence(spark, sf_dir):
    return C.caption_report(D.captions(spark, sf_dir))


@query
def observed_presence(spark, sf_dir):
    """The counts of ``caption_presence``, taken along by the write of the captions."""
    rows, counts = C.with_report(D.captions(spark, sf_dir))
    materialize(rows.drop("source"), "photos")
    return spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in counts.get.items()])


@query
def caption_halves(spark, sf_dir):
    without, given = C.split_by_caption(D.captions(spark, sf_dir))
    half = lambda df, name: df.select("photo_id", F.lit(name).alias("half"), F.length("caption").alias("chars"))
    return half(without, "without").unionByName(half(given, "with"))


@query
def complete_rows(spark, sf_dir):
    return C.drop_incomplete(D.captions(spark, sf_dir)).select("photo_id", "image_path")


@query
def image_paths(spark, sf_dir):
    return D.captions(spark, sf_dir).select("photo_id", T.image_path(F.col("photo_id"), "raw/", ".png").alias("path"))


@query
def tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("photo_id", F.array_join("tokens", " ").alias("tokens"))


@query
def all_tokens(spark, sf_dir):
    whole_text = T.tokenize(F.col("text"), max_len=None)
    rows = D.table(spark, sf_dir, "documents").select("doc_id", whole_text.alias("t"))
    return rows.select(
        F.col("doc_id").alias("photo_id"),
        F.size("t").alias("n_tokens"),
        F.md5(F.array_join("t", " ")).alias("tokens_md5"),
    )


@query
def word_freq(spark, sf_dir):
    return vocabulary.word_counts(_tokens(spark, sf_dir), "tokens", "ord").select("word", "freq")


@query
def vocab(spark, sf_dir):
    return _vocabulary(spark, sf_dir).table


@query
def vocab_size(spark, sf_dir):
    return _vocabulary(spark, sf_dir).table.agg((F.count("*") + 2).alias("vocab_size"))


@query
def encoded_captions(spark, sf_dir):
    return _encoded(spark, sf_dir).select("photo_id", _joined("token_ids").alias("ids"))


@query
def encoded_captions_large_vocabulary(spark, sf_dir):
    """The form for vocabularies too large to broadcast, here above 100 words."""
    rows = _tokens(spark, sf_dir)
    words = vocabulary.build_vocabulary(rows, "tokens", "ord")
    coded = vocabulary.encode(rows, "tokens", words, "photo_id", broadcast_rows=100)
    return coded.select("photo_id", _joined("token_ids").alias("ids"))


# Labels.


@query
def label_ids(spark, sf_dir):
    return labels.label_ids(D.captions(spark, sf_dir))


@query
def label_encoded(spark, sf_dir):
    rows = D.captions(spark, sf_dir)
    return labels.with_label_id(rows, labels.label_ids(rows)).select("photo_id", "label_id")


@query
def label_names(spark, sf_dir):
    rows = D.captions(spark, sf_dir)
    table = labels.label_ids(rows)
    coded = labels.with_label_id(rows, table).select("photo_id", "label_id")
    return labels.with_label_name(coded, table, "label_id", "name").select("photo_id", "name")


# Order, split, batches.


@query
def split_exact(spark, sf_dir):
    return ranking.with_split(D.captions(spark, sf_dir), ["photo_id"]).select("photo_id", "split")


@query
def split_counts_by_label(spark, sf_dir):
    rows = ranking.with_split(D.captions(spark, sf_dir), ["photo_id"])
    return rows.groupBy("split", "label").agg(F.count("*").alias("rows"))


@query
def shuffled_order(spark, sf_dir):
    rows = D.captions(spark, sf_dir).select("photo_id")
    return ranking.seeded_row_number(rows, ["photo_id"]).select("photo_id", "rn")


@query
def row_numbers(spark, sf_dir):
    _, given = C.split_by_caption(D.captions(spark, sf_dir))
    return ranking.global_row_number(given.select("source", "photo_id"), "source", "photo_id")


@query
def batches(spark, sf_dir):
    rows = D.captions(spark, sf_dir).select("photo_id", "ord")
    return ranking.with_batches(rows, "ord").select("photo_id", "batch_id", "batch_pos")


@query
def epoch_batches(spark, sf_dir):
    rows = ranking.with_split(D.captions(spark, sf_dir), ["photo_id"]).where("split = 'train'").select("photo_id")
    return ranking.epoch_batches(rows, ["photo_id"], epoch=3).select("photo_id", "batch_id", "batch_pos")


@query
def prepared_photos(spark, sf_dir):
    """Raw photos to the encoded table; photos judged toxic stand for broken images."""
    judged = D.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("photo_id"), "toxic")
    kept = image_files.drop_broken(D.texts(spark, sf_dir), judged.where("toxic = 1"))
    table = prepare(kept).table
    return table.select("photo_id", "image_path", "label_id", "split", _joined("token_ids").alias("ids"))


@query
def keep_valid(spark, sf_dir):
    valid = D.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("photo_id"))
    return image_files.keep_valid(D.captions(spark, sf_dir), valid).select("photo_id", "image_path")


@query
def drop_broken(spark, sf_dir):
    broken = D.table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("photo_id"))
    return image_files.drop_broken(D.captions(spark, sf_dir), broken).select("photo_id", "image_path")


# Sources and sinks.


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def csv_round_trip(spark, sf_dir):
    path = _new_path(spark, "completed")
    rows = D.captions(spark, sf_dir).select("photo_id", "caption", "label", "image_path")
    photos.write_table(rows, path, "csv")
    return photos.read_completed(spark, path).withColumn("photo_id", F.col("photo_id").cast("long"))


@query
def json_round_trip(spark, sf_dir):
    path = _new_path(spark, "photos")
    rows = D.captions(spark, sf_dir).select("photo_id", "caption", "label", "source")
    photos.write_table(rows, path, "json")
    back = photos.read_photos(spark, path, extra="source string", lines=True)
    return back.withColumn("photo_id", F.col("photo_id").cast("long"))


@query
def source_order(spark, sf_dir):
    """Positions given at ingest; files hold the photos in order of their id."""
    path = _new_path(spark, "ordered")
    rows = D.captions(spark, sf_dir).select("photo_id", "caption", "label")
    photos.write_table(rows.orderBy("photo_id"), path, "json")
    back = photos.with_source_order(photos.read_photos(spark, path, lines=True))
    return back.select(F.col("photo_id").cast("long").alias("photo_id"), "ord")


# Photo files.


def _photo_files(spark, sf_dir):
    """Pictures as files with awkward names: whole, cut, without bytes, or not there at all."""
    of_eight = F.element_at(F.array(*[F.lit(n) for n in D.FILE_NAMES]), (F.col("photo_id") % 8 + 1).cast("int"))
    state = F.expr("photo_id div 8 % 5")
    rows = images.with_png(D.pictures(spark, sf_dir)).withColumn("state", state)
    content = (
        F.when(F.col("state") == 1, F.expr("substring(content, 1, length(content) div 2)"))
        .when(F.col("state") == 2, F.lit("").cast("binary"))
        .otherwise(F.col("content"))
    )
    stem = F.replace(of_eight, F.lit("#id"), F.col("photo_id").cast("string"))
    return rows.select(F.col("photo_id").alias("id"), stem.alias("photo_id"), "state", content.alias("content"))


def _written_photos(spark, sf_dir):
    """The photos, and the folder their files were written to."""
    folder = _new_path(spark, "photos")
    rows = materialize(_photo_files(spark, sf_dir), "contents")
    there = rows.where("state <> 3").select(F.concat("photo_id", F.lit(".png")).alias("name"), "content")
    photo_files.write_photos(there.repartition(4), folder)
    return rows.drop("content"), folder


@query
def photo_files_read(spark, sf_dir):
    """Photos written as files and read back: which exist, which can be read, and the sum of their pixels."""
    rows, folder = _written_photos(spark, sf_dir)
    files = photo_files.list_photos(spark, folder).select("photo_id", (F.col("length") > 0).alias("filled"))
    pixels = F.transform(F.split(F.regexp_replace(F.hex("data"), "(..)", "$1 "), " "), lambda h: F.conv(h, 16, 10).cast("long"))
    total = F.aggregate(F.filter(pixels, lambda p: p.isNotNull()), F.lit(0).cast("long"), lambda a, p: a + p)
    read = image_files.read_images(spark, folder, recursiveFileLookup=True)
    read = read.select("photo_id", "height", "width", total.alias("total"))
    both = rows.join(files, "photo_id", "left").join(read, "photo_id", "left")
    return both.select("id", "photo_id", F.col("filled").isNotNull().alias("there"), "filled", "height", "width", "total")


@query
def photo_files_kept(spark, sf_dir):
    """Photos whose file exists, by dropping the others and by failing on any other; and whose file can be read."""
    rows, folder = _written_photos(spark, sf_dir)
    files = photo_files.list_photos(spark, folder)
    existing = image_files.keep_existing(rows, files)
    strict = image_files.keep_existing(rows.where("state <> 3"), files, strict=True)
    valid = image_files.keep_valid(rows, image_files.valid_photos(spark, folder, recursiveFileLookup=True))
    started = image_files.keep_valid(rows, image_files.valid_photos(spark, folder, decode=False, recursiveFileLookup=True))
    out = None
    for form, kept in (("existing", existing), ("strict", strict), ("valid", valid), ("header", started)):
        part = kept.select(F.lit(form).alias("form"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query
def photo_file_verdicts(spark, sf_dir):
    """Verdicts on written photos: one listing taken in twice."""
    rows, folder = _written_photos(spark, sf_dir)
    table = _new_path(spark, "verdicts")
    image_files.refresh_verdicts(spark, folder, table, recursiveFileLookup=True)
    verdicts = image_files.refresh_verdicts(spark, folder, table, recursiveFileLookup=True)
    return rows.join(verdicts, "photo_id").select("id", "photo_id", "valid")


@query
def replayed_verdicts(spark, sf_dir):
    """Verdicts after listings that come twice, late, re-written, under a name used before, or half.

    Documents are files. ``labels`` judges them by quality; re-written files by the contrary.
    """
    table = _new_path(spark, "verdicts")
    good = D.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("photo_id"), F.lit(True).alias("good"))

    def listing(of, time, more):
        return D.table(spark, sf_dir, "documents").where(of).select(
            F.col("doc_id").cast("string").alias("photo_id"),
            F.concat(F.lit("files/"), "doc_id").alias("path"),
            F.timestamp_seconds(F.lit(time) + F.col("doc_id")).alias("modified"),
            (F.col("n_chars") + more).alias("length"),
        )

    def judge(contrary):
        verdict = F.col("good").isNull() if contrary else F.col("good").isNotNull()
        return lambda fresh: fresh.join(good, "photo_id", "left").select("path", verdict.alias("valid"))

    first = listing("doc_id % 3 <> 0", 1_700_000_000, 0)
    image_files.apply_listing(first, table, judge(False), "first")
    image_files.apply_listing(first, table, judge(True))  # nothing in it is new
    image_files.apply_listing(listing("doc_id % 3 = 0", 1_600_000_000, 0), table, judge(False), "late")
    half = image_files.read_batches(spark, table, image_files.VERDICTS).drop("batch")
    half.withColumn("valid", F.lit(False)).withColumn("seen", F.lit(9).cast("long")).write.parquet(f"{table}/_writing-killed")
    image_files.apply_listing(listing("doc_id % 7 = 0", 1_500_000_000, 1), table, judge(True), "rewritten")
    last = image_files.apply_listing(listing("doc_id % 11 = 0", 1_800_000_000, 2), table, judge(True), "late")
    return last.select(F.col("photo_id").cast("long").alias("photo_id"), F.unix_timestamp("modified").alias("modified"), "valid")


# Metrics.


@query
def confusion(spark, sf_dir):
    return metrics.confusion(D.predictions(spark, sf_dir), "label", "pred")


@query
def metrics_observed(spark, sf_dir):
    scores = metrics.class_metrics(D.predictions(spark, sf_dir), "label", "pred")
    return scores.select("class", *[_six(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def metrics_fixed(spark, sf_dir):
    scores = metrics.class_metrics(D.predictions(spark, sf_dir), "label", "pred", D.LANGS)
    return scores.select("class", *[_six(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def metrics_by_config(spark, sf_dir):
    scores = metrics.class_metrics(D.all_predictions(spark, sf_dir), "label", "pred", D.LANGS, by=["config"])
    return scores.select("config", "class", *[_six(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def macro_f1(spark, sf_dir):
    rows = D.predictions(spark, sf_dir)
    both = {"observed": metrics.OBSERVED, "fixed": D.LANGS}
    parts = [
        metrics.macro_f1(metrics.class_metrics(rows, "label", "pred", c)).select(
            F.lit(name).alias("classes"), _six(F.col("macro_f1")).alias("macro_f1")
        )
        for name, c in both.items()
    ]
    return parts[0].unionByName(parts[1])


@query
def micro_precision(spark, sf_dir):
    rows = metrics.micro_precision(D.all_predictions(spark, sf_dir), "label", "pred", by=["config"])
    return rows.select("config", _six(F.col("micro_precision")).alias("micro_precision"))


@query
def paired_predictions(spark, sf_dir):
    truth = D.captions(spark, sf_dir)
    return metrics.pair_predictions(truth, D.predictions(spark, sf_dir), "photo_id", "label", "pred")


@query
def unpaired_counts(spark, sf_dir):
    judged = D.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("photo_id"))
    return metrics.unpaired_counts(D.captions(spark, sf_dir), judged, "photo_id")


@query
def metrics_json(spark, sf_dir):
    """The JSON report of every configuration, parsed back."""
    scores = metrics.class_metrics(D.all_predictions(spark, sf_dir), "label", "pred", D.LANGS, by=["config"])
    body = "per_class map<string, struct<precision: double, recall: double, f1: double, support: bigint>>, macro_f1 double"
    rows = reports.metrics_json(scores, ["config"]).select("config", F.from_json("json", body).alias("r"))
    rows = rows.select("config", _six(F.col("r.macro_f1")).alias("macro_f1"), F.explode("r.per_class").alias("class", "s"))
    values = [_six(F.col(f"s.{c}")).alias(c) for c in ("precision", "recall", "f1")]
    return rows.select("config", "class", "macro_f1", *values, "s.support")


@query
def metrics_report_file(spark, sf_dir):
    """Report written as JSON per run, read back."""
    path = _new_path(spark, "report")
    scores = metrics.class_metrics(D.all_predictions(spark, sf_dir), "label", "pred", D.LANGS, by=["config"])
    reports.write_metrics(scores, path, ["config"], run_id="check")
    back = spark.read.json(path)
    supports = [F.col(f"per_class.{c}.support").alias(f"support_{c}") for c in D.LANGS]
    return back.select("config", "run_id", _six(F.col("macro_f1")).alias("macro_f1"), *supports)


@query
def config_compare(spark, sf_dir):
    scores = metrics.class_metrics(D.all_predictions(spark, sf_dir), "label", "pred", D.LANGS, by=["config"])
    wide = compare.compare_configs(scores, list(D.VARIANTS), "all_words")
    return wide.select("class", *[_six(F.col(c)).alias(c) for c in wide.columns if c != "class"])


@query
def predictions_wide(spark, sf_dir):
    return compare.predictions_wide(D.all_predictions(spark, sf_dir), "photo_id", list(D.VARIANTS))


# Exploration of the training split.


def _training_tokens(rows):
    """Training captions with all their tokens, however long."""
    whole = rows.withColumn("tokens", T.tokenize(F.col("caption"), None))
    return ranking.with_split(whole, ["photo_id"]).where("split = 'train'")


@query
def caption_stats(spark, sf_dir):
    stats = C.class_balance(_training_tokens(D.captions(spark, sf_dir)))
    return stats.select(
        "label",
        "rows",
        _six(F.col("missing_rate")).alias("missing_rate"),
        _six(F.col("mean_tokens")).alias("mean_tokens"),
        "max_tokens",
    )


@query
def length_histogram(spark, sf_dir):
    return C.length_histogram(_training_tokens(D.texts(spark, sf_dir)))


@query
def top_words_by_label(spark, sf_dir):
    return C.top_words(_training_tokens(D.texts(spark, sf_dir)), 10)


SHARES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


@query
def length_quantiles(spark, sf_dir):
    """Quantiles of caption lengths from sketches per class and split, and from those merged per split.

    ``within``: the rank of the length, counted exactly, is within the sketch's stated error of the share.
    """
    rows = ranking.with_split(D.texts(spark, sf_dir), ["photo_id"])
    tokens = materialize(rows.select("label", "split", T.tokenize(F.col("caption"), None).alias("tokens")), "tokens")
    fine = materialize(C.length_sketches(tokens, ["label", "split"]), "sketches")
    coarse = C.merge_sketches(fine, ["split"]).select(F.lit("all").alias("label"), "split", "sketch")
    told = C.sketch_quantiles(fine.unionByName(coarse), SHARES)
    lengths = tokens.groupBy("label", "split", F.size("tokens").alias("size")).agg(F.count("*").alias("rows"))
    every = lengths.groupBy("split", "size").agg(F.sum("rows").alias("rows")).withColumn("label", F.lit("all"))
    counted = lengths.unionByName(every).withColumnsRenamed({"label": "_label", "split": "_split"})
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("split") == F.col("_split"))
    ranks = told.join(counted, same).groupBy("label", "split", "share", "length", "n").agg(
        F.sum(F.when(F.col("size") < F.col("length"), F.col("rows")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("size") <= F.col("length"), F.col("rows")).otherwise(0)).alias("upto"),
    )
    slack = C.SKETCH_ERROR * F.col("n") + 1
    within = (F.col("below") <= F.col("share") * F.col("n") + slack) & (F.col("upto") >= F.col("share") * F.col("n") - slack)
    return ranks.select("label", "split", "share", "n", within.alias("within"))


# Prompts, messages, model output.


@query
def prompts(spark, sf_dir):
    rows = inference.classification_inputs(D.captions(spark, sf_dir), list(inference.CONFIGS))
    return rows.select("photo_id", "config", "prompt")


@query
def rendered_prompts(spark, sf_dir):
    rows = inference.classification_inputs(D.captions(spark, sf_dir), list(inference.CONFIGS))
    return rows.select("photo_id", "config", "request")


@query
def training_examples(spark, sf_dir):
    rows = examples.training_examples(D.captions(spark, sf_dir))
    return rows.select("photo_id", P.render(F.col("messages")).alias("rendered"), "caption")


@query
def rendered_turns(spark, sf_dir):
    """Every turn of a conversation written as a chat message."""
    turn = F.array(P.text_message(F.col("role"), F.col("text"))).cast(P.MESSAGE_TYPE)
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", P.render(turn).alias("rendered"))


@query
def rendered_conversations(spark, sf_dir):
    """Every conversation as one string, with the start of an answer."""
    turns = D.table(spark, sf_dir, "conversations")
    return examples.rendered_conversations(turns, generation=True)


@query
def streamed_captions(spark, sf_dir):
    """Captions encoded as a stream that is started, ended and started again after more files came."""
    rows = _tokens(spark, sf_dir)
    words = vocabulary.build_vocabulary(rows, "tokens", "ord")
    source, out, checkpoint = (_new_path(spark, n) for n in ("stream", "coded", "stream-state"))
    arriving = D.texts(spark, sf_dir).select("photo_id", "caption")
    for late in (False, True):
        arriving.where((F.col("photo_id") % 3 == 0) == F.lit(late)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(arriving.schema).parquet(source)
        captions_stream.write_encoded(stream, words, out, checkpoint)
    return spark.read.parquet(out).select("photo_id", _joined("token_ids").alias("ids"))


@query
def stripped(spark, sf_dir):
    text = F.concat(F.lit("\t "), F.col("text"), F.lit(" \n\x1c"))
    return D.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("photo_id"), F.md5(T.strip(text)).alias("text_md5")
    )


OUTPUT_LABELS = ["menu", "drink", "food", "la", "with", "the"]


@query
def parse_label(spark, sf_dir):
    parsed = T.parse_label(F.col("text"), OUTPUT_LABELS)
    return D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("photo_id"), parsed.alias("pred"))


def _id_lists(spark, sf_dir):
    """Ids of all tokens of the texts, without padding; the vocabulary is that of the first ten."""
    whole = D.texts(spark, sf_dir).select("photo_id", "ord", T.tokenize(F.col("caption"), None).alias("tokens"))
    return vocabulary.encode_whole(whole, "tokens", _vocabulary(spark, sf_dir), "photo_id").drop("tokens")


IMAGE_ID = 5


@query
def padded_batch(spark, sf_dir):
    stored = materialize(_id_lists(spark, sf_dir), "ids")
    rows = examples.padded_batches(stored, "ids", "ord", image_id=IMAGE_ID)
    return rows.select("photo_id", "batch_id", F.size("input_ids").alias("n_ids"), _md5("input_ids"), _md5("labels"))


@query
def masked_labels(spark, sf_dir):
    """Whole texts, padded to lengths that eight divides, with padding and image places masked or not."""
    padded = S.pad_right(F.col("ids"), F.ceil(F.size("ids") / 8).cast("int") * 8)
    rows = _id_lists(spark, sf_dir).select("photo_id", padded.alias("ids"))
    both, none = S.mask_labels(F.col("ids"), 0, IMAGE_ID), S.mask_labels(F.col("ids"), None, None)
    rows = rows.select("photo_id", F.size("ids").alias("n_ids"), both.alias("both"), none.alias("none"))
    return rows.select("photo_id", "n_ids", _md5("both"), _md5("none"))


@query
def trim_prefix(spark, sf_dir):
    """The text's ids as generated after a prompt made of the first half of them."""
    rows = _id_lists(spark, sf_dir).withColumn("prompt", F.expr("slice(ids, 1, size(ids) div 2)"))
    rows = rows.select("photo_id", S.trim_prefix(F.col("ids"), F.col("prompt")).alias("generated"))
    return rows.select("photo_id", F.size("generated").alias("n_ids"), _md5("generated"))


# Inference with stand-in models.


def _captioner():
    """Stand-in captioner: names the file."""
    return lambda frame: ["A photo from " + path for path in frame["image_path"]]


@query
def complete_captions(spark, sf_dir):
    done = inference.complete_captions(D.captions(spark, sf_dir), _captioner)
    return done.select("photo_id", "caption", "label")


def _answerer():
    """Stand-in classifier: a word of the caption in the request decides; an image alone is always food."""

    def answer(frame: pd.DataFrame) -> list[str]:
        answers = []
        for path, request in zip(frame["image_path"], frame["request"]):
            _, _, rest = request.partition("\nCaption:\n")
            caption = rest.rpartition("\n\nImportant:\n")[0]
            if not rest:
                answers.append(" Food.\n")
            elif " the " in caption:
                answers.append("The label is MENU")
            elif " und " in caption:
                answers.append("drink" if path is None else "drinks")
            else:
                answers.append("inside\t")
        return answers

    return answer


@query
def prompted_classification(spark, sf_dir):
    rows = ranking.with_split(D.captions(spark, sf_dir), ["photo_id"]).where("split = 'test'")
    return inference.classify(rows, _answerer).select("photo_id", "config", "pred")


# Embeddings and losses.


@query
def modality_pairs(spark, sf_dir):
    texts = _tokens(spark, sf_dir).select("photo_id", F.array(F.size("tokens").cast("double")).alias("text_vector"))
    pairs = embeddings.pair_modalities(D.embeddings(spark, sf_dir), texts, "photo_id")
    fused = F.concat("vector", "text_vector")
    return pairs.select("photo_id", F.size(fused).alias("dim"), _six(F.aggregate(fused, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query
def mean_pool(spark, sf_dir):
    pooled = embeddings.mean_by_group(D.embeddings(spark, sf_dir), "label", "vector", EMB_DIM)
    return pooled.select("label", "n", F.posexplode("mean").alias("pos", "mean")).withColumn("mean", _six(F.col("mean")))


def _noise() -> Column:
    """Noise computed from the id, the same in every engine."""
    return F.transform(F.sequence(F.lit(0), F.lit(EMB_DIM - 1)), lambda i: F.sin(F.col("photo_id") * 0.5 + i))


def _copy(vector: str | Column = "vector", dim: int = EMB_DIM) -> Column:
    return V.perturb(F.col(vector) if isinstance(vector, str) else vector, F.slice(_noise(), 1, dim))


def _pairs(spark, sf_dir, near: Column | None = None):
    """Each vector with its perturbed copy and the copy of another row of its batch."""
    rows = D.embeddings(spark, sf_dir).select("photo_id", "vector")
    size = embeddings.batch_rows(rows.count())
    rows = ranking.with_batches(rows, "photo_id").withColumn("near", _copy() if near is None else near)
    other = embeddings.negative_position(F.col("batch_pos"), size, whole(SEED, F.col("photo_id")))
    return embeddings.negative_pairs(rows, "vector", "near", other)


@query
def cosine_negatives(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    return rows.select(
        "photo_id",
        "neg_pos",
        _six(V.cosine(F.col("vector"), F.col("near"))).alias("pos_sim"),
        _six(V.cosine(F.col("vector"), F.col("neg_vector"))).alias("neg_sim"),
    )


@query
def infonce(spark, sf_dir):
    loss = embeddings.info_nce(_pairs(spark, sf_dir), "vector", "near")
    return loss.select("batch_id", _six(F.col("loss")).alias("loss"), "n")


@query
def contrastive_total(spark, sf_dir):
    """Image loss on the whole vectors plus text loss on their second halves, from one ranking and one pair join."""
    parts = {"image": F.col("vector"), "text": F.slice("vector", 33, 32)}
    copies = F.struct(_copy().alias("image"), _copy(parts["text"], 32).alias("text"))
    pairs = _pairs(spark, sf_dir, copies)
    losses = {}
    for name, vector in parts.items():
        own = pairs.select(
            "batch_id", vector.alias("vector"), F.col(f"near.{name}").alias("near"), F.col(f"neg_vector.{name}").alias("neg_vector")
        )
        losses[name] = embeddings.info_nce(own, "vector", "near")
    total = embeddings.contrastive_total(losses, MODALITY_WEIGHTS)
    return total.select("batch_id", _six(F.col("contrastive_loss")).alias("contrastive_loss"))


@query
def gaussian_perturbation(spark, sf_dir):
    """Every vector with seeded noise: its sum, and the largest change."""
    rows = D.embeddings(spark, sf_dir)
    near = V.perturb(F.col("vector"), gaussian(F.col("photo_id"), EMB_DIM, SEED))
    moved = rows.select("photo_id", "vector", near.alias("near"))
    change = F.array_max(F.zip_with("near", "vector", lambda a, b: F.abs(a - b)))
    total = F.aggregate("near", F.lit(0.0), lambda a, x: a + x)
    return moved.select("photo_id", _six(total).alias("total"), _six(change).alias("change"))


def _logits(spark, sf_dir) -> DataFrame:
    """Scores against class centres, whose weights are one value of a subquery."""
    rows = D.embeddings(spark, sf_dir)
    centres = embeddings.mean_by_group(rows, "label", "vector", EMB_DIM)
    mean = F.col("mean")
    unit = F.struct("label", mean.alias("weights"), (-0.5 * V.dot(mean, mean)).alias("bias"))
    layer = centres.agg(F.sort_array(F.collect_list(unit)).alias("layer")).scalar()
    rows = rows.select("photo_id", "label", "vector", layer.alias("layer"))
    return rows.select("photo_id", "label", V.layer_scores(F.col("vector"), F.col("layer")).alias("logits"))


@query
def centroid_argmax(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    best = F.array_max(V.softmax(F.col("logits")))
    return rows.select("photo_id", V.argmax(F.col("logits")).alias("pred"), _six(best).alias("share"))


@query
def cross_entropy(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    loss = V.cross_entropy(F.col("logits"), F.col("label"))
    return rows.groupBy("label").agg(_six(F.avg(loss)).alias("loss"), F.count("*").alias("n"))


def _word_vectors(spark, sf_dir, most_id):
    """Embeddings as learned vectors: one per word id, taken in turn until all have one, and one per place."""
    learned = D.embeddings(spark, sf_dir).select(F.col("photo_id").alias("turn"), "vector")
    n = learned.count()
    ids = spark.range(most_id + 1).select("id", (F.col("id") % n).alias("turn"))
    places = learned.where(F.col("turn") < MAX_LEN).select(F.col("turn").alias("pos"), F.col("vector").alias("position"))
    return ids.join(learned, "turn").select("id", "vector"), places


def _vector_rows(spark, sf_dir, broadcast_rows, positions):
    rows = _encoded(spark, sf_dir).select("photo_id", F.col("token_ids").cast("array<bigint>").alias("ids"))
    rows = materialize(rows, "ids")
    most_id = rows.agg(F.max(F.array_max("ids"))).first()[0] or 0
    table, places = _word_vectors(spark, sf_dir, most_id)
    found = embeddings.lookup_vectors(rows, "photo_id", "ids", table, places if positions else None, broadcast_rows)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return found.select("photo_id", F.col("pos").cast("int").alias("pos"), "id", _six(total).alias("total"))


@query
def vector_lookup(spark, sf_dir):
    return _vector_rows(spark, sf_dir, None, positions=False)


@query
def vector_lookup_shuffled(spark, sf_dir):
    """The form for vector tables too large to broadcast; padding is a hot key."""
    return _vector_rows(spark, sf_dir, 0, positions=False)


@query
def vector_add(spark, sf_dir):
    return _vector_rows(spark, sf_dir, None, positions=True)


def _feature_maps(spark, sf_dir):
    """The 64 values as a map of four channels on 4 x 4 places."""
    rows = D.embeddings(spark, sf_dir)
    channels = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice("vector", c * 16 + 1, 16))
    return rows.select("photo_id", V.map_to_tokens(channels, 4, 4).alias("places"))


@query
def map_to_tokens(spark, sf_dir):
    rows = _feature_maps(spark, sf_dir).select("photo_id", F.posexplode("places").alias("place", "v"))
    return rows.select("photo_id", F.col("place").cast("int").alias("place"), *[_six(F.col("v")[c]).alias(f"c{c}") for c in range(4)])


@query
def mean_tokens(spark, sf_dir):
    rows = _feature_maps(spark, sf_dir).select("photo_id", V.mean_tokens(F.col("places"), 4).alias("m"))
    return rows.select("photo_id", *[_six(F.col("m")[c]).alias(f"c{c}") for c in range(4)])


# Training logs.


@query
def epoch_loss(spark, sf_dir):
    rows = trainlog.epoch_losses(D.batch_log(spark, sf_dir))
    # Twelve places: means of values with few decimals often lie halfway between two shorter numbers.
    losses = [F.round(c, 12).alias(c) for c in ("pred_loss", "contrastive_loss", "total_loss")]
    return rows.select("run", "epoch", *losses, "batches")


PATIENCE = 4


@query
def early_stop(spark, sf_dir):
    return trainlog.early_stopping(D.epoch_log(spark, sf_dir), patience=PATIENCE)


@query
def best_epoch(spark, sf_dir):
    return trainlog.best_epoch(D.epoch_log(spark, sf_dir))


# Images.

GEOMETRY = ["resized_height", "resized_width", "crop_top", "crop_left"]


def _sizes(spark, sf_dir):
    """Text lengths as image sizes."""
    side = lambda c: (100 + c % 900).cast("int")
    return D.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("photo_id"),
        side(F.col("n_chars")).alias("height"),
        side(F.length("text") * 7 + F.col("doc_id")).alias("width"),
    )


@query
def image_geometry(spark, sf_dir):
    return images.plan_eval(_sizes(spark, sf_dir)).select("photo_id", "height", "width", *GEOMETRY)


@query
def image_augmentation(spark, sf_dir):
    return images.plan_train(_sizes(spark, sf_dir), epoch=2).select("photo_id", *GEOMETRY, "flip")


@query
def image_tensors(spark, sf_dir):
    """8 x 8 images resized to 16 and cropped to 14: one row per channel and pixel row."""
    planned = images.plan_eval(D.pictures(spark, sf_dir), resize_to=16, crop_to=14)
    rows = images.with_tensor(planned).select("photo_id", F.posexplode("tensor").alias("i", "v"))
    total = F.sum(F.round(F.col("v").cast("double") * 255).cast("long"))
    channel, y = F.expr("cast(i div 196 as int)"), F.expr("cast(i % 196 div 14 as int)")
    return rows.groupBy("photo_id", channel.alias("channel"), y.alias("y")).agg(total.alias("total"))


@query
def image_features(spark, sf_dir):
    planned = images.plan_eval(D.pictures(spark, sf_dir), resize_to=8, crop_to=6)
    rows = images.with_colour_features(planned)
    channels = F.explode(F.array(*[F.lit(c) for c in range(3)])).alias("channel")
    feature = lambda i: F.get("image_features", i).cast("double")
    return rows.select("photo_id", "image_features", channels).select(
        "photo_id",
        "channel",
        F.size("image_features").alias("dim"),
        F.round(feature(F.col("channel")) * 255 * 36).cast("long").alias("total"),
        *[F.round(feature(3 + 8 * F.col("channel") + b) * 36).cast("long").alias(f"bin{b}") for b in range(8)],
    )


GRID_SIDE, CHANNELS = 7, 64


def _encoder():
    """Stand-in image encoder: a vector of 64 for each of 7 x 7 places, multiples of one colour of the place."""

    def encode(frame: pd.DataFrame) -> list[np.ndarray]:
        times = np.arange(1, CHANNELS + 1, dtype=np.float32)
        out = []
        for tensor, shape in zip(frame["tensor"], frame["shape"]):
            places = np.asarray(tensor, dtype=np.float32).reshape(*shape).reshape(3, -1).T
            out.append(places[:, np.arange(CHANNELS) % 3] * times)
        return out

    return encode


@query
def encoded_images(spark, sf_dir):
    """An encoder's 49 vectors of 64 values for every picture, pooled to one: a row per value of it."""
    planned = images.plan_eval(D.pictures(spark, sf_dir), resize_to=8, crop_to=GRID_SIDE)
    rows = images.with_tensor(planned)
    places = inference.infer(_encoder, {"tensor": F.col("tensor"), "shape": F.col("shape")}, "array<array<float>>")
    rows = materialize(rows.select("photo_id", places.alias("places")), "encoded")
    pooled = rows.select("photo_id", F.size("places").alias("n"), V.mean_tokens(F.col("places"), CHANNELS).alias("m"))
    values = pooled.select("photo_id", "n", F.posexplode("m").alias("k", "v"))
    total = F.round(F.col("v") * F.col("n") * 255 / (F.col("k") + 1)).cast("long")
    return values.select("photo_id", F.col("k").cast("int").alias("k"), "n", total.alias("total"))


# Classifiers.


def _photo_variant(spark, sf_dir, variant):
    """Photos with whole texts, with captions as delivered (raw), or with missing ones written (completed)."""
    if variant == "whole":
        return D.texts(spark, sf_dir)
    rows = D.captions(spark, sf_dir)
    return inference.complete_captions(rows, _captioner, shuffle=False) if variant == "completed" else rows


def _caption_table(spark, sf_dir, variant="whole"):
    return prepare(_photo_variant(spark, sf_dir, variant)).table


def _judged(table: DataFrame, image: bool, text: bool) -> DataFrame:
    """Test rows with their label, and whether the answer is a known label."""
    known = table.where("label_id is not null").select(F.col("label_id").alias("pred_id")).distinct().withColumn("_known", F.lit(True))
    answers = baselines.run_config(table, image=image, text=text).join(known, "pred_id", "left")
    return answers.select("photo_id", "label_id", F.col("_known").isNotNull().alias("known"))


@query
def text_classifier(spark, sf_dir):
    return _judged(_caption_table(spark, sf_dir), image=False, text=True)


@query
def reloaded_classifier(spark, sf_dir):
    """Test rows judged by a pipeline that an earlier run fitted and kept."""
    table, store = _caption_table(spark, sf_dir), _new_path(spark, "pipelines")

    def never(value):
        raise RuntimeError("fitted again")

    baselines.run_config(table, image=False, text=True, grid=(0.01,), store=store)
    answers = baselines.run_config(table, image=False, text=True, make=never, store=store)
    known = table.where("label_id is not null").select(F.col("label_id").alias("pred_id")).distinct()
    answers = answers.join(known.withColumn("_known", F.lit(True)), "pred_id", "left")
    return answers.select("photo_id", "label_id", F.col("_known").isNotNull().alias("known"))


def _photos_with_vectors(spark, sf_dir, variant="whole"):
    vectors = D.embeddings(spark, sf_dir).select("photo_id", array_to_vector("vector").alias("image_vector"))
    return embeddings.pair_modalities(vectors, _caption_table(spark, sf_dir, variant), "photo_id")


@query
def image_classifier(spark, sf_dir):
    return _judged(_photos_with_vectors(spark, sf_dir), image=True, text=False)


@query
def fused_classifier(spark, sf_dir):
    return _judged(_photos_with_vectors(spark, sf_dir), image=True, text=True)


def _learned(spark, sf_dir):
    """Prepared photos, and a vector for every id of their vocabulary, learned from their tokens."""
    ready = prepare(D.texts(spark, sf_dir))
    table = materialize(ready.table.select("photo_id", "label_id", "split", "token_ids"), "prepared")
    return table, word_vectors.learn_token_vectors(table, "token_ids", ready.vocabulary), ready


@query
def learned_vectors(spark, sf_dir):
    """The learned vector of every token id of every photo; padding has the zero vector."""
    table, vectors, _ = _learned(spark, sf_dir)
    places = table.select("photo_id", F.col("token_ids").cast("array<bigint>").alias("ids"))
    found = embeddings.lookup_vectors(places, "photo_id", "ids", vectors)
    zero = ~F.exists("vector", lambda x: x != 0)
    return found.select("photo_id", F.col("pos").cast("int").alias("pos"), "id", F.size("vector").alias("dim"), zero.alias("zero"))


@query
def fused_network(spark, sf_dir):
    """Test rows of the two-layer network on image vectors and learned text vectors.

    The columns on the training say that its log has as many epochs as the rule of early stopping
    lets it have, and that the chosen weights are those of the best epoch by that rule.
    """
    table, vectors, ready = _learned(spark, sf_dir)
    texts = word_vectors.text_vectors(table, "photo_id", "token_ids", vectors)
    images = D.embeddings(spark, sf_dir).select("photo_id", F.col("vector").alias("image_vector"))
    both = embeddings.pair_modalities(table.join(images, "photo_id"), texts, "photo_id")
    judged, trained = network.run_network(
        both, _new_path(spark, "network"), ready.labels.count(), epochs=12, patience=3, steps=15
    )
    rule = trainlog.early_stopping(trained.history, patience=3)
    top = trainlog.best_epoch(trained.history).select("run", F.col("best_epoch").alias("top"))
    logged = trained.history.groupBy("run").agg(F.count("*").alias("logged"))
    told = rule.join(logged, "run").join(top, "run", "left").select(
        ((F.col("epochs") == F.col("logged")) & ((F.col("logged") == 12) | (F.col("logged") == F.col("stop_epoch")))).alias("epochs_by_rule"),
        (F.col("top").eqNullSafe(F.lit(trained.best)) & F.col("best_epoch").eqNullSafe(F.col("top"))).alias("best_by_rule"),
    ).first()
    known = ready.labels.select(F.col("label_id").alias("pred_id"), F.lit(True).alias("_known"))
    rows = judged.join(F.broadcast(known), "pred_id", "left")
    return rows.select(
        "photo_id", "label_id", F.col("_known").isNotNull().alias("known"), *[F.lit(v).alias(n) for n, v in told.asDict().items()]
    )


@query
def run_matrix(spark, sf_dir):
    """Classes scored for every modality on raw and on completed captions, models chosen over the whole grid."""
    tables = {v: _photos_with_vectors(spark, sf_dir, v) for v in ("raw", "completed")}
    within = F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("f1").between(0, 1)
    return baselines.run_matrix(tables).where("support > 0").select("config", "class", "support", within.alias("within"))

"""The operators' queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from capframe.llm import chat, decontaminate, lexical, neighbours, packing, passages, pii, quality, resample, rollup
from capframe.llm import simhash, topk, toxicity
from capframe.llm.common import materialize, read
from capframe.session import scratch_dir


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(read(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after inserts, a new tokenizer, a revision, a take-down, and a batch that comes twice.

    Batch 1 inserts all documents as counted by ``words``; 2 those of ``pieces``; 3 revises the
    German ones, whose pieces count once more for every word; 4 deletes documents under 100
    characters or without text; then batch 3 arrives again.
    """
    docs = read(spark, sf_dir, "documents").select("source", "lang", "text")
    counted = materialize(
        docs.select("source", "lang", F.length("text").alias("chars"), rollup.words(F.col("text")).alias("w"), rollup.word_pieces(F.col("text")).alias("p")),
        "counts",
    )
    german, short = counted.where("lang = 'de'"), counted.where("chars < 100 or chars is null")
    revised = rollup.changes(german, "revise", "pieces", F.col("p") + F.col("w"), F.col("p"))
    now = F.when(F.col("lang") == "de", F.col("p") + F.col("w")).otherwise(F.col("p"))
    totals = rollup.TokenRollup(spark, f"{scratch_dir(spark)}/rollup-{uuid.uuid4().hex}")
    totals.apply("words", rollup.changes(counted, "insert", "words", F.col("w")))
    totals.apply("pieces", rollup.changes(counted, "insert", "pieces", F.col("p")))
    totals.apply("german", revised)
    gone = rollup.changes(short, "delete", "words", None, F.col("w")).unionByName(
        rollup.changes(short, "delete", "pieces", None, now)
    )
    totals.apply("short", gone)
    totals.apply("german", revised)
    return totals.totals()


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    formatted = materialize(chat.format_conversations(turns.unionByName(extra)), "formatted")
    return chat.digests(formatted)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(quality.document_stats(read(spark, sf_dir, "documents")), "stats")
    return quality.score(stats, quality.fit(stats, read(spark, sf_dir, "labels")))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more found elsewhere; spans as start:end, joined by commas."""
    found = passages.repeated(read(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", F.array_join(spans, ",").alias("spans"), "dup_words")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all rows."""
    vectors = read(spark, sf_dir, "embeddings")
    return topk.search(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the longer documents, drawn towards the words of ``benchmark``."""
    return resample.draw(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that match each item of ``benchmark`` best."""
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_embeddings": op4_embeddings,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_token_rollup": op7_token_rollup,
    "op8_chat": op8_chat,
    "op9_quality": op9_quality,
    "op10_passages": op10_passages,
    "op11_exact_topk": op11_exact_topk,
    "op12_resampling": op12_resampling,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {}

SQL["op4_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.9),
reached AS (
  SELECT vec_id, vec_id AS root FROM embeddings
  UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.vec_id),
degrees AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(any_value(n_links), 0) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept
FROM reached LEFT JOIN degrees USING (vec_id) GROUP BY vec_id"""

SQL["op10_passages"] = r"""
WITH listed AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x09-\x0D\x1C-\x1F\x{85}\pZ]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
places AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS start FROM listed),
windows AS (SELECT doc_id, start, array_to_string(w[start + 1:start + 50], ' ') AS words FROM places),
twice AS (SELECT DISTINCT doc_id, start FROM (SELECT doc_id, start, count(*) OVER (PARTITION BY words) AS n FROM windows) WHERE n > 1),
marked AS (
  SELECT *, CASE WHEN start <= 50 + lag(start) OVER (PARTITION BY doc_id ORDER BY start) THEN 0 ELSE 1 END AS new FROM twice),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM marked),
islands AS (SELECT doc_id, min(start) AS a, max(start) + 50 AS b FROM grouped GROUP BY doc_id, island)
SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, CAST(sum(b - a) AS BIGINT) AS dup_words
FROM islands GROUP BY doc_id"""

SQL["op7_token_rollup"] = r"""
WITH counted AS (
  SELECT source, lang,
         len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS w,
         len(regexp_extract_all(text, '[\p{L}\p{N}]{1,4}|[^\p{L}\p{N} \t\n\r\f\x0B]')) AS p
  FROM documents WHERE length(text) >= 100)
SELECT source, lang, 'words' AS tokenizer, count(*) AS n_docs, CAST(sum(w) AS BIGINT) AS n_tokens
FROM counted GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces', count(*), CAST(sum(CASE WHEN lang = 'de' THEN p + w ELSE p END) AS BIGINT)
FROM counted GROUP BY source, lang"""

SQL["op8_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
escaped AS (
  SELECT *, regexp_replace(text, '(<\\*)\|', '\1\\|', 'g') AS body,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '(<\\*)\|', '\1\\|', 'g') AS head
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(head) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""

SQL["op11_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM met)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5"""

SQL["op12_resampling"] = r"""
WITH crc AS (  -- the usual table, by its rule
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
texts AS (
  SELECT false AS aim, doc_id AS id, text FROM documents UNION ALL SELECT true, item_id, text FROM benchmark),
listed AS (
  SELECT aim, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
counted AS (
  SELECT aim, id, word, count(*) AS n FROM (SELECT aim, id, unnest(words) AS word FROM listed) GROUP BY ALL),
bytes AS (
  SELECT word, list_transform(range(octet_length(encode(word))),
           lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS b
  FROM (SELECT DISTINCT word FROM counted)),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b),
           lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1]))) % 10000 AS bucket
  FROM bytes, crc),
sums AS (
  SELECT bucket, sum(n) FILTER (NOT aim) AS s, sum(n) FILTER (aim) AS t
  FROM counted JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE)
           / CAST((coalesce(s, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM sums, totals),
weighed AS (
  SELECT id, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE NOT aim GROUP BY id),
scores AS (
  SELECT id AS doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || id), 1, 8) AS BIGINT)
           + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM (SELECT * FROM listed WHERE NOT aim) LEFT JOIN weighed USING (id)),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scores WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scores s LEFT JOIN placed p USING (doc_id)"""

SQL["op13_lexical_search"] = r"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p,
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS large, 'abcdefghijklmnopqrstuvwxyz' AS small),
docs AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), p), lambda w: translate(w, large, small)) AS words
  FROM documents, pattern),
corpus AS (SELECT count(*) FILTER (len(words) > 0) AS n_all, CAST(sum(len(words)) AS BIGINT) AS l_all FROM docs),
tfs AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM docs) GROUP BY ALL),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), p),
                                              lambda w: translate(w, large, small))) AS term
        FROM benchmark, pattern) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), corpus),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf)
           // (1000 * tf + 8 * (25 + (75 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term), corpus GROUP BY item_id, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place
           FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 10"""

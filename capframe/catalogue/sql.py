"""SQL giving the same rows as the queries, run by another engine on the same tables."""

from __future__ import annotations

from capframe.catalogue import views as D
from capframe.catalogue.queries import IMAGE_ID, OUTPUT_LABELS, PATIENCE
from capframe.fixed_values import (
    CAPTION_PROMPT,
    CONTRASTIVE_WEIGHT,
    IMAGE_AND_TEXT_PROMPT,
    IMAGE_PROMPT,
    SEED,
    TEXT_PROMPT,
)

SQL: dict[str, str] = {}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TOKENS = r"""tok AS (
  SELECT *, list_slice(regexp_extract_all(lower(coalesce(caption, '')), '[a-zA-Z]+|[.,!?;:()\-'']'), 1, 10) AS tokens
  FROM texts)"""

WORDS = """words AS (
  SELECT photo_id, ord, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM tok)"""

VOCAB = """vocab AS (
  SELECT word, freq, CAST(row_number() OVER (ORDER BY first) + 1 AS INTEGER) AS id
  FROM (SELECT word, count(*) AS freq, min(ord * 100 + pos) AS first FROM words GROUP BY word HAVING count(*) >= 3))"""

IDS = """ids AS (
  SELECT tok.*, coalesce(l, []) AS ids, list_resize(coalesce(l, []), 10, 0) AS token_ids
  FROM tok LEFT JOIN (
    SELECT photo_id, list(coalesce(id, 1) ORDER BY pos) AS l FROM words LEFT JOIN vocab USING (word) GROUP BY photo_id
  ) USING (photo_id))"""


def split_sql(source: str) -> str:
    """``split_rows``: the rows of ``source`` with their split."""
    return f"""split_rows AS (
  SELECT * EXCLUDE (rn, n, held),
         CASE WHEN rn <= n - held THEN 'train' WHEN rn <= n - (2 * held + 2) // 3 THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT *, (3 * n + 9) // 10 AS held FROM (
    SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || photo_id), photo_id) AS rn, count(*) OVER () AS n FROM {source})))"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


ENCODED = (D.TEXTS_SQL, TOKENS, WORDS, VOCAB, IDS)

# Captions.
SQL["caption_presence"] = _with(D.CAPTIONS_SQL) + """
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS broken, count(*) AS kept,
       count(*) FILTER (caption = '') AS without_caption,
       count(*) FILTER (caption IS DISTINCT FROM '') AS with_caption,
       count(*) FILTER (caption IS NULL) AS null_caption FROM captions"""
SQL["observed_presence"] = SQL["caption_presence"]
SQL["caption_halves"] = _with(D.CAPTIONS_SQL) + """
SELECT photo_id, CASE WHEN caption = '' THEN 'without' ELSE 'with' END AS half,
       CAST(length(caption) AS INTEGER) AS chars FROM captions"""
SQL["complete_rows"] = _with(D.CAPTIONS_SQL) + """
SELECT photo_id, image_path FROM captions WHERE image_path IS NOT NULL AND caption IS NOT NULL"""
SQL["image_paths"] = "SELECT doc_id AS photo_id, 'raw/' || doc_id || '.png' AS path FROM documents"
SQL["tokens"] = _with(D.TEXTS_SQL, TOKENS) + "SELECT photo_id, array_to_string(tokens, ' ') AS tokens FROM tok"
SQL["all_tokens"] = r"""
SELECT doc_id AS photo_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z]+|[.,!?;:()\-'']') AS t FROM documents)"""
SQL["word_freq"] = _with(D.TEXTS_SQL, TOKENS, WORDS) + "SELECT word, count(*) AS freq FROM words GROUP BY word"
SQL["vocab"] = _with(D.TEXTS_SQL, TOKENS, WORDS, VOCAB) + "SELECT word, freq, id FROM vocab"
SQL["vocab_size"] = _with(D.TEXTS_SQL, TOKENS, WORDS, VOCAB) + "SELECT count(*) + 2 AS vocab_size FROM vocab"
SQL["encoded_captions"] = _with(*ENCODED) + "SELECT photo_id, array_to_string(token_ids, ' ') AS ids FROM ids"
SQL["encoded_captions_large_vocabulary"] = SQL["encoded_captions"]

# Labels.
LABELS = """labels_by_id AS (
  SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id
  FROM (SELECT DISTINCT label FROM captions WHERE label IS NOT NULL))"""
SQL["label_ids"] = _with(D.CAPTIONS_SQL, LABELS) + "SELECT label, label_id FROM labels_by_id"
SQL["label_encoded"] = _with(D.CAPTIONS_SQL, LABELS) + """
SELECT photo_id, label_id FROM captions LEFT JOIN labels_by_id USING (label)"""
SQL["label_names"] = _with(D.CAPTIONS_SQL) + "SELECT photo_id, label AS name FROM captions"

# Order, split, batches.
SPLIT = (D.CAPTIONS_SQL, split_sql("captions"))
SQL["split_exact"] = _with(*SPLIT) + "SELECT photo_id, split FROM split_rows"
SQL["split_counts_by_label"] = _with(*SPLIT) + """
SELECT split, label, count(*) AS rows FROM split_rows GROUP BY split, label"""
SQL["shuffled_order"] = f"""
SELECT doc_id AS photo_id, row_number() OVER (ORDER BY md5('{SEED}|' || doc_id), doc_id) AS rn FROM documents"""
SQL["row_numbers"] = _with(D.CAPTIONS_SQL) + """
SELECT source, photo_id, row_number() OVER (ORDER BY source, photo_id) AS rn
FROM captions WHERE caption IS DISTINCT FROM ''"""
SQL["batches"] = """
SELECT doc_id AS photo_id, (rn - 1) // 128 AS batch_id, CAST((rn - 1) % 128 AS INTEGER) AS batch_pos
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)"""
SQL["epoch_batches"] = _with(*SPLIT) + f"""
SELECT photo_id, (rn - 1) // 128 AS batch_id, CAST((rn - 1) % 128 AS INTEGER) AS batch_pos
FROM (SELECT photo_id, row_number() OVER (ORDER BY md5('{SEED}|3|' || photo_id), photo_id) AS rn
      FROM split_rows WHERE split = 'train')"""
KEPT = "kept AS (SELECT * FROM texts WHERE photo_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"
SQL["prepared_photos"] = _with(
    D.TEXTS_SQL,
    KEPT,
    TOKENS.replace("FROM texts", "FROM kept"),
    WORDS,
    VOCAB,
    IDS,
    LABELS.replace("FROM captions", "FROM kept"),
    split_sql("ids"),
) + """
SELECT photo_id, image_path, label_id, split, array_to_string(token_ids, ' ') AS ids
FROM split_rows LEFT JOIN labels_by_id USING (label)"""
SQL["keep_valid"] = _with(D.CAPTIONS_SQL) + """
SELECT photo_id, image_path FROM captions WHERE photo_id IN (SELECT doc_id FROM labels WHERE quality = 1)"""
SQL["drop_broken"] = _with(D.CAPTIONS_SQL) + """
SELECT photo_id, image_path FROM captions WHERE photo_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"""

# Sources and sinks.
SQL["csv_round_trip"] = _with(D.CAPTIONS_SQL) + """
SELECT photo_id, coalesce(caption, '') AS caption, label, image_path FROM captions"""
SQL["json_round_trip"] = _with(D.CAPTIONS_SQL) + "SELECT photo_id, caption, label, source FROM captions"
SQL["source_order"] = "SELECT doc_id AS photo_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents"

# Photo files.
PHOTO_FILES = D.PICTURES_SQL + f""",
files AS (
  SELECT photo_id AS id, replace({D.FILE_NAMES}[photo_id % 8 + 1], '#id', CAST(photo_id AS VARCHAR)) AS photo_id,
         photo_id // 8 % 5 AS state, CAST(sum(list_sum(px)) AS BIGINT) AS total
  FROM pictures GROUP BY pictures.photo_id)"""
SQL["photo_files_read"] = _with(PHOTO_FILES) + """
SELECT id, photo_id, state <> 3 AS there, CASE WHEN state <> 3 THEN state <> 2 END AS filled,
       CASE WHEN state IN (0, 4) THEN 8 END AS height, CASE WHEN state IN (0, 4) THEN 8 END AS width,
       CASE WHEN state IN (0, 4) THEN total END AS total FROM files"""
SQL["photo_files_kept"] = _with(PHOTO_FILES) + """
SELECT form, id FROM files, (VALUES ('existing', [0, 1, 2, 4]), ('strict', [0, 1, 2, 4]), ('valid', [0, 4]),
                                    ('header', [0, 1, 4])) AS forms (form, states)
WHERE list_contains(states, state)"""
SQL["photo_file_verdicts"] = _with(PHOTO_FILES) + """
SELECT id, photo_id, state <> 1 AS valid FROM files WHERE state NOT IN (2, 3)"""
SQL["replayed_verdicts"] = """
SELECT doc_id AS photo_id,
       CASE WHEN doc_id % 7 = 0 THEN 1500000000 WHEN doc_id % 3 = 0 THEN 1600000000 ELSE 1700000000 END + doc_id AS modified,
       (doc_id % 7 = 0) <> (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS valid
FROM documents"""


# Metrics.
def scores_sql(classes: str, by: str = "") -> str:
    """``scores`` per class; ``classes`` gives (by..., class) rows."""
    group = f"{by}, " if by else ""
    same = f"p.{by} = c.{by} AND " if by else ""
    lead = f"c.{by}, " if by else ""
    return f"""classes AS ({classes}),
scored AS (SELECT * FROM predictions WHERE label IS NOT NULL),
counts AS (
  SELECT {lead}c.class, count(*) FILTER (p.label = c.class AND p.pred = c.class) AS tp,
         count(*) FILTER (p.pred = c.class) AS predicted, count(*) FILTER (p.label = c.class) AS support
  FROM classes c LEFT JOIN scored p ON {same}(p.label = c.class OR p.pred = c.class) GROUP BY ALL),
scores AS (
  SELECT {group}class,
         coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0.0e0) AS precision,
         coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0e0) AS recall,
         coalesce(CAST(2 * tp AS DOUBLE) / nullif(predicted + support, 0), 0.0e0) AS f1, support FROM counts)"""


OBSERVED = """SELECT DISTINCT unnest([label, pred]) AS class FROM predictions WHERE label IS NOT NULL"""
FIXED = f"SELECT unnest({D.LANGS}) AS class"
FIXED_BY = f"SELECT DISTINCT config, unnest({D.LANGS}) AS class FROM predictions"
ROUNDED = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support"

SQL["confusion"] = _with(D.predictions_sql()) + "SELECT label, pred, count(*) AS n FROM predictions GROUP BY ALL"
SQL["metrics_observed"] = _with(D.predictions_sql(), scores_sql(OBSERVED)) + f"SELECT class, {ROUNDED} FROM scores"
SQL["metrics_fixed"] = _with(D.predictions_sql(), scores_sql(FIXED)) + f"SELECT class, {ROUNDED} FROM scores"
SQL["metrics_by_config"] = _with(D.all_predictions_sql(), scores_sql(FIXED_BY, "config")) + f"""
SELECT config, class, {ROUNDED} FROM scores"""
SQL["macro_f1"] = f"""
SELECT 'observed' AS classes, round(avg(f1), 6) AS macro_f1
FROM ({_with(D.predictions_sql(), scores_sql(OBSERVED))} SELECT * FROM scores)
UNION ALL
SELECT 'fixed', round(avg(f1), 6)
FROM ({_with(D.predictions_sql(), scores_sql(FIXED))} SELECT * FROM scores)"""
SQL["micro_precision"] = _with(D.all_predictions_sql()) + """
SELECT config, round(avg(CASE WHEN label = pred THEN 1.0e0 ELSE 0.0e0 END), 6) AS micro_precision
FROM predictions WHERE label IS NOT NULL GROUP BY config"""
SQL["paired_predictions"] = _with(D.predictions_sql()) + "SELECT photo_id, label, pred FROM predictions"
SQL["unpaired_counts"] = """
SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS paired,
       count(*) FILTER (l.doc_id IS NULL) AS only_truth, count(*) FILTER (d.doc_id IS NULL) AS only_pred
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id"""
SQL["metrics_report_file"] = _with(D.all_predictions_sql(), scores_sql(FIXED_BY, "config")) + """
SELECT config, 'check' AS run_id, round(avg(f1), 6) AS macro_f1, """ + ", ".join(
    f"max(support) FILTER (class = '{c}') AS support_{c}" for c in D.LANGS
) + " FROM scores GROUP BY config"
SQL["metrics_json"] = _with(D.all_predictions_sql(), scores_sql(FIXED_BY, "config")) + f"""
SELECT config, class, round(avg(f1) OVER (PARTITION BY config), 6) AS macro_f1, {ROUNDED} FROM scores"""
_COLUMNS = [f"max(f1) FILTER (config = '{v}')" for v in D.VARIANTS]
SQL["config_compare"] = _with(D.all_predictions_sql(), scores_sql(FIXED_BY, "config")) + (
    "SELECT class, "
    + ", ".join(f"round({c}, 6) AS {v}" for c, v in zip(_COLUMNS, D.VARIANTS))
    + ", "
    + ", ".join(f"round({c} - {_COLUMNS[0]}, 6) AS {v}_delta" for c, v in list(zip(_COLUMNS, D.VARIANTS))[1:])
    + " FROM scores GROUP BY class"
)
SQL["predictions_wide"] = _with(D.all_predictions_sql()) + (
    "SELECT photo_id, "
    + ", ".join(f"max(pred) FILTER (config = '{v}') AS pred_{v}" for v in D.VARIANTS)
    + " FROM predictions GROUP BY photo_id"
)

# Exploration of the training split.
ALL_TOKENS = r"""tok AS (
  SELECT *, regexp_extract_all(lower(coalesce(caption, '')), '[a-zA-Z]+|[.,!?;:()\-'']') AS tokens FROM captions)"""
TRAIN = (D.CAPTIONS_SQL, ALL_TOKENS, split_sql("tok"), "train AS (SELECT * FROM split_rows WHERE split = 'train')")
WHOLE_TRAIN = (D.TEXTS_SQL, ALL_TOKENS.replace("FROM captions", "FROM texts"), *TRAIN[2:])
SQL["caption_stats"] = _with(*TRAIN) + """
SELECT label, count(*) AS rows,
       round(avg(CASE WHEN coalesce(caption, '') = '' THEN 1.0e0 ELSE 0.0e0 END), 6) AS missing_rate,
       round(avg(CAST(len(tokens) AS DOUBLE)), 6) AS mean_tokens, CAST(max(len(tokens)) AS INTEGER) AS max_tokens
FROM train GROUP BY label"""
SQL["length_histogram"] = _with(*WHOLE_TRAIN) + """
SELECT CAST(len(tokens) AS INTEGER) AS n_tokens, count(*) AS rows FROM train GROUP BY 1"""
SQL["top_words_by_label"] = _with(*WHOLE_TRAIN) + """
SELECT label, word, freq, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY freq DESC, word) AS rank FROM (
    SELECT label, word, count(*) AS freq FROM (SELECT label, unnest(tokens) AS word FROM train) GROUP BY ALL))
WHERE rank <= 10"""
SQL["length_quantiles"] = _with(*WHOLE_TRAIN[:3]) + """
SELECT label, split, share, n, true AS within FROM (
  SELECT label, split, count(*) AS n FROM split_rows GROUP BY ALL
  UNION ALL SELECT 'all', split, count(*) FROM split_rows GROUP BY ALL),
  (SELECT unnest([0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0, 0.99e0]) AS share)"""

# Prompts, messages, model output.
ASKED = f"""asked AS (
  SELECT photo_id, 'image' AS config, image_path, caption, {_quote(IMAGE_PROMPT)} AS prompt FROM captions
  UNION ALL SELECT photo_id, 'text', NULL, caption,
         replace({_quote(TEXT_PROMPT)}, '{{caption}}', coalesce(caption, '')) FROM captions
  UNION ALL SELECT photo_id, 'image_text', image_path, caption,
         replace({_quote(IMAGE_AND_TEXT_PROMPT)}, '{{caption}}', coalesce(caption, '')) FROM captions)"""
SQL["prompts"] = _with(D.CAPTIONS_SQL, ASKED) + "SELECT photo_id, config, prompt FROM asked"
SQL["rendered_prompts"] = _with(D.CAPTIONS_SQL, ASKED) + """
SELECT photo_id, config, '<|im_start|>user' || chr(10) || CASE WHEN config = 'text' THEN '' ELSE '<|image|>' END
       || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS request FROM asked"""
SQL["training_examples"] = _with(D.CAPTIONS_SQL) + f"""
SELECT photo_id, '<|im_start|>user' || chr(10) || '<|image|>' || {_quote(CAPTION_PROMPT)} || '<|im_end|>' || chr(10)
       || '<|im_start|>assistant' || chr(10) || caption || '<|im_end|>' || chr(10) AS rendered, caption
FROM captions WHERE caption IS NOT NULL"""
SQL["rendered_turns"] = """
SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered FROM conversations"""
SQL["rendered_conversations"] = """
SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn)
       || '<|im_start|>assistant' || chr(10) AS rendered
FROM conversations GROUP BY conv_id"""
SQL["streamed_captions"] = SQL["encoded_captions"]
BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
STRIPPED = rf"regexp_replace(%s, '^{BLANK}+|{BLANK}+$', '', 'g')"
SQL["stripped"] = f"SELECT doc_id AS photo_id, md5({STRIPPED % 'text'}) AS text_md5 FROM documents"
_PARSE = " ".join(
    rf"WHEN regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){w}([^\p{{L}}\p{{N}}_]|$)') THEN '{w}'" for w in OUTPUT_LABELS
)
SQL["parse_label"] = f"SELECT doc_id AS photo_id, CASE {_PARSE} ELSE {STRIPPED % 'text'} END AS pred FROM documents"
MASK = f"list_transform(%s, lambda x: CASE WHEN x IN (0, {IMAGE_ID}) THEN -100 ELSE x END)"
WHOLE_IDS = r"""whole_ids AS (
  SELECT photo_id, ord, coalesce(l, []) AS ids FROM texts LEFT JOIN (
    SELECT photo_id, list(coalesce(id, 1) ORDER BY pos) AS l FROM (
      SELECT photo_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (
        SELECT photo_id, regexp_extract_all(lower(coalesce(caption, '')), '[a-zA-Z]+|[.,!?;:()\-'']') AS t FROM texts))
    LEFT JOIN vocab USING (word) GROUP BY photo_id) USING (photo_id))"""
WHOLE = (D.TEXTS_SQL, TOKENS, WORDS, VOCAB, WHOLE_IDS)
SQL["padded_batch"] = _with(*WHOLE) + f"""
SELECT photo_id, batch_id, CAST(len(input_ids) AS INTEGER) AS n_ids, md5(array_to_string(input_ids, ' ')) AS input_ids,
       md5(array_to_string({MASK % 'input_ids'}, ' ')) AS labels
FROM (SELECT photo_id, batch_id, list_resize(ids, max(len(ids)) OVER (PARTITION BY batch_id), 0) AS input_ids
      FROM (SELECT photo_id, ids, (row_number() OVER (ORDER BY ord) - 1) // 128 AS batch_id FROM whole_ids))"""
SQL["masked_labels"] = _with(*WHOLE) + f"""
SELECT photo_id, CAST(len(ids) AS INTEGER) AS n_ids, md5(array_to_string({MASK % 'ids'}, ' ')) AS both,
       md5(array_to_string(ids, ' ')) AS none
FROM (SELECT photo_id, list_resize(ids, ((len(ids) + 7) // 8) * 8, 0) AS ids FROM whole_ids)"""
SQL["trim_prefix"] = _with(*WHOLE) + """
SELECT photo_id, CAST(len(ids) - len(ids) // 2 AS INTEGER) AS n_ids,
       md5(array_to_string(ids[len(ids) // 2 + 1 :], ' ')) AS generated FROM whole_ids"""
SQL["complete_captions"] = _with(D.CAPTIONS_SQL) + """
SELECT photo_id, CASE WHEN caption = '' THEN 'A photo from ' || image_path ELSE caption END AS caption, label FROM captions"""
SQL["prompted_classification"] = _with(*SPLIT) + """
SELECT photo_id, config,
       CASE WHEN config = 'image' THEN 'food' WHEN contains(caption, ' the ') THEN 'menu'
            WHEN contains(caption, ' und ') THEN CASE WHEN config = 'text' THEN 'drink' ELSE 'drinks' END
            ELSE 'inside' END AS pred
FROM (SELECT photo_id, coalesce(caption, '') AS caption, unnest(['image_text', 'image', 'text']) AS config
      FROM split_rows WHERE split = 'test')"""

# Embeddings and losses.
SQL["modality_pairs"] = _with(D.TEXTS_SQL, TOKENS, D.EMBEDDINGS_SQL) + """
SELECT photo_id, CAST(len(vector) + 1 AS INTEGER) AS dim, round(list_sum(vector) + len(tokens), 6) AS total
FROM vectors JOIN tok USING (photo_id)"""
SQL["mean_pool"] = _with(D.EMBEDDINGS_SQL) + """
SELECT label, count(*) AS n, CAST(pos - 1 AS INTEGER) AS pos, round(avg(v), 6) AS mean
FROM (SELECT label, unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM vectors) GROUP BY label, pos"""
PAIRS = f"""batched AS (
  SELECT photo_id, vector, (rn - 1) // 128 AS batch_id, (rn - 1) % 128 AS batch_pos,
         list_transform(vector, lambda x, i: x + 0.1e0 * sin(photo_id * 0.5e0 + (i - 1))) AS near
  FROM (SELECT *, row_number() OVER (ORDER BY photo_id) AS rn FROM vectors)),
drawn AS (
  SELECT *, CASE WHEN size > 1 THEN (batch_pos + 1 + CAST('0x' || substr(md5('{SEED}|' || photo_id), 1, 15) AS BIGINT) % (size - 1)) % size END AS neg_pos
  FROM (SELECT *, count(*) OVER (PARTITION BY batch_id) AS size FROM batched)),
pairs AS (
  SELECT a.photo_id, a.batch_id, a.neg_pos, list_cosine_similarity(a.vector, a.near) AS pos_sim,
         list_cosine_similarity(a.vector, b.near) AS neg_sim
  FROM drawn a JOIN batched b ON a.batch_id = b.batch_id AND a.neg_pos = b.batch_pos)"""
SQL["cosine_negatives"] = _with(D.EMBEDDINGS_SQL, PAIRS) + """
SELECT photo_id, CAST(neg_pos AS INTEGER) AS neg_pos, round(pos_sim, 6) AS pos_sim, round(neg_sim, 6) AS neg_sim FROM pairs"""
SQL["infonce"] = _with(D.EMBEDDINGS_SQL, PAIRS) + """
SELECT batch_id, round(avg(ln(1 + exp((neg_sim - pos_sim) / 0.2e0))), 6) AS loss, count(*) AS n FROM pairs GROUP BY batch_id"""
_LOSS = "SELECT batch_id, avg(ln(1 + exp((neg_sim - pos_sim) / 0.2e0))) AS loss FROM pairs GROUP BY batch_id"
_HALF = D.EMBEDDINGS_SQL + ", halves AS (SELECT photo_id, vector[33:64] AS vector FROM vectors)"
SQL["contrastive_total"] = f"""
SELECT batch_id, round(sum(loss), 6) AS contrastive_loss FROM (
  ({_with(D.EMBEDDINGS_SQL, PAIRS)} {_LOSS})
  UNION ALL
  ({_with(_HALF, PAIRS.replace('FROM vectors', 'FROM halves'))} {_LOSS}))
GROUP BY batch_id"""
SQL["gaussian_perturbation"] = _with(D.EMBEDDINGS_SQL) + """
SELECT photo_id, round(sum(v + 0.1e0 * g), 6) AS total, round(max(abs(0.1e0 * g)), 6) AS change FROM (
  SELECT photo_id, v, sqrt(-2 * ln((CAST(u1 AS DOUBLE) + 0.5e0) / pow(2, 60)))
                      * cos(2 * pi() * ((CAST(u2 AS DOUBLE) + 0.5e0) / pow(2, 60))) AS g
  FROM (SELECT photo_id, v, """ + ", ".join(
    f"CAST('0x' || substr(md5('{SEED}|{k}|' || photo_id || '|' || i), 1, 15) AS BIGINT) AS u{k}" for k in (1, 2)
) + """
        FROM (SELECT photo_id, unnest(vector) AS v, generate_subscripts(vector, 1) - 1 AS i FROM vectors)))
GROUP BY photo_id"""
LOGITS = """centres AS (
  SELECT label, list(m ORDER BY pos) AS centre FROM (
    SELECT label, pos, avg(v) AS m FROM (
      SELECT label, unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM vectors) GROUP BY label, pos)
  GROUP BY label),
logits AS (
  SELECT v.photo_id, v.label AS label, c.label AS class,
         list_dot_product(v.vector, c.centre) - 0.5e0 * list_dot_product(c.centre, c.centre) AS logit
  FROM vectors v CROSS JOIN centres c)"""
SQL["centroid_argmax"] = _with(D.EMBEDDINGS_SQL, LOGITS) + """
SELECT photo_id, arg_max(class, logit) AS pred, round(1 / sum(exp(logit - top)), 6) AS share
FROM (SELECT *, max(logit) OVER (PARTITION BY photo_id) AS top FROM logits) GROUP BY photo_id"""
SQL["cross_entropy"] = _with(D.EMBEDDINGS_SQL, LOGITS) + """
SELECT label, round(avg(loss), 6) AS loss, count(*) AS n FROM (
  SELECT photo_id, label, ln(sum(exp(logit))) - max(logit) FILTER (class = label) AS loss FROM logits GROUP BY ALL)
GROUP BY label"""
PLACES = """places AS (
  SELECT photo_id, CAST(generate_subscripts(token_ids, 1) - 1 AS INTEGER) AS pos,
         CAST(unnest(token_ids) AS BIGINT) AS id FROM ids)"""
SQL["vector_lookup"] = _with(*ENCODED, D.EMBEDDINGS_SQL, PLACES) + """
SELECT p.photo_id, pos, id, round(list_sum(vector), 6) AS total
FROM places p LEFT JOIN vectors v ON p.id % (SELECT count(*) FROM vectors) = v.photo_id"""
SQL["vector_lookup_shuffled"] = SQL["vector_lookup"]
SQL["vector_add"] = _with(*ENCODED, D.EMBEDDINGS_SQL, PLACES) + """
SELECT p.photo_id, pos, id, round(list_sum(v.vector) + list_sum(w.vector), 6) AS total
FROM places p LEFT JOIN vectors v ON p.id % (SELECT count(*) FROM vectors) = v.photo_id LEFT JOIN vectors w ON p.pos = w.photo_id"""
SQL["map_to_tokens"] = _with(D.EMBEDDINGS_SQL) + """
SELECT photo_id, CAST(place AS INTEGER) AS place, round(vector[place + 1], 6) AS c0, round(vector[place + 17], 6) AS c1,
       round(vector[place + 33], 6) AS c2, round(vector[place + 49], 6) AS c3
FROM (SELECT photo_id, vector, unnest(range(16)) AS place FROM vectors)"""
SQL["mean_tokens"] = _with(D.EMBEDDINGS_SQL) + (
    "SELECT photo_id, "
    + ", ".join(f"round(list_avg(vector[{c * 16 + 1}:{c * 16 + 16}]), 6) AS c{c}" for c in range(4))
    + " FROM vectors"
)

# Training logs.
SQL["epoch_loss"] = _with(D.BATCH_LOG_SQL) + f"""
SELECT run, epoch, round(avg(pred_loss), 12) AS pred_loss, round(avg(contrastive_loss), 12) AS contrastive_loss,
       round(avg(pred_loss + {CONTRASTIVE_WEIGHT}e0 * contrastive_loss), 12) AS total_loss, count(*) AS batches
FROM batch_log GROUP BY run, epoch"""
SQL["early_stop"] = _with(D.EPOCH_LOG_SQL) + f""",
steps AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i,
  score > greatest(coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS better
  FROM epoch_log),
gaps AS (SELECT *, i - coalesce(max(CASE WHEN better THEN i END) OVER (PARTITION BY run ORDER BY epoch), 0) >= {PATIENCE} AS stop FROM steps),
seen AS (SELECT * FROM (SELECT *, coalesce(bool_or(stop) OVER (
  PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM gaps) WHERE NOT stopped)
SELECT run, count(*) AS epochs, max(epoch) FILTER (better) AS best_epoch, max(score) FILTER (better) AS best_score,
       max(epoch) FILTER (stop) AS stop_epoch FROM seen GROUP BY run""".replace(",\nsteps", ", steps", 1)
SQL["best_epoch"] = _with(D.EPOCH_LOG_SQL) + """
SELECT run, epoch AS best_epoch, score AS best_score FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, epoch) AS r FROM epoch_log WHERE score > 0) WHERE r = 1"""

# Images.
SIZES = """sizes AS (
  SELECT doc_id AS photo_id, CAST(100 + n_chars % 900 AS INTEGER) AS height,
         CAST(100 + (length(text) * 7 + doc_id) % 900 AS INTEGER) AS width FROM documents),
resized AS (
  SELECT *, CASE WHEN height >= width THEN (256 * height) // width ELSE 256 END AS rh,
         CASE WHEN height >= width THEN 256 ELSE (256 * width) // height END AS rw FROM sizes)"""
SQL["image_geometry"] = _with(SIZES) + """
SELECT photo_id, height, width, CAST(rh AS INTEGER) AS resized_height, CAST(rw AS INTEGER) AS resized_width,
       CAST(round_even((rh - 224) / 2, 0) AS INTEGER) AS crop_top, CAST(round_even((rw - 224) / 2, 0) AS INTEGER) AS crop_left
FROM resized"""
_DRAW = f"CAST('0x' || substr(md5('{SEED}|2|%s|' || photo_id), 1, 15) AS BIGINT)"
SQL["image_augmentation"] = _with(SIZES) + f"""
SELECT photo_id, CAST(rh AS INTEGER) AS resized_height, CAST(rw AS INTEGER) AS resized_width,
       CAST({_DRAW % 'top'} % (rh + 16 - 224 + 1) AS INTEGER) AS crop_top,
       CAST({_DRAW % 'left'} % (rw + 16 - 224 + 1) AS INTEGER) AS crop_left, {_DRAW % 'flip'} % 2 = 1 AS flip
FROM resized"""
# Doubling an 8-pixel line: every output pixel is 3/4 of its own and 1/4 of the nearer neighbour, the edge repeated.
_PIXEL = "px[8 * least(greatest({y}, 0), 7) + least(greatest({x}, 0), 7) + 1]"
_OWN = _PIXEL.format(y="{y}", x="x // 2")
_NEAR = _PIXEL.format(y="{y}", x="(x // 2 + CASE WHEN x % 2 = 1 THEN 1 ELSE -1 END)")
_LINE = f"((3 * {_OWN} + {_NEAR} + 2) // 4)"
SQL["image_tensors"] = _with(D.PICTURES_SQL) + f"""
SELECT photo_id, channel, CAST(y - 1 AS INTEGER) AS y, CAST(sum((3 * own + near + 2) // 4) AS BIGINT) AS total FROM (
  SELECT photo_id, channel, y, x, {_LINE.replace('{y}', 'y // 2')} AS own,
         {_LINE.replace('{y}', '(y // 2 + CASE WHEN y % 2 = 1 THEN 1 ELSE -1 END)')} AS near
  FROM (SELECT photo_id, channel, px, y, unnest(range(16)) AS x FROM (SELECT photo_id, channel, px, unnest(range(16)) AS y FROM pictures)))
WHERE x BETWEEN 1 AND 14 AND y BETWEEN 1 AND 14 GROUP BY photo_id, channel, y"""
SQL["image_features"] = _with(D.PICTURES_SQL) + """
SELECT photo_id, channel, CAST(27 AS INTEGER) AS dim, CAST(sum(v) AS BIGINT) AS total,
       """ + ", ".join(f"count(*) FILTER (v // 32 = {b}) AS bin{b}" for b in range(8)) + """
FROM (SELECT photo_id, channel, unnest(px) AS v, generate_subscripts(px, 1) - 1 AS i FROM pictures)
WHERE i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6 GROUP BY photo_id, channel"""
SQL["encoded_images"] = _with(D.PICTURES_SQL) + """
SELECT photo_id, k, CAST(49 AS INTEGER) AS n, CAST(sum(v) AS BIGINT) AS total FROM (
  SELECT photo_id, channel, unnest(px) AS v, generate_subscripts(px, 1) - 1 AS i FROM pictures)
JOIN (SELECT CAST(unnest(range(64)) AS INTEGER) AS k) ON k % 3 = channel
WHERE i % 8 < 7 AND i // 8 < 7 GROUP BY photo_id, k"""

# Classifiers: the rows they judge, not their answers.
_TESTED = (D.CAPTIONS_SQL, LABELS, split_sql("captions"), D.EMBEDDINGS_SQL, """tested AS (
  SELECT photo_id, label_id FROM split_rows JOIN labels_by_id USING (label) WHERE split = 'test')""")
SQL["text_classifier"] = _with(*_TESTED) + "SELECT photo_id, label_id, true AS known FROM tested"
SQL["reloaded_classifier"] = SQL["text_classifier"]
SQL["image_classifier"] = _with(*_TESTED) + """
SELECT photo_id, label_id, true AS known FROM tested JOIN vectors USING (photo_id)"""
SQL["fused_classifier"] = SQL["image_classifier"]
SQL["fused_network"] = _with(*_TESTED) + """
SELECT photo_id, label_id, true AS known, true AS epochs_by_rule, true AS best_by_rule
FROM tested JOIN vectors USING (photo_id)"""
SQL["learned_vectors"] = _with(*ENCODED, PLACES) + """
SELECT photo_id, pos, id, CAST(64 AS INTEGER) AS dim, id = 0 AS zero FROM places"""
SQL["run_matrix"] = _with(*_TESTED) + """
SELECT modality || '_' || variant AS config, label_id AS class, count(*) AS support, true AS within
FROM (SELECT label_id, unnest(['text', 'image', 'both']) AS modality FROM tested JOIN vectors USING (photo_id)),
     (SELECT unnest(['raw', 'completed']) AS variant)
GROUP BY ALL"""

"""The pipeline: each stage works on what the one before kept, and its decisions take effect."""

from __future__ import annotations

import re

import corpus_pipeline
from capframe.llm import common, decontaminate, pii, quality, simhash
from capframe.llm.common import materialize, read


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf), name)
        assert docs.columns == before.columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
        seen[name] = docs
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    model = quality.fit(quality.document_stats(seen["documents"]), read(spark, sf, "labels"))
    scores = quality.score(quality.document_stats(seen["documents"]), model).collect()
    assert ids["quality"] == {r.doc_id for r in scores if r.predicted}
    groups = simhash.near_duplicates(seen["quality"]).collect()
    assert ids["simhash"] == {r.component_id for r in groups}
    bad = decontaminate.contaminated(seen["simhash"], read(spark, sf, "benchmark")).collect()
    assert ids["decontamination"] == ids["simhash"] - {r.doc_id for r in bad}
    assert ids["pii"] == ids["decontamination"]
    for r in seen["pii"].collect():
        assert r.n_chars == len(r.text) and not pii.base_spans(re.sub(r"<[A-Z]+>", "\n", r.text))
    rows = corpus_pipeline.run(spark, sf).collect()
    texts = {r.doc_id: r.text for r in seen["pii"].collect()}
    placed = dict.fromkeys(texts, 0)
    for r in rows:
        placed[r.doc_id] += r.n_tokens
    assert placed == {d: len(t.split()) for d, t in texts.items()}


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        read(spark, sf, name).where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontamination", "pii", "packing"]


def test_small_batches_keep_smaller_settings(spark):
    rows, size = (f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    before = {k: spark.conf.get(k) for k in (rows, size)}
    try:
        for given, want in (("10000", common.BATCH_ROWS), ("0", common.BATCH_ROWS), ("7", 7)):
            spark.conf.set(rows, given)
            spark.conf.set(size, "64m")
            common.small_batches(spark)
            assert spark.conf.get(rows) == str(want)
            assert spark.conf.get(size).removesuffix("b") == str(common.BATCH_BYTES)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

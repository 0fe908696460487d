"""Exact top-k, importance draws and ranked search against plain definitions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from capframe.llm import lexical, resample, topk
from capframe.llm.words import ascii_lower_words

NAN, INF = float("nan"), float("inf")


def test_words():
    assert ascii_lower_words(None) == ascii_lower_words("") == ascii_lower_words(" -_[]{}\x00\x7f") == []
    text = "Ab9-éÉ İx\x80y\x7fz_Q ŉ日本"
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    assert [w.decode() for w in ascii_lower_words(text)] == want


# ---- exact top-k ----


def slow_topk(rows, k=5, every=50):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for query in sorted({(i, tuple(q)) for i, q in whole if i % every == 0}):
        near = [(-sum(a * b for a, b in zip(query[1], x)), i) for i, x in whole if i != query[0] and len(x) == len(query[1])]
        out += [(query[0], n, i, -s) for n, (s, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def found_topk(table, every=50):
    rows = topk.search(table.where(F.col("vec_id") % every == 0), table).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows)


def test_topk_on_embeddings(spark, sf, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 128)
    monkeypatch.setattr(topk, "QUERIES", 4)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert found_topk(table) == slow_topk([(r.vec_id, r.embedding) for r in table.collect()])


@pytest.mark.parametrize("scale", [1, 3000, 2**40])
def test_lists_stop_early_and_lose_nothing(monkeypatch, scale):
    """Values small, beyond exact 32-bit and beyond exact 64-bit floats; many ties; every stopping rule."""
    monkeypatch.setattr(topk, "RESOLVE", 3)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = np.random.default_rng(2)
    x = rng.integers(-4, 5, (200, 6)) * scale
    x[50:90] = x[7]
    ids = rng.permutation(200).astype(np.int64)
    q, own = x[:11], ids[:11]
    for k in (1, 5, 300):
        for query, rows, scores in topk.best(x, ids, q, own, k):
            near = sorted((-sum(int(a) * int(b) for a, b in zip(q[query], v)), int(i)) for i, v in zip(ids, x) if i != own[query])
            assert [(-int(s), int(ids[r])) for r, s in zip(rows, scores)] == near[:k]


def test_lists_are_read_in_part():
    rng = np.random.default_rng(4)
    x = rng.integers(-100, 101, (512, 8)).astype(np.int64)
    lists = topk.Lists(x, np.float64)
    last = np.full((512, 16), np.inf)
    for _ in range(8):
        lists.read(64)
        true = np.hstack([x, x])
        assert (lists.upper[:, :8] >= x).all() and (lists.lower[:, :8] <= x).all()
        assert (lists.upper[:, 8:] <= x).all() and (lists.lower[:, 8:] >= x).all()
        assert (lists.upper[lists.seen] == true[lists.seen]).all()
        gap = np.abs(lists.upper - lists.lower)
        assert (gap <= last).all() and lists.seen.sum() == 16 * lists.depth
        last = gap
    assert (last == 0).all()


def test_topk_edges(spark):
    rows = [(0, [0.5, -0.25]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [-1.0, 0.0]), (100, [NAN, 1.0]), (150, None), (200, [INF, 0.0])]
    rows += [(250, [None, 1.0]), (300, []), (301, []), (None, [9.0, 9.0]), (7, [0.1, 0.1]), (9, [0.1, 0.1]), (8, [0.1, 0.1]), (8, [0.1, 0.1])]
    rows += [(3, [1.0, 2.0, 3.0]), (-50, [0.003, -0.003]), (400, [1.0, 2.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = table.select("*", *[F.lit("x").alias(c) for c in ("shard", "block", "query", "query_id", "x", "score", "rank")])
    assert found_topk(clash) == slow_topk(rows)
    assert found_topk(table.where("false")) == []
    assert topk.search(table.where("false"), table).count() == 0
    far = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    assert [(r[1], r[2], r[3]) for r in found_topk(far)] == [(1, 1, 2**63 - 1), (2, 2, -(2**63))]


def test_topk_hot_vector(spark, monkeypatch):
    """A third of the rows are one vector and one id: shards stay even and ties go to smaller ids."""
    monkeypatch.setattr(topk, "SHARD", 64)
    rng = np.random.default_rng(8)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(200, 4)))]
    rows += [(1000 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(100)] + [(77, [1.0, 1.0, 1.0, 1.0])] * 50
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_topk(table) == slow_topk(rows)


# ---- importance draws ----


def slow_draw(docs, target, percent=10, least=20, buckets=10_000, run=1):
    def features(text):
        words = [w.decode() for w in ascii_lower_words(text)]
        return words, [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    out, fit = [], []
    for at, (doc_id, text) in enumerate(docs):
        words, own = features(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None])
        if len(words) >= least:
            fit.append((-score, doc_id is None, doc_id or 0, at))
    for rank, (*_, at) in enumerate(sorted(fit)[: percent * len(fit) // 100], 1):
        out[at][4] = rank
    return sorted(map(tuple, out), key=repr)


def drawn(table, target, **more):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in resample.draw(table, target, **more).collect()), key=repr)


def test_draw_on_documents(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, aims = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    assert drawn(docs, target) == slow_draw(rows, aims)
    assert drawn(docs, target, percent=37, least_words=1, buckets=64, run=3) == slow_draw(rows, aims, 37, 1, 64, 3)


def test_draw_edges(spark):
    long = " ".join(f"w{i % 7}" for i in range(40))
    rows = [(i, f"{long} x{i % 3}") for i in range(30)] + [(5, f"{long} x2"), (None, long), (None, None), (90, ""), (91, "few words")]
    rows += [(92, "big " * 30_000), (93, "é " * 20), (94, "- _ ?")]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(rows, schema)
    target = spark.createDataFrame([("w1 w2 w3",), (None,), ("",)], "text string")
    clash = docs.select("*", *[F.lit("x").alias(c) for c in ("score", "words", "down", "gone", "id", "row", "rn")])
    assert drawn(clash, target, percent=50) == slow_draw(rows, ["w1 w2 w3", None, ""], 50)
    assert drawn(docs, target.where("false"), percent=100) == slow_draw(rows, [], 100)
    assert all(r[4] is None for r in drawn(docs, target, percent=0))
    assert drawn(docs.where("false"), target) == []
    twice = spark.createDataFrame(rows[:4] * 3, schema)  # equal rows at the cutoff: the number drawn stays exact
    ranks = sorted(r[4] for r in drawn(twice, target, percent=50) if r[4])
    assert ranks == [1, 2, 3, 4, 5, 6]


def test_bracket_widens_until_it_holds_the_cutoff(spark):
    rng = random.Random(1)
    scores = [rng.choice([7, 7, 7, rng.randrange(1000)]) for _ in range(4000)]
    rows = spark.createDataFrame([(s,) for s in scores], "score long")
    good = rows.agg(F.kll_sketch_agg_bigint("score", F.lit(resample.SKETCH))).first()[0]
    wrong = spark.createDataFrame([(5000 + s,) for s in range(100)], "score long").agg(F.kll_sketch_agg_bigint("score")).first()[0]
    order = sorted(scores, reverse=True)
    for sketch in (good, wrong):
        for wanted in (1, 17, 900, 2500, 4000):
            low, high, above = resample.bracket(rows, wanted, len(scores), bytes(sketch))
            assert low <= order[wanted - 1] <= high and above == sum(s > high for s in scores) < wanted


# ---- ranked search ----


def slow_search(docs, items, k=10):
    texts = [(i, [w.decode() for w in ascii_lower_words(t)]) for i, t in docs]
    n_all, l_all = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    counted = [(i, len(w), Counter(w)) for i, w in texts]
    df = Counter(t for _, _, c in counted for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, []).extend(w.decode() for w in ascii_lower_words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc_id, n, tf in counted:
            m = 25 + (75 * n * n_all) // max(l_all, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in terms
                if tf[t]
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found_search(docs, items, k=10):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(docs, items, k).collect()), key=repr)


def test_search_on_documents(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = slow_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found_search(docs, items) == want
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 300)
    assert found_search(docs.repartition(3), items) == want


def test_search_edges(spark):
    words = [f"t{i}" for i in range(150)]
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(120)]
    docs += [(500 + i, "same text here") for i in range(30)] + [(3, "same text here"), (None, "same text here"), (4, None), (5, ""), (6, "?!")]
    docs += [(700, "t1 " * 40_000)]
    items = [(1, " ".join(words)), (1, "t1 t1 T1"), (2, "same text t5"), (3, None), (4, ""), (5, "unheard of"), (None, "t1"), (6, "same"), (7, " ".join(words[:64]))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    clash = table.select("*", *[F.lit("x").alias(c) for c in ("n", "terms", "tfs", "row", "score", "item_id")])
    for k in (1, 10, 40):
        assert found_search(clash, asked.withColumn("doc_id", F.lit("y")), k) == slow_search(docs, items, k)
    assert found_search(table.where("false"), asked) == found_search(table, asked.where("false")) == []
    everywhere = spark.createDataFrame([(i, "a b") for i in range(2000)], "doc_id long, text string")
    assert found_search(everywhere, spark.createDataFrame([(1, "a")], "item_id long, text string")) == slow_search([(i, "a b") for i in range(2000)], [(1, "a")])


def test_few_masks_are_evaluated():
    """Groups that cannot reach the ranks are left alone, and the ranks stay exact."""
    rng = np.random.default_rng(3)
    terms = [np.unique(rng.zipf(1.5, 30) % 50).astype(np.int32) for _ in range(2000)]
    tfs = [rng.integers(1, 4, len(t)).astype(np.int32) for t in terms]
    offsets = np.r_[0, np.cumsum([len(t) for t in terms])]
    n = rng.integers(40, 200, 2000)
    batch = lexical.Batch(n, offsets, np.concatenate(terms), np.concatenate(tfs), (2000, int(n.sum())))
    asked, gain = np.arange(1, 12, dtype=np.int32), rng.integers(100, 8000, 11)
    weight, top = np.zeros(50, dtype=np.int64), lexical.Best(10)
    ids = rng.permutation(2000).astype(np.int64)
    done = lexical.rank_batch(batch, ids, np.zeros(2000, bool), asked, gain, weight, top)
    masks = len(lexical.groups(batch.masks(asked)[0])[0])
    assert done < masks / 2 and not weight.any()
    weight[asked] = gain
    scores = batch.scores(np.arange(2000), weight)
    assert [tuple(r[:2]) for r in top.rows] == sorted(zip(scores.tolist(), ids.tolist()), key=lambda r: (-r[0], r[1]))[:10]

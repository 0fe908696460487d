"""SimHash and embedding near-duplicates against every pair, compared one by one."""

from __future__ import annotations

import math
import os
import random
import re

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64

from capframe.llm import neighbours, simhash
from capframe.llm.components import components
from capframe.session import materialize, scratch_dir


def reach(ids, links):
    """Smallest id each id reaches."""
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > len(hashes) / 2)


def test_fingerprint_by_definition():
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É É x y", "a b c a b c a b c d", "x " * 3000]
    for text in texts:
        assert simhash.fingerprint(text) == slow_fingerprint(text), text


def test_simhash_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fps)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    found = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in found} == fps
    assert {r.doc_id: r.component_id for r in found} == reach(ids, links)


def test_similar_fingerprints_lose_no_link(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) & 0xFFFF00FFFF0000FF for _ in range(20)]
    fps = {0}
    for c in centres:
        fps.add(c)
        for _ in range(15):
            near = c
            for b in rng.sample(range(64), rng.randint(1, 5)):
                near ^= 1 << b
            fps.add(near)
    signed = sorted(f - 2**64 if f >> 63 else f for f in fps)
    want = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3}
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    layout = simhash.plan_partitions(rows)
    assert sum(t + 1 for _, t in layout) == 4
    found = simhash.similar_fingerprints(rows, layout).distinct().collect()
    assert {tuple(r) for r in found} == want
    fixed = [(list(range(40)), 1), (list(range(40, 64)), 1)]  # unequal partitions, thresholds above 0
    assert {tuple(r) for r in simhash.similar_fingerprints(rows, fixed).distinct().collect()} == want


def test_allocate_is_least():
    costs = [[0, 5, 6, 30, 90], [0, 1, 50, 60, 70], [0, 9, 9, 9, 9]]
    total, thresholds = simhash.allocate([[float(c) for c in row] for row in costs], 4)
    best = min(
        costs[0][a] + costs[1][b] + costs[2][4 - a - b] for a in range(5) for b in range(5 - a)
    )
    assert total == best and sum(t + 1 for t in thresholds) == 4


def test_simhash_edges(spark):
    schema = "doc_id long, text string, fp string, component_id int, part int"
    rows = [(3, "a b c d", "x", 1, 0), (1, "A b  c d", "y", 2, 0), (3, "a b c d", "x", 1, 0), (None, "a b c d", "z", 3, 0)]
    rows += [(7, None, "n", 0, 0), (5, " ", "e", 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    found = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == [(-1, 1), (1, 1), (3, 1), (3, 1), (5, 5), (7, 5)]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 5]
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.keep_first(docs.where("false")).count() == 0


def test_first_copies_with_repeated_ids(spark):
    """Whole rows, against the rule: an id stays if one of its rows is first in its group, with one row."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(60)) for _ in range(12)]
    rows = [(rng.choice([None, *range(20)]), rng.choice(texts), f"s{i}", i) for i in range(120)]
    rows += [(100 + i, " ".join(rng.choice("qrstuvwxyz") * 4 for _ in range(50)), "own", 1000 + i) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, stays long").repartition(5)
    found = simhash.near_duplicates(docs).collect()
    first = {r.doc_id for r in found if r.doc_id is not None and r.doc_id == r.component_id}
    got = simhash.keep_first(docs).collect()
    assert {tuple(r) for r in got} <= set(rows)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(first)
    assert sorted(r.stays for r in got if r.doc_id is None) == sorted(r[3] for r in rows if r[0] is None)
    assert first >= set(range(100, 115)) and len(first) < 15 + 20


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 180)] + [(500, k) for k in range(501, 560)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    rows = spark.createDataFrame([*links, (None, 5), (6, 6)], "a long, b long")
    ids = {i for a, b in links if a != b for i in (a, b)}
    want = reach(ids, [x for x in links if x[0] != x[1]])
    assert {r.id: r.component for r in components(rows).collect()} == want


def slow_vectors(rows):
    good = {i: v for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    good = {i: [x / max(map(abs, v)) for x in v] if max(map(abs, v)) > 1e100 or max(map(abs, v)) < 1e-100 else v for i, v in good.items()}
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in good.items()}
    ids = sorted(unit)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9
    ]
    degree = dict.fromkeys((i for i, _ in rows), 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    low = reach([i for i, _ in rows], links)
    return {i: (degree[i], low[i], low[i] == i) for i, _ in rows}


def test_vectors_on_embeddings(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_vectors(table).collect()}
    assert found == slow_vectors(rows)


def test_vectors_with_small_leaves_and_blocks(spark, monkeypatch):
    """Deep trees and leaves of several blocks: recall of planted near copies, no link below the bound, none twice."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    near = centres[rng.integers(0, 40, 400)] + 0.15 * rng.normal(size=(400, 24))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(near)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in neighbours.near_vectors(table, leaf=60).collect()}
    want = {i: n for i, (n, _, _) in slow_vectors(rows).items()}
    assert all(found[i] <= n for i, n in want.items())
    assert sum(found.values()) >= 0.9 * sum(want.values())


def planted_pairs(n, pairs, seed, d=64):
    """Random directions, and partners of the first of them at cosines of 0.90 to 0.92."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, side = x[:pairs], rng.normal(size=(pairs, d))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.92, (pairs, 1))
    return np.vstack([x, c * a + np.sqrt(1 - c * c) * side])


def test_recall_of_the_trees_as_they_are():
    """50,000 vectors and 5,000 links just above the bound, at the default parameters."""
    x = planted_pairs(50_000, 5000, 1)
    trees = [neighbours.fit_tree(x, len(x), 11 + t, neighbours.LEAF, 0.9, neighbours.SPILL) for t in range(neighbours.TREES)]
    rows, codes = neighbours.filed_codes(x, trees)
    lies_in = {}
    for row, code in zip(rows.tolist(), codes.tolist()):
        lies_in.setdefault(row, set()).add(code)
    met = np.mean([bool(lies_in[p] & lies_in[50_000 + p]) for p in range(5000)])
    assert met >= 0.99
    assert np.bincount(codes).max() <= 2 * neighbours.LEAF and len(rows) < 2.2 * neighbours.TREES * len(x)


def test_recall_of_the_whole_operator(spark):
    x = planted_pairs(6000, 1500, 2)
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(table, leaf=200).collect()}
    linked = [p for p in range(1500) if found[6000 + p] == (1, p)]
    assert len(linked) >= 0.98 * 1500 and all(found[p] == (0, p) for p in range(1500, 6000))


def test_many_alike_in_one_leaf(spark):
    """A crowd that no split parts: every link counted once, whatever number of leaves it shares."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=64) + 0.05 * rng.normal(size=(700, 64))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(table, leaf=50).collect()}
    assert found == {i: (699, 0) for i in range(700)}


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0])]
    rows += [(8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e200, 0.0]), (13, [1e-200, 0.0])]
    schema = "vec_id long, embedding array<double>"
    table = spark.createDataFrame(rows, schema)
    clash = table.select("*", F.lit("x").alias("hash"), F.lit(1).alias("n_links"), F.lit(2).alias("leaf"))
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_vectors(clash).collect()}
    assert found == slow_vectors(rows)
    assert neighbours.near_vectors(table.where("false")).count() == 0
    again = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], schema)
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in neighbours.near_vectors(again).collect()) == [
        (0, 0, None),
        (1, 1, 1),
        (1, 1, 1),
    ]


def bytes_on_disk(spark):
    """Of the scratch tables and of the shuffles."""
    folders = [scratch_dir(spark).removeprefix("file:")]
    folders += [str(f) for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = [os.path.join(d, f) for top in folders for d, _, names in os.walk(top) for f in names]
    return sum(os.path.getsize(f) for f in files if f.endswith(".parquet") or "/shuffle_" in f)


def test_vectors_are_kept_once_on_disk(spark):
    """Copies for the trees are sent in passes that end with their shuffles: what stays is the table, not eleven of it."""
    x = planted_pairs(16_000, 500, 4)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    table = materialize(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "given")
    before = bytes_on_disk(spark)
    links = neighbours.near_vectors(table).where("n_links > 0").count()
    assert 0.98 * 1000 <= links <= 1000
    assert bytes_on_disk(spark) - before < 2 * 4 * x.size


def test_vectors_in_many_passes(spark, monkeypatch):
    """Passes of a cell or two, and of two blocks of one, give the rows of one pass."""
    rng = np.random.default_rng(8)
    x = np.vstack([planted_pairs(900, 300, 6, 16), rng.normal(size=16) + 0.1 * rng.normal(size=(100, 16))])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(5000 + i, [1.0, float(i)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    once = {tuple(r) for r in neighbours.near_vectors(table, leaf=100, trees=3).collect()}
    monkeypatch.setattr(neighbours, "BLOCK", 120)
    monkeypatch.setattr(neighbours, "PASS", 0.5)
    monkeypatch.setattr(neighbours, "PASS_BYTES", 1)
    assert {tuple(r) for r in neighbours.near_vectors(table, leaf=100, trees=3).collect()} == once
    assert sum(r[1] > 0 for r in once) >= 600


def test_vectors_of_one_hash(spark, monkeypatch):
    """Different vectors may have one hash; their rows are told apart by their parts."""
    rng = np.random.default_rng(9)
    near = rng.normal(size=(12, 8))[rng.integers(0, 12, 60)] + 0.2 * rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*near, *near[:10]])] + [(90, None), (91, [0.0, 0.0]), (92, [-0.0, 1.0]), (93, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "_hash", lambda vector: F.pmod(F.xxhash64(vector), F.lit(5)))
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_vectors(table).collect()}
    assert found == slow_vectors(rows)

"""Ranked lexical search by presence masks.

Documents become postings of the items' terms once. A task then holds a batch of postings by term:
for every item, bitmap operations give each document the mask of the item's terms it holds, and
documents of equal masks form a group. A mask's greatest possible score follows from the greatest
weight of each of its terms in the batch. Masks are evaluated from the greatest possible score down,
until the next cannot reach the item's ranks any more; the best so far is kept from batch to batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capframe.llm.common import materialize
from capframe.llm.words import ascii_lower_words

K = 10
SATURATION = 8  # weight of the length term
LENGTH_SHARE = 75  # percent of the length term that follows the document's length
BLOCK_TERMS = 500_000  # (item, term) rows broadcast at once
CHUNK = 256  # documents evaluated together
_LAST = np.iinfo(np.int64).max


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): the terms of all rows of an item; null ids are left out."""

    def terms(frames: Iterable):
        import pandas as pd

        for frame in frames:
            found = [(i, w.decode("utf-8", "surrogatepass"), 1) for i, t in zip(frame["item_id"], frame["text"]) for w in ascii_lower_words(t)]
            yield pd.DataFrame(found, columns=["item_id", "term", "times"])

    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    counted = rows.mapInPandas(terms, "item_id long, term string, times long")
    return counted.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the whole text), terms (places in ``vocabulary``, ascending) and tfs of every row."""

    def batches(frames: Iterable):
        import pandas as pd

        for frame in frames:
            n, terms, tfs = [], [], []
            for text in frame["text"]:
                words = ascii_lower_words(text)
                known = np.fromiter(map(vocabulary.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                term, tf = np.unique(known[known >= 0], return_counts=True)
                n.append(len(words))
                terms.append(term)
                tfs.append(tf.astype(np.int32))
            yield pd.DataFrame({"row": frame["row"], "n": np.array(n, dtype=np.int64), "terms": terms, "tfs": tfs})

    rows = docs.select(F.col("doc_id").cast("string").alias("row"), "text")
    out = rows.mapInPandas(batches, "row string, n long, terms array<int>, tfs array<int>")
    return out.select(F.col("row").cast("long").alias("doc_id"), "n", "terms", "tfs")


class Batch:
    """Postings of some documents, by document and by term, with the weight factor of each."""

    def __init__(self, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, share: tuple[int, int]):
        docs, words = share
        m = (100 - LENGTH_SHARE) + (LENGTH_SHARE * n * docs) // max(words, 1)
        self.size, self.offsets, self.terms = len(n), offsets, terms
        row = np.repeat(np.arange(len(n)), np.diff(offsets))
        tf = tfs.astype(np.int64)
        self.factor = (1_000_000_000 * tf) // (1000 * tf + SATURATION * m[row])
        order = np.argsort(terms, kind="stable")
        self.rows = row[order]
        by_term = terms[order]
        self.starts = np.flatnonzero(np.r_[True, by_term[1:] != by_term[:-1]]) if len(by_term) else np.zeros(0, int)
        self.ends = np.r_[self.starts[1:], len(by_term)].astype(int)
        self.place = {int(t): i for i, t in enumerate(by_term[self.starts])}
        self.greatest = np.maximum.reduceat(self.factor[order], self.starts) if len(by_term) else np.zeros(0, int)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A bit per term of the item in 64-bit words, by document; greatest factor of each term here."""
        bits = np.zeros((self.size, -(-len(terms) // 64)), dtype=np.uint64)
        greatest = np.zeros(len(terms), dtype=np.int64)
        for j, term in enumerate(terms.tolist()):
            at = self.place.get(term)
            if at is not None:
                bits[self.rows[self.starts[at] : self.ends[at]], j // 64] |= np.uint64(1 << (j % 64))
                greatest[j] = self.greatest[at]
        return bits, greatest

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of documents that hold a term at least; ``weight`` by term, 0 for others."""
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.offsets[rows] - (ends - sizes), sizes)
        return np.add.reduceat(weight[self.terms[at]] * self.factor[at], ends - sizes)


def groups(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct masks but the empty one, the documents in order of their mask, and the groups' ends."""
    held = np.flatnonzero(bits.any(axis=1))
    own = bits[held]
    order = np.argsort(own[:, 0], kind="stable") if own.shape[1] == 1 else np.lexsort(own.T)
    own, held = own[order], held[order]
    new = np.r_[True, (own[1:] != own[:-1]).any(axis=1)] if len(own) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    return own[starts], held, np.r_[starts, len(held)]


class Best:
    """The k best (score, id) of an item; null ids come last among equals."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((0, 3), dtype=np.int64)

    @property
    def floor(self) -> int:
        """A score below this cannot enter."""
        return int(self.rows[-1, 0]) if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, gone: np.ndarray) -> None:
        keep = scores >= max(self.floor, 1)
        rows = np.vstack([self.rows, np.column_stack([scores[keep], ids[keep], gone[keep]]).astype(np.int64)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]


def rank_batch(batch: Batch, ids: np.ndarray, gone: np.ndarray, terms: np.ndarray, gain: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Enter a batch's documents into an item's best; how many masks were evaluated.

    ``terms`` and ``gain`` are the item's terms and their weights times their repeats; ``weight`` is
    a zeroed array over the vocabulary to be filled and zeroed again.
    """
    bits, greatest = batch.masks(terms)
    distinct, docs, ends = groups(bits)
    held = (distinct[:, np.arange(len(terms)) // 64] >> (np.arange(len(terms)) % 64).astype(np.uint64)) & np.uint64(1)
    most = held.astype(np.int64) @ (gain * greatest)
    order = np.argsort(-most, kind="stable")
    weight[terms] = gain
    done = 0
    while done < len(order) and most[order[done]] >= best.floor:
        take, rows = done, []
        while take < len(order) and sum(map(len, rows)) < CHUNK and most[order[take]] >= best.floor:
            rows.append(docs[ends[order[take]] : ends[order[take] + 1]])
            take += 1
        chosen = np.concatenate(rows)
        best.add(batch.scores(chosen, weight), ids[chosen], gone[chosen])
        done = take
    weight[terms] = 0
    return done


def _rank(table: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], size: int, share: tuple[int, int], k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's best of every item."""

    def tasks(batches: Iterable):
        import pyarrow as pa

        best = [Best(k) for _ in items]
        weight = np.zeros(size, dtype=np.int64)
        for b in batches:
            offsets = b["terms"].offsets.to_numpy().astype(np.int64)
            batch = Batch(b["n"].to_numpy(), offsets - offsets[0], b["terms"].flatten().to_numpy(), b["tfs"].flatten().to_numpy(), share)
            ids = b["doc_id"].fill_null(int(_LAST)).to_numpy()
            gone = b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            for (_, terms, gain), top in zip(items, best):
                rank_batch(batch, ids, gone, terms, gain, weight, top)
        for (item, _, _), top in zip(items, best):
            score, doc, null = (top.rows[:, i] for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), item, dtype=np.int64)), pa.array(doc, mask=null.astype(bool)), pa.array(score)],
                names=["item_id", "doc_id", "score"],
            )

    return table.mapInArrow(tasks, "item_id long, doc_id long, score long")


def term_weights(count: int, holding: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N+2) / (2df+1))) of terms held by so many of N documents."""
    return np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(df) + 1))) for df in holding], dtype=np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents (doc_id, text) that score highest for every item (item_id, text).

    Scores above 0 only; equal scores by ascending doc_id, null ids last. Every row of ``docs`` is a
    document of its own, whatever its id. Null texts hold no term. Rows that repeat an item_id are one
    item with all their terms; null item_ids are left out. Items are answered in blocks of bounded size.
    """
    terms = materialize(item_terms(items), "item-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    dealt = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found, share = [], None
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).collect()  # some BLOCK_TERMS rows
        words = sorted({r["term"] for r in rows})
        place = {w: i for i, w in enumerate(words)}
        table = materialize(postings(docs, {w.encode("utf-8", "surrogatepass"): i for w, i in place.items()}), "postings")
        if share is None:
            share = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = np.zeros(len(words), dtype=np.int64)
        for term, df in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            holding[term] = df
        weights = term_weights(share[0], holding)
        own: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            own.setdefault(r["item_id"], []).append((place[r["term"]], r["times"]))
        asked = []
        for item, pairs in sorted(own.items()):
            at = np.array(sorted(pairs), dtype=np.int64)
            asked.append((item, at[:, 0].astype(np.int32), weights[at[:, 0]] * at[:, 1]))
        found.append(_ranked(_rank(table, asked, len(words), tuple(share), k), k))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _ranked(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

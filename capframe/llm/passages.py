"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where a k-word hash is the least of its window (a minimiser), so equal
passages keep suffixes at equal places. Suffixes whose first k words occur more than once are sorted
by all tasks together; each is compared with its neighbours and the match is extended to the left
and right. What neighbours leave open is settled by hashes of whole least-length windows. Of texts
that are alike word for word one goes through this; the others are repeated as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from capframe.llm.common import materialize

LEAST = 50  # words of a passage
SEED = 16  # words that pick and start a suffix

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


class WordHashes(dict):
    """32-bit hash of a word, remembered; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 32
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint32, count=len(words))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive entries: a polynomial in ``_STEP``, from running sums modulo 2^64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes.astype(np.uint64) * down)])
    out = (sums[width:] - sums[:n]) * up[width - 1 :]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``_STEP`` and of its inverse modulo 2^64, kept for the next text."""
    if len(_kept[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        for i, base in enumerate((int(_STEP), pow(int(_STEP), -1, 1 << 64))):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _kept[i] = np.cumprod(factors, dtype=np.uint64)
    return _kept[0][:n], _kept[1][:n]


_kept = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def minimisers(seeds: np.ndarray, window: int) -> np.ndarray:
    """Places of the least seed of every ``window`` consecutive ones, the first of equals."""
    if not len(seeds):
        return np.zeros(0, dtype=np.int64)
    if len(seeds) <= window:
        return np.array([seeds.argmin()])
    views = np.lib.stride_tricks.sliding_window_view(seeds, window)
    least = np.concatenate(
        [views[i : i + 8192].argmin(axis=1) + np.arange(i, min(i + 8192, len(views))) for i in range(0, len(views), 8192)]
    )
    return np.unique(least)


def _texts(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """doc_id, n (words), digest of the words, and the keys of the kept suffixes.

    Texts of fewer than ``least`` words hold no passage and keep nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(frames: Iterable):
        import pandas as pd
        from xxhash import xxh128_hexdigest

        words = WordHashes()
        none = np.zeros(0, np.int64)
        for frame in frames:
            rows = []
            for text in frame["text"]:
                own = words.of(text)
                if len(own) < least:
                    rows.append((len(own), None, none))
                    continue
                seeds = rolled(own, seed)
                keys = seeds[minimisers(seeds, least - seed + 1)]
                rows.append((len(own), xxh128_hexdigest(own.tobytes()), keys.view(np.int64)))
            out = pd.DataFrame(rows, columns=["n", "digest", "keys"])
            out.insert(0, "doc_id", frame["doc_id"])
            yield out

    return docs.mapInPandas(batches, f"doc_id {kind}, n long, digest string, keys array<long>")


def _contexts(docs: DataFrame, reach: int, seed: int) -> DataFrame:
    """Suffixes with a repeated seed: key, place, and ``reach`` word hashes after the seed and before it (nearest first).

    ``docs`` has ``wanted``, the repeated keys of each text. Every passage of the least length around a
    seed lies within its words and ``reach`` to either side. ``after`` and ``before`` count the words
    there are; places beyond the text are filled with 0.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(frames: Iterable):
        import pandas as pd

        hashes = WordHashes()
        right = seed + np.arange(reach)
        left = -1 - np.arange(reach)
        for frame in frames:
            parts, held = [], 0
            for doc_id, text, wanted in zip(frame["doc_id"], frame["text"], frame["wanted"]):
                words = hashes.of(text)
                seeds = rolled(words, seed).view(np.int64)
                pos = minimisers(seeds.view(np.uint64), reach + 1)
                pos = pos[np.isin(seeds[pos], wanted)]
                line = np.concatenate([np.zeros(reach, np.uint32), words, np.zeros(reach, np.uint32)]).astype(">u4")
                parts.append((doc_id, pos, seeds[pos], line[(pos + reach)[:, None] + right], line[(pos + reach)[:, None] + left], len(words)))
                held += len(pos)
                if held >= 20_000:
                    yield _context_frame(pd, parts, reach, seed)
                    parts, held = [], 0
            if parts:
                yield _context_frame(pd, parts, reach, seed)

    return docs.mapInPandas(batches, f"doc_id {kind}, pos long, key long, right binary, left binary, after int, before int")


def _context_frame(pd, parts: list, reach: int, seed: int):
    sizes = [len(p[1]) for p in parts]
    pos = np.concatenate([p[1] for p in parts])
    n = np.repeat([p[5] for p in parts], sizes)
    lines = [np.empty(len(pos), dtype=object) for _ in range(2)]
    for side, out in enumerate(lines):
        flat = np.concatenate([p[3 + side] for p in parts]).tobytes()
        out[:] = [flat[i : i + 4 * reach] for i in range(0, 4 * reach * len(pos), 4 * reach)] if reach else b""
    return pd.DataFrame(
        {
            "doc_id": pd.Series([p[0] for p in parts]).repeat(sizes).reset_index(drop=True),
            "pos": pos,
            "key": np.concatenate([p[2] for p in parts]),
            "right": lines[0],
            "left": lines[1],
            "after": np.minimum(n - pos - seed, reach).astype(np.int32),
            "before": np.minimum(pos, reach).astype(np.int32),
        }
    )


class Sorted:
    """Some sorted suffixes with whole groups of equal keys, as arrays."""

    def __init__(self, frame, reach: int, seed: int, least: int):
        self.frame, self.reach, self.seed, self.least = frame, reach, seed, least
        self.key, self.pos = frame["key"].to_numpy(), frame["pos"].to_numpy()
        self.after, self.before = frame["after"].to_numpy().astype(np.int64), frame["before"].to_numpy().astype(np.int64)
        words = lambda c: np.frombuffer(b"".join(frame[c]), ">u4").reshape(len(frame), reach)
        self.right, self.left = words("right"), words("left")
        self.starts = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]])
        self.in_order = np.arange(len(self.key))
        self.by_left = np.lexsort((np.unique(frame["left"].to_numpy(), return_inverse=True)[1], self.key))
        self.group = np.repeat(np.arange(len(self.starts)), np.diff(np.r_[self.starts, len(self.key)]))

    def _common(self, words: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Words that each row shares with the next one from the seed on."""
        if not self.reach:
            return np.zeros(len(words) - 1, np.int64)
        same = words[1:] == words[:-1]
        return np.minimum.reduce([np.where(same.all(axis=1), self.reach, same.argmin(axis=1)), there[1:], there[:-1]])

    def spans(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours in ``order``: start and end of each row's longer match (0, 0: none), most words shared right and left.

        In order of the words after the seed some neighbour shares the most of those, in order of the
        words before it the most of those.
        """
        n = len(self.key)
        pos, key = self.pos[order], self.key[order]
        start, end, right_far, left_far = np.zeros((4, n), np.int64)
        right, left = self._common(self.right[order], self.after[order]), self._common(self.left[order], self.before[order])
        alike = key[1:] == key[:-1]
        long = alike & (left + self.seed + right >= self.least)
        for own in (slice(1, None), slice(0, n - 1)):  # the neighbour before, the one after
            right_far[own] = np.maximum(right_far[own], np.where(alike, self.seed + right, 0))
            left_far[own] = np.maximum(left_far[own], np.where(alike, left, 0))
            better = long & (left + self.seed + right > end[own] - start[own])
            start[own] = np.where(better, pos[own] - left, start[own])
            end[own] = np.where(better, pos[own] + self.seed + right, end[own])
        back = np.argsort(order)
        return start[back], end[back], right_far[back], left_far[back]

    def matches(self, edges: list[int]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Spans of neighbours in either order; which windows (one per words before the suffix) must be hashed, and
        which of all windows those spans leave out.

        A third suffix may share a window with a row of which neither its neighbours by the right nor
        those by the left share all. A window is open if the row's spans leave it out though some other
        suffix agrees up to its end, and one up to its start; then all rows of its group of which that
        holds show theirs. Groups at the ends of a task (``edges``) may go on elsewhere: they show all, of
        rows alike in all their words one.
        """
        *by_right, far, _ = self.spans(self.in_order)
        *by_left, _, far_left = self.spans(self.by_left)
        back = np.arange(self.reach + 1)
        there = (back <= self.before[:, None]) & (self.least - back <= (self.seed + self.after)[:, None])
        near = there & (self.least - back <= far[:, None]) & (back <= far_left[:, None])
        left_out, at = there.copy(), self.pos[:, None] - back
        for start, end in (by_right, by_left):
            left_out &= ~((at >= start[:, None]) & (at + self.least <= end[:, None]))
        asked = np.logical_or.reduceat(near & left_out, self.starts, axis=0)
        asked[np.diff(np.r_[self.starts, len(self.key)]) <= 2] = False
        shown = near & asked[self.group]
        at_edge = np.isin(self.group, edges)
        again = np.zeros(len(self.key), dtype=bool)
        again[1:] = (self.key[1:] == self.key[:-1]) & (self.after[1:] == self.after[:-1]) & (self.before[1:] == self.before[:-1])
        again[1:] &= (self.right[1:] == self.right[:-1]).all(axis=1) & (self.left[1:] == self.left[:-1]).all(axis=1)
        whole = (self.after == self.reach) & (self.before == self.reach)  # such rows cover each other's windows
        shown[at_edge] = there[at_edge] & ~(again & whole)[at_edge, None]
        return [tuple(by_right), tuple(by_left)], shown, left_out

    def windows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, hash) of the wanted windows, put together from the words left and right of the seed."""
        rows = np.flatnonzero(wanted.any(axis=1))
        out = []
        for some in (rows[i : i + 20_000] for i in range(0, len(rows), 20_000)):
            sides = []
            for words in (self.left[some], self.right[some]):
                sums = np.zeros((len(some), self.reach + 1), dtype=np.uint64)
                for k in range(self.reach):
                    sums[:, k + 1] = (sums[:, k] + words[:, k] + np.uint64(1)) * _STEP
                sides.append(sums)
            i, back = np.nonzero(wanted[some])
            own = self.key[some].view(np.uint64)[i] + back.astype(np.uint64) * _STEP
            for sums, k in ((sides[0], back), (sides[1], self.reach - back)):
                own = (own ^ (own >> np.uint64(31))) * _MIX + sums[i, k]
            out.append((some[i], self.pos[some][i] - back, (own ^ (own >> np.uint64(29))).view(np.int64)))
        return tuple(np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]) for k in range(3))


def _matches(sorted_rows: DataFrame, reach: int, seed: int, least: int) -> DataFrame:
    """Spans (doc_id, start, end) of matches, and hashes (doc_id, start, window) of windows that may stand elsewhere too.

    Equal windows have equal keys. So what a task holds of a group settles its windows there and then,
    and only groups at a task's ends give hashes, one place for each.
    """
    kind = sorted_rows.schema["doc_id"].dataType.simpleString()

    def found(frame, edges: list[int]):
        import pandas as pd

        part, ids = Sorted(frame, reach, seed, least), frame["doc_id"]
        spans, shown, left_out = part.matches(edges)
        rows, at, window = part.windows(shown)
        _, first, kind_of, count = np.unique(window, return_index=True, return_inverse=True, return_counts=True)
        twice = (count[kind_of] > 1) & left_out[rows, part.pos[rows] - at]
        spans.append((at[twice], at[twice] + least, rows[twice]))
        once = np.sort(first[np.isin(part.group[rows[first]], edges)])
        rows, at, window = rows[once], at[once], window[once]
        for start, end, *which in spans:
            own = np.flatnonzero(end > start)
            of = which[0][own] if which else own
            yield pd.DataFrame({"doc_id": ids.iloc[of].to_numpy(), "start": start[own], "end": end[own], "window": None})
        for some in (slice(i, i + 50_000) for i in range(0, len(rows), 50_000)):
            yield pd.DataFrame({"doc_id": ids.iloc[rows[some]].to_numpy(), "start": at[some], "end": None, "window": window[some]})

    def batches(frames: Iterable):
        import pandas as pd

        pending, first = [], True
        for frame in frames:
            pending.append(frame)
            key = frame["key"].to_numpy()
            if not len(key) or pending[0]["key"].iloc[0] == key[-1]:
                continue  # one group so far
            held = pd.concat(pending, ignore_index=True)
            cut = int(np.flatnonzero(held["key"].to_numpy() != key[-1])[-1]) + 1
            yield from found(held.iloc[:cut].reset_index(drop=True), [0] if first else [])
            pending, first = [held.iloc[cut:].reset_index(drop=True)], False
        held = pd.concat(pending, ignore_index=True) if pending else []
        if len(held):
            yield from found(held, [0])  # the last group, and the first if there is no other

    return sorted_rows.mapInPandas(batches, f"doc_id {kind}, start long, end long, window long")


def repeated(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id and spans of words (start, end) of every passage of ``least`` words or more found elsewhere.

    "Elsewhere" is another document or another place of the same one. Words are runs without white
    space, compared as they are. Spans of a document are merged where they overlap. Null texts and
    texts shorter than ``least`` words have none; rows with null doc_ids are left out; rows that
    repeat a doc_id count as one more text each, and their spans are listed together.
    """
    reach = least - seed
    own = docs.where("doc_id is not null").select("doc_id", "text")
    texts = materialize(_texts(own, least, seed), "texts")
    alike = texts.where("digest is not null").groupBy("digest").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"))
    copies = texts.select("doc_id", "n", "digest").join(alike.where("rows > 1").hint("merge"), "digest")
    copies = materialize(copies.select("doc_id", "n", "digest", "first"), "copies")
    places = texts.select("doc_id", "digest", F.explode("keys").alias("key"))
    others = copies.where("doc_id <> first").select("doc_id", "digest").distinct()
    places = places.join(others.hint("merge"), ["doc_id", "digest"], "left_anti").select("doc_id", "key")
    places = materialize(places, "places")
    keys = places.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    wanted = places.join(keys.hint("merge"), "key").groupBy("doc_id").agg(F.collect_set("key").alias("wanted"))
    order = ["key", "right", "left", "doc_id", "pos"]
    contexts = _contexts(own.join(wanted, "doc_id"), reach, seed)
    ranged = contexts.repartitionByRange(*order).sortWithinPartitions(*order)
    matches = materialize(_matches(ranged, reach, seed, least), "matches")
    windows = matches.where("window is not null").select("doc_id", "start", "window")
    place = F.struct("doc_id", "start")
    twice = windows.groupBy("window").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("window")
    rest = windows.join(twice.hint("merge"), "window", "left_semi")
    spans = matches.where("window is null").select("doc_id", "start", "end")
    spans = spans.unionByName(rest.select("doc_id", "start", (F.col("start") + least).alias("end")))
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    return _merged(spans.unionByName(whole))


def _merged(spans: DataFrame) -> DataFrame:
    """(doc_id, spans, dup_words): overlapping spans of a document made one."""
    before = W.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1))
    islands = (
        spans.distinct()
        .withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("new").over(before.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc_id", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    return islands.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.sum(F.col("end") - F.col("start")).alias("dup_words"),
    )

"""Toxicity: a linear-chain conditional random field tags toxic words; marginals give scores and offsets."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capframe.llm.common import label_rows, materialize, remainder

HELD_OUT = (5, 0)
SAMPLE = 20_000  # labelled documents the word list and the calibration come from
TRAIN = 500  # of them, per class, the field is fitted on
TRAIN_CHARS = 20_000  # longer documents are not used to fit the field
CANDIDATES = 5_000  # words considered for the list
ODDS = 4.0
FADE, TAIL = 0.4, 0.05
CHUNK = 500_000  # tokens decoded at once

STEMS = (3, 7)  # a list entry ``abc*`` stands for all words that start so; lengths of such stems

_TOKEN = re.compile(r"[^\W_]+")
_BUCKETS, _SHAPES, _LENGTHS = 3, 4, 4
_EDGE = _BUCKETS  # neighbour beyond the text


class TokenCodes(dict):
    """Code of a token's features: how toxic its word is known to be, its shape, its length."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        shape = 0 if token.islower() else 1 if token.istitle() else 2 if token.isupper() else 3
        word = token.lower()
        entries = [word, *(f"{word[:k]}*" for k in range(STEMS[0], min(STEMS[1], len(word)) + 1))]
        bucket = max(self.words.get(e, 0) for e in entries)
        self[token] = code = (bucket * _SHAPES + shape) * _LENGTHS + min(len(token), 15) // 4
        return code

    def of(self, text: str | None) -> np.ndarray:
        return np.array([self[t] for t in _TOKEN.findall(text or "")], dtype=np.int64)


@dataclass
class Field:
    """Weights of the toxic state (the other's are 0) and of the transitions."""

    bucket: np.ndarray
    shape: np.ndarray
    length: np.ndarray
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray  # log weights, 2 x 2
    start: np.ndarray  # log weight of starting toxic, one value

    def parts(self) -> list[np.ndarray]:
        return [self.bucket, self.shape, self.length, self.before, self.after, self.step, self.start]


def new_field() -> Field:
    return Field(*(np.zeros(n) for n in (_BUCKETS, _SHAPES, _LENGTHS, _BUCKETS + 1, _BUCKETS + 1)), np.zeros((2, 2)), np.full(1, -3.0))


class Lanes:
    """Documents laid end to end in lanes of like length, so that all lanes step together."""

    def __init__(self, docs: list[np.ndarray]):
        self.docs = docs
        order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
        sizes = [len(docs[k]) for k in order]
        self.height = max([2000, *sizes])
        lane, at, lanes, tops = 0, 0, [], []
        for size in sizes:
            if at + size > self.height:
                lane, at = lane + 1, 0
            lanes.append(lane)
            tops.append(at)
            at += size
        self.width = lane + 1
        self.order = order
        codes = np.concatenate([docs[k] for k in order]) if docs else np.zeros(0, np.int64)
        sizes_, tops_ = np.array(sizes, dtype=np.int64), np.array(tops, dtype=np.int64)
        self.ends = np.cumsum(sizes_)
        inside = np.arange(len(codes)) - np.repeat(self.ends - sizes_, sizes_)
        self.t = np.repeat(tops_, sizes_) + inside
        self.lane = np.repeat(np.array(lanes, dtype=np.int64), sizes_)
        self.first = inside == 0
        self.bucket, rest = np.divmod(codes, _SHAPES * _LENGTHS)
        self.shape, self.length = np.divmod(rest, _LENGTHS)
        last = np.append(self.first[1:], True)
        self.before = np.where(self.first, _EDGE, np.roll(self.bucket, 1))
        self.after = np.where(last, _EDGE, np.roll(self.bucket, -1))

    def run(self, f: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Odds of the toxic state seen from the left (with the word) and from the right, and word weights."""
        emit = f.bucket[self.bucket] + f.shape[self.shape] + f.length[self.length] + f.before[self.before] + f.after[self.after]
        w = np.ones((self.height, self.width))
        w[self.t, self.lane] = np.exp(np.clip(emit, -30, 30))
        fresh = np.ones((self.height + 1, self.width), dtype=bool)
        fresh[self.t, self.lane] = self.first
        (k00, k01), (k10, k11) = np.exp(f.step)
        start = float(np.exp(f.start[0]))
        left, right = np.empty_like(w), np.empty_like(w)
        a = np.ones(self.width)
        for t in range(self.height):
            a = np.where(fresh[t], start, (k01 + a * k11) / (k00 + a * k10)) * w[t]
            left[t] = a
        b = np.ones(self.width)
        right[-1] = b
        for t in range(self.height - 2, -1, -1):
            v = w[t + 1] * b
            b = np.where(fresh[t + 1], 1.0, (k10 + k11 * v) / (k00 + k01 * v))
            right[t] = b
        return left[self.t, self.lane], right[self.t, self.lane], w[self.t, self.lane]

    def marginals(self, f: Field) -> list[np.ndarray]:
        """P(toxic) of every word, by document in the order given."""
        left, right, _ = self.run(f)
        odds = left * right
        flat = np.split(odds / (1 + odds), self.ends[:-1]) if len(self.docs) else []
        out: list = [None] * len(self.docs)
        for k, p in zip(self.order, flat):
            out[k] = p
        return out


def fit_field(docs: list[np.ndarray], toxic: list[bool], rounds: int = 80, ridge: float = 0.02) -> Field:
    """Maximise the penalised conditional likelihood: words of the list in toxic documents are toxic."""
    lanes, f = Lanes(docs), new_field()
    y = np.concatenate([(docs[k] // (_SHAPES * _LENGTHS) == _BUCKETS - 1) & toxic[k] for k in lanes.order]).astype(float)
    inner = ~lanes.first
    inner[0] = False
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (np.roll(y, 1)[inner].astype(int), y[inner].astype(int)), 1)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in f.parts()]
    for k in range(1, rounds + 1):
        left, right, w = lanes.run(f)
        p = left * right / (1 + left * right)
        came = np.roll(left, 1)
        step = np.exp(f.step)
        joint = np.array([[step[0, 0] + 0 * w, step[0, 1] * w * right], [step[1, 0] * came, step[1, 1] * came * w * right]])[:, :, inner]
        joint /= joint.sum(axis=(0, 1))
        miss = y - p
        names = (lanes.bucket, lanes.shape, lanes.length, lanes.before, lanes.after)
        grads = [np.bincount(x, weights=miss, minlength=len(q)) for x, q in zip(names, f.parts())]
        grads += [pairs - joint.sum(axis=2), np.array([miss[lanes.first].sum()])]
        for q, g, (m, v) in zip(f.parts(), grads, moments):
            g -= ridge * q
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q += 0.25 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return f


def _entries(text: Column) -> Column:
    """Distinct words of a text and their stems, as entries of the word list."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))

    def stems(word: Column) -> Column:
        lengths = F.sequence(F.lit(STEMS[0]), F.least(F.lit(STEMS[1]), F.length(word)))
        cut = F.transform(lengths, lambda k: F.concat(F.substring(word, F.lit(1), k), F.lit("*")))
        return F.when(F.length(word) >= STEMS[0], F.concat(F.array(word), cut)).otherwise(F.array(word))

    return F.array_distinct(F.flatten(F.transform(words, stems)))


def choose_words(holders: dict[str, set], clean: dict[str, int], per_clean: float) -> list[str]:
    """Entries that explain the toxic documents.

    Greedily the one whose toxic documents weigh most, less ``per_clean`` for each clean one; the
    longer of equals. A document weighs 1, and ``FADE`` times as much after each entry that explains
    it. It ends when the best weighs less than 2, or than ``TAIL`` of the first.
    """
    weight = dict.fromkeys(set().union(*holders.values()) if holders else (), 1.0)
    left, chosen, least = dict(holders), [], 2.0
    while left:
        gains = {w: sum(weight[d] for d in docs) - per_clean * clean[w] for w, docs in left.items()}
        word = max(sorted(left), key=lambda w: (round(gains[w], 6), len(w)))
        if gains[word] < least:
            break
        least = max(least, TAIL * gains[word]) if not chosen else least
        chosen.append(word)
        for doc in left.pop(word):
            weight[doc] *= FADE
        left = {w: d for w, d in left.items() if gains[w] >= least}  # gains only fall
    return chosen


@dataclass
class ToxicityModel:
    """``field`` is None if there was nothing to learn from: every score is ``prior``."""

    words: dict[str, int]
    field: Field | None
    weights: np.ndarray
    prior: float = 0.0

    def score(self, best: np.ndarray, total: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        if self.field is None:
            return np.full(len(best), self.prior)
        return 1 / (1 + np.exp(-np.clip(_summary(best, total, tokens) @ self.weights, -30, 30)))


def _summary(best: np.ndarray, total: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """What a document's marginals say of it: the largest, as log odds, their sum, their share."""
    best = np.clip(best, 1e-6, 1 - 1e-6)
    share = np.log((total + 0.02) / (tokens + 1)) / 5
    return np.column_stack([np.ones(len(best)), np.log(best / (1 - best)) / 5, np.log1p(total), share])


def decode(texts: Iterable[str | None], codes: TokenCodes, field: Field):
    """(largest marginal, their sum, words, offending spans) of each text, whole texts, some tokens at a time."""
    held, raw, n = [], [], 0

    def flush():
        for text, p in zip(raw, Lanes(held).marginals(field)):
            hits = np.flatnonzero(p >= 0.5)
            spans = ""
            if len(hits):
                wanted = set(hits.tolist())
                spans = ",".join(f"{m.start()}:{m.end()}" for k, m in enumerate(_TOKEN.finditer(text)) if k in wanted)
            yield float(p.max(initial=0.0)), float(p.sum()), len(p), spans

    for text in texts:
        held.append(codes.of(text))
        raw.append(text or "")
        n += len(held[-1])
        if n >= CHUNK:
            yield from flush()
            held, raw, n = [], [], 0
    if held:
        yield from flush()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learn from at most ``sample`` labelled documents that are not held out, chosen by hash of the id.

    Copies of a text count once. The word list is what best tells toxic documents from others; words
    of the list in toxic documents are the labelled tokens of the field; a logistic fit on the
    marginals calibrates the score. Without toxic and clean documents the score is a constant: 0
    without labels, else the share of toxic ones.
    """
    chosen = label_rows(labels, label, HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    train = materialize(
        docs.where("text is not null")
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
        .dropDuplicates(["text"]),
        "toxic-sample",
    )
    counts = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel({}, None, np.zeros(4), 1.0 if toxic else 0.0)
    words = train.select("doc_id", "y", F.explode_outer(_entries(F.col("text"))).alias("word"))
    odds = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    listed = (
        words.where("word is not null")
        .groupBy("word")
        .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
        .where((F.col("t") >= 2) & (odds >= ODDS))
        .orderBy((F.col("t") * F.log(odds)).desc(), "word")
        .limit(CANDIDATES)
    )
    listed = materialize(listed, "toxic-words")
    holders: dict[str, set] = {r.word: set() for r in listed.select("word").collect()}
    for r in words.where("y = 1").join(F.broadcast(listed.select("word")), "word").select("word", "doc_id").collect():
        holders[r.word].add(r.doc_id)
    known = choose_words(holders, {r.word: r.c for r in listed.collect()}, toxic / clean)
    codes = {w: 1 for w in holders} | {w: 2 for w in known}
    rows = []
    for y in (0, 1):
        some = train.where((F.col("y") == y) & (F.length("text") <= TRAIN_CHARS))
        rows += some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN).select("text", "y").collect()
    table = TokenCodes(codes)
    rows = [(c, bool(r.y)) for r in rows if len(c := table.of(r.text))]
    if not rows:
        return ToxicityModel({}, None, np.zeros(4), toxic / (toxic + clean))
    field = fit_field([c for c, _ in rows], [y for _, y in rows])
    model = ToxicityModel(codes, field, np.zeros(4))
    seen = marginals(train.select("doc_id", "y", "text"), model, "y int").select("y", "best", "total", "tokens").toPandas()
    x = _summary(*(seen[c].to_numpy() for c in ("best", "total", "tokens")))
    y = seen["y"].to_numpy(float)
    w = np.zeros(4)
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(4), x.T @ (y - p) - 0.01 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def marginals(docs: DataFrame, model: ToxicityModel, more: str = "") -> DataFrame:
    """(doc_id, ..., best, total, tokens, spans) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [c for c in docs.columns if c != "text"]

    def batches(frames: Iterable):
        import pandas as pd

        codes = TokenCodes(model.words)
        for frame in frames:
            out = pd.DataFrame(decode(frame["text"], codes, model.field), columns=["best", "total", "tokens", "spans"])
            yield pd.concat([frame[names].reset_index(drop=True), out], axis=1)

    kinds = ", ".join(x for x in (f"doc_id {kind}", more, "best double, total double, tokens long, spans string") if x)
    return docs.mapInPandas(batches, kinds)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start:end of toxic words) of every row; null texts are empty."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def scores(best, total, tokens):
        import pandas as pd

        return pd.Series(model.score(best.to_numpy(), total.to_numpy(), tokens.to_numpy()))

    usable = model if model.field is not None else ToxicityModel({}, new_field(), np.zeros(4))
    found = marginals(docs.select("doc_id", "text"), usable)
    modulus, rest = HELD_OUT
    return found.select(
        "doc_id",
        (remainder(F.col("doc_id"), modulus) == rest).alias("held_out"),
        scores("best", "total", "tokens").alias("score"),
        "spans",
    ).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")

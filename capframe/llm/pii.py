"""Personal data: exact base patterns, and further spans found by weakly supervised labelers.

Looser candidates than the base patterns are voted on by regex, gazetteer and context labelers.
Expectation-maximisation over counts of vote patterns estimates how reliable each labeler is; the
resulting soft labels train a logistic span classifier, which decides what the method adds. Beside
the votes it sees what no labeler votes on: the words around a span, its shape, the characters at its
ends.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from capframe.llm.common import fresh, materialize

KINDS = ("email", "ip", "card", "phone", "name", "secret")  # the first four have base patterns
_LOCAL = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-".decode())
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits match possessively and from the start of their run: long runs of digits cost linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_LOOSE = {
    "email": re.compile(r"(?<!\w)[A-Za-z0-9._%+-]{1,64}(?: ?\[at\] ?| ?\(at\) ?)[A-Za-z0-9-]{1,63}(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9-]{1,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": _CARD,
    "phone": re.compile(r"(?<![0-9+(.])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"),
    "name": re.compile(r"(?<!\w)[A-Z][a-z]+ [A-Z][a-z]+(?!\w)"),
    "secret": re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])"),
}
FIRST_NAMES = frozenset(
    "James John Robert Michael William David Richard Thomas Charles Daniel Mary Patricia Jennifer Linda Elizabeth "
    "Barbara Susan Jessica Sarah Karen Anna Emma Laura Julia Peter Paul Hans Klaus Petra Sabine Pierre Jean Marie "
    "Sophie Luc Carlos Juan Jose Maria Carmen Luis Pablo Elena".split()
)
AREA_CODES = frozenset("201 202 206 212 213 215 301 303 305 310 312 404 415 512 555 602 617 646 702 713 718 800 888 917".split())
DOMAINS = ("com", "org", "net", "edu", "de", "fr", "es", "io")
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "account", "iban"),
    "phone": ("phone", "call", "tel", "fax", "mobile"),
    "name": ("mr", "mrs", "ms", "dr", "name", "by", "from"),
    "secret": ("token", "key", "secret", "password", "api"),
}
_WORD_BEFORE = re.compile(r"[^\W\d_]+")
TITLES = ("mr", "mrs", "ms", "dr")
BEFORE = 30  # characters of context
N_LABELERS = 4
TRUST = 0.2
BELIEFS = np.array([[0.45, 0.45, 0.1], [0.1, 0.45, 0.45]])  # signs -, 0, + of what is not personal, and of what is
CLUES = 256  # places that clues are hashed to
PER_PATTERN = 100  # different spans, about, that train the classifier for each vote pattern


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from their @ signs: linear however long a run of local characters is."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the exact patterns, sorted."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _votes(kind: str, text: str, start: int, end: int, base: bool) -> str:
    """One sign per labeler: + personal, - not, 0 no opinion."""
    span = text[start:end]
    digits = "".join(c for c in span if c.isdigit())
    last = re.split(r"[.\])] ?", span)[-1].lower()
    if base:
        strict = "+"
    elif kind == "card":
        strict = "+" if 12 <= len(digits) <= 19 and luhn(digits) else "-"
    elif kind == "email":
        strict = "+" if len(last) > 1 and last.isalpha() else "-"
    elif kind == "secret":
        strict = "+" if len(span) in (32, 40, 64) and len(set(span)) >= 10 else "-"
    else:
        strict = "+" if kind == "ip" else "0"
    if kind == "name":
        listed = "+" if span.split(" ")[0] in FIRST_NAMES else "-"
    elif kind == "phone":
        listed = "+" if digits[:3] in AREA_CODES or span[0] == "+" else "0"
    elif kind == "email":
        listed = "+" if last in DOMAINS else "0"
    elif kind == "card":
        listed = "+" if digits[:1] in "3456" else "-"
    else:
        listed = "0"
    words = _WORD_BEFORE.findall(text[max(0, start - BEFORE) : start].lower())[-3:]
    near = "+" if any(w in CONTEXT[kind] for w in words) else "0"
    before, after = text[start - 1 : start], text[end : end + 1]
    glued = "-" if (before + after).strip(" \t\n\r.,;:!?()\"'[]<>|#$%&*").strip() else "0"
    return strict + listed + near + glued


def _pattern(kind: int, text: str, start: int, end: int, base: bool) -> str:
    """Kind, votes, length class: what the labelers tell; a few hundred values at most."""
    return f"{kind}{_votes(KINDS[kind], text, start, end, base)}{min(end - start, 47) // 8}"


_CLASSES = ((re.compile(r"[a-z]+"), "a"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"[0-9]+"), "9"))


def _sort(c: str) -> str:
    """Kind of a character next to a span; the characters themselves if they are signs."""
    return "a" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() else c


def _clues(kind: int, text: str, start: int, end: int) -> str:
    """Hashed places of what surrounds a span and how it looks, as text: two words before, one after, ends, shape."""
    before = _WORD_BEFORE.findall(text[max(0, start - BEFORE) : start].lower())[-2:]
    after = _WORD_BEFORE.findall(text[end : end + BEFORE].lower())[:1]
    shape = text[start : min(end, start + 64)]
    for run, sign in _CLASSES:
        shape = run.sub(sign, shape)
    said = [f"<{w}" for w in before[-1:]] + [f"<<{w}" for w in before[:-1]] + [f">{w}" for w in after]
    said += [f"|{_sort(text[start - 1 : start])}{_sort(text[end : end + 1])}", f"#{shape[:16]}"]
    places = {crc32(f"{kind}{w}".encode("utf-8", "surrogatepass")) % CLUES for w in said}
    return " ".join(map(str, sorted(places)))


def _told(kind: int, text: str, start: int, end: int, base: bool) -> tuple[str, str]:
    return _pattern(kind, text, start, end, base), _clues(kind, text, start, end)


def _names(text: str):
    """Two capitalised words, the first listed or after a title; where they fail, the second may begin a name."""
    at = 0
    while m := _LOOSE["name"].search(text, at):
        first = m[0].split(" ")[0]
        titled = _WORD_BEFORE.findall(text[max(0, m.start() - 6) : m.start()].lower())[-1:]
        if first in FIRST_NAMES or (titled and titled[0] in TITLES):
            yield m
            at = m.end()
        else:
            at = m.start() + len(first)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str]]:
    """(start, kind, end, pattern, clues) of looser spans that overlap neither a base span nor one before.

    Of spans that start together the kind listed first is taken.
    """
    found = []
    for kind, pattern in enumerate(_LOOSE.values()):
        if kind == 0 and "(at)" not in text and "[at]" not in text:
            continue
        for m in _names(text) if kind == 4 else pattern.finditer(text):
            if kind == 2 and not 12 <= sum(c.isdigit() for c in m[0]) <= 19:
                continue
            found.append((m.start(), kind, m.end()))
    out, taken = [], sorted((s, e) for s, _, e in base)
    ends = -1
    at = 0
    for start, kind, end in sorted(found):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= ends and not (at < len(taken) and taken[at][0] < end):
            out.append((start, kind, end, *_told(kind, text, start, end, False)))
            ends = end
    return out


_SPAN = "array<struct<start:int,kind:int,end:int,pattern:string,clues:string>>"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, extra) of every row: spans with their patterns, no text. A null text is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(frames: Iterable):
        import pandas as pd

        for frame in frames:
            base, extra = [], []
            for text in frame["text"]:
                text = text or ""
                spans = base_spans(text)
                base.append([(s, k, e, *_told(k, text, s, e, True)) for s, k, e in spans])
                extra.append(candidates(text, spans))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "base": base, "extra": extra})

    return docs.select("doc_id", "text").mapInPandas(batches, f"doc_id {kind}, base {_SPAN}, extra {_SPAN}")


def reliabilities(votes: dict[str, float], rounds: int = 100) -> dict[str, float]:
    """P(personal) of every pattern by expectation-maximisation over the labelers' votes.

    Patterns are kind digit, one sign per labeler, length class. Labelers are independent given the
    truth; each has rates of its own for each kind, so that kinds a labeler has no opinion on say
    nothing of the others. Priors that weigh ``TRUST`` of a kind's spans hold that labelers are
    better than chance and that both truths occur.
    """
    keys = sorted(votes)
    n = np.array([votes[k] for k in keys], dtype=float)
    kinds = np.array([int(k[0]) for k in keys])
    signs = np.array([["-0+".index(c) for c in k[1 : 1 + N_LABELERS]] for k in keys])
    held = 1 + TRUST * np.bincount(kinds, weights=n, minlength=len(KINDS))
    p = np.clip(0.5 + 0.2 * (signs - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        like = np.zeros((len(keys), 2))
        for truth, weight in ((1, n * p), (0, n * (1 - p))):
            like[:, truth] = np.log(np.bincount(kinds, weights=weight, minlength=len(KINDS)) + held / 2)[kinds]
            for labeler in range(N_LABELERS):
                rate = held[:, None] * BELIEFS[truth]
                np.add.at(rate, (kinds, signs[:, labeler]), weight)
                like[:, truth] += np.log(rate / rate.sum(axis=1, keepdims=True))[kinds, signs[:, labeler]]
        p = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
    return dict(zip(keys, p))


_VOTED = 1 + len(KINDS) + 2 * N_LABELERS + 6


def _features(pattern: str, clues: str) -> list[int]:
    """Places that are 1: bias, kind, votes, length class, then the clues."""
    kind, signs, length = int(pattern[0]), pattern[1 : 1 + N_LABELERS], int(pattern[-1])
    voted = [1 + len(KINDS) + 2 * i + (sign == "+") for i, sign in enumerate(signs) if sign != "0"]
    return [0, 1 + kind, *voted, _VOTED - 6 + length, *(_VOTED + int(c) for c in clues.split())]


@dataclass
class SpanModel:
    """Logistic weights; None if there was nothing to learn from, and then nothing is personal."""

    weights: np.ndarray | None

    def score(self, pattern: str, clues: str) -> float:
        if self.weights is None:
            return 0.0
        z = float(self.weights[_features(pattern, clues)].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train_spans(spans: list[tuple[str, str, float]], soft: dict[str, float], block: int = 10_000) -> SpanModel:
    """The span classifier: ridge logistic regression of the soft labels on (pattern, clues, weight)."""
    if not spans:
        return SpanModel(None)
    places = [_features(pattern, clues) for pattern, clues, _ in spans]
    y = np.array([soft[pattern] for pattern, _, _ in spans])
    n = np.array([weight for _, _, weight in spans], dtype=float)
    n *= len(n) / n.sum()  # the ridge counts for as much whatever the size of the table
    w = np.zeros(_VOTED + CLUES)
    for _ in range(25):  # Newton steps, some rows at a time
        grad, curve = -w, np.eye(len(w))
        for at in range(0, len(places), block):
            own = places[at : at + block]
            x = np.zeros((len(own), len(w)))
            x[np.repeat(np.arange(len(own)), [len(o) for o in own]), np.concatenate(own)] = 1
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = grad + x.T @ (n[at : at + block] * (y[at : at + block] - p))
            curve += (x * (n[at : at + block] * p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(curve, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return SpanModel(w)


def fit(detected: DataFrame) -> SpanModel:
    """Train on the spans of ``detected``.

    Reliabilities come from the votes of all spans. The classifier learns from different (pattern,
    clues), copies counted: all of a pattern's up to about ``PER_PATTERN``, beyond that as many drawn
    by hash and weighted up. What reaches the driver is a line per pattern and those spans.
    """
    spans = detected.select(F.explode(F.concat("base", "extra")).alias("s"))
    kinds = materialize(spans.groupBy("s.pattern", "s.clues").agg(F.count("*").alias("n")), "span-kinds")
    counts = kinds.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    if not counts:
        return SpanModel(None)
    soft = reliabilities({r.pattern: float(r.n) for r in counts})
    rates = [(r.pattern, min(1.0, PER_PATTERN / r.kinds)) for r in counts]
    drawn = kinds.join(F.broadcast(detected.sparkSession.createDataFrame(rates, "pattern string, rate double")), "pattern")
    drawn = drawn.where(F.pmod(F.xxhash64("pattern", "clues"), F.lit(1_000_000)) < F.col("rate") * 1_000_000)
    rows = drawn.select("pattern", "clues", (F.col("n") / F.col("rate")).alias("n")).orderBy("pattern", "clues").collect()
    return train_spans([(r.pattern, r.clues, r.n) for r in rows], soft)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def decide(detected: DataFrame, model: SpanModel, least: float = 0.5) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans (base ones and those the classifier adds)."""
    kind = detected.schema["doc_id"].dataType.simpleString()

    def batches(frames: Iterable):
        import pandas as pd

        for frame in frames:
            base = [[(s["start"], s["kind"], s["end"]) for s in spans] for spans in frame["base"]]
            extra = [[(s["start"], s["kind"], s["end"]) for s in spans if model.score(s["pattern"], s["clues"]) >= least] for spans in frame["extra"]]
            out = {"doc_id": frame["doc_id"]}
            for k, name in enumerate(KINDS[:4]):
                out[f"n_{name}"] = [sum(s[1] == k for s in spans) for spans in base]
            out["base_sha256"] = [hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base]
            out["spans"] = [_joined(a + b) for a, b in zip(base, extra)]
            yield pd.DataFrame(out)

    counts = ", ".join(f"n_{name} long" for name in KINDS[:4])
    return detected.mapInPandas(batches, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def find(docs: DataFrame) -> DataFrame:
    """Every row's personal data; see ``decide``.

    An empty table trains nothing and gives no rows. Rows that repeat a doc_id, or have none, are
    judged one by one; texts of any length are read whole.
    """
    detected = materialize(detect(docs), "spans")
    return decide(detected, fit(detected))


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by ``<KIND>``; overlapping ones become one, named after the first."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and, if there, ``n_chars`` counted anew. Null stays null."""
    model = fit(materialize(detect(docs), "spans"))

    @pandas_udf("string")
    def masked(texts):
        import pandas as pd

        def one(text):
            if text is None:
                return None
            base = base_spans(text)
            return mask_text(text, base + [s[:3] for s in candidates(text, base) if model.score(s[3], s[4]) >= least])

        return pd.Series([one(t) for t in texts], dtype=object)

    name = fresh(docs, "masked_text")
    out = docs.withColumn(name, masked("text"))
    columns = {"text": F.col(name)} | ({"n_chars": F.length(name).cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])

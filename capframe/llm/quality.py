"""Quality classifier: random Fourier features, ridge from summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from capframe.llm.common import fresh, label_rows, materialize, remainder, summed_products

HELD_OUT = (3, 1)
WAVES = 256
RIDGE = 1e-4  # times the number of training rows
BINS = 1000  # calibration bins per unit of raw score

#: Bytes of each class, for shares of a text.
_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "space": b" \t\n\r",
    "stop": b".,;:?'\"",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~=<>{}[]\\/_+`",
}
_TABLE = np.zeros((256, len(_CLASSES) + 1))
for _k, _bytes in enumerate(_CLASSES.values()):
    _TABLE[list(_bytes), _k] = 1
_TABLE[128:, -1] = 1
N_STATS = 17


def text_stats(text: str | None) -> list[float]:
    """Shape of one text: sizes, shares of character classes, repeated words and lines. Null is empty."""
    text = text or ""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    shares = np.bincount(raw, minlength=256) @ _TABLE / max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    letters = shares[0] + shares[1]
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / n if words else 0.0,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        np.log1p(len(text) / len(lines)),
        shares[0] / letters if letters else 0.0,
        *shares[2:],
        sum(len(w) <= 2 for w in words) / n,
    ]


def document_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row of ``docs``; other columns are not read."""

    def batches(frames: Iterable):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "stats": [text_stats(t) for t in frame["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(batches, f"doc_id {kind}, stats array<double>")


@dataclass
class QualityModel:
    """Fitted scorer. ``weights`` is None if there was nothing to learn from: every score is ``prior``."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray
    prior: float = 0.5

    def expand(self, stats: np.ndarray) -> np.ndarray:
        """Cosines whose products approximate the Gaussian kernel, and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.waves + self.phase) * np.sqrt(2 / self.waves.shape[1])
        return np.hstack([waves, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        return np.interp(self.raw(stats), self.knots, self.values)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(-1, N_STATS)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a nondecreasing fit of ``y`` at sorted ``x``."""
    blocks: list[list[float]] = []
    for i in range(len(x)):
        blocks.append([y[i] * weight[i], weight[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return x, np.repeat([s / w for s, w, _ in blocks], [int(n) for _, _, n in blocks])


def fit(stats: DataFrame, labels: DataFrame, waves: int = WAVES, seed: int = 7, label: str = "quality") -> QualityModel:
    """Learn from all labelled rows that are not held out.

    Four fifths of them give the ridge weights, one fifth the calibration (all of them both, if
    that fifth lacks a class). Without rows of both classes the model is a constant: 0.5 without
    any rows, else the share of ones.
    """
    train = materialize(stats.join(label_rows(labels, label, HELD_OUT), "doc_id"), "quality-train")
    moments = train.agg(
        F.count("*"),
        F.sum("y"),
        *[f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(N_STATS)],
    ).first()
    n, ones = moments[0], moments[1] or 0
    rng = np.random.default_rng(seed)
    model = QualityModel(
        np.array([v or 0.0 for v in moments[2 : 2 + N_STATS]]),
        np.array([v if v and v > 1e-9 else 1.0 for v in moments[2 + N_STATS :]]),
        rng.normal(size=(N_STATS, waves)) / np.sqrt(N_STATS / 2),
        rng.uniform(0, 2 * np.pi, waves),
        None,
        np.zeros(0),
        np.zeros(0),
    )
    if not n or ones in (0, n):
        model.prior = ones / n if n else 0.5
        return model
    held = F.xxhash64("doc_id") % 5 == 0
    sides = train.groupBy(held.alias("held")).agg(F.min("y").alias("low"), F.max("y").alias("high")).collect()
    split = len(sides) == 2 and all(s.low != s.high for s in sides)
    fitted, checked = (train.where(~held), train.where(held)) if split else (train, train)

    def products(frame):
        return np.hstack([model.expand(_matrix(frame["stats"])), frame[["y"]].to_numpy(float)])

    sums = summed_products(fitted, products, waves + 2)
    rows = sums[-2, -2]
    model.weights = np.linalg.solve(
        sums[:-1, :-1] + RIDGE * rows * np.diag([1.0] * waves + [0.0]), sums[:-1, -1]
    )

    def raw_bins(frames: Iterable):
        import pandas as pd

        for frame in frames:
            bins = np.round(np.clip(model.raw(_matrix(frame["stats"])), -1, 2) * BINS).astype("int64")
            yield pd.DataFrame({"bin": bins, "y": frame["y"].astype("int64")})

    bins = checked.mapInPandas(raw_bins, "bin long, y long").groupBy("bin").agg(F.count("*"), F.sum("y"))
    table = np.array(sorted(map(tuple, bins.collect())), dtype=float)  # at most 3 * BINS + 1 rows
    model.knots, model.values = isotonic(table[:, 0] / BINS, table[:, 2] / table[:, 1], table[:, 1])
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every row of ``stats``."""

    @pandas_udf("double")
    def scores(column):
        import pandas as pd

        return pd.Series(model.score(_matrix(column)))

    modulus, rest = HELD_OUT
    return stats.select(
        "doc_id",
        (remainder(F.col("doc_id"), modulus) == rest).alias("held_out"),
        scores("stats").alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs``, all columns, that the model scores at least 0.5."""

    @pandas_udf("double")
    def scores(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([text_stats(t) for t in texts], dtype=float).reshape(-1, N_STATS)))

    name = fresh(docs, "quality_score")
    return docs.withColumn(name, scores("text")).where(F.col(name) >= 0.5).drop(name)

"""Vectors held as array columns: similarity, pooling, scores and losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from capframe.fixed_values import COSINE_FLOOR, NOISE_EPS


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; the product of the norms is at least 1e-8."""
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a) * dot(b, b)), F.lit(COSINE_FLOOR))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def perturb(vector: Column, noise: Column, eps: float = NOISE_EPS) -> Column:
    """Vector plus ``eps`` times a noise vector of the same length."""
    return F.zip_with(vector, noise, lambda x, n: x.cast("double") + F.lit(eps) * n)


def mean_tokens(tokens: Column, dim: int) -> Column:
    """Mean over the first axis of a ``[tokens, dim]`` array."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: _sum(F.transform(tokens, lambda t: F.get(t, i).cast("double"))) / F.size(tokens),
    )


def map_to_tokens(channels: Column, height: int, width: int) -> Column:
    """Feature map ``[channels, height * width]`` as one row of channel values per place."""
    places = F.sequence(F.lit(0), F.lit(height * width - 1))
    return F.transform(places, lambda i: F.transform(channels, lambda c: F.get(c, i)))


def linear_scores(vector: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """Logits of a linear layer whose weights are literals, one row per class."""
    return F.array(
        *[
            dot(vector, F.array(*[F.lit(float(w)) for w in row])) + F.lit(float(b))
            for row, b in zip(weights, bias, strict=True)
        ]
    )


def layer_scores(vector: Column, layer: Column) -> Column:
    """Logits of a linear layer held as an array of ``weights, bias`` structs, one per class."""
    return F.transform(layer, lambda c: dot(vector, c["weights"]) + c["bias"])


def argmax(logits: Column) -> Column:
    """Place of the largest value from 0, the first on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(_sum(F.transform(logits, lambda x: F.exp(x - top))))


def log_softmax(logits: Column) -> Column:
    total = log_sum_exp(logits)
    return F.transform(logits, lambda x: x - total)


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), F.exp)


def cross_entropy(logits: Column, label: Column) -> Column:
    """Loss of one row: minus log softmax at the label's place."""
    return log_sum_exp(logits) - F.get(logits, label)

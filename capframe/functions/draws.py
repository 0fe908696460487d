"""Random numbers drawn from keys: a task that runs again draws the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(parts: tuple) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in columns])


def digest(*parts: Column | str | int) -> Column:
    """Hex digest of the joined parts: evenly spread, the same wherever the row lies."""
    return F.md5(_joined(parts))


def whole(*parts: Column | str | int) -> Column:
    """Whole number from 0 to 2^60 - 1."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("long")


def gaussian(key: Column, dim: int, seed: int) -> Column:
    """Standard normal vector."""

    def uniform(i: Column, salt: int) -> Column:
        return (whole(seed, salt, key, i) + F.lit(0.5)) / F.lit(float(1 << 60))

    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.sqrt(-2 * F.log(uniform(i, 1))) * F.cos(2 * F.pi() * uniform(i, 2)),
    )

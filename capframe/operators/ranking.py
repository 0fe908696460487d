"""Row numbers, seeded order, exact splits and batches without a one-task window over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from capframe.fixed_values import BATCH_SIZE, SEED
from capframe.functions.draws import digest
from capframe.session import materialize

_PART_BITS = 33  # monotonically_increasing_id counts a partition's rows in the low 33 bits
_HEX = 4  # digits looked at per pass when a cut is searched: 65,536 counts at most
_SMALL = 20_000  # rows sorted to find a cut


def _running_before(value: str, order: str) -> Column:
    """Sum over the rows before; only for tables with one row per partition or bucket."""
    window = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def global_row_number(df: DataFrame, *order: str, out: str = "rn") -> DataFrame:
    """Position from 1 in the total order of ``order``, which should be unique: ties share a range.

    Range-partitioned and sorted in parallel, written once, then numbered by adding each
    partition's offset: one shuffle, and no task sees more than its range.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    table = materialize(ranged, "ordered")
    part = F.shiftright("_seq", _PART_BITS)
    offsets = (
        table.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", _running_before("_n", "_part").alias("_before"))
    )
    # One row per range partition, so its size is set by the number of partitions.
    return (
        table.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.col("_seq") % (1 << _PART_BITS) + 1)
        .drop("_part", "_seq", "_before")
    )


def running_total(df: DataFrame, value: str, *order: str, out: str = "before") -> DataFrame:
    """Sum of ``value`` over the rows before, in the total order of ``order``, which should be unique.

    As for row numbers: ranges are summed on their own and moved up by the ranges before.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    table = materialize(ranged, "ranged").withColumn("_part", F.shiftright("_seq", _PART_BITS))
    offsets = (
        table.groupBy("_part")
        .agg(F.sum(value).alias("_sum"))
        .select("_part", _running_before("_sum", "_part").alias("_moved"))
    )
    inside = W.partitionBy("_part").orderBy("_seq").rowsBetween(W.unboundedPreceding, -1)
    return (
        table.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_moved") + F.col(out))
        .drop("_part", "_seq", "_moved")
    )


def seeded_hash(key: Sequence[str], seed: int | str = SEED) -> Column:
    """Hex digest of seed and key, the sort key of every seeded order."""
    return digest(seed, *[F.col(k) for k in key])


def _bucket_digits(df: DataFrame) -> int:
    """Hex digits that give every shuffle partition some 16 buckets, 65,536 buckets at most."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = 2
    while digits < 4 and 16**digits < 16 * partitions:
        digits += 1
    return digits


def seeded_row_number(df: DataFrame, key: Sequence[str], seed: int | str = SEED, out: str = "rn") -> DataFrame:
    """Position from 1 in the shuffled order of ``seed``; ``key`` must be unique.

    The first digits of the hash are evenly filled buckets in hash order, so rows are
    numbered per bucket and moved up by the rows of the buckets before.
    """
    digits = _bucket_digits(df)
    hashed = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_bucket", F.substring("_h", 1, digits))
    offsets = (
        hashed.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .select("_bucket", _running_before("_n", "_bucket").alias("_before"))
    )
    inside = W.partitionBy("_bucket").orderBy("_h", *key)
    return (
        hashed.withColumn("_i", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_before") + F.col("_i"))
        .drop("_h", "_bucket", "_before", "_i")
    )


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """All rows in seeded random order."""
    return df.orderBy(seeded_hash(key, seed), *key)


def with_batches(df: DataFrame, *order: str, size: int = BATCH_SIZE, rank: str | None = None) -> DataFrame:
    """``batch_id`` of consecutive groups of ``size`` rows, the last one short; ``batch_pos`` from 0.

    ``rank`` names a row number from 1 the rows already have.
    """
    numbered = df if rank else global_row_number(df, *order, out="_rn")
    zero = F.col(rank or "_rn") - 1
    batched = numbered.withColumn("batch_id", ((zero - zero % size) / size).cast("long")).withColumn(
        "batch_pos", (zero % size).cast("int")
    )
    return batched if rank else batched.drop("_rn")


def epoch_batches(
    df: DataFrame, key: Sequence[str], epoch: int, seed: int = SEED, size: int = BATCH_SIZE
) -> DataFrame:
    """Batches of one training epoch: another row order for every epoch."""
    shuffled = seeded_row_number(df, key, f"{seed}|{epoch}", out="_rn")
    return with_batches(shuffled, size=size, rank="_rn").drop("_rn")


def split_sizes(n: int) -> tuple[int, int, int]:
    """Rows in train, valid and test: 0.3 held out, two thirds of that for test, both rounded up."""
    held = (3 * n + 9) // 10
    test = (2 * held + 2) // 3
    return n - held, held - test, test


def _row_at(hashed: DataFrame, key: Sequence[str], rank: int, counts: dict[str, int]):
    """Sort key of the row at place ``rank`` from 0, narrowed digit by digit to a small bucket."""
    prefix = ""
    while True:
        for bucket in sorted(counts):
            if rank < counts[bucket]:
                break
            rank -= counts[bucket]
        prefix, size = prefix + bucket, counts[bucket]
        inside = hashed.where(F.col("_h").startswith(prefix))
        if size <= _SMALL:
            break
        if len(prefix) >= 32:
            raise ValueError(f"split key {list(key)} is not unique")
        counts = _bucket_counts(inside, len(prefix))
    rows = inside.orderBy("_h", *key).offset(max(rank - 1, 0)).limit(2).collect()
    if rank and rows[0] == rows[1]:
        raise ValueError(f"split key {list(key)} is not unique")
    return rows[1 if rank else 0]


def _bucket_counts(hashed: DataFrame, start: int) -> dict[str, int]:
    counts = hashed.groupBy(F.substring("_h", start + 1, _HEX).alias("b")).agg(F.count("*").alias("n"))
    return {row.b: row.n for row in counts.collect()}


def split_column(df: DataFrame, key: Sequence[str], seed: int = SEED) -> Column:
    """Expression giving ``train``, ``valid`` or ``test`` in the exact sizes of ``split_sizes``.

    Only the two rows at the cuts are looked up, from counts over the hashed key. The split
    itself is then a comparison in the scan that needs it: rows are never shuffled for it, and
    no column but the key decides.
    """
    hashed = df.select(seeded_hash(key, seed).alias("_h"), *key)
    counts = _bucket_counts(hashed, 0)
    n = sum(counts.values())
    train, valid, _ = split_sizes(n)
    here = F.struct(seeded_hash(key, seed), *key)

    def before(rank: int) -> Column:
        if rank >= n:
            return F.lit(True)
        row = _row_at(hashed, key, rank, counts)
        cut = [F.lit(row["_h"])] + [F.lit(row[k]).cast(df.schema[k].dataType) for k in key]
        return here < F.struct(*cut)

    return F.when(before(train), "train").when(before(train + valid), "valid").otherwise("test")


def with_split(df: DataFrame, key: Sequence[str], seed: int = SEED, out: str = "split") -> DataFrame:
    return df.withColumn(out, split_column(df, key, seed))

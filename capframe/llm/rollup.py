"""Token totals kept up to date by signed deltas, with idempotent batch commits.

A rollup is a folder: ``totals/<n>-<random>`` holds the totals after commit n, ``commits/<n>.json``
names the batch and its totals. A commit is a whole file moved into place by a rename that never
overwrites, so of two writers of the same number one fails, and a writer that dies at any point leaves
nothing that is read or in the way. Totals are additive: a batch costs one
aggregation of its own rows and a merge with the old totals, never a second look at old documents.

Every ``EVERY`` commits, ``checkpoints/<n>`` takes up the names of all batches to commit n, as a table
sorted by name. A call reads the commits from the last checkpoint on, and asks that table for one batch;
the log never comes to the driver. Checkpoints only save reading: a lost or late one changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capframe.session import move_once

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
LOG_SCHEMA = "number long, batch_id string, totals string"
EVERY = 64  # commits read one by one, at most about so many


def words(text: Column) -> Column:
    """Runs without white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")


def word_pieces(text: Column) -> Column:
    """Runs of up to four letters or digits, and every other visible character; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]{1,4}|[^\p{L}\p{N} \t\n\r\f\x0B]")), F.lit(0)).cast("long")


def changes(rows: DataFrame, op: str, tokenizer: str, tokens: Column | None = None, old_tokens: Column | None = None) -> DataFrame:
    """Change rows of one kind: insert (``tokens``), delete (``old_tokens``) or revise (both)."""
    zero = F.lit(0).cast("long")
    return rows.select(
        F.lit(op).alias("op"),
        "source",
        "lang",
        F.lit(tokenizer).alias("tokenizer"),
        (zero if tokens is None else tokens).alias("tokens"),
        (zero if old_tokens is None else old_tokens).alias("old_tokens"),
    )


def deltas(rows: DataFrame) -> DataFrame:
    """Signed totals of change rows (op, source, lang, tokenizer, tokens, old_tokens).

    Null counts are 0, null keys are a group of their own, an unknown or null op changes nothing.
    Sums are taken before the shuffle, so a hot source costs a row per task.
    """
    new, old = (F.coalesce(F.col(c), F.lit(0)) for c in ("tokens", "old_tokens"))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -old).when(F.col("op") == "revise", new - old).otherwise(0)
    return rows.groupBy(*KEYS).agg(
        F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens")
    )


class TokenRollup:
    """Totals by source, language and tokenizer version under ``path``, a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._file = lambda name: hadoop.Path(f"{self.path}/commits/{name}")
        self._system = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _checkpoint(self) -> int:
        """Number of the last checkpoint, 0 if there is none."""
        folder = self._path(f"{self.path}/checkpoints")
        if not self._system.exists(folder):
            return 0
        names = [status.getPath().getName() for status in self._system.listStatus(folder)]
        return max((int(name) for name in names if name.isdigit()), default=0)

    def _log(self) -> list[dict]:
        """Commits in order from the last checkpoint's own on; each is a small file."""
        number = max(self._checkpoint(), 1)
        files = []
        while self._system.exists(self._file(f"{number:06d}.json")):
            files.append(f"{self.path}/commits/{number:06d}.json")
            number += 1
        lines = self.spark.read.text(files).collect() if files else []
        return sorted((json.loads(r[0]) for r in lines), key=lambda c: c["number"])

    def _older(self) -> DataFrame:
        """All commits up to the last checkpoint."""
        number = self._checkpoint()
        if not number:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/checkpoints/{number:06d}")

    def totals(self) -> DataFrame:
        """Current totals; empty before the first commit. Groups whose totals are 0 are left out."""
        return self._totals(self._log())

    def _totals(self, log: list[dict]) -> DataFrame:
        if not log:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/totals/{log[-1]['totals']}")

    def apply(self, batch_id: str, rows: DataFrame) -> bool:
        """Add a batch of changes once; False, and no work, if ``batch_id`` was committed before.

        A job that dies before its commit leaves only unread files and can run again. A writer that
        loses a race gets an error and can run again too.
        """
        log = self._log()
        if any(c["batch_id"] == batch_id for c in log):
            return False
        if log and log[0]["number"] > 1 and not self._older().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        number = log[-1]["number"] + 1 if log else 1
        name = f"{number:06d}-{uuid.uuid4().hex}"
        merged = self._totals(log).unionByName(deltas(rows)).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        merged.where("n_docs != 0 or n_tokens != 0").write.parquet(f"{self.path}/totals/{name}")
        commit = {"number": number, "batch_id": batch_id, "totals": name}
        self._write(aside := f"_writing-{uuid.uuid4().hex}", json.dumps(commit))
        if not move_once(self.spark, f"{self.path}/commits/{aside}", f"{self.path}/commits/{number:06d}.json"):
            raise FileExistsError(f"commit {number} of {self.path} was made by another writer")
        if len(log) >= EVERY:
            self._take_up([*log, commit])
        return True

    def _take_up(self, log: list[dict]) -> None:
        """A checkpoint at the last commit of ``log``; of two writers of it the first one's stays."""
        new = [(c["number"], c["batch_id"], c["totals"]) for c in log]
        # The log starts with the last checkpoint's own commit, which that table has already.
        every = self._older().where(F.col("number") < new[0][0]).unionByName(self.spark.createDataFrame(new, LOG_SCHEMA))
        folder = f"{self.path}/checkpoints"
        aside = f"{folder}/_writing-{uuid.uuid4().hex}"
        every.repartitionByRange("batch_id").sortWithinPartitions("batch_id").write.parquet(aside)
        move_once(self.spark, aside, f"{folder}/{new[-1][0]:06d}")

    def _write(self, name: str, line: str) -> None:
        stream = self._system.create(self._file(name), False)
        stream.write(bytearray(line.encode()))
        stream.close()

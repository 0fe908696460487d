"""Spark session settings and scratch tables."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "capframe", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library expects; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Images and feature maps are wide: Python workers get batches by size, not only by rows.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, by way of the shared scratch folder.

    Image and model jobs import it there.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as package:
        for source in sorted(root.rglob("*.py")):
            package.write(source, source.relative_to(root.parent))
    target = f"{scratch_dir(spark)}/capframe.zip"
    path, system = _hadoop(spark, target)
    stream = system.create(path, True)
    stream.write(archive.getvalue())
    stream.close()
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def _hadoop(spark: SparkSession, name: str):
    """Path and file system of a name, whatever storage it lies on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, name: str) -> bool:
    path, system = _hadoop(spark, name)
    return system.exists(path)


def move_once(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder unless the target exists; whether it was moved."""
    path, _ = _hadoop(spark, source)
    goal, _ = _hadoop(spark, target)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    names = hadoop.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        names.rename(path, goal, never_over)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def delete_path(spark: SparkSession, name: str) -> bool:
    path, system = _hadoop(spark, name)
    return system.delete(path, True)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for tables written mid-job: the shared folder in ``spark.checkpoint.dir``.

    Only a local master may go without the setting; a cluster has no shared default.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="capframe-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{context.applicationId}"


_run_folder: ContextVar[str] = ContextVar("_run_folder", default="")


@contextmanager
def run_scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside are deleted at the end, also when the run fails.

    Frames that leave must not read them: write those out, or ``materialize(..., kept=True)``.
    """
    token = _run_folder.set(f"{_run_folder.get()}/run-{uuid.uuid4().hex}")
    folder = f"{scratch_dir(spark)}{_run_folder.get()}"
    try:
        yield
    finally:
        _run_folder.reset(token)
        delete_path(spark, folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as each ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: short lineage, columnar, sized by its files.

    Inside ``run_scratch`` the table goes with the run, unless it is ``kept``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}{'' if kept else _run_folder.get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_from_files(df: DataFrame) -> bool:
    """Whether ``df`` is files with at most columns computed and rows left out: cheap to read once more."""
    plain = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "Relation", "DataSourceV2Relation", "View"}
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in plain:
            return False
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
    return True


def drop_scratch(spark: SparkSession) -> bool:
    """Delete this application's scratch tables; frames built on them stop working."""
    return delete_path(spark, scratch_dir(spark))

"""Photos as one file each: a data source that writes them from a table and lists them, empty ones included."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from capframe.sources.images import file_stem

WRITING = "_writing-"  # folders of unfinished jobs; Spark's readers pass by names that start so


def file_system(uri: str):
    """Storage and plain path of a folder, as Python workers open it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri.rstrip("/")) if uri.startswith("/") else fs.FileSystem.from_uri(uri.rstrip("/"))


@dataclass
class Written(WriterCommitMessage):
    """A task's finished folder."""

    partition: int
    folder: str
    files: int


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


class PhotoFiles(DataSource):
    """Format ``photofiles``. Writes (name, content) to files; reads (path, modified, length) of files.

    A task writes into a folder of its own attempt. When all tasks are done, each folder comes into
    place by one rename; files of failed or repeated attempts are never seen and go with the job.
    """

    @classmethod
    def name(cls) -> str:
        return "photofiles"

    def schema(self) -> str:
        return "path string, modified timestamp, length long"

    def writer(self, schema, overwrite: bool) -> "PhotoWriter":
        if overwrite:
            raise ValueError("photo files are only added: use mode append")
        return PhotoWriter(self.options["path"])

    def reader(self, schema) -> "PhotoLister":
        return PhotoLister(self.options["path"])


class PhotoWriter(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri, self.job = uri, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = file_system(self.uri)
        folder = f"{base}/{WRITING}{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        files = 0
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                if not name or "/" in name or content is None:
                    raise ValueError(f"no file can be written for the name {name!r}")
                if not files:
                    store.create_dir(folder)
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
                files += 1
        return Written(task.partitionId(), folder, files)

    def commit(self, messages: list) -> None:
        store, base = file_system(self.uri)
        store.create_dir(base)
        for done in messages:
            if done.files:
                store.move(done.folder, f"{base}/part-{done.partition:05d}-{self.job}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, base = file_system(self.uri)
        aside = f"{base}/{WRITING}{self.job}"
        if store.get_file_info(aside).type != fs.FileType.NotFound:
            store.delete_dir(aside)


class PhotoLister(DataSourceReader):
    """A task per folder below the top one; only those folders' names are looked up on the driver."""

    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        store, base = file_system(self.uri)
        below = [f for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory]
        return [Folder(base, False), *[Folder(f.path, True) for f in below if not f.base_name.startswith(("_", "."))]]

    def read(self, partition: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = file_system(self.uri)
        for found in store.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep)):
            if found.type == fs.FileType.File and not found.base_name.startswith(("_", ".")):
                yield found.path, found.mtime, found.size


def write_photos(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """One file per row, added to ``folder``: all rows or, if the job fails, none.

    Names must be distinct within a task. Two rows of one name in different tasks give two files.
    """
    df.sparkSession.dataSource.register(PhotoFiles)
    rows = df.select(F.col(name).alias("name"), F.col(content).alias("content"))
    rows.write.format("photofiles").mode("append").save(folder)


def list_photos(spark: SparkSession, folder: str) -> DataFrame:
    """``photo_id, path, modified, length`` of all files below a folder, those without bytes included."""
    spark.dataSource.register(PhotoFiles)
    rows = spark.read.format("photofiles").load(folder)
    return rows.select(file_stem(F.col("path")).alias("photo_id"), "path", "modified", "length")

"""One file a row at a path of the row's own: a data source writer."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: A file that says that all files of a job are there, with their number and bytes.
DONE = "_WRITTEN.json"


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


def _store(root: str):
    """(file system, folder) of a URI or an absolute path, as executors see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _inside(path: str | None) -> str:
    """A relative path that stays below its root."""
    clean = posixpath.normpath(path) if path else ""
    if not clean or clean.startswith(("/", "..")) or clean == ".":
        raise ValueError(f"not a path below the folder: {path!r}")
    return clean


class FileTreeWriter(DataSourceWriter):
    """Writes (path, text) rows: a file is written under another name beside its place and moved there, so that readers never see half a file.

    A task that runs again, or twice at once, puts the same files in the same places. The driver gets a count a task and, when all have ended, writes DONE.
    """

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _store(self.root)
        files = size = 0
        made = set()
        for row in iterator:
            place = f"{root}/{_inside(row['path'])}"
            folder = posixpath.dirname(place)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            # The last line ends like the others; Spark's readers pass over files without a byte.
            body = f"{row['text'] or ''}\n".encode()
            part = f"{folder}/.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write(body)
            store.move(part, place)
            files, size = files + 1, size + len(body)
        return Written(files, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.root)
        store.create_dir(root, recursive=True)
        there = [m for m in messages if m is not None]
        with store.open_output_stream(f"{root}/{DONE}") as out:
            out.write(json.dumps({"files": sum(m.files for m in there), "bytes": sum(m.bytes for m in there)}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files that are there are whole; without DONE the job counts as not done, and writing it again puts them there again."""


class FileTree(DataSource):
    """df(path, text).write.format("file_tree").save(folder)"""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def writer(self, schema: StructType, overwrite: bool) -> FileTreeWriter:
        if {"path", "text"} - set(schema.names):
            raise ValueError("file_tree writes the columns path and text")
        return FileTreeWriter(self.options["path"])


def write_files(df: DataFrame, folder: str, name: str = "path", text: str = "text", kind: str = ".txt") -> None:
    """A file a row at its page's path below folder, with `kind` for .html.

    A null text is like an empty one; a path that is null, absolute or leads out of the folder fails the job. Of rows with one path the least text stays.
    """
    df.sparkSession.dataSource.register(FileTree)
    rows = df.select(F.regexp_replace(name, r"\.html?$", kind).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows.groupBy("path").agg(F.min("text").alias("text")).write.format("file_tree").mode("append").save(folder)


def read_files(spark: SparkSession, folder: str, kind: str = ".txt") -> DataFrame:
    """(path below folder, text) of every file of a kind."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{kind}").text(folder, wholetext=True)
    end = folder.rstrip("/").rsplit("/", 1)[-1]
    # The path as it is, not as a URI; without the end of the last line.
    at, text = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), F.col("value")
    return files.select(F.substring_index(at, f"/{end}/", -1).alias("path"), F.substring(text, F.lit(1), F.length(text) - 1).alias("text"))

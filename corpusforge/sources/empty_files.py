"""Files without bytes, which Spark's file sources list but have no row for."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..plans.shared import matched


def hidden(name: str) -> bool:
    """Spark's readers skip a name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def walked(name: str) -> bool:
    """Spark's readers look into a folder of this name."""
    return not hidden(name) or name.startswith(("_metadata", "_common_metadata"))


def entries(at: str) -> Iterator[os.DirEntry]:
    """What stands in a folder, without names that are no UTF-8: Java reaches none of them."""
    with os.scandir(at) as found:
        yield from (e for e in found if e.name.isascii() or not any("\udc80" <= c <= "\udcff" for c in e.name))


def no_bytes(at: str, deep: bool) -> Iterator[str]:
    """Files without bytes of a folder, or of all below it; links are followed, as by Spark."""
    todo = [at]
    while todo:
        for e in entries(todo.pop()):
            if e.is_dir():
                if deep and walked(e.name):
                    todo.append(e.path)
            elif not hidden(e.name):
                try:
                    if not e.stat().st_size:
                        yield e.path
                except FileNotFoundError:  # it went, or is a link to nothing
                    pass


class Folders(InputPartition):
    """Folders (path, with all below it or not), or single files, of one task."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class EmptyReader(DataSourceReader):
    def __init__(self, roots: list[str], parts: int):
        self.roots, self.parts = roots, parts

    def partitions(self) -> list[Folders]:
        folders = [(t, False) for t in self.roots]
        folders += [(e.path, True) for t in self.roots if os.path.isdir(t) for e in entries(t) if e.is_dir() and walked(e.name)]
        return [Folders(folders[k :: self.parts]) for k in range(min(self.parts, len(folders)))]

    def read(self, part: Folders) -> Iterator[tuple]:
        for at, deep in part.folders:
            found = no_bytes(at, deep) if os.path.isdir(at) else [] if os.path.getsize(at) else [at]
            for path in found:
                yield (f"file:{path}",)


class EmptyFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "empty_files"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema: StructType) -> EmptyReader:
        return EmptyReader([r.removeprefix("file:") for r in json.loads(self.options["roots"])], int(self.options["parts"]))


def empty_files(spark: SparkSession, path: str, pattern: str, reader: Callable[[], DataFrame]) -> DataFrame:
    """path of each file without bytes that Spark lists below ``path``.

    On a disk or mount tasks look for them, which are dealt the folders of the first
    level; nothing but these folders' names passes through the driver. In other stores
    they are the names in Spark's own listing, which the driver holds, that ``reader``
    (Spark's, of the same files) has no row of.
    """
    roots = matched(spark, path)
    if all(r.startswith("file:") for r in roots):
        spark.dataSource.register(EmptyFiles)
        empty = spark.read.format("empty_files").option("roots", json.dumps(roots)).option("parts", str(spark.sparkContext.defaultParallelism)).load()
    else:
        files = reader()
        names = (unquote(n) for n in files.inputFiles())
        listed = spark.createDataFrame([(n,) for n in names if not hidden(n.rsplit("/", 1)[-1])], "path string")
        empty = listed.join(files.select("path"), "path", "left_anti")
    glob = spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(pattern).pattern()
    return empty.where(F.element_at(F.split("path", "/"), -1).rlike(rf"(?s)\A(?:{glob})\z"))

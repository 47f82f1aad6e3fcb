"""File trees as a data source of its own: ``spark.read.format("file_tree")``.

A row for each entry, names that start with ``_`` or ``.`` too, as os.walk sees
them. The driver only lists the first ``split_depth`` levels; every directory
found there is a partition, which a task walks. Folders lie on a disk or mount
that all executors reach. Conditions on ``kind`` and ``depth`` are taken by the
reader: a bound on the depth ends the walk there.

Options: ``path`` (one root, as load() gives it) or ``roots`` (a JSON list),
``split_depth`` (1 by default). Symbolic links are entries, and are not followed.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .listing import ENTRY


class Folder(InputPartition):
    """A folder of a tree and all below it, or its own entries alone."""

    def __init__(self, root: str, below: str, deep: bool):
        self.root, self.below, self.deep = root, below, deep


class TreeReader(DataSourceReader):
    def __init__(self, roots: list[str], split_depth: int):
        self.roots, self.split_depth = roots, split_depth
        self.kinds: set[str] | None = None
        self.least, self.most = 1, 1 << 31

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "kind" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.kinds = wanted if self.kinds is None else self.kinds & wanted
            elif name == "depth" and isinstance(f, EqualTo):
                self.least, self.most = max(self.least, f.value), min(self.most, f.value)
            elif name == "depth" and isinstance(f, LessThan | LessThanOrEqual):
                self.most = min(self.most, f.value - isinstance(f, LessThan))
            elif name == "depth" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            elif not isinstance(f, IsNotNull):  # no column is ever null
                yield f

    def partitions(self) -> list[Folder]:
        out = []
        for root in self.roots:
            todo = [("", 0)]
            while todo:
                below, level = todo.pop()
                deep = level >= self.split_depth
                out.append(Folder(root, below, deep))
                if not deep and level + 1 < self.most:
                    with os.scandir(root + below) as found:
                        todo += [(f"{below}/{e.name}", level + 1) for e in found if e.is_dir(follow_symlinks=False)]
        return out

    def read(self, part: Folder) -> Iterator[tuple]:
        todo = [part.below]
        while todo:
            below = todo.pop()
            at, depth = part.root + below, below.count("/") + 1
            if depth > self.most:
                continue
            try:
                found = os.scandir(at)
            except FileNotFoundError:  # it went since the driver listed it
                continue
            with found:
                for e in found:
                    folder = e.is_dir(follow_symlinks=False)
                    kind = "dir" if folder else "file"
                    if depth >= self.least and (self.kinds is None or kind in self.kinds):
                        yield part.root, at, e.path, below, e.name, kind, depth
                    if folder and part.deep:
                        todo.append(f"{below}/{e.name}")


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema: StructType) -> TreeReader:
        given = json.loads(self.options["roots"]) if "roots" in self.options else [self.options["path"]]
        return TreeReader([r.removeprefix("file:").rstrip("/") or "/" for r in given], int(self.options.get("split_depth", "1")))


def read_tree(spark: SparkSession, *roots: str, split_depth: int = 1) -> DataFrame:
    """Entries (root, parent, path, dir, name, kind, depth) of trees, read by tasks.

    A name that goes while it is read is left out; a root that does not exist is
    an error. An empty root has no rows.
    """
    spark.dataSource.register(FileTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("file_tree").option("roots", json.dumps(list(roots))).option("split_depth", str(split_depth)).load()

"""File listings and whole-file reads.

Spark's file sources list a file without bytes, but have no row for it. Here such
files have rows as all others do; ``empty_files`` finds them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_archive, is_lock_file
from .empty_files import empty_files

#: For corpora of many small files: what opening one counts as, in bytes, when
#: partitions are filled (4 MB by default, so a partition has 32 files at most), and
#: how many folders the driver lists by itself (32 by default).
SMALL_FILES = {"spark.sql.files.openCostInBytes": "65536", "spark.sql.sources.parallelPartitionDiscovery.threshold": "1"}
ENTRY = "root string, parent string, path string, dir string, name string, kind string, depth int"


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Settings for reading many small files, as before once it is left.

    What is read within must be worked out within. The readers set nothing
    themselves, since both are settings of a session alone.
    """
    before = {k: spark.conf.get(k) for k in SMALL_FILES}
    try:
        for k, v in SMALL_FILES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of files below ``path`` whose names match a glob.

    Only the listing is read; file bytes are not. Names that start with ``_`` or
    ``.`` are skipped by Spark's reader; ``list_tree`` sees them.
    """
    files = _files(spark, path, pattern)
    empty = empty_files(spark, path, pattern, lambda: files)
    return files.select("path", "length").unionByName(empty.select("path", F.lit(0).cast("long").alias("length")))


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, "*.txt")


def documents_among(files: DataFrame) -> DataFrame:
    """Word-processor files of a listing, without lock files."""
    return files.where(F.col("path").rlike(r"\.docx?\z") & ~is_lock_file(F.col("path")))


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Word-processor files without lock files."""
    return documents_among(scan(spark, path, "*.{doc,docx}"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path and content, a row per file; paths as ``scan`` has them, not as addresses."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    empty = empty_files(spark, path, pattern, lambda: _files(spark, path, pattern))
    return rows.select(name.alias("path"), F.col("value").alias("content")).unionByName(empty.select("path", F.lit("").alias("content")))


def read_binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content, a row per file."""
    files = _files(spark, path, pattern)
    empty = empty_files(spark, path, pattern, lambda: files)
    return files.select("path", "content").unionByName(empty.select("path", F.lit(b"").alias("content")))


def list_tree(spark: SparkSession, *roots: str) -> DataFrame:
    """Entries of local trees, walked on the driver (names of every kind).

    The tool that plans renames and deletions works on one machine's folders;
    the listing is as large as the number of their entries.
    """
    rows = []
    for root in roots:
        todo = [(root, "", 0)]
        while todo:
            at, below, depth = todo.pop()
            with os.scandir(at) as found:
                for e in sorted(found, key=lambda e: e.name):
                    folder = e.is_dir(follow_symlinks=False)
                    rows.append((root, at, e.path, below, e.name, "dir" if folder else "file", depth + 1))
                    if folder:
                        todo.append((e.path, f"{below}/{e.name}", depth + 1))
    return spark.createDataFrame(rows, ENTRY)


def flat(entries: DataFrame, kind: str = "file") -> DataFrame:
    """Entries that stand in a root itself."""
    return entries.where((F.col("depth") == 1) & (F.col("kind") == kind))


def collect_files(entries: DataFrame, exclude_archives: bool = False) -> DataFrame:
    files = entries.where("kind = 'file'")
    return files.where(~is_archive(F.col("name"))) if exclude_archives else files


def existing(paths: DataFrame, entries: DataFrame, kind: str | None = None) -> DataFrame:
    """Rows of ``paths`` (column path) that are listed."""
    known = entries if kind is None else entries.where(F.col("kind") == kind)
    return paths.join(known.select("path"), "path", "left_semi")


def catalog_files(files: DataFrame, base: str) -> DataFrame:
    """(dir, file) of txt, doc and docx files one level below ``base``."""
    prefix = base.rstrip("/") + "/"
    rest = F.substr("path", F.locate(prefix, F.col("path")) + len(prefix))
    parts = F.split(rest, "/")
    rows = files.where(F.contains("path", F.lit(prefix))).select(parts.alias("p")).where(F.size("p") == 2)
    return rows.select(F.col("p")[0].alias("dir"), F.col("p")[1].alias("file")).where(F.col("file").rlike(r"\.(txt|doc|docx)\z"))

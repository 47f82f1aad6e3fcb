"""Writing a built corpus: a file for each document and image; a command line.

A corpus is written beside its target, with a manifest, and takes the target's
place only when every file is there: a failed or stopped build leaves what was.
"""

from __future__ import annotations

import argparse
import hashlib
import os
import posixpath
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache, reduce
from itertools import batched

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import basename, file_stem, safe_name
from ..sources.config import BuildConfig
from .build import Built, build, report
from .shared import checked_target, exists, kept, listed, make, qualified, remove, staging, swap, within

#: Folder of a written corpus that holds what its tasks have written.
MANIFEST = ".manifest"
WRITTEN = "path string, bytes long, sha256 string, error string"
#: Files that a task removes at a time, names of a list that it holds, and rows that
#: deal out a list, by turns of so many names.
REMOVERS, REMOVED_NAMES, REMOVED_PARTS = 8, 4096, 4


def write_files(rows: DataFrame, base: str, manifest: str | None = None) -> DataFrame:
    """Writes rows (path, data) below ``base``; one row each: path, bytes, sha256, error.

    ``base`` is a folder that every executor reaches: a path of a shared mount,
    or an address that Arrow's file systems know. A file is written whole under
    its own name, so a task that runs again writes the same. A path outside the
    base or a failed write is a row with an error and ends nothing. Files are
    written when the result is read. With ``manifest``, a name, each task also
    lists its files (digest, bytes, path by tabs) below ``.manifest``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base.removeprefix("file:"))
        listed = None
        for b in batches:
            sizes, digests, errors = [], [], []
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                size, digest, error = 0, None, None
                try:
                    if path is None:
                        raise ValueError("a file without a path")
                    target = posixpath.normpath(f"{root}/{path}")
                    if not target.startswith(root.rstrip("/") + "/"):
                        raise ValueError("the path lies outside the target")
                    system.create_dir(posixpath.dirname(target), recursive=True)
                    held = data.as_buffer() if data.is_valid else pa.py_buffer(b"")
                    with system.open_output_stream(target) as out:
                        out.write(held)
                    size, digest = held.size, hashlib.sha256(held).hexdigest()
                    if manifest is not None:
                        if listed is None:
                            system.create_dir(f"{root}/{MANIFEST}", recursive=True)
                            listed = system.open_output_stream(f"{root}/{MANIFEST}/.{manifest}-{TaskContext.get().partitionId():05d}.tsv")
                        listed.write(f"{digest}\t{size}\t{path}\n".encode())
                except Exception as e:
                    error = str(e) or type(e).__name__
                sizes.append(size)
                digests.append(digest)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(errors, pa.string())], ["path", "bytes", "sha256", "error"])
        if listed is not None:
            listed.close()

    return rows.select(F.col("path").cast("string"), F.col("data").cast("binary")).mapInArrow(run, WRITTEN)


def corpus_files(built: Built, target: str) -> dict[str, DataFrame]:
    """Kind -> (path, data), paths below the target, of all that is written."""
    below = F.substr("path", F.lit(len(target.rstrip("/")) + 2))
    out = {"documents": built.documents.select(below.alias("path"), F.encode("content", "UTF-8").alias("data"))}
    if built.images is not None:
        name = safe_name(file_stem(basename(F.col("path"))))
        out["images"] = built.images.where("status = 'ok'").select(F.concat(F.lit("images/"), name, F.lit("/"), F.col("name")).alias("path"), "data")
    return out


def write_corpus(spark: SparkSession, built: Built, target: str, base: str, sources: list[str] | None = None, partial: bool = False) -> DataFrame:
    """Writes documents and shown images anew; what failed: path, stage, error.

    Paths of ``built.documents`` begin with ``target``; files go below ``base``.
    A target that is no folder below the base, or that overlaps one of the
    ``sources``, is refused before anything is done. Where a file could not be
    written, what the target held stays as it was and the new files go, unless
    ``partial`` is true; so it does where the build itself fails.
    """
    full = checked_target(spark, base, target, sources or [])
    new = staging(full)
    try:
        written = {kind: kept(write_files(files, new, manifest=kind)) for kind, files in corpus_files(built, target).items()}
        failed = reduce(DataFrame.unionByName, [w.where("error IS NOT NULL").select(F.concat(F.lit(f"{target}/"), "path").alias("path"), F.lit("write").alias("stage"), "error") for w in written.values()])
        if partial or failed.isEmpty():
            if not exists(spark, new):  # nothing was to be written
                make(spark, new)
            swap(spark, new, full)
    finally:
        remove(spark, new)
    return failed


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256 of what a written corpus should hold.

    Spark's readers skip names that start with a dot, so tasks open the lists;
    there is one for each task that wrote.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name.removeprefix("file:"))
                with system.open_input_stream(at) as lines:
                    rows = [x.split("\t", 2) for x in lines.read().decode().split("\n")[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.string()), pa.array([int(r[1]) for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.string())], ["path", "bytes", "sha256"])

    return spark.createDataFrame([(n,) for n in listed(spark, f"{folder}/{MANIFEST}")], "name string").mapInArrow(run, "path string, bytes long, sha256 string")


def remove_written(spark: SparkSession, folder: str) -> None:
    """Removes a written corpus, with all that lies in its folder.

    On a disk or mount the files that the manifest names go by tasks, in the order of
    writing, since a disk may take longer to free a small file than to write it. The
    driver removes what is left: folders, lists and files that no list names. Other
    systems remove a folder in one call. What lies behind a symbolic link stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = os.path.realpath(root)
        inside = lru_cache(1024)(lambda at: within(os.path.realpath(at), top))

        def drop(lines: tuple[bytes, ...]) -> None:
            for line in lines:
                target = posixpath.normpath(f"{top}/{os.fsdecode(line.rstrip(b'\n').split(b'\t', 2)[-1])}")
                if target != top and inside(posixpath.dirname(target)):
                    try:
                        os.unlink(target)
                    except OSError:  # it is gone, or is a matter of the driver
                        pass

        with ThreadPoolExecutor(REMOVERS) as threads:
            for b in batches:
                for name, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    with open(name.removeprefix("file:"), "rb") as lines:
                        for k, block in enumerate(batched(lines, REMOVED_NAMES)):
                            if k % REMOVED_PARTS == part:
                                list(threads.map(drop, (block[i::REMOVERS] for i in range(REMOVERS))))
                yield b

    full = qualified(spark, folder)
    root = full.removeprefix("file:")
    try:
        lists = listed(spark, f"{folder}/{MANIFEST}") if full.startswith("file:") else []
        if lists:
            rows = [(n, part) for n in lists for part in range(REMOVED_PARTS)]
            spark.createDataFrame(rows, "name string, part int").mapInArrow(run, "name string, part int").write.format("noop").mode("overwrite").save()
    finally:
        remove(spark, folder)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusforge-build", description=__doc__)
    parser.add_argument("source", help="folder of the source documents")
    parser.add_argument("out", help="folder to write below")
    parser.add_argument("--target", default="docs", help="name of the written corpus")
    parser.add_argument("--manual", help="folder of the catalog; by default the source")
    parser.add_argument("--ignore", action="append", default=[], help="folder to leave out, as Spark lists it")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    sources = [args.source, args.manual or args.source]
    try:
        checked_target(spark, args.out, args.target, sources)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    built = build(spark, args.source, args.target, args.manual or args.source, BuildConfig(ignored_folders=tuple(args.ignore)))
    failed = write_corpus(spark, built, args.target, args.out, sources)
    for row in report(Built(built.documents, built.images, built.errors.unionByName(failed))).orderBy("stage").collect():
        print(row.stage, row.n)
    return 0


if __name__ == "__main__":
    sys.exit(main())

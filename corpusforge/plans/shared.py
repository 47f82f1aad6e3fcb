"""Folders on the file systems that Spark reaches: kept tables, safe targets, swaps."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares.

    ``spark.checkpoint.dir`` is used as the session has it. Where it is unset, a
    temporary folder serves on one machine; a cluster without it is refused, as
    its executors would not see each other's files.
    """
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if folder is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpusforge-")
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` worked out once, in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's path as listings show it, symbolic links of local ones resolved."""
    system, path = _path(spark, folder)
    full = system.makeQualified(path).toString().rstrip("/")
    if full.startswith("file:"):
        full = "file:" + os.path.realpath(full.removeprefix("file:"))
    return full


def exists(spark: SparkSession, folder: str) -> bool:
    system, path = _path(spark, folder)
    return system.exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    system, path = _path(spark, folder)
    system.delete(path, True)


def make(spark: SparkSession, folder: str) -> None:
    system, path = _path(spark, folder)
    system.mkdirs(path)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The files that stand in a folder, hidden ones too."""
    system, path = _path(spark, folder)
    return sorted(s.getPath().toString() for s in system.listStatus(path)) if system.exists(path) else []


def matched(spark: SparkSession, pattern: str) -> list[str]:
    """What a path, or a pattern of paths, stands for, as listings show it."""
    system, path = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in system.globStatus(path) or [])


def move(spark: SparkSession, src: str, dst: str) -> None:
    system, path = _path(spark, src)
    if not system.rename(path, _path(spark, dst)[1]):
        raise OSError(f"{src} was not moved to {dst}")


def within(path: str, folder: str) -> bool:
    """The path is the folder or lies in it."""
    return path == folder or path.startswith(folder.rstrip("/") + "/")


def checked_target(spark: SparkSession, base: str, target: str, sources: list[str]) -> str:
    """The full path of ``target`` below ``base``, if it may be written anew.

    It must be a name or a relative path that leads below the base and that is
    neither one of the sources, nor above or below one: what stands there is
    replaced, and a lazy build reads its sources until the end.
    """
    clean = posixpath.normpath(target.replace("\\", "/")) if target.strip() else "."
    if clean == "." or clean.startswith(("/", "../")) or clean == ".." or "://" in target:
        raise ValueError(f"the target {target!r} names no folder below {base}")
    top, full = qualified(spark, base), qualified(spark, f"{base}/{clean}")
    if full == top or not within(full, top):
        raise ValueError(f"the target {target!r} leads out of {base}")
    for source in sources:
        own = qualified(spark, source)
        if within(own, full) or within(full, own):
            raise ValueError(f"the target {full} and the source {own} overlap")
    return full


def staging(folder: str) -> str:
    """A fresh name beside a folder, hidden from Spark's readers."""
    parent, name = folder.rstrip("/").rsplit("/", 1)
    return f"{parent}/.{name}-{uuid.uuid4().hex}"


def swap(spark: SparkSession, new: str, folder: str) -> None:
    """``new`` takes the place of ``folder``; on a failure the old one is put back.

    Renames are atomic on HDFS and local disks. On object stores they copy, so a
    reader there may meet a half-moved folder.
    """
    old = staging(folder) if exists(spark, folder) else None
    if old:
        move(spark, folder, old)
    try:
        move(spark, new, folder)
    except Exception:
        if old:
            move(spark, old, folder)
        raise
    if old:
        remove(spark, old)

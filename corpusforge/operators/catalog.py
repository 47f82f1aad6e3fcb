"""The catalog of names by directory, and its subset of pointing names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.names import catalog_name, is_lock_file, is_pointing, strip_pointing, under


def ignore_filter(files: DataFrame, folders: list[str] | None = None, ignored: list[str] | DataFrame | None = None, path: str = "path") -> DataFrame:
    """Files that are in no ignored folder, not ignored themselves, no lock files.

    A short list of ignored files is folded into the scan's filter; a DataFrame
    (column ``path``) is an anti join, whatever its size.
    """
    if isinstance(ignored, DataFrame):
        return files.where(ignore_test(F.col(path), folders)).join(ignored.select(F.col("path").alias(path)), path, "left_anti")
    return files.where(ignore_test(F.col(path), folders, ignored))


def catalog_rows(names: DataFrame) -> DataFrame:
    """(dir, name) of listed files with columns dir and file."""
    return names.select("dir", catalog_name(F.col("file")).alias("name"))


def catalog(rows: DataFrame) -> DataFrame:
    """dir -> names, sorted; directories without names have no row."""
    return rows.groupBy("dir").agg(F.array_sort(F.collect_list("name")).alias("names"))


def pointing_rows(rows: DataFrame) -> DataFrame:
    return rows.where(is_pointing(F.col("name"))).select("dir", strip_pointing(F.col("name")).alias("name"))


def catalog_counts(rows: DataFrame) -> DataFrame:
    """One row: directories, names, and those of the pointing subset."""
    mark = is_pointing(F.col("name"))
    return rows.agg(F.count_distinct("dir").alias("n_dirs"), F.count(F.lit(1)).alias("n_names"), F.count_distinct(F.when(mark, F.col("dir"))).alias("n_pointing_dirs"), F.count_if(mark).alias("n_pointing"))


def ignore_test(path: Column, folders: list[str] | None = None, ignored: list[str] | None = None) -> Column:
    """True for files that the ignore rules keep."""
    keep = ~is_lock_file(path)
    for folder in folders or []:
        keep = keep & ~under(path, folder)
    return keep & ~path.isin(*ignored) if ignored else keep


def file_counts(files: DataFrame, folders: list[str] | None = None, ignored: list[str] | None = None, path: str = "path") -> DataFrame:
    """One row: n_found files, n_ignored of them by the ignore rules, n_kept."""
    keep = ignore_test(F.col(path), folders, ignored)
    return files.agg(F.count(F.lit(1)).alias("n_found"), F.count_if(~keep).alias("n_ignored"), F.count_if(keep).alias("n_kept"))


def observed_filter(files: DataFrame, folders: list[str] | None = None, ignored: list[str] | None = None, path: str = "path") -> tuple[DataFrame, Observation]:
    """``ignore_filter`` by name lists, and the counts of ``file_counts`` that come
    with it: once the files are read the observation has n_found, n_ignored, n_kept."""
    keep, seen = ignore_test(F.col(path), folders, ignored), Observation()
    counted = files.withColumn("__keep", keep).observe(seen, F.count(F.lit(1)).alias("n_found"), F.count_if(~F.col("__keep")).alias("n_ignored"), F.count_if(F.col("__keep")).alias("n_kept"))
    return counted.where("__keep").drop("__keep"), seen

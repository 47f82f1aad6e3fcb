"""Plans of renames, moves and deletions, as a table of actions.

``actions``: root, seq, op ("extract", "delete", "move", "rename"), src, dst,
reason. A plan is data: it can be looked at, filtered and tested; ``commit``
carries it out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import file_stem
from ..operators.targets import DECOMPRESS, detect_targets, number_range, select_archives
from ..operators.tree import deepest_dirs, dirty_files, flatten_moves, non_volume_files, pruned_dirs, volume_sets
from ..sources.config import OrganizeConfig

COLUMNS = ["root", "seq", "op", "src", "dst", "reason"]


def _actions(rows: DataFrame, seq: int, op: str, src, dst, reason: str) -> DataFrame:
    return rows.select("root", F.lit(seq).alias("seq"), F.lit(op).alias("op"), src.alias("src"), dst.cast("string").alias("dst"), F.lit(reason).alias("reason"))


def _path(folder: str = "dir", name: str = "name"):
    return F.concat(F.col("root"), F.col(folder), F.lit("/"), F.col(name))


def plan_targets(spark: SparkSession, entries: DataFrame, config: OrganizeConfig, base: str) -> DataFrame:
    """number (null in full mode), phase, full_path, name of what is to be done.

    With a range: the best entry for each number; without: every archive.
    """
    top = entries.where("depth = 1")
    if config.folder_range:
        return detect_targets(number_range(spark, *config.folder_range), top, base)
    found = select_archives(top, config.decompress_mixed_names)
    return found.select(F.lit(None).cast("long").alias("number"), F.lit(DECOMPRESS).alias("phase"), F.concat(F.lit(base.rstrip("/") + "/"), "name").alias("full_path"), "name")


def plan_extractions(targets: DataFrame, config: OrganizeConfig) -> DataFrame:
    """First round: unpack archives beside themselves; then their source goes."""
    rows = targets.where(F.col("phase") == DECOMPRESS).withColumn("root", F.concat(F.regexp_replace("full_path", r"[^/]*\z", ""), file_stem(F.col("name"))))
    out = _actions(rows, 0, "extract", F.col("full_path"), F.col("root"), "archive")
    return out.unionByName(_actions(rows, 1, "delete", F.col("full_path"), F.lit(None), "package")) if config.delete_packages else out


def plan_dirty(spark: SparkSession, entries: DataFrame, config: OrganizeConfig) -> DataFrame:
    """Junk in folders, wherever it lies."""
    names = spark.createDataFrame([(n,) for n in config.dirty_files], "name string")
    dirty = dirty_files(entries.where("kind = 'file'").select("root", "dir", "name"), names)
    return _actions(dirty, 5, "delete", _path(), F.lit(None), "junk")


def plan_volumes(files: DataFrame, config: OrganizeConfig) -> DataFrame:
    """Second round, over unpacked folders: what multi-volume sets need."""
    sets = volume_sets(files)
    junk = _actions(non_volume_files(files, sets), 10, "delete", _path(), F.lit(None), "not a volume")
    first = F.concat("root", "dir", F.lit("/"), "base", F.lit(".7z.001"))
    parts = [junk, _actions(sets, 11, "extract", first, F.concat("root", "dir"), "volumes")]
    if config.delete_packages:
        parts.append(_actions(sets.select("root", "dir", F.explode("files").alias("name")), 12, "delete", _path(), F.lit(None), "volume"))
    return reduce(DataFrame.unionByName, parts)


def plan_organize(spark: SparkSession, entries: DataFrame, config: OrganizeConfig, archives_only: DataFrame | None = None) -> DataFrame:
    """Third round, over folders: junk, flattening, pruning, renaming.

    ``entries`` has root, dir, name, kind. ``archives_only`` (root, base) names
    folders that came from archives: they are flattened whatever their depth
    and take the base as their name.
    """
    names = spark.createDataFrame([(n,) for n in config.dirty_files], "name string")
    files = entries.where("kind = 'file'").select("root", "dir", "name")
    dirty = dirty_files(files, names)
    left = files.join(dirty, ["root", "dir", "name"], "left_anti")
    kept = entries.join(dirty.withColumn("kind", F.lit("file")), ["root", "dir", "name", "kind"], "left_anti")
    deepest = deepest_dirs(kept, entries.select("root").distinct())
    nested = deepest.where("dir <> ''").select("root", F.col("detected").alias("new_name"))
    if archives_only is not None:
        nested = nested.join(archives_only, "root", "left_anti").unionByName(archives_only.select("root", F.col("base").alias("new_name")))
    parts = [_actions(dirty, 20, "delete", _path(), F.lit(None), "junk")]
    if config.move_files_to_root:
        inside = left.join(nested.select("root"), "root", "left_semi")
        moves = flatten_moves(inside)
        parts.append(_actions(moves, 21, "move", _path(), F.concat("root", F.lit("/"), "dest"), "flatten"))
        # All plain files have left by then: every directory below the root goes.
        dirs = kept.where("kind = 'dir'").select("root", F.concat("dir", F.lit("/"), "name").alias("dir")).join(nested.select("root"), "root", "left_semi")
        gone = pruned_dirs(inside.limit(0), dirs).where(F.size(F.split("dir", "/")) == 2)
        parts.append(_actions(gone, 22, "delete", F.concat("root", "dir"), F.lit(None), "empty"))
    if config.rename_root:
        dst = F.concat(F.regexp_replace("root", r"[^/]*\z", ""), "new_name")
        renames = nested.where("new_name IS NOT NULL").withColumn("dst", dst).where("dst <> root")
        taken = renames.join(entries.select(F.col("root").alias("dst")).distinct(), "dst", "left_semi")
        parts.append(_actions(taken, 23, "delete", F.col("dst"), F.lit(None), "name taken"))
        parts.append(_actions(renames, 24, "rename", F.col("root"), F.col("dst"), "detected name"))
    return reduce(DataFrame.unionByName, parts)

"""Which archive or folder stands for each number of a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jstext import padded
from ..functions.names import is_archive_candidate, leading_digits

DECOMPRESS, ORGANIZE, UNKNOWN = "decompress", "organize", "unknown"


def number_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Numbers from start to end, both inclusive."""
    return spark.range(start, end + 1).select(F.col("id").alias("number"))


def select_archives(entries: DataFrame, allow_mixed: bool = False) -> DataFrame:
    """Files (name, kind) that may be unpacked."""
    return entries.where((F.col("kind") == "file") & is_archive_candidate(F.col("name"), allow_mixed))


def _priority(name: Column, kind: Column, number: Column) -> Column:
    """1.. for an archive, then an exact folder, then a fuzzy one; else null."""
    bare, full = number.cast("string"), padded(number)
    rank = None
    for i, ext in enumerate((".gz", ".zip", ".7z")):
        for j, form in enumerate((bare, full)):
            test = (kind == "file") & (name == F.concat(form, F.lit(ext)))
            rank = F.when(test, 1 + 2 * i + j) if rank is None else rank.when(test, 1 + 2 * i + j)
    return rank.when((kind == "dir") & (name == bare), 7).when((kind == "dir") & (name == full), 8).when((kind == "dir") & ~F.contains(name, F.lit("NO.")), 9)


def detect_targets(numbers: DataFrame, entries: DataFrame, root: str = "") -> DataFrame:
    """number, phase, full_path, name: the best entry (name, kind) of each number.

    A number matches an entry whose leading run of digits is the number, bare
    or padded to three places; that makes the lookup an equi join. Numbers
    without an entry have no row. Of fuzzy folders the first by name counts.
    """
    keys = F.explode(F.array_distinct(F.array(F.col("number").cast("string"), padded(F.col("number")))))
    wanted = numbers.select("number", keys.alias("digits"))
    found = wanted.join(entries.select("name", "kind", leading_digits(F.col("name")).alias("digits")).where("digits <> ''"), "digits")
    found = found.withColumn("rank", _priority(F.col("name"), F.col("kind"), F.col("number"))).where("rank IS NOT NULL")
    best = found.groupBy("number").agg(F.min(F.struct("rank", "name")).alias("best"))
    phase = F.when(F.col("best.rank") <= 6, DECOMPRESS).otherwise(ORGANIZE)
    return best.select("number", phase.alias("phase"), F.concat(F.lit(root.rstrip("/") + "/" if root else ""), F.col("best.name")).alias("full_path"), F.col("best.name").alias("name"))


def phase_counts(targets: DataFrame) -> DataFrame:
    return targets.groupBy("phase").agg(F.count(F.lit(1)).alias("n"))



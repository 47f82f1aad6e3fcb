"""File trees as tables: junk, volumes, flattening, pruning, descent.

A tree is a table of entries: ``root`` (which tree), ``dir`` (the directory of
the entry below the root, "" for the root itself, else starting with a slash),
``name`` and ``kind`` ("file" or "dir"). Where only files are listed,
``directories`` gives the directories. Nothing here touches a disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import extension, file_stem, is_archive, is_volume, volume_base
from ..plans.shared import kept


#: Names are broadcast up to this size, by a measuring pass; a name is heavy if it has
#: at least one file in so many, so there are at most so many heavy ones.
BROADCAST_BYTES, HEAVY_NAMES = 16 << 20, 4096
#: So many junk names at most are part of a filter.
SMALL_NAMES = 1024
#: Rows that are dealt out to a partition, in up to so many (Spark writes these without
#: sorting them); parts of a tree.
SPREAD_ROWS, SPREAD_MOST, TREE_PARTS = 500_000, 200, 1024
#: How far below its root a directory lies.
LEVEL = "length(dir) - length(replace(dir, '/'))"


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, without the root."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    paths = F.transform(parts, lambda p, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    return F.when(F.size(parts) > 0, paths).otherwise(F.array().cast("array<string>"))


def parent_of(folder: Column) -> Column:
    return F.regexp_replace(folder, r"/[^/]*\z", "")


def last_of(folder: Column) -> Column:
    return F.regexp_extract(folder, r"([^/]*)\z", 1)


def directories(files: DataFrame) -> DataFrame:
    """Distinct (root, dir) of all directories that hold the files, root left out."""
    return files.select("root", F.explode(ancestors(F.col("dir"))).alias("dir")).distinct()


def dirty_files(files: DataFrame, names: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, small_names: int = SMALL_NAMES) -> DataFrame:
    """Files whose name or stem is in ``names`` (column name), each once.

    Files are never dealt out by a name that many of them have. At most ``small_names``
    names are a filter, which Spark takes to where the files are read; more are
    broadcast where their measured size allows. Of a larger table, the names in it that
    files really have are found first, from distinct names; those of at least one
    file in HEAVY_NAMES are broadcast, and only files of other names are shuffled.
    """
    keys = F.explode(F.array_distinct(F.array("name", file_stem(F.col("name"))))).alias("__key")
    wanted = kept(names.select(F.col("name").alias("__key")).where("__key IS NOT NULL").distinct())
    few = wanted.limit(small_names + 1).collect()
    if len(few) <= small_names:
        known = [r[0] for r in few]
        return files.where(F.col("name").isin(known) | file_stem(F.col("name")).isin(known)).distinct()
    size = wanted.agg(F.sum(F.octet_length("__key") + 32)).first()[0] or 0
    if size <= broadcast_bytes:
        return files.select("*", keys).join(F.broadcast(wanted), "__key", "left_semi").drop("__key").distinct()
    counted = kept(files.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hits = kept(counted.select("*", keys).join(wanted, "__key", "left_semi").drop("__key").distinct())
    heavy = F.broadcast(hits.where(F.col("n") * HEAVY_NAMES >= total).select("name"))
    rare = files.join(heavy, "name", "left_anti").join(hits.where(F.col("n") * HEAVY_NAMES < total).select("name"), "name", "left_semi")
    return files.join(heavy, "name", "left_semi").unionByName(rare).select(files.columns).distinct()


def volume_sets(files: DataFrame) -> DataFrame:
    """root, dir, base, files: the first directory of a tree that holds volumes.

    First is by path; the base is that of its first volume by name, while
    ``files`` has all volumes of the directory, of other bases too.
    """
    volumes = files.where(is_volume(F.col("name")))
    at = volumes.groupBy("root").agg(F.min("dir").alias("dir"))
    held = volumes.join(at, ["root", "dir"]).groupBy("root", "dir").agg(F.array_sort(F.collect_set("name")).alias("files"))
    return held.select("root", "dir", volume_base(F.col("files")[0]).alias("base"), "files")


def non_volume_files(files: DataFrame, sets: DataFrame) -> DataFrame:
    """Files of a volume directory that are not named after its base."""
    joined = files.join(sets.select("root", "dir", "base"), ["root", "dir"])
    return joined.where(~F.startswith("name", F.concat("base", F.lit(".7z.")))).drop("base")


def unique_names(files: DataFrame) -> DataFrame:
    """root, dir, name, dest: names of files moved to their root.

    The fast form: files that stand in the root keep their names, later ones of
    a name get -1, -2, ... by directory. It is exact where no file is itself
    named like a numbered one; ``unique_names_exact`` covers the rest.
    """
    order = Window.partitionBy("root", "name").orderBy(F.when(F.col("dir") == "", 0).otherwise(1), "dir")
    n = F.row_number().over(order) - 1
    numbered = F.concat(file_stem(F.col("name")), F.lit("-"), n.cast("string"), extension(F.col("name")))
    return files.select("root", "dir", "name", F.when(n == 0, F.col("name")).otherwise(numbered).alias("dest"))


#: A name that looks like a numbered one: its stem without the number, and the number.
NUMBERED = r"(?s)\A(.+)-([1-9][0-9]{0,17})\z"


def _skipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (root, name, k, least) rows in order those numbers that are never given
    out, with how many there are up to each: one is skipped if fewer than ``least``
    were before it. Only that count is held."""
    of, count = None, 0
    for b in batches:
        keep, counts = [], []
        for root, name, k, least in zip(*(b.column(c).to_pylist() for c in ("root", "name", "k", "least")), strict=True):
            if (root, name) != of:
                of, count = (root, name), 0
            keep.append(count < least)
            count += keep[-1]
            counts.append(count)
        yield pa.RecordBatch.from_arrays([b.column("root"), b.column("name"), b.column("k"), pa.array(counts, pa.int64())], ["root", "name", "k", "count"]).filter(pa.array(keep, pa.bool_()))


def unique_names_exact(files: DataFrame) -> DataFrame:
    """As ``unique_names``, also where a numbered name exists by itself.

    Files are moved by directory, then name, and each takes the first name that
    is free: its own, or stem-1, stem-2, ... The files of one name in a tree are a
    family, and a number k is closed to it once a file of its own is named stem-k
    and its turn has come. So the numbers that a family never gives out follow
    from the turns of those files alone, and the i-th file takes the i-th of the
    others: windows over families, no task over a tree. A file named stem-k may in
    turn find its name given out to a file of that family; therefore families
    without a number go first, then those with one, two, ... numbers at the end.
    Families without such relations take the window of ``unique_names``.
    """
    files = kept(files.select("root", "dir", "name"))
    if files.where(file_stem(F.col("name")).rlike(NUMBERED)).isEmpty():
        return unique_names(files)
    first = files.groupBy("root", "name").agg(F.min("dir").alias("first")).withColumns({"stem": file_stem(F.col("name")), "ext": extension(F.col("name"))})
    own = first.select("root", F.col("name").alias("parent"), F.col("stem").alias("p_stem"), F.col("ext").alias("p_ext"))
    told = first.where(F.col("stem").rlike(NUMBERED)).withColumns({"p_stem": F.regexp_extract("stem", NUMBERED, 1), "k": F.regexp_extract("stem", NUMBERED, 2).cast("long")})
    told = told.withColumn("parent", F.concat("p_stem", "ext")).join(own.withColumnRenamed("p_ext", "ext"), ["root", "parent", "p_stem", "ext"])
    told = kept(told.select("root", "parent", "name", "k", "first"))
    if told.isEmpty():
        return unique_names(files)

    related = told.select("root", "name").union(told.select("root", F.col("parent").alias("name"))).distinct()
    level = F.size(F.regexp_extract_all(F.regexp_extract(file_stem(F.col("name")), r"((?:-[1-9][0-9]*)*)\z", 1), F.lit("-"), F.lit(0)))
    touched = kept(files.join(related, ["root", "name"], "left_semi").withColumn("level", level))
    out = unique_names(files.join(related, ["root", "name"], "left_anti"))
    family = Window.partitionBy("root", "name")
    kind = T.StructType([T.StructField("root", files.schema["root"].dataType), T.StructField("name", T.StringType()), T.StructField("k", T.LongType()), T.StructField("count", T.LongType())])
    given = None
    for at in sorted(r.level for r in touched.select("level").distinct().collect()):  # no more than a name has digits
        rows = touched.where(F.col("level") == at)
        n = F.row_number().over(family.orderBy("dir")) - 1
        if given is None:
            rows = rows.withColumn("n", n.cast("long"))
        else:
            # The name of the first one was given to a file of another family before.
            rows = rows.join(given, ["root", "name"], "left").withColumn("n", (n + F.coalesce("lost", F.lit(0))).cast("long"))
        rows = kept(rows.select("root", "dir", "name", "n"))
        late = rows.where("n > 0")
        closed = told.join(rows.select("root", F.col("name").alias("parent")).distinct(), ["root", "parent"], "left_semi")
        turns = late.select("root", "name", F.struct("dir", "name").alias("turn"), F.lit(0).cast("long").alias("k"))
        turns = turns.unionByName(closed.select("root", F.col("parent").alias("name"), F.struct(F.col("first").alias("dir"), "name").alias("turn"), "k"))
        before = F.count_if(F.col("k") == 0).over(family.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        # k is skipped if its file comes before the file that would take it.
        least = turns.withColumn("least", F.col("k") - before).where("k > 0").select("root", "name", "k", "least")
        skips = least.repartition("root", "name").sortWithinPartitions("root", "name", "k").mapInArrow(_skipped, kind)
        # The i-th number that is left: i and the skipped ones with fewer left below them.
        both = late.select("root", "name", "dir", "n", F.col("n").alias("at"), F.lit(1).alias("file"))
        both = both.unionByName(skips.select("root", "name", F.lit(None).cast("string").alias("dir"), F.lit(None).cast("long").alias("n"), (F.col("k") - F.col("count") + 1).alias("at"), F.lit(0).alias("file")))
        over = F.count_if(F.col("file") == 0).over(family.orderBy("at", "file").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        number = (F.col("n") + over).cast("string")
        dest = F.concat(file_stem(F.col("name")), F.lit("-"), number, extension(F.col("name")))
        numbered = kept(both.withColumn("dest", dest).where("file = 1").select("root", "dir", "name", "dest"))
        out = out.unionByName(rows.where("n = 0").select("root", "dir", "name", F.col("name").alias("dest"))).unionByName(numbered)
        given = kept(numbered.join(related.withColumnRenamed("name", "dest"), ["root", "dest"], "left_semi").select("root", F.col("dest").alias("name"), F.lit(1).alias("lost")))
    return out


def flatten_moves(files: DataFrame, exact: bool = True) -> DataFrame:
    """Moves of all files but archives from below the root into it."""
    plain = files.where(~is_archive(F.col("name")) | (F.col("dir") == ""))
    named = unique_names_exact(plain) if exact else unique_names(plain)
    return named.where("dir <> ''")


def pruned_dirs(files: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """(root, dir) that go when empty and archive-only directories are deleted.

    Bottom up, a directory goes if nothing is left in it but names that look
    like archives (of directories too, with all they hold). So it keeps itself
    iff a file with another name lies in it, or below it with only directories
    of other names in between; and it stays iff all above it stay as well.
    """
    # One pass over the files: each directory once, with what it holds.
    held = files.select("root", "dir", (~is_archive(F.col("name"))).alias("plain"))
    held = held if dirs is None else held.unionByName(dirs.select("root", "dir", F.lit(False).alias("plain")))
    held = held.groupBy("root", "dir").agg(F.bool_or("plain").alias("plain"))
    dirs = held.select("root", F.explode(ancestors(F.col("dir"))).alias("dir")).distinct()
    plain = held.where("plain")
    # From the file's directory upwards, as far as no archive-named directory is left behind.
    chain = ancestors(F.col("dir"))
    named = F.transform(chain, lambda d: is_archive(last_of(d)))
    last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(chain), F.lit(1))), F.lit(0), lambda acc, i: F.when(F.try_element_at(named, i), i).otherwise(acc))
    reach = F.slice(chain, F.greatest(last, F.lit(1)), F.size(chain))
    keeps = plain.where("dir <> ''").select("root", F.explode(reach).alias("dir")).distinct()
    fails = dirs.join(keeps, ["root", "dir"], "left_anti")
    above = dirs.select("root", "dir", F.explode(ancestors(F.col("dir"))).alias("up"))
    return above.join(fails.withColumnRenamed("dir", "up"), ["root", "up"], "left_semi").select("root", "dir").distinct()


def _parts(rows: DataFrame) -> int:
    """To how many partitions directories are dealt out: by their number.

    Spark puts partitions together by their size on disk, and paths in order are many
    times larger in a hash table; partitions that are asked for by number are left alone.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, min(SPREAD_MOST, rows.count() // SPREAD_ROWS + 1))


def _deepest(listed: DataFrame, parts: int) -> DataFrame:
    """root, dir, detected of directories (root, dir, folder, holds), rows repeated at will.

    ``folder`` tells that the directory is listed itself, ``holds`` that a file lies in it.
    """
    # Each directory once, then the levels of a part of each tree: dealt out once for both.
    part = F.pmod(F.xxhash64("dir"), F.lit(TREE_PARTS)).cast("int")
    dirs = listed.withColumn("part", part).repartition(parts, "root", "part").groupBy("root", "part", "dir").agg(F.bool_or("folder").alias("folder"), F.bool_or("holds").alias("holds"))
    dirs = dirs.withColumns({"depth": F.expr(LEVEL), "own": F.col("folder") | (F.col("dir") == "")})
    some = dirs.groupBy("root", "part", "depth").agg(F.count_if("own").alias("n"), F.bool_or(F.col("own") & F.col("holds")).alias("holds"), F.min(F.when(F.col("own"), F.col("dir"))).alias("dir"))
    levels = some.repartition(parts, "root").groupBy("root", "depth").agg(F.sum("n").alias("n"), F.bool_or("holds").alias("holds"), F.min("dir").alias("dir"))
    # A level is reached if it has one directory and the one above is left for it.
    down = Window.partitionBy("root").orderBy("depth")
    bare = ~F.coalesce(F.lag("holds").over(down), F.lit(False))
    next_to = F.coalesce(F.lag("depth").over(down), F.lit(0)) == F.col("depth") - 1
    step = levels.select("root", "depth", "dir", bare.alias("bare"), ((F.col("depth") == 0) | ((F.col("n") == 1) & next_to & (bare | F.col("holds")))).alias("step"))
    reached = step.withColumn("reached", F.bool_and("step").over(down))
    last = F.lead("reached").over(down)
    # A directory without files gives its name to what was detected before.
    name = F.max(F.when(F.col("bare") & F.col("reached"), F.col("depth"))).over(down)
    ends = reached.select("root", "depth", "dir", "reached", name.alias("at"), (~F.coalesce(last, F.lit(False))).alias("last"), F.row_number().over(down).alias("row"))
    ends = ends.where("(reached AND last) OR (NOT reached AND row = 1)")
    found = F.col("reached") & (F.col("depth") > 0)
    return ends.select("root", F.when(found, F.col("dir")).otherwise("").alias("dir"), F.when(found, F.element_at(F.split("dir", "/"), F.greatest(F.coalesce("at", F.lit(1)), F.lit(1)).cast("int") + 1)).alias("detected"))


def deepest_dirs(entries: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """root, dir, detected: where the content of a tree begins.

    From the root: a directory that holds one directory and no file is left for
    it, and its name is the detected one; one that holds one directory and
    files is left for it if it holds a file, and gives a name only if there is
    none yet. So the way down goes by levels of a tree that have one directory, and
    ends at the first that has more: levels are counted, and no tree is ever in
    one task. All directories above a listed one are taken to be listed too.
    """
    folder = F.col("kind") == "dir"
    listed = entries.select("root", F.when(folder, F.concat("dir", F.lit("/"), "name")).otherwise(F.col("dir")).alias("dir"), folder.alias("folder"), (F.col("kind") == "file").alias("holds"))
    found = _deepest(listed, _parts(entries))
    return found if roots is None else roots.join(found, "root", "left").select("root", F.coalesce("dir", F.lit("")).alias("dir"), "detected")


def deepest_dirs_of(files: DataFrame) -> DataFrame:
    """``deepest_dirs`` where only files (root, dir) are listed, rows repeated at will."""
    parts = _parts(files)
    held = files.select("root", "dir").repartition(parts, "root", "dir").distinct()
    # The root, what lies between, and the directory itself.
    at = F.expr(f"transform(sequence(0, {LEVEL}), k -> named_struct('dir', substring_index(dir, '/', k + 1), 'holds', k = {LEVEL}))")
    return _deepest(held.select("root", F.inline(at)).withColumn("folder", F.lit(True)), parts)


def rename_collisions(renames: DataFrame) -> DataFrame:
    """Targets that several trees would take: dst, n."""
    return renames.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

"""Renames as a graph: chains, cycles, names that are taken.

All renames are meant to happen at once. Done one after the other they must be
put in order: in a chain the last one goes first, and a cycle needs a name for
the time being. Sources that want one name, and names of folders that stay, are
found before anything is done. Chains and cycles of any length take a number of
joins that grows with the logarithm of their length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import kept

RENAME, COLLISION, TAKEN, BLOCKED = "rename", "collision", "taken", "blocked"


#: What is known of a mover after some rounds: where so many steps lead (``jump``, null
#: beyond the end of its chain), the least source met on the way with the first and last
#: step at which it was met, and, at the end, its chain's ``end`` with the steps to it.
_WALK = ("src", "dst", "jump", "least", "first", "last", "end", "dist", "cyclic")


def _walked(links: DataFrame) -> DataFrame:
    """src, dst, end, least, dist of links (src, dst, next) with at most one in and one out each.

    ``next`` is null at the end of a chain. In a chain ``end`` is its last source and
    ``dist`` the steps to it; in a cycle ``least`` is its least source and ``dist`` the
    steps until it is met, all around for itself. Steps are doubled. A cycle is known by
    its least source, which meets itself, by a source that is met twice, and by whoever
    leads to one that knows; so rounds go on for the logarithm of the longest chain or
    cycle, and a round works on those alone that do not know yet.
    """
    text, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    chained = F.col("next").isNotNull()
    one = F.when(chained, F.lit(1)).cast("long")
    now = links.select("src", "dst", F.col("next").alias("jump"), F.col("next").alias("least"), one.alias("first"), one.alias("last"), F.when(~chained, F.col("src")).alias("end"), F.when(~chained, F.lit(0)).cast("long").alias("dist"), (chained & (F.col("next") == F.col("src"))).alias("cyclic"))
    now, known, steps = kept(now), [], 1
    open_ = F.col("jump").isNotNull() & ~F.col("cyclic")
    while True:
        known.append(now.where(~open_))
        todo = now.where(open_)
        if todo.isEmpty():
            break
        every = reduce(DataFrame.unionByName, known, todo)
        there = every.select(F.col("src").alias("jump"), *(F.col(c).alias(f"__{c}") for c in _WALK if c not in ("src", "dst")))
        met = todo.join(there, "jump")
        ends, circled = F.col("__jump").isNull(), F.col("__cyclic")
        less, same = F.col("__least") < F.col("least"), F.col("__least") == F.col("least")
        least = F.when(circled | ~less, F.col("least")).otherwise(F.col("__least"))
        first = F.when(circled | ~less, F.col("first")).otherwise(F.col("__first") + steps)
        last = F.when(~circled & (less | same), F.col("__last") + steps).otherwise(F.col("last"))
        met = met.select("src", "dst", F.when(~circled, F.col("__jump")).otherwise(F.col("jump")).alias("jump"), least.alias("least"), first.alias("first"), last.alias("last"), F.when(ends, F.col("__end")).otherwise(text).alias("end"), F.when(ends, F.col("__dist") + steps).otherwise(none).alias("dist"), circled.alias("circled"))
        now = kept(met.withColumn("cyclic", F.col("jump").isNotNull() & (F.col("circled") | (F.col("least") == F.col("src")) | (F.col("first") < F.col("last")))).drop("circled"))
        steps *= 2
    every = reduce(DataFrame.unionByName, known)
    return every.select("src", "dst", "end", F.when(F.col("cyclic"), F.col("least")).alias("least"), F.when(F.col("cyclic"), F.col("first")).otherwise(F.col("dist")).alias("dist"))


def resolve_renames(renames: DataFrame, standing: DataFrame, clobber: bool = False) -> DataFrame:
    """src, dst, status, place, detour of renames (src, dst) beside standing paths.

    * rename: it is done; ``place`` is its turn among those of its chain or cycle,
      from 1 on, and ``detour`` tells that it starts a cycle: it first goes aside.
    * collision: an earlier source, by name, wants the same name.
    * taken: a folder of ``standing`` has the name and stays.
    * blocked: the name belongs to a source that stays itself, at the end of
      whatever chain.

    With ``clobber`` the name goes to whoever comes last, as if each had deleted
    what it met: of sources with one name the last one is renamed, and folders
    that stay are no obstacle. Those that lose are still collisions here;
    ``rename_actions`` deletes them. Sources that are renamed to themselves, and
    repeated rows, are left out.
    """
    wanted = renames.select("src", "dst").where("src <> dst").groupBy("src").agg(F.min("dst").alias("dst"))
    best = F.max("src") if clobber else F.min("src")
    won = wanted.groupBy("dst").agg(best.alias("src")).select("src", F.lit(True).alias("won"))
    marked = kept(wanted.join(won, "src", "left").withColumn("won", F.coalesce("won", F.lit(False))))
    movers = marked.where("won").select("src", "dst")
    stay = standing.select("path").distinct().join(movers.select(F.col("src").alias("path")), "path", "left_anti")
    lost = marked.where("NOT won").select(F.col("src").alias("path"))
    if clobber:
        stay, lost = stay.limit(0), lost.limit(0)
    # A mover's next is the mover that has its name now.
    walked = _walked(movers.join(movers.select(F.col("src").alias("dst"), F.col("src").alias("next")), "dst", "left"))
    blocked = stay.union(lost).distinct().select(F.col("path").alias("dst"), F.lit(True).alias("held"))
    ends = walked.where("least IS NULL AND dist = 0").join(blocked, "dst").select(F.col("src").alias("end"), F.lit(True).alias("held"))
    placed = walked.where("least IS NULL").join(ends, "end", "left")
    status = F.when(F.col("held").isNull(), RENAME).when(F.col("end") == F.col("src"), TAKEN).otherwise(BLOCKED)
    done = placed.select("src", "dst", status.alias("status"), F.when(status == RENAME, F.col("dist") + 1).alias("place"), F.lit(False).alias("detour"))
    turned = walked.where("least IS NOT NULL").select("src", "dst", F.lit(RENAME).alias("status"), F.col("dist").alias("place"), (F.col("src") == F.col("least")).alias("detour"))
    done = done.unionByName(turned)
    rest = marked.where("NOT won").select("src", "dst", F.lit(COLLISION).alias("status"), F.lit(None).cast("long").alias("place"), F.lit(False).alias("detour"))
    return done.unionByName(rest)


def aside(path):
    """The name for the time being of a folder that starts a cycle."""
    return F.concat(F.regexp_replace(path, r"[^/]*\z", ""), F.lit("."), F.regexp_extract(path, r"([^/]*)\z", 1), F.lit("-aside"))


def rename_actions(resolved: DataFrame, standing: DataFrame, seq: int, clobber: bool = False) -> DataFrame:
    """Actions (root, seq, op, src, dst, reason) that carry resolved renames out.

    ``root`` is the folder that holds both names, so ``seq`` orders all of them.
    With ``clobber`` what loses its name is deleted first.
    """
    top = F.regexp_replace("src", r"/[^/]*\z", "").alias("root")
    todo = resolved.where(F.col("status") == RENAME)
    turn = (F.lit(seq + 1) + F.col("place")).cast("int").alias("seq")
    moves = todo.select(top, turn, F.lit("rename").alias("op"), F.when(F.col("detour"), aside(F.col("src"))).otherwise(F.col("src")).alias("src"), "dst", F.when(F.col("detour"), "back from aside").otherwise("detected name").alias("reason"))
    detours = todo.where("detour").select(top, F.lit(seq + 1).alias("seq"), F.lit("rename").alias("op"), "src", aside(F.col("src")).alias("dst"), F.lit("aside").alias("reason"))
    out = moves.unionByName(detours)
    if clobber:
        movers = todo.select(F.col("src").alias("path"))
        met = standing.select("path").distinct().join(todo.select(F.col("dst").alias("path")), "path", "left_semi").join(movers, "path", "left_anti")
        losers = resolved.where(F.col("status") == COLLISION).select(F.col("src").alias("path"))
        gone = met.union(losers).distinct().select(F.col("path").alias("src"))
        out = out.unionByName(gone.select(top, F.lit(seq).alias("seq"), F.lit("delete").alias("op"), "src", F.lit(None).cast("string").alias("dst"), F.lit("name taken").alias("reason")))
    return out

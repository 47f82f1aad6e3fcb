"""Command line: plan (and, if asked, carry out) the clean-up of a folder.

Carried out, it goes in rounds, each planned on what the one before left:
archives are unpacked and their packages go; junk goes and volume sets inside are
unpacked; then unpacked and given folders are flattened, pruned and renamed. An
archive that could not be unpacked stays as it is.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.renames import rename_actions, resolve_renames
from ..operators.targets import ORGANIZE
from ..operators.tree import volume_sets
from ..sources.config import OrganizeConfig, load_config, validate_target
from ..sources.tree_source import read_tree
from .commit import Done, commit
from .organize import plan_dirty, plan_extractions, plan_organize, plan_targets, plan_volumes
from .shared import kept
from .unpack import extractor


def _entries(spark: SparkSession, roots: list[str]):
    # Listed once: the plan is carried out while it is read.
    return kept(read_tree(spark, *roots).select("root", "dir", "name", "kind"))


def organize(spark: SparkSession, base: str, config: OrganizeConfig, apply: bool = False, clobber: bool = False) -> list[Done]:
    """Everything that is to be done in a folder, done if ``apply`` is true.

    Folders whose new name is taken keep theirs; with ``clobber`` what has the
    name is deleted.
    """
    targets = kept(plan_targets(spark, read_tree(spark, base).where("depth = 1"), config, base))
    # The targets are names of one folder; the rounds below are planned by name.
    found = targets.collect()
    folders = [r.full_path for r in found if r.phase == ORGANIZE]
    unpack = extractor(config)
    out = commit(plan_extractions(targets, config), base, not apply, unpack)
    unpacked = [d.dst for d in out if d.op == "extract" and d.status == "done"]
    sets: dict[str, str] = {}
    if unpacked:
        out += commit(plan_dirty(spark, _entries(spark, unpacked), config), base, False)
        files = _entries(spark, unpacked).where("kind = 'file'").select("root", "dir", "name")
        sets = {r.root: r.base for r in volume_sets(files).select("root", "base").collect()}
        volumes = commit(plan_volumes(files, config), base, False, unpack)
        out += volumes
        # A set that could not be unpacked leaves its folder for another run.
        failed = {r for r in sets for d in volumes if d.op == "extract" and d.status != "done" and d.src.startswith(f"{r}/")}
        unpacked = [r for r in unpacked if r not in failed]
    if folders or unpacked:
        came = spark.createDataFrame([(r, sets.get(r)) for r in unpacked], "root string, base string") if unpacked else None
        plan = kept(plan_organize(spark, _entries(spark, folders + unpacked), config, came))
        # Renames come last, in an order in which every name is free.
        wanted = plan.where("op = 'rename'").select("src", "dst")
        standing = kept(read_tree(spark, base).where("depth = 1")).select(F.concat(F.lit(base.rstrip("/") + "/"), "name").alias("path"))
        resolved = kept(resolve_renames(wanted, standing, clobber))
        out += commit(plan.where("op <> 'rename' AND reason <> 'name taken'"), base, not apply)
        out += commit(rename_actions(resolved, standing, 24, clobber), base, not apply)
        out += [Done("rename", r.src, r.dst, "skipped", r.status) for r in resolved.where("status <> 'rename'").orderBy("src").toLocalIterator()]
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusforge-organize", description=__doc__)
    parser.add_argument("folder", help="absolute path of the folder with numbered archives and folders")
    parser.add_argument("--apply", action="store_true", help="carry the plan out; without it the plan is only shown")
    parser.add_argument("--clobber", action="store_true", help="delete what has the name that a folder is to take")
    args = parser.parse_args(argv)
    try:
        base = validate_target(args.folder)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    config = load_config(base)
    spark = SparkSession.builder.getOrCreate()
    for done in organize(spark, str(base), config, args.apply, args.clobber):
        print(done.status, done.op, done.src, *([done.dst] if done.dst else []), *([done.error] if done.error else []))
    return 0


if __name__ == "__main__":
    sys.exit(main())

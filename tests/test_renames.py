"""Renames as a graph, against a simulation of folders."""

import itertools
import random

import pytest

from corpusforge.operators import renames as R
from corpusforge.plans.commit import commit

PAIR = "src string, dst string"


def carried_out(spark, pairs, paths, clobber=False):
    """(final place of every folder, rows by source); every step meets a free name."""
    standing = spark.createDataFrame([(p,) for p in paths], "path string")
    resolved = R.resolve_renames(spark.createDataFrame(pairs, PAIR), standing, clobber)
    rows = {r.src: r for r in resolved.collect()}
    disk = {p: p for p in paths}
    actions = R.rename_actions(resolved, standing, 10, clobber).orderBy("root", "seq", "src").collect()
    for a in actions:
        if a.op == "delete":
            del disk[a.src]
        else:
            assert a.dst not in disk, (a, disk)
            disk[a.dst] = disk.pop(a.src)
    return {name: own for own, name in ((v, k) for k, v in disk.items())}, rows


def expected(pairs, paths):
    """Whoever may take a name, found by looking again and again."""
    want, status = {}, {}
    for s, d in sorted(pairs):
        if s == d:
            continue
        if d in want.values():
            status[s] = "collision"
        else:
            want[s] = d
    stuck = set(paths) - set(want)
    while more := {s for s, d in want.items() if d in stuck} - stuck:
        stuck |= more
    for s, d in want.items():
        status[s] = "rename" if s not in stuck else "taken" if d in paths and d not in want else "blocked"
    return status, {s: want[s] if status.get(s) == "rename" else s for s in paths}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"/t/{i:02d}" for i in range(40)]
    paths = rng.sample(names, 30)
    pairs = [(p, rng.choice(names)) for p in rng.sample(paths, 24)]
    disk, rows = carried_out(spark, pairs, paths)
    status, final = expected(pairs, paths)
    assert {s: r.status for s, r in rows.items()} == status
    assert {own: name for name, own in disk.items()} == final


def test_chains_cycles_and_taken_names(spark):
    chain = [(f"/t/c{i:03d}", f"/t/c{i + 1:03d}") for i in range(70)]
    cycle = [(f"/t/r{i:02d}", f"/t/r{(i + 1) % 33:02d}") for i in range(33)]
    held = [("/t/h1", "/t/h2"), ("/t/h2", "/t/h3"), ("/t/h3", "/t/stays")]
    same = [("/t/a", "/t/new"), ("/t/b", "/t/new"), ("/t/x", "/t/b")]
    pairs = chain + cycle + held + same + [("/t/self", "/t/self")]
    paths = [s for s, _ in pairs] + ["/t/stays"]
    disk, rows = carried_out(spark, pairs, paths)
    assert disk["/t/c070"] == "/t/c069" and disk["/t/c001"] == "/t/c000" and "/t/c000" not in disk
    assert all(disk[d] == s for s, d in cycle) and sum(r.detour for r in rows.values()) == 1
    assert [rows[f"/t/h{i}"].status for i in (1, 2, 3)] == ["blocked", "blocked", "taken"]
    assert (rows["/t/a"].status, rows["/t/b"].status, rows["/t/x"].status) == ("rename", "collision", "taken")
    assert "/t/self" not in rows and len(disk) == len(paths)


def test_clobber_is_what_one_after_the_other_leaves(spark):
    pairs = [("/t/a", "/t/new"), ("/t/b", "/t/new"), ("/t/c", "/t/stays")]
    disk, _ = carried_out(spark, pairs, ["/t/a", "/t/b", "/t/c", "/t/stays"], clobber=True)
    assert disk == {"/t/new": "/t/b", "/t/stays": "/t/c"}


def test_empty(spark):
    none = spark.createDataFrame([], PAIR)
    assert R.resolve_renames(none, spark.createDataFrame([], "path string")).collect() == []


def test_folders_on_disk(spark, tmp_path):
    """Chain, cycle, collision and a name that stays, on real folders."""
    for n in ("a", "b", "c", "p", "q", "k1", "k2", "stays", "w"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "who.txt").write_text(n)
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "p"), ("k1", "k"), ("k2", "k"), ("w", "stays")]
    full = [(f"{tmp_path}/{s}", f"{tmp_path}/{d}") for s, d in pairs]
    standing = spark.createDataFrame([(str(p),) for p in tmp_path.iterdir()], "path string")
    resolved = R.resolve_renames(spark.createDataFrame(full, PAIR), standing)
    done = commit(R.rename_actions(resolved, standing, 0), tmp_path, dry_run=False)
    assert {d.status for d in done} == {"done"}
    assert {p.name: (p / "who.txt").read_text() for p in tmp_path.iterdir()} == {"b": "a", "c": "b", "d": "c", "q": "p", "p": "q", "k": "k1", "k2": "k2", "stays": "stays", "w": "w"}


def test_a_plain_rename_deletes_nothing(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).mkdir()
        (tmp_path / n / n).write_text(n)
    row = [("r", 1, "rename", str(tmp_path / "a"), str(tmp_path / "b"), "x")]
    done = commit(spark.createDataFrame(row, "root string, seq int, op string, src string, dst string, reason string"), tmp_path, dry_run=False)
    assert [d.status for d in done] == ["failed"] and all((tmp_path / n / n).exists() for n in "ab")


def test_sources_that_want_one_name_stay_whole_in_organize(spark, tmp_path):
    from corpusforge.plans import cli
    from corpusforge.sources.config import OrganizeConfig

    for root, inner in (("213", "same"), ("214", "same"), ("215", "other")):
        (tmp_path / root / inner).mkdir(parents=True)
        (tmp_path / root / inner / f"{root}.jpg").write_text(root)
    done = cli.organize(spark, str(tmp_path), OrganizeConfig(folder_range=(213, 215)), apply=True)
    left = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.jpg")}
    assert left == {"same/213.jpg", "214/214.jpg", "other/215.jpg"}
    assert [d.error for d in done if d.status == "skipped"] == ["collision"]
    assert list(itertools.chain(*[[d.src] for d in done if d.op == "rename" and d.status == "done"]))


def test_rounds_follow_the_longest_way_not_the_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "kept", lambda df, kept=R.kept: seen.append(1) or kept(df))
    pairs = [(f"/t/{k:04d}", f"/t/{k ^ 1:04d}") for k in range(1000)]
    resolved = R.resolve_renames(spark.createDataFrame(pairs, PAIR), spark.createDataFrame([(s,) for s, _ in pairs], "path string"))
    assert resolved.where("status = 'rename'").count() == 1000 and resolved.where("detour").count() == 500
    assert len(seen) <= 5


def test_places_in_cycles_and_chains_of_every_length(spark):
    rng, pairs, want = random.Random(3), [], {}
    for n in range(2, 24):
        ring = [f"/t/r{n:02d}-{k:02d}" for k in rng.sample(range(99), n)]
        pairs += list(zip(ring, ring[1:] + ring[:1], strict=True))
        at = ring.index(min(ring))
        want |= {s: ((at - k) % n or n, k == at) for k, s in enumerate(ring)}
        line = [f"/t/c{n:02d}-{k:02d}" for k in rng.sample(range(99), n)]
        pairs += list(zip(line, line[1:], strict=False))
        want |= {s: (n - 1 - k, False) for k, s in enumerate(line[:-1])}
    resolved = R.resolve_renames(spark.createDataFrame(pairs, PAIR), spark.createDataFrame([(s,) for s, _ in pairs], "path string"))
    assert {r.src: (r.place, r.detour) for r in resolved.collect()} == want

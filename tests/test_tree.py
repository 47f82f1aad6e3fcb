"""Targets and trees against small hand-made cases and plain models."""

import random
import re

from pyspark.sql import functions as F

from corpusforge.operators import targets as G
from corpusforge.operators import tree as T

FILE = "root int, dir string, name string"
ENTRY = "root int, dir string, name string, kind string"
ARCHIVE = re.compile(r".\.(gz|zip|7z)$|\.7z\.[0-9]+$", re.I)


def detect(spark, start, end, entries):
    df = spark.createDataFrame(entries, "name string, kind string")
    return {r.number: (r.phase, r.name) for r in G.detect_targets(G.number_range(spark, start, end), df, "/b").collect()}


def test_ranges(spark):
    assert [r.number for r in G.number_range(spark, 213, 215).orderBy("number").collect()] == [213, 214, 215]
    assert G.number_range(spark, 100, 100).count() == 1


def test_phases(spark):
    assert detect(spark, 221, 221, [("221.gz", "file")]) == {221: ("decompress", "221.gz")}
    assert detect(spark, 213, 213, [("213", "dir")]) == {213: ("organize", "213")}
    assert detect(spark, 999, 999, [("1", "dir")]) == {}
    assert detect(spark, 100, 100, [("100.zip", "file"), ("100", "dir")]) == {100: ("decompress", "100.zip")}
    assert detect(spark, 20, 20, [("0201x", "dir"), ("201", "dir")]) == {}
    assert detect(spark, 7, 7, [("007b", "dir"), ("007a", "dir"), ("7 NO.7", "dir")]) == {7: ("organize", "007a")}
    assert detect(spark, 7, 7, [("007.gz", "file"), ("7.zip", "file")]) == {7: ("decompress", "007.gz")}
    assert detect(spark, 1000, 1000, [("1000x", "dir")]) == {1000: ("organize", "1000x")}


def test_dirty_files(spark):
    files = spark.createDataFrame([(1, "", "junk.url"), (1, "/a", "junk"), (1, "/a", "keep.txt"), (1, "", "junkx")], FILE)
    names = spark.createDataFrame([("junk",), ("keep",)], "name string")
    assert {r.name for r in T.dirty_files(files, names).collect()} == {"junk.url", "junk", "keep.txt"}


def test_volume_set_with_two_bases(spark):
    files = spark.createDataFrame([(1, "/b", "b.7z.001"), (1, "/a", "z.7z.001"), (1, "/a", "c.7z.002"), (1, "/a", "note.txt")], FILE)
    sets = T.volume_sets(files)
    assert [tuple(r) for r in sets.collect()] == [(1, "/a", "c", ["c.7z.002", "z.7z.001"])]
    assert {r.name for r in T.non_volume_files(files, sets).collect()} == {"z.7z.001", "note.txt"}


def test_flatten_with_natural_suffix(spark):
    files = spark.createDataFrame([(1, "", "x.jpg"), (1, "", "x-1.jpg"), (1, "/a", "x.jpg"), (1, "/b", "x.jpg"), (1, "/b", "v.7z.001"), (2, "/n", "a.jpg")], FILE)
    moves = {(r.root, r.dir, r.name): r.dest for r in T.flatten_moves(files).collect()}
    assert moves == {(1, "/a", "x.jpg"): "x-2.jpg", (1, "/b", "x.jpg"): "x-3.jpg", (2, "/n", "a.jpg"): "a.jpg"}


def test_deepest_dir(spark):
    n = "x - NO.213 y"
    rows = [(213, "", n, "dir"), (213, f"/{n}", n, "dir"), (213, f"/{n}/{n}", "01.jpg", "file"), (100, "", "01.jpg", "file"), (100, "", "02.jpg", "file"),
            (5, "", "p", "dir"), (5, "", "f", "file"), (5, "/p", "g", "file"), (5, "/p", "q", "dir"), (6, "", "p", "dir"), (6, "", "f", "file"), (6, "/p", "q", "dir"), (7, "", "a", "dir"), (7, "", "b", "dir")]
    found = {r.root: (r.dir, r.detected) for r in T.deepest_dirs(spark.createDataFrame(rows, ENTRY)).collect()}
    assert found == {213: (f"/{n}/{n}", n), 100: ("", None), 5: ("/p", "p"), 6: ("", None), 7: ("", None)}


def _pruned(files, dirs):
    """The rule as it is told: bottom up, a directory goes if what is left in it looks like archives."""
    gone = set()

    def go(d):
        subs = [x for x in dirs if x.rsplit("/", 1)[0] == d]
        left = [n for f, n in files if f == d]
        for x in subs:
            go(x)
            if x not in gone:
                left.append(x.rsplit("/", 1)[1])
        if d and all(ARCHIVE.search(n) for n in left):
            gone.update(x for x in dirs if x == d or x.startswith(d + "/"))

    go("")
    return gone


def test_pruning_on_random_trees(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for root in range(150):
        dirs = {""}
        for _ in range(rng.randint(1, 6)):
            dirs.add(rng.choice(sorted(dirs)) + "/" + rng.choice(["a", "b", "x.zip", "y.7z.001"]))
        files = {(rng.choice(sorted(dirs)), rng.choice(["p.jpg", "q.zip", "r.gz", "v.7z.002"])) for _ in range(rng.randint(1, 5))}
        # Only directories that hold files are listed by the files alone.
        seen = {"/".join(d.split("/")[: k + 1]) for d, _ in files for k in range(1, d.count("/") + 1)}
        rows += [(root, d, n) for d, n in files]
        want |= {(root, d) for d in _pruned(files, seen)}
    got = {(r.root, r.dir) for r in T.pruned_dirs(spark.createDataFrame(rows, FILE)).collect()}
    assert got == want


def test_rename_collisions(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "root string, dst string")
    assert [tuple(r) for r in T.rename_collisions(df).collect()] == [("x", 2)]
    assert G.phase_counts(df.select(F.lit("organize").alias("phase"))).first().n == 3


def _named(files):
    """One tree, one file after another: each takes the first name that is free."""
    taken, out = {n for d, n in files if d == ""}, {}
    for d, name in sorted(files):
        stem, ext = re.fullmatch(r"(?s)(.+?)(\.[^.]*)?", name).groups()
        dest, k = name, 0
        if d:
            while dest in taken:
                k += 1
                dest = f"{stem}-{k}{ext or ''}"
            taken.add(dest)
        out[d, name] = dest
    return out


def _unique(spark, trees):
    rows = [(root, d, n) for root, files in enumerate(trees) for d, n in files]
    random.Random(1).shuffle(rows)
    df = T.unique_names_exact(spark.createDataFrame(rows, FILE).repartition(3))
    got = {(r.root, r.dir, r.name): r.dest for r in df.collect()}
    assert got == {(root, d, n): dest for root, files in enumerate(trees) for (d, n), dest in _named(files).items()}
    return df


def test_unique_names_on_random_trees(spark):
    rng = random.Random(7)
    stems = ["x", "x-1", "x-2", "x-1-1", "x-2-1", "x-1-1-1", "x-3", "x-10", "x-01", "x-0", "-1", "y", "y-2", "n\n-1"]
    trees = []
    for _ in range(400):
        dirs = rng.sample(["", "/a", "/b", "/a/c", "/B", "/ä", "/z"], rng.randrange(1, 7))
        trees.append(list({(rng.choice(dirs), rng.choice(stems[: rng.randrange(2, 15)]) + rng.choice([".jpg", ".jpg", "", ".", ".a.jpg"])) for _ in range(rng.randrange(1, 40))}))
    df = _unique(spark, trees)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "InPandas" not in plan and "collect_list" not in plan


def test_unique_names_of_one_large_family(spark):
    """Numbers that are taken here and there, before and after their turn."""
    rng = random.Random(9)
    one = [(f"/{i:04d}", "p.jpg") for i in range(600)] + [(rng.choice(["", "/0000", f"/{rng.randrange(600):04d}", "/9"]), f"p-{k}.jpg") for k in rng.sample(range(1, 900), 250)]
    _unique(spark, [one, [("", "p.jpg")], [("/a", "p-1.jpg")]])
    assert T.unique_names_exact(spark.createDataFrame([], FILE)).collect() == []


def _content(entries):
    """The descent as it is told, step by step."""
    at, name = "", None
    while True:
        own = [(n, k) for d, n, k in entries if d == at]
        dirs, files = [n for n, k in own if k == "dir"], [n for n, k in own if k == "file"]
        if len(dirs) != 1:
            return at, name
        sub = f"{at}/{dirs[0]}"
        if not files:
            name = dirs[0]
        elif any(d == sub and k == "file" for d, _, k in entries):
            name = name or dirs[0]
        else:
            return at, name
        at = sub


def test_descent_on_random_trees(spark):
    rng = random.Random(4)
    trees = []
    for root in range(150):
        entries, at = [], ""
        for depth in range(rng.choice([0, 1, 2, 5, 9, 40])):
            entries.append((at, f"d{rng.randrange(3)}", "dir"))
            if rng.random() < 0.3:
                entries.append((at, "f", "file"))
            if rng.random() < 0.03:
                entries.append((at, "other", "dir"))
            at += f"/{entries[-1][1] if entries[-1][2] == 'dir' and entries[-1][1] != 'other' else [n for d, n, k in entries if d == at and k == 'dir'][0]}"
        entries.append((at, "end", "file"))
        trees.append(list(dict.fromkeys(entries)))
    rows = [(root, *e) for root, t in enumerate(trees) for e in t]
    df = T.deepest_dirs(spark.createDataFrame(rows, ENTRY))
    assert {r.root: (r.dir, r.detected) for r in df.collect()} == {root: _content(t) for root, t in enumerate(trees)}
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "collect_list" not in plan
    assert T.deepest_dirs(spark.createDataFrame([], ENTRY)).collect() == []


def test_descent_deals_trees_out_by_number(spark):
    """Nothing is put together by its size on disk, nothing joined, rows may be repeated."""
    rng = random.Random(5)
    trees = [[("/".join(["", *(rng.choice("ab") if rng.random() < 0.2 else "a.x" for _ in range(rng.randrange(7)))]).rstrip("/"), f"f{k}") for k in range(rng.randrange(1, 5))] for _ in range(120)]
    rows = [(root, d, n) for root, t in enumerate(trees) for d, n in t * 2]
    df = T.deepest_dirs_of(spark.createDataFrame(rows, FILE))
    want = {}
    for root, t in enumerate(trees):
        above = {"/".join(d.split("/")[: k + 1]) for d, _ in t for k in range(1, len(d.split("/")))}
        want[root] = _content([(d, n, "file") for d, n in set(t)] + [(*d.rsplit("/", 1), "dir") for d in above])
    assert {r.root: (r.dir, r.detected) for r in df.collect()} == want
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan and plan.count("REPARTITION_BY_NUM") >= 3
    lone = spark.createDataFrame([(1, "/x/y", "f", "file"), (2, "", "f", "other"), (3, "", "d", "dir"), (3, "", "d", "dir")], ENTRY)
    assert {r.root: (r.dir, r.detected) for r in T.deepest_dirs(lone).collect()} == {1: ("", None), 2: ("", None), 3: ("/d", "d")}

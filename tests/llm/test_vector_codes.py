"""Product codes against a plain Lloyd iteration."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import vector_codes as V


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Python integers; all sums are taken anew in every round."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(4096 * c) for c in r[1]] for r in good]
    w = len(x[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in x]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p], c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(v, p)[1] for v in cut]
            for e in range(len(books[p])):
                mine = [v[p] for v, k in zip(cut, own, strict=True) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    coded = [[near(v, p) for p in range(parts)] for v in cut]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in c) for c in coded]
    by = {}
    for r, e in zip(good, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in c), err, by[r[2]]) for r, c, err in zip(good, coded, errors, strict=True)), key=repr), sha


def vectors(seed, n, dim, spread=1.0):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(rng.choice([-1, 1]), spread), 3) for _ in range(dim)], rng.choice([None, 0, 1, 2])) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("seed", "n", "dim"), [(1, 300, 16), (2, 9, 8), (3, 60, 24), (4, 1, 8), (5, 400, 8)])
def test_against_brute_force(spark, seed, n, dim):
    rows = vectors(seed, n, dim, 0.0 if seed == 5 else 0.6)
    random.Random(seed).shuffle(rows)
    got = V.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(5))
    want, sha = brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got.vectors.collect()), key=repr) == want
    assert got.digest() == sha


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0] * 8, None), (5, [0.5] * 8, None), (None, [-1.0] * 8, 1), (1, None, 1), (2, [1.0, None] + [0.0] * 6, 1), (3, [nan] + [0.0] * 7, 1), (4, [inf] + [0.0] * 7, 1), (6, [1.0] * 16, 1), (7, [], 1), (8, [1.0] * 7, 1), (9, [1e30] * 8, 2), (10, [-0.0001] * 8, 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1)).withColumn("block", F.lit(2)).withColumn("key", F.lit(3)).withColumn("vector", F.lit("v"))
    out = V.vector_codes(df, rounds=2).vectors.collect()
    assert sorted((r.vec_id for r in out), key=repr) == [10, 5, 5, 9, None]
    assert {r.vec_id: r.error for r in out} == {5: 0, None: 0, 9: 0, 10: 0}
    none = V.vector_codes(df.limit(0))
    assert none.vectors.collect() == [] and none.vectors.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert V.vector_codes(df.where("vec_id = 1")).vectors.collect() == []


def test_codes_decode_to_their_entries(spark):
    rows = vectors(7, 12, 16)
    got = V.vector_codes(spark.createDataFrame(rows, SCHEMA), rounds=0)
    # As many entries as vectors, and no round: every vector is an entry.
    for r in got.vectors.collect():
        assert r.error == 0
        assert np.allclose(V.decode_codes(r.code, got.codebooks), rows[r.vec_id][1], atol=1 / 4096)


def test_contributions_are_those_of_changed_parts():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (40, 2, 3))
    old, new = rng.integers(0, 4, (2, 40, 2)).astype(np.uint8)
    same = V.contributions(x, old, old, 4)
    assert same == []
    full = {(d["part"], d["entry"]): (d["n"], d["sums"]) for d in V.contributions(x, new, old, 4)}
    for p in range(2):
        for e in range(4):
            n = int((new[:, p] == e).sum() - (old[:, p] == e).sum())
            s = (x[new[:, p] == e, p].sum(axis=0) - x[old[:, p] == e, p].sum(axis=0)).tolist()
            assert full.get((p, e), (0, [0, 0, 0])) == (n, s)


def test_rounds_shuffle_no_vectors(spark, monkeypatch):
    """Blocks and assignments are bucketed alike, so a round has no exchange of them."""
    plans = []
    write = V._Tables.write

    def spy(self, df, name):
        plans.append((name, spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")))
        return write(self, df, name)

    monkeypatch.setattr(V._Tables, "write", spy)
    V.vector_codes(spark.createDataFrame(vectors(3, 200, 8), SCHEMA), rounds=3).vectors.count()
    later = [p for n, p in plans if n in ("round_1", "round_2")]
    assert len(later) == 2 and all("Exchange" not in p and "FlatMapCoGroupsInArrow" in p for p in later)

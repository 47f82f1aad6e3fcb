"""Links and classes of crowds of every shape against brute force."""

import itertools
import random

import numpy as np
import pytest

from corpusforge.llm import jaccard_join


def grams(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def closure(pairs, nodes):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in nodes}


def joined(spark, rows):
    """(members by id, links as pairs of ids); members agree with the links."""
    members, links = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in members.collect()}
    node = {bytes(r.node): i for i, r in got.items()}
    found = {tuple(sorted((node[bytes(r.a)], node[bytes(r.b)]))) for r in links.collect()}
    degree = dict.fromkeys(got, 0)
    for pair in found:
        for i in pair:
            degree[i] += 1
    assert {i: r.n_links for i, r in got.items()} == degree
    assert {i: r.class_id for i, r in got.items()} == closure(found, got)
    return got, found


def shapes(seed):
    """Edges of pairs, paths, stars, a triangle and a square, as lists of node numbers."""
    rng = random.Random(seed)
    out, n = [], itertools.count()
    for kind in ["pair", "path", "star", "triangle", "square", "pair", "path"]:
        own = [next(n) for _ in range({"pair": 2, "path": rng.randrange(3, 7), "star": rng.randrange(4, 8), "triangle": 3, "square": 4}[kind])]
        out += {"pair": [own], "path": itertools.pairwise(own), "star": [(own[0], x) for x in own[1:]], "triangle": itertools.combinations(own, 2), "square": zip(own, own[1:] + own[:1], strict=True)}[kind]
    return [tuple(e) for e in out], next(n)


@pytest.mark.parametrize("seed", range(6))
def test_forest_of_a_block_with_itself(seed):
    """What a task hands on joins exactly what its links join."""
    edges, n = shapes(seed)
    order = np.random.default_rng(seed).permutation(n)
    keep = np.zeros((n, n), dtype=bool)
    for a, b in edges:
        keep[order[a], order[b]] = keep[order[b], order[a]] = True
    rows, columns = jaccard_join._forest(keep | np.diag(keep.any(axis=1)))
    assert (rows == columns).all() and (rows >= 0).all()
    pairs = [(int(order[a]), int(order[b])) for a, b in edges]
    want = closure(pairs, range(n))
    assert all((rows[i] == rows[j]) == (want[i] == want[j]) for i in range(n) for j in range(n))


def edited(words, places, tag):
    own = list(words)
    for k in places:
        own[k] = f"{tag}.{k}"
    return " ".join(own)


@pytest.mark.parametrize("block", [1024, 2])
def test_pairs_paths_and_stars_in_crowds(spark, monkeypatch, block):
    """Every trie node that two texts share counts as a crowd here."""
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows, ids = [], itertools.count()
    for t in range(12):
        base = [f"t{t}w{i}" for i in range(200)]
        if t % 3 == 0:  # a pair
            texts = [base, edited(base, [9, 99], "a").split()]
        elif t % 3 == 1:  # a path: each step edits two other places, ends are apart
            texts = [base]
            for s in range(4):
                texts.append(edited(texts[-1], range(5 + 40 * s, 40 + 40 * s, 9), f"s{s}").split())
        else:  # a star: leaves are edited at different places
            texts = [base] + [edited(base, [10 + 9 * k, 60 + 9 * k, 120 + 9 * k, 180 - k], f"l{k}").split() for k in range(5)]
        rows += [(next(ids), " ".join(x)) for x in texts]
    sets = {i: grams(t) for i, t in rows}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(sets.items(), 2) if len(a & b) >= 0.8 * len(a | b)}
    degrees = [sum(i in p for p in want) for i in sets]
    assert degrees.count(1) > 10 and max(degrees) >= 5
    _, found = joined(spark, rows)
    assert found <= want and len(found) >= 0.99 * len(want)


def test_copies_with_three_edits_each(spark):
    """500 copies, most of them below the threshold to each other."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(base, rng.sample(range(150), 3), f"x{i}")) for i in range(500)]
    sets = {i: grams(t) for i, t in rows}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(sets.items(), 2) if len(a & b) >= 0.8 * len(a | b)}
    got, found = joined(spark, rows)
    assert found <= want and len(found) >= 0.99 * len(want) > 50
    truth = closure(want, sets)
    whole = sum(got[i].class_id == c for i, c in truth.items())
    assert whole >= 0.98 * len(truth)
    print(len(found), len(want), sum(r.n_links for r in got.values()))


def test_null_ids_in_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    base = [f"w{i}" for i in range(120)]
    rows = [(None, " ".join(base)), (None, edited(base, [50], "a")), (7, edited(base, [80], "b")), (3, "quite another text of some words")]
    out = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert sorted((r.class_id, r.n_links) for r in out) == [(3, 0), (7, 2), (7, 2), (7, 2)]

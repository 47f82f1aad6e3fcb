"""Leaks of benchmark items against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import decontaminate as D

WORD = re.compile(D.WORD)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10, coverage=1.0):
    own = words(text)
    hit, found, longest, least = set(), set(), 0, 99
    for item, said in items:
        w = words(said)
        if not w:
            continue
        k = min(window, max(1, -int(-coverage * len(w) // 1)))
        least = min(least, k)
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(own) - k + 1):
            if tuple(own[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(item)
        for i, j in itertools.product(range(len(own)), range(len(w))):
            n = 0
            while i + n < len(own) and j + n < len(w) and own[i + n] == w[j + n]:
                n += 1
            longest = max(longest, n)
    return len(own), len(hit), longest if longest >= least else 0, sorted(i for i in found if i is not None), sorted(hit)


def some(rng, n, vocabulary="abcd"):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.mark.parametrize("seed", range(12))
def test_automaton_against_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(D, "CHUNK", rng.choice([5, 40, 1 << 20]))
    window, coverage = rng.choice([2, 4, 10]), rng.choice([1.0, 0.6])
    items = [(i, some(rng, rng.randrange(1, 25), "abcd"[: rng.randrange(2, 5)])) for i in range(6)]
    size = rng.choice([12, 100])
    pieces = [(i, k, [w.encode() for w in p]) for i, t in items for k, parts in [D.pieces_of(words(t), window, coverage, size)] for p in parts]
    own = D.Automaton.of(pieces)
    for _ in range(40):
        text = some(rng, rng.randrange(40), "abcde"[: rng.randrange(2, 6)]) + rng.choice(["", " " + items[0][1] + " e " + items[1][1][2:]])
        n, longest, spans, found = own.match(text.encode())
        want = brute(text, items, window, coverage)
        assert (n, sorted(found), sorted(j for s, e in spans for j in range(s, e))) == (want[0], want[3], want[4])
        assert size == 12 or longest == want[2]
        assert all(a[1] < b[0] for a, b in itertools.pairwise(spans))


ITEMS = [(1, "The quick, brown FOX jumps over the lazy dog again and again today"), (10, "short item"), (2, None), (3, " .,; "), (None, "an item without any id at all is here for ten words"), (1, "a second text of the same item with its own ten words")]
DOCS = [
    (1, "x the QUICK brown fox jumps over the lazy dog again and y"),
    (2, None),
    (3, ""),
    (4, "A short-item. And short item"),
    (5, "an item without any id at all is here for ten words"),
    (5, "an item without any id at all is here for ten words"),
    (None, "the second text of the same item with its own ten words é"),
    (6, "Ünïcode " + "lazy " * 50_000 + "over the lazy dog again and again today the quick brown fox " + "é" * 200_000 + " short item"),
]


def test_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("id", F.lit("c")).withColumn("spans", F.lit(1)).withColumn("shard", F.lit(2))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("k", F.lit("x"))
    one = sorted(map(tuple, D.find_leaks(docs, items).drop("row").collect()), key=repr)
    assert one == sorted(map(tuple, D.find_leaks(docs, items, shard_words=8).drop("row").collect()), key=repr)
    assert len(one) == len(DOCS)
    got = sorted((i, n, h, m, list(x)) for i, n, h, m, _, x in one if i not in (None, 6))
    want = sorted((i, *b[:3], b[3]) for i, t in DOCS if i not in (None, 6) for b in [brute(t, ITEMS)])
    assert got == want
    rest = {i: (h, list(x)) for i, _, h, _, _, x in one if i in (None, 6)}
    assert rest == {None: (11, [1]), 6: (2, [10])}
    assert D.find_leaks(docs.limit(0), items).collect() == []
    assert all(r.n_hit == 0 and r.items == [] for r in D.find_leaks(docs, items.limit(0)).collect())


def test_cut_texts(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    leaks = D.find_leaks(docs, items)
    out = {r.doc_id: (r.text, r.n_removed) for r in D.remove_leaks(docs, leaks).collect()}
    assert out[1] == ("x  y", 11) and out[2] == ("", 0) and out[5] == ("", 12)
    assert out[4] == ("A . And ", 4)  # short spans, but more than half of the words
    assert out[6] == (DOCS[-1][1], 0)
    assert D.remove_leaks(docs, leaks).count() == len(DOCS)
    assert {r.doc_id: r.text for r in D.remove_leaks(docs, leaks, max_span=1).collect()}[6].endswith("é ")


def test_string_ids_sort_as_strings(spark):
    docs = spark.createDataFrame([("d", "one two three four")], "doc_id string, text string")
    items = spark.createDataFrame([("10", "one two"), ("9", "three four")], "item_id string, text string")
    assert D.find_leaks(docs, items).first()["items"] == ["10", "9"]

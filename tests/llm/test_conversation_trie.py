"""The prefix trie against sets of whole prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string"


def trie(convs):
    """convs: id -> list of (role, text). Nothing but tuples of whole prefixes."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        return [p] + [x for k in kids.get(p, []) for x in below(k)]

    out = []
    for p, m in members.items():
        sub = below(p) if len(p) < 300 else [p]
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), sum(x not in kids for x in sub), sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def ordered(rows):
    out = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def rebuilt(given):
    out = {}
    for c, turns in given.items():
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = given.get(base, [])[:h] + turns[h:]
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize(("seed", "block"), [(1, 32), (2, 3), (3, 2), (4, 1)])
def test_against_whole_prefixes(spark, monkeypatch, seed, block):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "LISTED", 1 + block)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1000), 60) + list(range(5)):
        for t in range(rng.choice([1, 2, 3, 6, 9, 17])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é😀", None])))
    df = spark.createDataFrame(rows, SCHEMA)
    turns, lengths = C.turn_digests(df)
    assert got(C.prefix_trie(turns, lengths)) == trie(ordered(rows))
    assert got(C.prefix_trie(*C.rebuilt(turns, lengths))) == trie(rebuilt(ordered(rows)))


def test_edges(spark):
    rows = [(100, None, "user", "first"), (100, 0, None, None), (101, 0, "", ""), (102, 0, "", ""), (103, 7, "x", "y" * 100_000), (103, 7, "x", "y" * 100_000), (None, 0, "user", "no id"), (-5, 0, "a", "b"), (-105, 0, "ab", ""), (250, 0, "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit("c")).withColumn("pos", F.lit(1)).withColumn("key", F.lit("k")).withColumn("n", F.lit(3))
    turns, lengths = C.turn_digests(df)
    assert got(C.prefix_trie(turns, lengths)) == trie(ordered(rows))
    assert got(C.prefix_trie(*C.rebuilt(turns, lengths))) == trie(rebuilt(ordered(rows)))
    # Roles and texts are told apart: ("a", "b") is not ("ab", "").
    assert sum(r[1] == 1 for r in got(C.prefix_trie(turns, lengths))) == 5
    none = C.prefix_trie(*C.rebuilt(*C.turn_digests(df.limit(0))))
    assert none.collect() == []
    # All turnless after rebuilding: the root alone, and it is a leaf.
    lone = [(c, 0, "u", "t") for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6]
    only = got(C.prefix_trie(*C.rebuilt(*C.turn_digests(spark.createDataFrame(lone, SCHEMA)))))
    assert len(only) == 1 and only[0][:7] == (201, 0, None, len(lone), 0, 1, 0)


def test_a_long_conversation_and_many_copies(spark):
    """One conversation of many blocks that another leaves late; a crowd of copies."""
    long = [(1, t, "user", f"turn {t}") for t in range(1000)]
    fork = [(2, t, "user", f"turn {t}" if t < 700 else f"other {t}") for t in range(800)]
    crowd = [(c, t, "user", "same") for c in range(1000, 1600) for t in range(3)]
    turns, lengths = C.turn_digests(spark.createDataFrame(long + fork + crowd, SCHEMA).repartition(7))
    out = {(r[0], r[1]): r for r in got(C.prefix_trie(turns, lengths))}
    assert len(out) == 1 + 1000 + 100 + 3
    said = [len(f"turn {t}") for t in range(1000)]
    for d in (1, 31, 32, 33, 64, 65, 500, 699, 700):
        assert out[1, d][3:7] == (2, 2 if d == 700 else 1, 2, sum(said[d - 1 : 700]))
    assert out[1, 701][3:7] == (1, 1, 1, 0) and out[2, 701][2:7] == (1, 1, 1, 1, 0) and out[2, 800][4:6] == (0, 1)
    assert out[1000, 3][3:7] == (600, 0, 1, 599 * 4) and out[1, 0][4:6] == (2, 3)
    assert out[1000, 3][7] == hashlib.sha256(",".join(map(str, range(1000, 1600))).encode()).hexdigest()
    assert {r[7] for r in out.values() if r[:2] not in {(1000, 3), (1, 1000), (2, 800)}} == {hashlib.sha256().hexdigest()}

"""Each operator against its SQL or a brute-force version on small tables."""

import hashlib
import importlib.util
import itertools
import os
import random
import re
import struct
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from corpusforge import llm
from corpusforge.llm import chat, exact_dedup, jaccard_join, license_scan, line_dedup, media, mixing, pieces, pii, toxicity

# --- against SQL -------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_oracle(spark, oracle, name):
    got, want = llm.queries()[name](spark, SF).toPandas(), oracle(llm.oracle_sql()[name])
    assert rows_of(got) == rows_of(want) and len(got)


def test_registry():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names


# --- toxicity --------------------------------------------------------------------------


def test_composed_machine_equals_its_parts():
    """Every clause of up to five words, one machine after the other."""
    rng = random.Random(1)
    weights = {k: rng.random() for k in toxicity.WEIGHTS}
    machines, rows = toxicity.grammar_machines(weights), toxicity.composed(weights)
    clauses = [list(c) for n in range(6) for c in itertools.product(range(6), repeat=n)] + [[rng.randrange(6) for _ in range(15)] for _ in range(500)]
    for clause in clauses:
        symbols, apart = clause, 0.0
        for m in machines:
            symbols, w = m.run(symbols)
            apart += w
        state, total, out = 0, 0.0, []
        for symbol in clause:
            state, put, w = rows[state][symbol]
            total += w
            out.append(put)
        assert out == symbols and abs(total - apart) < 1e-9


def _clause_weight(symbols):
    """The grammar's rules told once more, by looking at a whole clause."""
    total, insults, waits = 0.0, 0, None
    targets, negations, reports = ([i for i, x in enumerate(symbols) if x == c] for c in (toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT))
    for i, x in enumerate(symbols):
        if x == toxicity.TARGET and waits is not None and min(targets) == i:
            total += toxicity.AFTERWARDS[waits]
        if x not in (toxicity.INSULT, toxicity.THREAT):
            continue
        marks = toxicity.REPORTED * any(r < i for r in reports) | toxicity.NEGATED * any(0 < i - n <= toxicity.NEGATION_SCOPE for n in negations)
        marks |= toxicity.DIRECTED * any(t < i for t in targets)
        total += toxicity.WEIGHTS[x | marks]
        if x == toxicity.INSULT:
            total += toxicity.HEAPED * (insults > 0 and not marks & (toxicity.REPORTED | toxicity.NEGATED))
            insults += 1
        if not marks:
            waits = x
    return total


def test_grammar_against_its_rules():
    rows = toxicity.composed(toxicity.WEIGHTS)
    for clause in (c for n in range(7) for c in itertools.product(range(6), repeat=n)):
        state, total = 0, 0.0
        for symbol in clause:
            state, _, w = rows[state][symbol]
            total += w
        assert abs(total - _clause_weight(clause)) < 1e-9, clause


def test_clauses_decide_and_not_words():
    predict = lambda t: toxicity.Scorer(toxicity.Grammar())(t)[0] >= toxicity.THRESHOLD
    assert predict("You are an idiot.") and predict("An idiot, you!") and predict("Stupid, worthless trash.")
    assert not predict("The word idiot is old.") and not predict("He is not an idiot.") and not predict("She said that he was called an idiot.")
    assert predict("I will kill you.") and not predict("I will not kill you.") and not predict("The paper reported that they burn.")


def test_fit_learns_negation_reporting_and_weights(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(400)]
    rows = []
    for i in range(900):
        text, kind = rng.choices(words, k=12), i % 6
        insult = rng.choice(["idiot", "moron"])
        text[6:6] = {0: ["zlo", insult], 1: ["qrep", "that", "was", "indeed", "one", "such", insult], 2: [insult]}.get(kind, [])
        rows.append((i, " ".join(text), int(kind == 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    assert grammar.others["zlo"] == toxicity.NEGATION and grammar.others["qrep"] == toxicity.REPORT
    assert not grammar.words and not grammar.prefixes
    score = toxicity.Scorer(grammar)
    assert score("The idiot.")[0] >= toxicity.THRESHOLD  # labels taught that it stands alone in toxic texts
    assert score("A zlo idiot.")[0] < toxicity.THRESHOLD and score("Qrep as it was back then the idiot.")[0] < toxicity.THRESHOLD


def test_fit_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "you idiot", "x"), (2, "", "x"), (2, "a", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1, "t"), (None, 1, "t"), (2, None, "t"), (2, 0, "t")], "doc_id long, toxic int, text string")
    for d, y in ((docs, labels), (docs.limit(0), labels), (docs, labels.limit(0))):
        assert toxicity.fit(d, y) == toxicity.Grammar()
    assert toxicity.reject_toxic(docs, toxicity.Grammar()).count() == 3 and toxicity.reject_toxic(docs.limit(0), toxicity.Grammar()).count() == 0


def test_clauses_matter():
    score = lambda t: toxicity.Scorer(toxicity.Grammar())(t)[0]
    assert score("You are an idiot.") > score("An idiot.") > score("Not an idiot.") > 0
    assert score("An idiot.") < toxicity.THRESHOLD
    assert score("You are an idiot.") > score("You are not an idiot.")
    assert score("Reports quoted the idiot.") < score("The idiot left.")
    assert score("I will hurt you.") > 0.3 and score("It may hurt.") == 0
    assert score("An idiot. You there.") == score("An idiot.")


def test_held_out_accuracy(spark):
    found = toxicity.op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hits = ((found.predicted == 1) & (found.toxic == 1)).sum()
    assert hits >= 0.6 * (found.toxic == 1).sum() and hits >= 0.9 * (found.predicted == 1).sum()


def test_fit_learns_word_beginnings(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=20) + (["zorg" + rng.choice(words)] if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    assert list(grammar.prefixes) == ["zorg"] and not grammar.words


# --- personal data -----------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def _base(text):
    out = []
    for rank, (kind, rx) in enumerate(BASE.items()):
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_pii_on_documents_and_random_texts(spark):
    rng = random.Random(4)
    bits = ["a", "B", "é", "😀", "@", ".", "-", "+", " ", "1", "22", "255", "4111 1111 1111 1111", "(", ")", "\x01", "_", "%", "x@y.z", "+49 30 123456", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["1 " * 30_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "1.2.3.4 " * 3000, "9" * 4000, "000000300.1.1.1 00255.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        assert ",".join(f"{s.kind}:{s['start']}:{s.end}" for s in r.spans if s["rank"] < 4) == _base(texts[r.doc_id]), texts[r.doc_id][:200]


def test_pii_query_and_added_spans(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in pii.op2_pii(spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(_base(docs[r.doc_id]).encode()).hexdigest()
    df = spark.createDataFrame([(0, "IBAN DE89370400440532013000, ssn 123-45-6789"), (1, "DE89370400440532013001 123-45-6789")], "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.score) for s in r.spans if s["rank"] >= 4] for r in pii.find_pii(df).collect()}
    assert found == {0: [("iban", 1.0), ("ssn", 0.9)], 1: []}


def test_context_before_through_and_after(spark):
    card = "4111 1111 1111 1111"
    texts = [f"cards: {card}, {card} and {card}", f"{card} (credit)", f"{card} " + "x" * 60 + " visa", f"visa {'x' * 60} {card}", card]
    texts += ["ssn 000-12-3456 ssn 666-12-3456, ssn 912-34-5678, ssn 123-00-4567, ssn 123-45-0000", "SSN 123-45-6789 and 234-56-7890", "123-45-6789 is my tax id"]
    rows = list(enumerate(texts))
    out = {r.doc_id: [(s.kind, s.score) for s in r.spans] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == [("card", 1.0)] * 2 + [("card", 0.8)] and out[1]  # the third is too far away
    assert out[1] == [("card", 1.0)]
    assert out[2] == out[3] == out[4] == [("card", 0.8)]
    assert out[5] == [] and out[6] == [("ssn", 0.9)] * 2 and out[7] == [("ssn", 0.9)]


def test_native_operators_run_no_python(spark):
    for df in (pii.op2_pii(spark, SF), chat.op8_chat(spark, SF)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- pieces -----------------------------------------------------------------------------

needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")


def _all_paths(m, unit):
    text, out = unit.translate(pieces._TO_PIECES), []

    def go(i, score, path):
        if i == len(text):
            out.append((score, path))
            return
        single = False
        for j in range(i + 1, len(text) + 1):
            k = m.ids.get(text[i:j])
            if k is not None:
                single = single or j == i + 1
                go(j, score + m.scores[k], [*path, k])
        if not single:
            go(i + 1, score + m.fallback, [*path, *(m.bytes[b] for b in unit[i].encode())])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@needs_model
def test_n_best_against_all_segmentations():
    m = pieces.parse_model(pieces.read_model(pieces.MODEL))
    rng = random.Random(5)
    for _ in range(150):
        unit = rng.choice(["", " "]) + "".join(rng.choice("theaningéß😀▁,") for _ in range(rng.randint(1, 9)))
        want, got = _all_paths(m, unit), m.encode_unit(unit, 4)
        assert [round(s, 3) for s, _ in got] == [round(s, 3) for s, _ in want[:4]]
        assert all(any(p == q and abs(s - t) < 1e-6 for t, q in want) for s, p in got)
        assert len({tuple(p) for _, p in got}) == len(got)


@needs_model
def test_chain_of_units_equals_whole_lattice():
    data = pieces.read_model(pieces.MODEL)
    m, units = pieces.parse_model(data), pieces.units_of(data, 3)
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["the", " ", "  ", "\n", "1", "23", "été", ".", ",", "²", "▁", "😀", "A", "-", "\t"]) for _ in range(rng.randint(1, 8)))
        every, scores = pieces.encode(text, units)
        whole = m.encode_unit(" " + text, 3)
        assert np.allclose(scores, [s for s, _ in whole], rtol=1e-12) and len(set(every)) == len(every) == len(scores)
        for ids, score in zip(every, scores, strict=True):
            ids = np.frombuffer(ids, "<i4")
            assert pieces.decode(ids, m) == text
            lost = sum(m.pieces[i][2] == pieces.BYTE for i in ids.tolist())
            assert lost or abs(sum(m.scores[i] for i in ids.tolist()) - score) < 1e-6


@needs_model
def test_all_segmentations_come_out_and_decode(spark):
    rows = [(1, "hello there, world"), (2, None), (3, ""), (4, "▁ 😀\x00")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, ids string, scores string")
    out = pieces.encode_pieces(df, n_best=4)
    found = {r.doc_id: r for r in out.collect()}
    assert len(found[1].others) == 3 and len(found[1].scores) == 4 and found[2].others == found[3].others == []
    every = out.select("doc_id", F.explode(F.concat(F.array("ids"), "others")).alias("ids"))
    assert {(r.doc_id, r.text) for r in pieces.decode_pieces(every).collect()} == {(i, t or "") for i, t in rows}
    assert pieces.decode_pieces(out.limit(0)).count() == 0
    null = spark.createDataFrame([(1, None, "x")], "doc_id long, ids binary, text string")
    assert [tuple(r) for r in pieces.decode_pieces(null).collect()] == [(1, "")]


@needs_model
def test_every_document_decodes(spark):
    out = pieces.op3_pieces(spark, SF)
    assert out.where("NOT exact").count() == 0 and out.count() == 1000


# --- mixing ----------------------------------------------------------------------------


def test_shortage_goes_to_siblings_first():
    root = mixing.Node(children={"a": mixing.Node(0.5, {"x": mixing.Node(0.5), "y": mixing.Node(0.5)}), "b": mixing.Node(0.5)})
    tokens = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    assert mixing.propagate(root, tokens, 200, 1) == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}
    assert mixing.propagate(root, {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 1000}, 200, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 170}
    assert sum(mixing.share_out(100, [1, 1, 1], [100, 100, 100])) == 100
    assert mixing.share_out(10**6, [1, 2], [5, 7]) == [5, 7]


@pytest.mark.parametrize("rows", [4096, 3])
def test_prefix_against_sorted_leaves(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    levels = F.array(*mixing.tree_levels())
    items = docs.select("doc_id", levels.alias("leaf"), F.regexp_count("text", F.lit(r"\S+")).alias("t")).collect()
    total = defaultdict(int)
    for r in items:
        total[tuple(r.leaf)] += r.t
    budget = mixing.propagate(mixing.TARGET, total, int(0.8 * sum(total.values())), 2)
    order = {}
    for e in (0, 1, 2):
        order |= {(r.id, e): r.h for r in docs.select(F.col("doc_id").alias("id")).select("id", mixing._order(mixing.SEED, F.lit(e)).alias("h")).collect()}
    want = set()
    for leaf in total:
        own = [r for r in items if tuple(r.leaf) == leaf]
        whole, rest = divmod(budget[leaf], total[leaf])
        want |= {(r.doc_id, e) for r in own for e in range(whole)}
        upto = 0
        for r in sorted(own, key=lambda r: (order[r.doc_id, whole], r.doc_id)):
            upto += r.t
            if not rest or upto > rest:
                break
            want.add((r.doc_id, whole))
    got = [(r.doc_id, r.epoch) for r in mixing.op4_mixing(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# --- similarity join ----------------------------------------------------------------------


def _grams(text):
    w = text.lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def _classes(rows, least=0.8):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, _grams(t or "")) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and len(a & b) >= least * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_jaccard_classes_against_all_pairs(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 14) if g else 60):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    members, links = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    want = _classes(rows)
    got = {r.doc_id: r.class_id for r in members.collect()}
    assert sum(got[i] != want[i] for i in want) <= 2  # the forest's recall is not 1
    texts = dict(rows)
    node = {bytes(r.node): r.doc_id for r in members.collect()}
    for r in links.collect():
        a, b = (_grams(texts[node[bytes(x)]]) for x in (r.a, r.b))
        assert abs(r.jaccard - len(a & b) / len(a | b)) < 1e-9 and r.jaccard >= 0.8


def test_intersections_and_forest_against_sets(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS", 7)
    rng = random.Random(9)
    x, y = ([np.array(sorted(rng.sample(range(60), rng.randint(1, 30))), dtype=np.uint64) for _ in range(n)] for n in (13, 17))
    assert jaccard_join.intersections(x, y).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]
    keep = np.array([[rng.random() < 0.06 for _ in y] for _ in x])
    rows, columns = jaccard_join._forest(keep)
    assert all(rows[i] == columns[j] >= 0 for i, j in zip(*np.nonzero(keep), strict=True))
    assert ((rows < 0) == ~keep.any(axis=1)).all() and ((columns < 0) == ~keep.any(axis=0)).all()


@pytest.mark.parametrize("block", [1024, 200])
def test_crowd_of_copies_unlike_each_other(spark, monkeypatch, block):
    """1,000 copies linked to one base and hardly to each other, and a dense crowd."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block, raising=False)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(204)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1001):
        own = list(base)
        for k in range(3):  # 15 of 200 shingles, so 0.86 to the base
            own[rng.randrange(5, 60) + 65 * k] = f"x{i}.{k}"
        rows.append((i, " ".join(own)))
    other = [f"v{i}" for i in range(120)]
    for i in range(1001, 1061):
        own = list(other)
        own[rng.randrange(5, 115)] = f"y{i}"
        rows.append((i, " ".join(own)))
    sets = {i: _grams(t) for i, t in rows}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(sets.items(), 2) if len(a & b) >= 0.8 * len(a | b)}
    assert sum(j <= 1000 for i, j in want if not i) == 1000
    members, links = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    got = members.collect()
    node = {bytes(r.node): r.doc_id for r in got}
    found = [tuple(sorted((node[bytes(r.a)], node[bytes(r.b)]))) for r in links.collect()]
    assert len(found) == len(set(found)) and set(found) <= want
    assert len(found) >= 0.99 * len(want) and sum(not i for i, _ in found) >= 990
    degree = defaultdict(int)
    for pair in found:
        for i in pair:
            degree[i] += 1
    assert {r.doc_id: r.n_links for r in got} == {r.doc_id: degree[r.doc_id] for r in got}
    classes = _classes_of(found, sets)
    assert {r.doc_id: r.class_id for r in got} == classes
    assert sum(c == 0 for c in classes.values()) >= 991 and sum(c == 1001 for c in classes.values()) == 60


def _classes_of(pairs, nodes):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in nodes}


def test_components_on_random_graphs(spark):
    rng = random.Random(8)
    edges = [(f"{rng.randrange(120):03d}", f"{rng.randrange(120):03d}") for _ in range(90)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)] + [("hub", f"s{i}") for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in jaccard_join.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in {v for e in edges for v in e if e[0] != e[1]}}


def test_prefix_depth_reaches_recall():
    k = jaccard_join.shortest_prefix(0.8, 0.99)
    assert 1 - (1 - 0.8**k) ** jaccard_join.TREES >= 0.99 > 1 - (1 - 0.8 ** (k + 1)) ** jaccard_join.TREES


# --- exact dedup --------------------------------------------------------------------------


def test_golomb_round_trip():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 7, 1000):
        for top in (2000, 1 << 20, 1 << 47):
            values = np.unique(rng.integers(0, top, n))
            assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values), len(values)) == values).all()
    values = np.unique(rng.integers(0, 1 << 48, 5000))
    assert len(exact_dedup.golomb_encode(values)) < 0.9 * 6 * len(values)


def test_suspects_are_verified(spark, monkeypatch):
    """With fingerprints of four bits nearly all rows are suspects; results stay."""
    monkeypatch.setattr(exact_dedup, "FINGERPRINT_BITS", 4)
    rows = [(i, ["a", "A", "é", "É", "b"][i % 5] * (1 + i % 7)) for i in range(200)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), owners=3)
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t)].append(i)
    want = {i: (max(g), len(g)) for g in groups.values() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in out.collect()} == want


# --- media -------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 12_289, 60_000])
def test_payload_round_trip(n):
    data = random.Random(n).randbytes(n) if n % 2 else b"\xff" * n
    payload = media.pad(data)
    assert len(payload) % 192 == 0 and payload[: len(data)] == data and set(payload[len(data) :]) <= {32}
    stored = media.store_payload(payload)
    back, histograms, avi = media.read_payload(stored)
    assert back == payload and len(histograms) == len(avi.frames)


def test_slow_and_fast_decoding_agree():
    avi = media.read_avi(media.store_payload(media.pad(random.Random(1).randbytes(2000))))
    head, scan = media._split_frame(avi.frames[0])
    _, fast = media.decode_coefficients(avi.frames[0])
    raw, ends = media._segments(scan)
    slow = [b for a, z in zip([0, *ends], ends, strict=False) for b in media._slow_segment(raw[a:z].tobytes(), head, 1)]
    assert (np.array(slow).reshape(fast.shape) == fast).all()


def _gray_jpeg(value):
    """A plain 8x8 grey frame with ordinary multi-code tables."""
    dc = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
    ac = bytes([1, 1] + [0] * 14) + bytes([0, 1])
    codes = {v: k for k, v in media._codes(dc[:16], dc[16:]).items()}
    level = (value - 128) * 8
    size = abs(level).bit_length()
    length, code = codes[size]
    bits = f"{code:0{length}b}" + (f"{level if level > 0 else level + (1 << size) - 1:0{size}b}" if size else "") + "0"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = media._segment
    return b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_ordinary_frames_and_shots(spark):
    for v in (0, 100, 128, 255):
        head, c = media.decode_coefficients(_gray_jpeg(v))
        assert set(media.luma(head, c).ravel()) == {v}
    frames = [_gray_jpeg(v) for v in [20] * 10 + [200] * 5 + [90] * 10]
    data = media.write_avi(frames, 8, 8, fps=5)
    df = spark.createDataFrame([(1, data), (2, None), (3, b"junk"), (4, data[:100]), (5, media.write_avi([], 8, 8))], "doc_id long, media binary")
    rows = media.clip_rows(df).collect()
    assert [(r.first_frame, r.end_frame, r.start_s, r.end_s) for r in rows if r.doc_id == 1] == [(0, 10, 0.0, 2.0), (10, 15, 2.0, 3.0), (15, 25, 3.0, 5.0)]
    assert {r.doc_id: r.error for r in rows if r.error} == {2: "no media", 3: "not an AVI file", 4: "the file is cut"} and not [r for r in rows if r.doc_id == 5]


def _standard_jpeg(coefficients, wide, tables=False):
    """A 4:2:0 frame of random coefficients in the standard's Huffman codes."""
    codes = {k: {v: c for c, v in media._codes(*t).items()} for k, t in media.STANDARD.items()}
    bits, last = [], [0, 0, 0]

    def put(table, symbol, value, size):
        length, code = codes[table][symbol]
        bits.append(f"{code:0{length}b}" + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""))

    for unit in coefficients:
        for block, part in zip(unit, (0, 0, 0, 0, 1, 2), strict=True):
            table = int(part > 0)
            size = abs(block[0] - last[part]).bit_length()
            put(table, size, block[0] - last[part], size)
            last[part], run = block[0], 0
            for k in range(1, 64):
                if not block[k]:
                    run += 1
                    continue
                while run > 15:
                    put(16 + table, 0xF0, 0, 0)
                    run -= 16
                size = abs(block[k]).bit_length()
                put(16 + table, run << 4 | size, block[k], size)
                run = 0
            if run:
                put(16 + table, 0, 0, 0)
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    scan = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0")
    seg, high = media._segment, len(coefficients) // wide
    dht = b"".join(seg(0xC4, bytes([k]) + n + v) for k, (n, v) in media.STANDARD.items()) if tables else b""
    return b"\xff\xd8" + seg(0xE0, b"AVI1") + seg(0xDB, b"\0" + b"\2" * 64) + seg(0xC0, bytes([8, 0, 16 * high, 0, 16 * wide, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + dht + seg(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + scan + b"\xff\xd9"


def test_frames_without_tables():
    assert [len(v) for _, v in media.STANDARD.values()] == [sum(n) for n, _ in media.STANDARD.values()] == [12, 12, 162, 162]
    rng = random.Random(13)
    blocks = [[[rng.randint(-300, 300) if rng.random() < 0.3 else 0 for _ in range(64)] for _ in range(6)] for _ in range(6)]
    for tables in (False, True):
        head, got = media.decode_coefficients(_standard_jpeg(blocks, 3, tables))
        assert (head.width, head.height) == (48, 32) and got.tolist() == blocks


def _avi(frames, layout):
    """The same frames without an index, in rec lists, or behind an OpenDML index."""
    c, li, rate = media._chunk, media._list, struct.pack("<II", 2, 20)
    strh = b"vidsMJPG" + bytes(12) + rate + bytes(28)
    sound = li(b"strl", c(b"strh", b"auds" + bytes(52)))
    body = [c(b"00wb", b"noise") + c(b"01dc", f) for f in frames]
    if layout == "rec":
        body = [li(b"rec ", x) for x in body]
    indx = c(b"indx", bytes(24 + 16)) if layout == "odml" else b""
    hdrl = lambda more: li(b"hdrl", c(b"avih", bytes(56)), sound, li(b"strl", c(b"strh", strh), more))
    riff = lambda *parts: c(b"RIFF", b"AVI " + b"".join(parts))
    if layout != "odml":
        return riff(hdrl(indx), li(b"movi", *body))
    start = 12 + len(hdrl(indx)) + 12
    places, at = [], start
    for f in frames:
        places.append((at + len(c(b"00wb", b"noise")) + 8, len(f)))
        at += len(c(b"00wb", b"noise")) + len(c(b"01dc", f))
    ix = c(b"ix01", struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"01dc", 0, 0) + b"".join(struct.pack("<II", *x) for x in places))
    top = c(b"indx", struct.pack("<HBBI4sQI", 4, 0, 0, 1, b"01dc", 0, 0) + struct.pack("<QII", at, len(ix), len(frames)))
    return riff(hdrl(top), li(b"movi", *body, ix))


@pytest.mark.parametrize("layout", ["plain", "rec", "odml"])
def test_layouts_of_files(spark, layout):
    frames = [_gray_jpeg(v) for v in [20] * 6 + [200] * 4]
    data = _avi(frames, layout)
    avi = media.read_avi(data)
    assert avi.frames == frames and avi.fps == 10
    df = spark.createDataFrame([(1, data, "x"), (2, data[:-30], "y"), (3, data.replace(b"\xff\xda", b"\xff\xd5"), "z")], "doc_id long, media binary, clip string")
    out = [(r.doc_id, r.start_s, r.end_s, bool(r.error)) for r in media.clip_rows(df).collect()]
    assert sorted(out) == [(1, 0.0, 0.6, False), (1, 0.6, 1.0, False), (2, 0.0, 0.0, True), (3, 0.0, 0.0, True)]


def test_clips_query(spark):
    features = {r.doc_id: r.feature for r in media.op7_media(spark, SF).collect()}
    clips = defaultdict(list)
    for r in media.media_clips(spark, SF).collect():
        assert r.error is None
        clips[r.doc_id].append((r.clip, f"{r.start_s:.2f}-{r.end_s:.2f}"))
    assert {i: ",".join(c for _, c in sorted(own)) for i, own in clips.items()} == {i: f.rsplit("clips=", 1)[1] for i, f in features.items()}


def test_media_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = {}
    for r in media.op7_media(spark, SF).collect():
        payload = media.pad(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(docs[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        assert seen.setdefault(payload, r[1:]) == r[1:]


# --- lines ------------------------------------------------------------------------------


def _dropped(rows):
    """Line by line, every earlier line looked at."""
    seen, drop = [], set()
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            w = line_dedup.fold(line).split()
            if len(w) < line_dedup.EXACT_WORDS:
                continue
            if any(w == v or (min(len(w), len(v)) >= line_dedup.NEAR_WORDS and line_dedup.within_one_edit(w, v)) for v in seen):
                drop.add((i, k))
            seen.append(w)
    return drop


def test_lines_against_all_pairs(spark):
    rng = random.Random(10)
    base = [[rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 16))] for _ in range(30)]
    rows = []
    for i in range(100):
        lines = []
        for _ in range(4):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 1)] = rng.choice([[], [rng.choice("abcdefgh") * 2]]) or ([] if len(w) > 1 else ["zz"])
            lines.append("  ".join(w).title() if rng.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join(lines)))
    drop = _dropped(rows)
    for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r.doc_id]
        assert r.text == "\n".join(x for k, x in enumerate(text.split("\n")) if (r.doc_id, k) not in drop)
    assert len(drop) > 50


def test_short_lines_go_as_exact_copies(spark):
    rows = [(1, "Ietzte.\n\nein wort\n这是没有空格的一整行文字"), (2, "ietzte.\n\n  EIN  wort\nein ort"), (3, "这是没有空格的一整行文字\n \nietzte")]
    out = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (rows[0][1], 0), 2: ("\nein ort", 2), 3: (" \nietzte", 1)}


def test_one_edit():
    words = [list(p) for n in range(5) for p in itertools.product("ab", repeat=n)]

    def distance(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    assert all(line_dedup.within_one_edit(a, b) == (distance(a, b) <= 1) for a in words for b in words)


# --- licences ---------------------------------------------------------------------------


def test_licenses_of_a_given_table(spark):
    mit = license_scan.LICENSES["MIT"]
    more = [("MIT", "MIT License\n\n" + mit, False), ("X-1", "Do as you like,\nbut keep this text.", False), ("X-1", "Under the X licence, version 1.", True), ("none", "", False)]
    known = license_scan.fixed_licenses(spark).union(spark.createDataFrame(more, "license_id string, text string, line boolean"))
    rows = [(1, f"MIT License\n\nCopyright (c) 2020 A. B.\n\n{mit}"), (2, "do as you like but KEEP this text"), (3, "some words\nUnder the X License version 1\nmore"), (4, mit), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.license_id, r.notices) for r in license_scan.license_scan(docs, known=known).collect()}
    assert out == {1: ("MIT", []), 2: ("X-1", []), 3: (None, ["X-1"]), 4: ("MIT", []), 5: (None, [])}
    whole = known.where("NOT line")
    assert [r.license_id for r in license_scan.license_scan(docs, known=whole).orderBy("doc_id").collect()] == ["MIT", "X-1", None, "MIT", None]


def _file(title, notice, text, width, lead=""):
    import textwrap

    body = "\n".join(textwrap.fill(part, width) for part in text.split("\n"))
    return "\n".join(lead + x for x in f"{title}\n\n{notice}\n\n{body}\n".split("\n"))


def test_usual_license_files(spark):
    """Titles, copyright notices, rights lines, wrapping and comment signs do not matter."""
    known, rows, want = license_scan.LICENSES, [], {}
    titles = {"MIT": "The MIT License (MIT)", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": 'BSD 3-Clause "New" or "Revised" License', "ISC": "ISC License", "Zlib": "zlib License", "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003", "0BSD": "Zero-Clause BSD License", "MIT-0": "MIT No Attribution License"}
    for name, title in titles.items():
        for width in (70, 75, 78, 80):
            for notice in ("Copyright (c) 2011-2024 A. Person and others", "Copyright 2020 A. B.\nAll rights reserved.", "(c) 2019 The Authors\nCopyright © 2020 C"):
                for lead in ("", "# ", " * "):
                    want[len(rows)] = name
                    rows.append((len(rows), _file(title, notice, known[name], width, lead)))
    filled = known["BSD-3-Clause"].replace("the copyright holder nor", "Some Company, Inc. nor").replace("1. ", "* ").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS")
    want[len(rows)] = "BSD-3-Clause"
    rows.append((len(rows), _file("", "Copyright (c) 1999 The Regents", filled.replace("2. ", "* ").replace("3. ", "* "), 72)))
    near = [known["MIT"] + " More words.", known["MIT"].replace("without restriction", "with restriction"), "MIT License", known["Apache-2.0"] + "\n" + known["MIT"]]
    for text in near:
        want[len(rows)] = None
        rows.append((len(rows), text))
    out = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.license_id for r in out.collect()} == want


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="no published texts here")
def test_published_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    rows = [(name, open(f"/usr/share/common-licenses/{name}", encoding="utf-8").read().upper().replace("\n", "\r\n")) for name in names]
    out = license_scan.license_scan(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {r.doc_id: r.license_id for r in out.collect()} == names


def test_notice_lines_of_any_length(spark):
    rows = [(1, "x\rReleased under the MIT License." + " " * 900 + "\ny"), (2, "// " + "-" * 500 + " Licensed under CC BY 4.0. " + "-" * 500), (3, "It was not Released under the MIT License.")]
    out = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.notices for r in out.collect()} == {1: ["MIT"], 2: ["CC-BY-4.0"], 3: []}


# --- chat --------------------------------------------------------------------------------


def test_windows_repeat_context_and_mask_once(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, k, "user" if k % 2 else "assistant", f"t{k} " * 20) for k in range(1, 30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df, span_tokens=100, history_tokens=45).withColumn("turns", chat.parse_chat(F.col("formatted"))).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans"))).orderBy("window").collect()
    assert len(out) > 4 and all(w.turns[0].role == "system" for w in out)
    assert [w.n_context for w in out[1:]] == [3] * (len(out) - 1)
    own = [t for w in out for t in w.turns[w.n_context :]]
    assert [(t.role, t.text) for t in own] == [(r, t) for _, _, r, t in rows]
    assert [x for w in out for x in w.loss] == [t for _, _, r, t in rows if r == "assistant"]


def test_windows_keep_their_budget(spark):
    """Every window is within the bound or one turn alone, whatever the turns' lengths."""
    rng = random.Random(14)
    rows = []
    for c in range(40):
        rows += [(c, 0, "system", "rule " * rng.choice([3, 20, 500]))] if c % 3 else []
        rows += [(c, k, rng.choice(["user", "assistant"]), f"w{k} " * rng.choice([0, 1, 5, 30, 60, 99, 101, 250, 1001, 5000])) for k in range(1, 30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df, span_tokens=100, history_tokens=40, system_tokens=50).withColumn("turns", chat.parse_chat(F.col("formatted"))).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans"))).collect()
    tokens = lambda t: max(1, len(t.split()))
    for w in out:
        assert w.n_tokens == sum(tokens(t.text) for t in w.turns)
        assert w.n_tokens <= 290 or len(w.turns) == 1
    for c in range(40):
        own = sorted((w for w in out if w.conv_id == c), key=lambda w: w.window)
        assert [(t.role, t.text) for w in own for t in w.turns[w.n_context :]] == [(r, t) for i, _, r, t in rows if i == c]
        assert [x for w in own for x in w.loss] == [t for i, _, r, t in rows if i == c and r == "assistant"]


def test_pipeline(spark):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no pipeline here")
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    one = P.drop_toxic(spark, docs, SF)
    grammar = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = toxicity.Scorer(grammar)
    assert {r.doc_id for r in one.collect()} == {i for i, t in text.items() if score(t or "")[0] < toxicity.THRESHOLD}
    two = {r.doc_id: r.text for r in P.drop_repeated_lines(spark, one, SF).collect()}
    rows = [(r.doc_id, r.text) for r in one.collect()]
    drop = _dropped_fast(rows)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drop) for i, t in rows}
    assert two == {i: t for i, t in want.items() if t or not text[i]}
    last = P.run(spark, SF)
    assert last.where("NOT exact").count() == 0 and 0 < last.count() < len(two)


def _dropped_fast(rows):
    """As _dropped, comparing only lines that share their first or last word."""
    exact, near, drop = set(), defaultdict(list), set()
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            w = line_dedup.fold(line).split()
            if len(w) < line_dedup.EXACT_WORDS:
                continue
            keys = [(side, w[side], n) for side in (0, -1) for n in (len(w) - 1, len(w), len(w) + 1)]
            if tuple(w) in exact or (len(w) >= line_dedup.NEAR_WORDS and any(line_dedup.within_one_edit(w, v) for key in keys for v in near[key])):
                drop.add((i, k))
            if len(w) >= line_dedup.NEAR_WORDS and tuple(w) not in exact:
                for side in (0, -1):
                    near[side, w[side], len(w)].append(w)
            exact.add(tuple(w))
    return drop

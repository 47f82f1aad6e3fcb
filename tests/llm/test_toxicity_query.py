"""The toxicity query, whole, against the grammar's rules told once more."""

import math
import random
import re

from conftest import SF

from corpusforge.llm import toxicity as X


def clause_weight(clause, weights):
    """clause: (symbol, what the word has learned) pairs, looked at as a whole."""
    total, insults, waits = 0.0, 0, None
    symbols = [s for s, _ in clause]
    targets, negations, reports = ([i for i, x in enumerate(symbols) if x == c] for c in (X.TARGET, X.NEGATION, X.REPORT))
    for i, (x, own) in enumerate(clause):
        if x == X.TARGET and waits is not None and min(targets) == i:
            total += X.AFTERWARDS[waits]
        if x not in (X.INSULT, X.THREAT):
            continue
        marks = X.REPORTED * any(r < i for r in reports) | X.NEGATED * any(0 < i - n <= X.NEGATION_SCOPE for n in negations)
        total += weights[x | marks | X.DIRECTED * any(t < i for t in targets)] + (0.0 if marks else own)
        if x == X.INSULT:
            total += X.HEAPED * (insults > 0 and not marks)
            insults += 1
        if not marks and not any(t < i for t in targets):
            waits = x
    return total


def symbol_of(word, grammar):
    for c, words in X.WORDS.items():
        if word in words:
            learned = max([grammar.words.get(word, 0.0), *(w for p, w in grammar.prefixes.items() if word.startswith(p) and word != p)])
            if c in (X.INSULT, X.THREAT):
                return c, grammar.listed.get(word, learned)
            return (X.INSULT, learned) if learned else (c, 0.0)
    learned = max([grammar.words.get(word, 0.0), *(w for p, w in grammar.prefixes.items() if word.startswith(p) and word != p)])
    return (X.INSULT, learned) if learned else (grammar.others.get(word, X.OTHER), 0.0)


def score(text, grammar):
    weights = []
    for part in re.split(r"[.!?;:\n]+", text.lower()):
        clause = [symbol_of(w, grammar) for w in re.findall(r"[^\W_]+(?:'[^\W_]+)?", part)]
        if any(s >= X.INSULT for s, _ in clause):
            weights.append(clause_weight(clause, grammar.weights))
    return 1 - math.exp(-0.5 * sum(w for w in weights if w > 0))


def test_query_on_all_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    grammar = X.fit(docs, labels)
    assert grammar.listed
    got = {r.doc_id: (r.score, r.predicted) for r in X.op1_toxicity(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = score(t, grammar)
        assert abs(got[i][0] - want) < 1e-9 and got[i][1] == (want >= 0.3)
    # What the labels taught reaches the scores.
    plain = sum(abs(got[i][0] - score(t, X.Grammar())) > 1e-6 for i, t in texts.items())
    assert plain > 10


def test_labels_change_what_a_listed_word_scores(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(300)]

    def corpus(toxic_clown):
        rows = []
        for i in range(400):
            own = rng.choices(words, k=15)
            own[7:7] = ["clown"] if i % 4 == 0 else ["you", "moron"] if i % 4 == 1 else []
            rows.append((i, " ".join(own), int(i % 4 == 1 or (toxic_clown and i % 4 == 0))))
        return spark.createDataFrame(rows, "doc_id long, text string, toxic int")

    scores = {}
    for toxic in (True, False):
        docs = corpus(toxic)
        grammar = X.fit(docs, docs.select("doc_id", "toxic"))
        scores[toxic] = [X.Scorer(grammar)(t)[0] for t in ("the clown left", "you clown", "you moron")]
    assert scores[True][0] >= X.THRESHOLD > scores[False][0]
    assert scores[True][1] > scores[False][1] and min(scores[True][2], scores[False][2]) >= X.THRESHOLD

"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words to symbols: insult, threat, target, negation,
reported speech, other. Five transducers read a clause one after the other:

* reported speech marks hits (insults and threats) after a word of reporting,
* negation marks hits that stand at most NEGATION_SCOPE words after a negation,
* target marks hits after a target, and marks a target after a hit,
* threat weighs threats by their marks and passes insults on,
* insult weighs insults by their marks, the more in one clause the heavier.

Their composition is one table over product states, built once. A clause, not a
word, is scored: an undirected insult that stands alone stays below the
threshold, one aimed at somebody passes it, a negated or quoted one weighs less.

Labels teach four things, from a bounded sample (``fit_rows``): insult arcs of
the lexicon (words, and word beginnings that stand for every word that starts
so), what a listed insult or threat is worth beside the others (more or less than
its pattern's weight), negating and reporting arcs (words that stand before hits
in clean texts), and the weight of a pattern where it is the only one in enough
labelled texts.
Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, documents_of, small_batches, table

OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT = range(6)
#: Marks that a transducer sets on the symbol of a hit, or on a target after one.
REPORTED, NEGATED, DIRECTED = 8, 16, 32
#: Words of each class, in the four languages of the corpus.
WORDS = {
    TARGET: "you your yours yourself u he she they him her them his their du dich dir dein deine ihr euch sie tu te toi ton ta vous votre ils elle él ella ellos tú ti usted ustedes vosotros".split(),
    NEGATION: "not never no neither nor nobody isn't aren't wasn't don't doesn't cannot without nicht nie kein keine keinen niemals pas jamais aucun ni nunca jamás tampoco ningún".split(),
    REPORT: "said says say saying wrote writes quoted quote quotes reported reports claimed claims alleged called sagte sagt schrieb zitiert behauptet dit disait écrit cité selon dijo dice escribió citado según".split(),
    INSULT: "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumb filthy garbage vermin dummkopf trottel abschaum imbécile crétin ordure idiota estúpido basura".split(),
    THREAT: "kill murder hurt destroy strangle shoot stab burn töten umbringen verletzen zerstören tuer détruire frapper matar destruir golpear".split(),
}
#: Weight of a hit by its marks; a hit without marks stands alone below the threshold.
WEIGHTS = {
    INSULT: 0.6, INSULT | DIRECTED: 2.0, INSULT | NEGATED: 0.3, INSULT | REPORTED: 0.3, INSULT | DIRECTED | NEGATED: 0.5, INSULT | DIRECTED | REPORTED: 0.5,
    INSULT | NEGATED | REPORTED: 0.1, INSULT | DIRECTED | NEGATED | REPORTED: 0.2,
    THREAT: 0.0, THREAT | DIRECTED: 2.0, THREAT | NEGATED: 0.0, THREAT | REPORTED: 0.0, THREAT | DIRECTED | NEGATED: 0.3, THREAT | DIRECTED | REPORTED: 0.3,
    THREAT | NEGATED | REPORTED: 0.0, THREAT | DIRECTED | NEGATED | REPORTED: 0.1,
}
#: What a target after an insult or a threat adds, and what further insults of a clause add.
AFTERWARDS, HEAPED = {INSULT: 1.0, THREAT: 1.0}, 0.4
NEGATION_SCOPE = 3
#: A learned arc needs so many texts, and such a share of one label.
LEAST_TEXTS, LEAST_SHARE = 6, 0.9
#: ... and, if it is an insult, so many toxic texts that no better arc explains.
LEAST_NEW = 4
#: Labels change the weight of a pattern that is alone in so many labelled texts.
LEAST_ALONE = 20
PREFIXES = (4, 5, 6)
FIT_ROWS = 12_000
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]+")
_CACHE = 100_000

#: What a word without a learned arc is read as, held once; -1 ends a clause.
_PLAIN = {c: (c, 0.0) for c in range(-1, 6)}

Symbol = int
Step = tuple[int, Symbol, float]


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) -> (state, symbol put out, weight).

    A symbol without an arc is put out as it came and leaves the state.
    """

    arcs: dict[tuple[int, Symbol], Step]

    def step(self, state: int, symbol: Symbol) -> Step:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def run(self, symbols: Iterable[Symbol]) -> tuple[list[Symbol], float]:
        """What comes out of a clause, and its weight."""
        state, out, total = 0, [], 0.0
        for symbol in symbols:
            state, put, weight = self.step(state, symbol)
            out.append(put)
            total += weight
        return out, total


def _marked(symbol: Symbol, *marks: int) -> list[Symbol]:
    """The symbol with every set of the marks."""
    out = [symbol]
    for mark in marks:
        out += [x | mark for x in out]
    return out


def reporting() -> Transducer:
    return Transducer({(0, REPORT): (1, REPORT, 0.0)} | {(1, hit): (1, hit | REPORTED, 0.0) for hit in (INSULT, THREAT)})


def negating() -> Transducer:
    """The state is the number of words that a negation still reaches."""
    arcs: dict[tuple[int, Symbol], Step] = {}
    for left in range(NEGATION_SCOPE + 1):
        for symbol in (OTHER, TARGET, REPORT, *_marked(INSULT, REPORTED), *_marked(THREAT, REPORTED)):
            hit = symbol & 7 in (INSULT, THREAT)
            arcs[left, symbol] = (max(0, left - 1), symbol | NEGATED if hit and left else symbol, 0.0)
        arcs[left, NEGATION] = (NEGATION_SCOPE, NEGATION, 0.0)
    return Transducer(arcs)


def targeting() -> Transducer:
    """State 1: after a target. State 2 and 3: after an insult or a threat without one."""
    arcs: dict[tuple[int, Symbol], Step] = {(s, TARGET): (1, TARGET, 0.0) for s in (0, 1)}
    for state, hit in ((2, INSULT), (3, THREAT)):
        arcs[state, TARGET] = (1, TARGET | (DIRECTED if hit == INSULT else REPORTED), 0.0)
    for hit, after in ((INSULT, 2), (THREAT, 3)):
        for symbol in _marked(hit, REPORTED, NEGATED):
            arcs[1, symbol] = (1, symbol | DIRECTED, 0.0)
            # Negated and quoted hits do not wait for a target.
            for state in (0, 2, 3):
                arcs[state, symbol] = (after if symbol == hit else state, symbol, 0.0)
    return Transducer(arcs)


def threatening(weights: dict[Symbol, float]) -> Transducer:
    arcs: dict[tuple[int, Symbol], Step] = {(0, s): (0, s, weights[s]) for s in _marked(THREAT, REPORTED, NEGATED, DIRECTED)}
    arcs[0, TARGET | REPORTED] = (0, TARGET, AFTERWARDS[THREAT])
    return Transducer(arcs)


def insulting(weights: dict[Symbol, float]) -> Transducer:
    """State 1: the clause has an insult, so the next one is heaped on it."""
    arcs: dict[tuple[int, Symbol], Step] = {}
    for state in (0, 1):
        for s in _marked(INSULT, REPORTED, NEGATED, DIRECTED):
            arcs[state, s] = (1, s, weights[s] + (HEAPED if state and not s & (REPORTED | NEGATED) else 0.0))
        arcs[state, TARGET | DIRECTED] = (state, TARGET, AFTERWARDS[INSULT])
    return Transducer(arcs)


def grammar_machines(weights: dict[Symbol, float]) -> list[Transducer]:
    """The five, in the order in which they read each other's output."""
    return [reporting(), negating(), targeting(), threatening(weights), insulting(weights)]


def compose(first: Transducer, second: Transducer, symbols: Iterable[Symbol]) -> Transducer:
    """One transducer that does what ``second`` does on the output of ``first``.

    Its states are the pairs that ``symbols`` reach from the two start states.
    """
    number, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    symbols = list(symbols)
    for pair in todo:
        for symbol in symbols:
            left, middle, weight = first.step(pair[0], symbol)
            right, out, more = second.step(pair[1], middle)
            if (left, right) not in number:
                number[left, right] = len(todo)
                todo.append((left, right))
            arcs[number[pair], symbol] = (number[left, right], out, weight + more)
    return Transducer(arcs)


def composed(weights: dict[Symbol, float]) -> list[list[Step]]:
    """The whole grammar as a table: row = state, column = symbol of the lexicon."""
    whole, *rest = grammar_machines(weights)
    for machine in rest:
        whole = compose(whole, machine, range(6))
    return [[whole.step(state, symbol) for symbol in range(6)] for state in sorted({s for s, _ in whole.arcs})]


@dataclass
class Grammar:
    """words and prefixes: learned insult arcs and what they add to a hit's weight;
    others: learned words of another class; listed: what fixed insults and threats
    add to, or take from, a hit's weight; weights: of a hit by its marks."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    others: dict[str, Symbol] = field(default_factory=dict)
    listed: dict[str, float] = field(default_factory=dict)
    weights: dict[Symbol, float] = field(default_factory=lambda: dict(WEIGHTS))


class Lexicon(dict):
    """The lexicon transducer: word -> (symbol, weight), filled as words are met."""

    def __init__(self, grammar: Grammar):
        self.fixed = {w: c for c, words in WORDS.items() for w in words}
        self.grammar = grammar

    def __missing__(self, word: str) -> tuple[Symbol, float]:
        if len(self) >= _CACHE:
            self.clear()
        g = self.grammar
        c = self.fixed.get(word, g.others.get(word, OTHER))
        found = max([g.words.get(word, 0.0), *(g.prefixes.get(word[:n], 0.0) for n in PREFIXES if len(word) > n)])
        if c in (INSULT, THREAT):
            out = (c, g.listed.get(word, found))
        elif found:
            out = (INSULT, found)
        else:
            out = _PLAIN[c if c != OTHER or word[0].isalnum() else -1]
        self[word] = out
        return out


class Scorer:
    def __init__(self, grammar: Grammar):
        self.lexicon = Lexicon(grammar)
        self.rows = composed(grammar.weights)

    def clauses(self, text: str) -> Iterator[tuple[float, list[Symbol]]]:
        """(weight, hits as put out) of each clause with a hit."""
        read = list(map(self.lexicon.__getitem__, _TOKEN.findall(text.lower())))
        if not read or max(read)[0] < INSULT:
            return
        state, weight, hits, rows = 0, 0.0, [], self.rows
        for symbol, own in [*read, (-1, 0.0)]:
            if symbol < 0:
                if hits:
                    yield weight, hits
                state, weight, hits = 0, 0.0, []
                continue
            state, out, more = rows[state][symbol]
            weight += more
            if symbol >= INSULT:
                # A negated or quoted hit does not bring what its word has learned.
                weight += 0.0 if out & (NEGATED | REPORTED) else own
                hits.append(out)

    def __call__(self, text: str) -> tuple[float, int]:
        """(score from 0 to 1, number of clauses that matched)."""
        weights = [w for w, _ in self.clauses(text) if w > 0]
        return 1.0 - math.exp(-0.5 * sum(weights)), len(weights)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _features(text: str) -> set[str]:
    words = {w for w in _TOKEN.findall(text.lower()) if w[0].isalnum()}
    return {"=" + w for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) > n}


def _before_hits(scorer: Scorer, text: str) -> set[str]:
    """Words of no class that stand in a clause before its first hit, by place:
    "-word" within the scope of a negation, "<word" further before."""
    out: set[str] = set()
    clause: list[tuple[str, Symbol]] = []
    for word in _TOKEN.findall(text.lower()):
        symbol, _ = scorer.lexicon[word]
        if symbol < 0:
            clause = []
        elif symbol >= INSULT:
            out.update(("-" if k < NEGATION_SCOPE else "<") + w for k, (w, c) in enumerate(reversed(clause)) if c == OTHER)
            clause = []
        else:
            clause.append((word, symbol))
    return out


def _only_pattern(scorer: Scorer, text: str) -> set[str]:
    """The marks of a text's one hit, if it has no other."""
    hits = [x for _, own in scorer.clauses(text) for x in own]
    return {f"#{hits[0]}"} if len(hits) == 1 else set()


def _count(features: Callable[[], Callable[[str], set[str]]]):
    """(feature, toxic texts, clean texts) of each batch of (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features()
        for b in batches:
            # A part at a time: its distinct words are held at once.
            for at in range(0, b.num_rows, 64):
                part, counts = b.slice(at, 64), (Counter(), Counter())
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts[1 if toxic else 0].update(of(text))
                names = list(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())], ["feature", "toxic", "clean"])

    return run


def _counted(sample: DataFrame, features: Callable[[], Callable[[str], set[str]]]) -> DataFrame:
    counts = sample.mapInArrow(_count(features), "feature string, toxic long, clean long")
    return counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _held(arcs: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_features(t) & arcs) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], ["features"])

    return run


def cover(arcs: list[str], toxic_texts: list[set[str]]) -> set[str]:
    """Arcs, best first, that each explain LEAST_NEW toxic texts not yet explained.

    Words that only stand beside an insult, in near copies of one text, go.
    """
    kept: set[str] = set()
    open_texts = toxic_texts
    for arc in arcs:
        rest = [t for t in open_texts if arc not in t]
        if len(open_texts) - len(rest) >= LEAST_NEW:
            kept.add(arc)
            open_texts = rest
    return kept


def _sample(documents: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame | None:
    """(text, toxic) of at most about ``fit_rows`` labelled rows."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    total = known.count()
    if not total:
        return None
    if total > fit_rows:
        # The share leaves a margin, so that the bound holds with all but certainty.
        known = known.where(F.pmod(F.xxhash64("__id", F.lit(17)), F.lit(1_000_003)) < int(1_000_003 * 0.95 * fit_rows / total))
    known = known.groupBy("__id").agg(F.max("__y").alias("__y"))
    texts = documents_of(documents, id_col, text_col).withColumnRenamed("id", "__id")
    return texts.join(F.broadcast(known), "__id").groupBy("text").agg(F.max("__y").alias("toxic"))


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Learn arcs and weights from at most about ``fit_rows`` labelled rows.

    What is gathered is bounded by that sample. Rows with a null label or id are
    not used. Of rows that repeat an id, the largest label counts; rows that
    repeat a text count once. The sample is taken by a hash of the id. No labels
    or no documents: the fixed grammar. Extra columns are ignored.
    """
    sample = _sample(documents, labels, fit_rows, id_col, text_col, label_col)
    grammar = Grammar()
    if sample is None:
        return grammar
    sample = checkpoint(sample)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    listed = F.col("feature").isin(*["=" + w for c in (INSULT, THREAT) for w in WORDS[c]])
    telling = (F.col("toxic") >= LEAST_TEXTS) & (share >= LEAST_SHARE)
    counted = _counted(sample, lambda: _features).where(telling | listed & (F.col("toxic") + F.col("clean") >= LEAST_TEXTS)).select("*", telling.alias("telling"), listed.alias("listed"))
    best = counted.orderBy(F.desc(F.col("toxic") - 5 * F.col("clean")), "feature").collect()
    for r in best:
        if r.listed:
            # As many texts of either label: the word says what its pattern does.
            grammar.listed[r.feature[1:]] = round(min(2.5, max(-2.0, math.log((r.toxic + 0.5) / (r.clean + 0.5)) / 2)), 3)
    best = [r for r in best if r.telling]
    arcs = [r.feature for r in best]
    held = sample.where("toxic = 1").mapInArrow(_held(set(arcs)), "features array<string>").collect()
    kept = cover(arcs, [set(r.features) for r in held])
    for r in best:
        if r.feature not in kept:
            continue
        weight = min(2.5, max(1.0, math.log((r.toxic + 0.5) / (r.clean + 0.5)) / 2))
        into, name = (grammar.words, r.feature[1:]) if r.feature[0] == "=" else (grammar.prefixes, r.feature)
        into[name] = round(weight, 3)

    # Words before hits, and patterns, in the texts that the lexicon now has hits in.
    def before() -> Callable[[str], set[str]]:
        scorer = Scorer(grammar)
        return lambda text: _before_hits(scorer, text)

    clean = _counted(sample, before).where((F.col("clean") >= LEAST_TEXTS) & (1 - share >= LEAST_SHARE)).collect()
    for feature in sorted((r.feature for r in clean), reverse=True):
        # "<" sorts before "-" here: a word that also stands near counts as negating.
        grammar.others[feature[1:]] = REPORT if feature[0] == "<" else NEGATION

    def alone() -> Callable[[str], set[str]]:
        scorer = Scorer(grammar)
        return lambda text: _only_pattern(scorer, text)

    for r in _counted(sample, alone).where(F.col("toxic") + F.col("clean") >= LEAST_ALONE).collect():
        odds = math.log((r.toxic + 0.5) / (r.clean + 0.5))
        grammar.weights[int(r.feature[1:])] = round(min(2.5, max(0.0, 0.6 + odds / 2)), 3)
    return grammar


def _scores(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(grammar)
        for b in batches:
            found = [scorer(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int32())], ["id", "score", "clauses"])

    return run


def score_toxicity(df: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), clauses.

    Null and empty texts score 0. Ties and repeated rows: each row by itself.
    Empty table: no rows. Other columns are ignored.
    """
    docs = documents_of(df, id_col, text_col)
    kind = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("clauses", T.IntegerType())])
    return docs.mapInArrow(_scores(grammar), kind).withColumnRenamed("id", id_col)


def reject_toxic(df: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, whose text scores below the threshold.

    Null and empty texts score 0 and stay, as do all columns whatever their
    names. Repeated rows: each by itself. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(grammar)
        for b in batches:
            yield b.filter(pa.array([scorer(t or "")[0] < threshold for t in b.column(text_col).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    found = score_toxicity(documents, fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "clauses")


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}

"""Benchmark decontamination with a generalised suffix automaton of the items.

1. Items are normalised to words and dealt into shards of about SHARD_WORDS
   words. A long item is cut into pieces that overlap by one word less than its
   window, so every window lies whole in some piece.
2. A task builds the automaton of each shard: states stand for classes of word
   sequences that occur in items. A state is marked with the window lengths, and
   the items, whose windows it holds.
3. Texts are streamed through it word by word. Kept is the longest suffix of what
   was read that occurs in an item; a state or a suffix of it that is marked with
   a length of at most that one ends a hit. Runs of words that items have, shorter
   than the least window, cannot hold one and are passed over.
4. Hits merge into spans. With more shards than one a pass is made for each, and
   the spans and items of a text are put together.

One automaton at a time goes to the executors; its size is bounded by SHARD_WORDS
and not by the benchmark. A text is read in pieces of CHUNK bytes, and the state
is carried over.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, documents_of, row_hash, sized_broadcast, small_batches, table

WINDOW = 10
#: Words of items that one automaton holds, about, and of a piece of an item.
SHARD_WORDS, PIECE_WORDS = 200_000, 20_000
#: Bytes of a text that are cut into words at a time.
CHUNK = 1 << 20

#: What is no part of a word: ASCII but digits and letters; A-Z are lower-cased first.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD.encode())
_GAP_AFTER = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


class Automaton:
    """Suffix automaton of several word sequences, with marked windows."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: State -> [(window length, owners)], and the nearest marked state on the
        #: way from a state to the root, itself included (0: none).
        self.marks: dict[int, list[tuple[int, tuple]]] = {}
        self.up: list[int] = []
        self.least = 0

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for the sequences that end at p and the word, if q holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            if (q := self.next[last].get(word)) is not None:
                last = self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def _windows(self, words: list[int], k: int) -> Iterator[int]:
        """The states of the windows of a sequence that was added."""
        state = held = 0
        for word in words:
            state, held = self.next[state][word], held + 1
            while self.length[self.link[state]] >= k:
                state = self.link[state]
            if held >= k:
                yield state

    @classmethod
    def of(cls, pieces: list[tuple[object, int, list[bytes]]]) -> Automaton:
        """Of (item, window length, words) pieces."""
        own = cls()
        coded = [(item, k, [own.vocabulary.setdefault(w, len(own.vocabulary)) for w in words]) for item, k, words in pieces]
        for _, _, words in coded:
            own.add(words)
        marks: dict[int, dict[int, set]] = {}
        for item, k, words in coded:
            for state in own._windows(words, k):
                marks.setdefault(state, {}).setdefault(k, set()).add(item)
        own.marks = {s: [(k, tuple(owners)) for k, owners in m.items()] for s, m in marks.items()}
        own.up = [0] * len(own.link)
        for state in sorted(range(1, len(own.link)), key=own.length.__getitem__):
            own.up[state] = state if state in own.marks else own.up[own.link[state]]
        own.least = min((k for _, k, _ in pieces), default=0)
        return own

    def match(self, data: bytes) -> tuple[int, int, list[tuple[int, int]], set]:
        """Words of a text, its longest match in words (0 if it is shorter than
        the least window), disjoint hit spans in order and the items they hit."""
        get, follow, link, length, up, marks = self.vocabulary.get, self.next, self.link, self.length, self.up, self.marks
        spans: list[tuple[int, int]] = []
        found: set[tuple[int, int]] = set()
        at = n = longest = state = held = 0
        while at < len(data):
            end = len(data)
            if end - at > CHUNK and (gap := _GAP_AFTER(data, at + CHUNK)):
                end = gap.start()
            words = _WORD.findall(data[at:end].translate(_LOWER))
            at = end
            ids = np.fromiter(map(get, words, itertools.repeat(-1)), np.int64, len(words))
            edge = np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]]))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = (ends - starts >= self.least) | (starts == 0) | (ends == len(words))
            carried = held
            for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                if s or not carried:
                    state = held = 0
                for j, word in enumerate(ids[s:e].tolist(), n + s + 1):
                    to = follow[state].get(word)
                    if to is None:
                        while to is None:
                            state = link[state]
                            to = follow[state].get(word)
                        held = length[state]
                    state, held = to, held + 1
                    if held > longest:
                        longest = held
                    best, u = 0, up[state]
                    while u:
                        for k, _ in marks[u]:
                            if k <= held:
                                found.add((u, k))
                                best = max(best, k)
                        u = up[link[u]]
                    if best:
                        first = j - best
                        while spans and spans[-1][1] >= first:
                            first = min(first, spans.pop()[0])
                        spans.append((first, j))
            if len(words) and ids[-1] < 0:
                held = 0
            n += len(words)
        items = {item for u, k in found for size, owners in marks[u] if size == k for item in owners}
        return n, longest if longest >= self.least else 0, spans, items


def pieces_of(words: list[bytes], window: int, coverage: float, size: int = PIECE_WORDS) -> tuple[int, list[list[bytes]]]:
    """The window length of an item, and pieces of it that hold every window."""
    k = min(window, max(1, int(np.ceil(coverage * len(words)))))
    step = max(size, k) - k + 1
    return k, [words[i : i + step + k - 1] for i in range(0, max(len(words) - k + 1, 1), step)]


def _cut(window: int, coverage: float, shards: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = _WORD.findall(text.encode().translate(_LOWER))
                if words:
                    k, parts = pieces_of(words, window, coverage)
                    out += [((hash_of(words[0]) + i) % shards, item, k, b" ".join(p)) for i, p in enumerate(parts)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), id_type, pa.int32(), pa.binary()), strict=True)], ["shard", "item", "k", "words"])

    return run


def hash_of(word: bytes) -> int:
    """Spreads items over shards; the same everywhere."""
    return int.from_bytes(word[-8:].rjust(8, b"\0"), "big") * 0x9E3779B97F4A7C15 >> 17


def _built(rows: pa.Table) -> pa.Table:
    pieces = [(item, k, words.split(b" ")) for item, k, words in zip(rows["item"].to_pylist(), rows["k"].to_pylist(), rows["words"].to_pylist(), strict=True)]
    return pa.table({"shard": rows["shard"].slice(0, 1), "automaton": pa.array([pickle.dumps(Automaton.of(pieces), protocol=5)], pa.binary())})


def _matched(automaton, least: int, id_type: pa.DataType, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Automaton = pickle.loads(automaton.value) if automaton is not None else Automaton.of([])
        own.least = least  # that of all shards, so that they agree on the longest match
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            rows = [own.match(x.as_buffer().to_pybytes()) for x in b.column("text")]
            columns = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in r[2]] for r in rows], pa.list_(span)),
                pa.array([[i for i in r[3] if i is not None] for r in rows], pa.list_(item_type)),
            ]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), *columns], ["id", "row", "n_words", "longest", "spans", "items"])

    return run


def _union(spans: Column) -> Column:
    """Sorted spans as disjoint ones; spans that touch become one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.named_struct(F.lit("start"), last["start"], F.lit("end"), F.greatest(last["end"], s["end"]))
        return F.when(last["end"] >= s["start"], F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, step)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = 1.0, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per text: id, row, n_words, n_hit, longest, spans, items.

    A window of an item is ``window`` of its words in a row, or fewer where they
    already are the share ``coverage`` of all its words: 1.0 makes an item of
    fewer words one window. ``spans`` are disjoint (start, end) word numbers of
    the text, from 0, end exclusive, that windows cover; ``n_hit`` their words.
    ``items`` are the ids of the items whose windows occur, in ascending order;
    ``longest`` is the longest word sequence that the text shares with an item (of
    several shards: with a piece of one), 0 below the least window. ``row`` is a
    hash of the text.

    Null texts and items have no words; items without words are in no text. An
    item without an id makes hits, but is not listed. Rows that repeat an item's
    id are one item of several texts. Repeated documents are a row each. Without
    items nothing is hit; an empty table gives no rows. Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    own = documents_of(docs, id_col, text_col, row_hash(text_col).alias("row")).select("id", "row", "text")
    known = documents_of(items, item_col, item_text_col)
    id_type, item_type = own.schema["id"].dataType, known.schema["id"].dataType
    total = known.agg(F.sum(F.regexp_count(normalised(F.col("text")), F.lit(WORD)).cast("long"))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    cut_type = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("item", item_type), T.StructField("k", T.IntegerType()), T.StructField("words", T.BinaryType())])
    cut = checkpoint(known.mapInArrow(_cut(window, coverage, shards, to_arrow_type(item_type)), cut_type))
    least = cut.agg(F.min("k")).first()[0] or 0
    built = checkpoint(cut.groupBy("shard").applyInArrow(_built, "shard int, automaton binary"))
    kind = T.StructType(
        [T.StructField("id", id_type), T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("longest", T.LongType())]
        + [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(item_type))]
    )
    # One automaton at a time comes to the driver, on its way to the executors.
    passes = [own.mapInArrow(_matched(spark.sparkContext.broadcast(bytes(r.automaton)), least, to_arrow_type(id_type), to_arrow_type(item_type)), kind) for r in built.toLocalIterator()]
    if not passes:
        passes = [own.mapInArrow(_matched(None, least, to_arrow_type(id_type), to_arrow_type(item_type)), kind)]
    found = passes[0]
    if len(passes) > 1:
        every = reduce(DataFrame.unionByName, [p.withColumn("shard", F.lit(k)) for k, p in enumerate(passes)])
        # Rows that repeat id and text have one result; they are counted, not gathered.
        each = every.groupBy("id", "row").agg(F.max("n_words").alias("n_words"), F.max("longest").alias("longest"), F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"), F.count_if(F.col("shard") == 0).cast("int").alias("copies"))
        found = each.select("id", "row", "n_words", "longest", _union(F.flatten("spans")).alias("spans"), F.array_distinct(F.flatten("items")).alias("items"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias(id_col), "row", "n_words", n_hit.alias("n_hit"), "longest", "spans", F.array_sort("items").alias("items"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
            data, parts, at = text.as_buffer().to_pybytes(), [], 0
            if spans:
                todo = iter(spans)
                span = next(todo)
                for n, m in enumerate(_WORD.finditer(data.translate(_LOWER))):
                    if n == span["start"]:
                        parts.append(data[at : m.start()])
                    if n == span["end"] - 1:
                        at = m.end()
                        span = next(todo, None)
                        if span is None:
                            break
            out.append(b"".join([*parts, data[at:]]).decode())
        at = b.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else b.column(k) for k in range(b.num_columns)], b.schema.names)


def remove_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_span: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """(id, row, text, n_removed) of every text, hit spans cut out.

    ``leaks`` is what ``find_leaks`` gives. A span goes if it has ``max_span``
    words or more; where the spans of a text cover more than ``max_coverage`` of
    its words, all of them go, however short. From the first to the last word of a
    span everything goes; what stands around it stays as it is. Only texts that
    lose something leave the scan. Null texts become empty; repeated rows lose
    the same spans.
    """
    lost = leaks.select(F.col(id_col).alias("leak_id"), F.col("row").alias("leak_row"), F.when(F.col("n_hit") > max_coverage * F.col("n_words"), F.col("spans")).otherwise(F.filter("spans", lambda s: s["end"] - s["start"] >= max_span)).alias("spans"))
    lost = sized_broadcast(checkpoint(lost.where(F.size("spans") > 0).dropDuplicates(["leak_id", "leak_row"])))
    own = documents_of(docs, id_col, text_col, row_hash(text_col).alias("row"))
    at = own["id"].eqNullSafe(lost["leak_id"]) & (own["row"] == lost["leak_row"])
    hit = own.join(lost, at).select("id", "row", "text", "spans")
    cut = hit.mapInArrow(_without, hit.schema)
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    clean = own.join(lost, at, "left_anti").select("id", "row", "text", F.lit(0).cast("long").alias("n_removed"))
    return clean.unionByName(cut.select("id", "row", "text", words.alias("n_removed"))).select(F.col("id").alias(id_col), "row", F.col("text").alias(text_col), "n_removed")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return leaks.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")


QUERIES = {"op12_decontaminate": op12_decontaminate}
_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}')"
ORACLES = {
    "op12_decontaminate": rf"""
        WITH items AS MATERIALIZED (SELECT item_id, w, least({WINDOW}, len(w)) AS k FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
        docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_WORDS_SQL} AS w FROM documents),
        windows AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
        grams AS MATERIALIZED (SELECT row, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items))),
        hits AS MATERIALIZED (SELECT g.row, g.i, g.k, v.item_id FROM grams g JOIN windows v ON v.k = g.k AND v.gram = g.gram),
        words AS (SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT row, i, k FROM hits)) GROUP BY row),
        owners AS (SELECT row, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT row, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY row),
        runs AS MATERIALIZED (SELECT d.row, d.i, p.item_id, p.j, d.gram FROM grams d JOIN (SELECT item_id, i AS j, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)) p ON p.k = d.k AND p.gram = d.gram),
        chains AS (SELECT row, count(*) AS n, any_value(k) AS k FROM (SELECT r.row, r.item_id, r.j - r.i AS shift, i.k, r.i - row_number() OVER (PARTITION BY r.row, r.item_id, r.j - r.i ORDER BY r.i) AS island FROM runs r JOIN items i ON i.item_id = r.item_id) GROUP BY row, item_id, shift, island)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated, coalesce((SELECT max(n + k - 1) FROM chains c WHERE c.row = d.row), 0)::BIGINT AS longest
        FROM docs d LEFT JOIN words USING (row) LEFT JOIN owners USING (row)""",
}

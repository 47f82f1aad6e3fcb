"""SentencePiece encoding and decoding with N-best segmentation.

The model file is read here (its vocabulary and scores); nothing is trained.

A text is cut where no piece of the vocabulary crosses, so that its piece
lattice is a chain of independent small lattices. In each, a forward Viterbi
pass gives the best score of every prefix; a backward A* search from the end
uses those scores as its exact heuristic and pops the N best segmentations in
order. Chains are merged by their N smallest losses; a segmentation but the best
differs from it in a few units, whose ids are put in place. Small lattices repeat,
so their results are kept in a bounded cache.

A character without a piece falls back to its byte pieces. A literal U+2581 is
written in bytes as well, so decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents_of, small_batches, table

#: Where the registered query and the pipeline find a model file, unless the
#: session names one in MODEL_SETTING.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_SETTING = "spark.corpusforge.pieces.model"
SPACE = "▁"
N_BEST = 3
#: Score of a byte-fallback character, below every piece: the least score minus this.
FALLBACK_LOSS = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Units that a worker holds at most, of some 250 bytes each; results do not depend on it.
HELD = 1_200_000
#: ... and of how many of them all segmentations.
OTHERS_HELD = 20_000
#: Blanks become the piece alphabet's space; the literal sign of it gets no piece.
_TO_PIECES = {ord(" "): SPACE, ord(SPACE): "\uffff"}


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: (number, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[wire]
            yield number, data[at : at + n]
            at += n


class PieceModel:
    """Vocabulary of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        normal: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 3:
                normal = dict(_fields(value))
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        # The normaliser's settings: a character map, a leading blank, blanks squeezed.
        if normal.get(2) or normal.get(4, 1):
            raise ValueError("the model changes texts, so they cannot be decoded exactly")
        self.lead = " " if normal.get(3, 1) else ""
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.scores = [s for _, s, _ in self.pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        real = [s for s in self.scores if s > -1e8]
        self.fallback = min(real) - FALLBACK_LOSS
        self.longest = max(map(len, self.ids))
        self.trie = self._trie()
        self.surface = [p.replace(SPACE, " ").encode() if kind in (NORMAL, USER) else bytes([int(p[3:5], 16)]) if kind == BYTE else b"" for p, _, kind in self.pieces]
        self.atom = re.compile(self._atoms())

    def _trie(self) -> dict:
        """character -> (trie below, score, id); id -1 where no piece ends."""
        tree: dict = {}
        for piece, k in self.ids.items():
            at = tree
            for c in piece:
                at = at.setdefault(c, {})
            at[None] = k
        leaf: dict = {}

        def frozen(node: dict) -> dict:
            return {c: (frozen(x) if len(x) > (None in x) else leaf, self.scores[x[None]] if None in x else 0.0, x.get(None, -1)) for c, x in node.items() if c is not None}

        return frozen(tree)

    def _atoms(self) -> str:
        """A pattern of the runs that pieces never leave.

        Runs of one class of characters are kept together; two classes share a
        run only if some piece holds a character of each, side by side.
        """
        # Number signs such as a raised 2 count as signs, not as letters.
        odd = "".join(sorted({re.escape(c) for p in self.ids for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
        classes = {"w": rf"[^\W\d_{odd}]", "d": r"\d", "s": r" ", "o": rf"[^\w ]|[_{odd}]"}
        tests = {k: re.compile(v) for k, v in classes.items()}
        kind = lambda c: next(k for k, t in tests.items() if t.match(" " if c == SPACE else c))
        crossing = {(kind(a), kind(b)) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        mixed = {x for pair in crossing if pair[0] != pair[1] for x in pair if pair[0] != "s"}
        alone = [c for c in "wo" if c not in mixed]
        lead = " *" if any(a == "s" for a, _ in crossing) else ""
        parts = [rf"{lead}(?:{classes[c]})+" if (c, c) in crossing else rf"{lead}(?:{classes[c]})" for c in alone]
        parts.append(rf"{lead}\d" if ("d", "d") not in crossing and "d" not in mixed else rf"{lead}\d+")
        if mixed:
            parts = [rf"{lead}[^ ]+"]
        return "|".join([*parts, " +", r"(?s:.)"])

    def lattice(self, unit: str) -> tuple[list[float], list[list[tuple[float, int, int]]]]:
        """Forward Viterbi: the best score of each prefix, and the arcs that end
        at each place as (loss against the best there, start, piece), best first.

        A fallback arc has piece -1.
        """
        text = unit.translate(_TO_PIECES)
        size, trie, lost, longest = len(text), self.trie, self.fallback, self.longest
        arcs: list[list] = [[] for _ in range(size + 1)]
        best = [0.0] * (size + 1)
        base = 0.0
        for i in range(size):
            if i:
                at = arcs[i]
                if len(at) > 1:
                    at.sort(reverse=True)
                best[i] = base = at[0][0]
            below, j = trie, i
            for c in text[i : i + longest]:
                found = below.get(c)
                if found is None:
                    break
                j += 1
                below, score, k = found
                if k >= 0:
                    arcs[j].append((base + score, i, k))
                elif j == i + 1:
                    arcs[j].append((base + lost, i, -1))
            if j == i:
                arcs[i + 1].append((base + lost, i, -1))
        at = arcs[size]
        if len(at) > 1:
            at.sort(reverse=True)
        best[size] = at[0][0]
        return best, arcs

    def encode_unit(self, unit: str, n: int, paths: bool = True) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a unit, best first.

        A* runs backwards from the end. With the exact heuristic the cost of a
        state is the best score minus what its arcs so far lose, so a popped
        state is completed along the best arcs at once, and only the arcs that
        leave that path are put on the agenda, if they can be among the N best.
        Only the first segmentation has its ids if ``paths`` is false.
        """
        best, arcs = self.lattice(unit)
        size = len(best) - 1
        out: list[tuple[float, list[int]]] = []
        agenda: list[tuple[float, int, int, tuple]] = [(0.0, 0, size, ())]
        bounds: list[float] = []  # negated losses of the best agenda entries ever made
        made = 0
        while agenda and len(out) < n:
            loss, _, at, tail = heapq.heappop(agenda)
            while at:
                here = arcs[at]
                if len(here) > 1:
                    top = here[0][0]
                    for score, start, piece in here[1:]:
                        more = loss + top - score
                        if len(bounds) >= n - 1:
                            if not bounds or more >= -bounds[0]:
                                break
                            heapq.heapreplace(bounds, -more)
                        else:
                            heapq.heappush(bounds, -more)
                        made += 1
                        heapq.heappush(agenda, (more, made, start, (piece, start, tail)))
                _, start, piece = here[0]
                tail = (piece, start, tail)
                at = start
            path: list[int] = []
            while (paths or not out) and tail:
                piece, start, tail = tail
                if piece >= 0:
                    path.append(piece)
                else:
                    path.extend(self.bytes[b] for b in unit[start].encode("utf-8", "surrogatepass"))
            out.append((best[size] - loss, path))
        return out


@lru_cache(maxsize=4)
def parse_model(data: bytes) -> PieceModel:
    return PieceModel(data)


def read_model(path: str) -> bytes:
    """The model file's bytes; tasks get these, not the path."""
    with open(path, "rb") as f:
        return f.read()


class Units(dict):
    """unit -> place in tables of the best ids, its score and the losses of the rest.

    The ids of the rest are held for a few units only: few of a text need them."""

    def __init__(self, model: PieceModel, n: int, held: int):
        self.model, self.n, self.held = model, n, held
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.others: dict[str, list] = {}
        self.count = 0
        # Score, end of the ids and losses of each unit; ids of all.
        self.score, self.end, self.losses, self.ids = array("d"), array("q", [0]), array("d"), array("i")

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views of the scores, ends, losses (units x n - 1) and ids, to be let go
        before a unit is added."""
        losses = np.frombuffer(self.losses).reshape(-1, max(1, self.n - 1)) if self.count else np.empty((0, max(1, self.n - 1)))
        return np.frombuffer(self.score), np.frombuffer(self.end, dtype=np.int64), losses, np.frombuffer(self.ids, dtype="<i4")

    def rest(self, unit: str) -> list[tuple[float, list[int]]]:
        """All segmentations of a unit. Those that lose least are asked for again
        and again, so some are held."""
        found = self.others.get(unit)
        if found is None:
            found = self.model.encode_unit(unit, self.n)
            if len(self.others) < OTHERS_HELD and len(unit) <= 64:
                self.others[unit] = found
        return found

    def __missing__(self, unit: str) -> int:
        found = self.model.encode_unit(unit, self.n, paths=False)
        score, ids = found[0]
        at = self.count
        self.score.append(score)
        self.ids.extend(ids)
        self.end.append(len(self.ids))
        lost = [score - other for other, _ in found[1:]]
        self.losses.extend(lost + [inf] * (max(1, self.n - 1) - len(lost)))
        self.count = at + 1
        if len(unit) <= 64:
            self[unit] = at
        return at


def merge_losses(losses: np.ndarray, n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n least total losses of a chain, each unit taking one of its own, and
    the choices: (unit, which of its losses) of the units that are not at best.

    Row = unit, ascending. Only the n - 1 units with the least first losses can
    take part: there are n totals no worse than one that leaves another's best.
    """
    least: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    if n == 1 or not len(losses):
        return least
    units = np.arange(len(losses))
    if len(losses) > n - 1:
        units = np.sort(np.argpartition(losses[:, 0], n - 2)[: n - 1])
    for u, row in zip(units.tolist(), losses[units].tolist(), strict=True):
        own = [(x, k) for k, x in enumerate(row) if x != np.inf]
        least = heapq.nsmallest(n, least + [(a + x, (*how, (u, k))) for a, how in least for x, k in own])
    return least


@lru_cache(maxsize=4)
def units_of(data: bytes, n: int, held: int = HELD) -> Units:
    return Units(parse_model(data), n, held)


def encode(text: str, units: Units) -> tuple[list[bytes], list[float]]:
    """(ids as int32 and score of each of the n best segmentations), best first."""
    if not text:
        return [b""], [0.0]
    if units.count >= units.held:
        units.reset()
    atoms = units.model.atom.findall(units.model.lead + text)
    at = np.fromiter(map(units.__getitem__, atoms), np.int64, len(atoms))
    score, end, losses, held = units.tables()
    start = end[at]
    size = end[at + 1] - start
    ends = np.cumsum(size)
    ids = held[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes()
    best, losses = float(score[at].sum()), losses[at]
    del score, end, held
    out, scores = [], []
    for loss, choices in merge_losses(losses, units.n):
        parts, done = [], 0
        for u, k in choices:
            last = 4 * int(ends[u])
            other = units.rest(atoms[u])[k + 1][1]
            parts += [ids[done : last - 4 * int(size[u])], np.array(other, dtype="<i4").tobytes()]
            done = last
        out.append(b"".join([*parts, ids[done:]]) if parts else ids)
        scores.append(best - loss)
    return out, scores


def decode(ids: np.ndarray, model: PieceModel) -> str:
    surface = model.surface
    out = b"".join([surface[i] for i in ids.tolist()])
    return (out[1:] if model.lead and out[:1] == b" " else out).decode("utf-8", "replace")


def _encode(data: bytes, n_best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(data, n_best)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                found = [encode(t, units) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([i[0] for i, _ in found], pa.binary()), pa.array([s for _, s in found], pa.list_(pa.float64())), pa.array([i[1:] for i, _ in found], pa.list_(pa.binary()))], ["id", "text", "ids", "scores", "others"])

    return run


def encode_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, n_best: int = N_BEST) -> DataFrame:
    """One row per input row: id, text, ids (int32 little endian), scores, others.

    ``ids`` are of the best segmentation, ``others`` of the next best, in order.
    ``scores`` holds the scores of all of them, at most ``n_best``. Null text: the empty text, without ids, score 0. Ties
    between segmentations go by the order of the search, which is fixed.
    Repeated rows: each by itself. Empty table: no rows. Other columns are
    ignored.
    """
    docs = documents_of(df, id_col, text_col)
    fields = [("id", docs.schema["id"].dataType), ("text", T.StringType()), ("ids", T.BinaryType()), ("scores", T.ArrayType(T.DoubleType())), ("others", T.ArrayType(T.BinaryType()))]
    return docs.mapInArrow(_encode(read_model(model), n_best), T.StructType([T.StructField(*f) for f in fields])).withColumnRenamed("id", id_col)


def _decode(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parse_model(data)
        for b in batches:
            texts = [decode(np.frombuffer(x or b"", dtype="<i4"), model) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode_pieces(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """One row per input row: id, text.

    Null and empty ids: the empty text. Ids of control pieces stand for nothing.
    Repeated rows: each by itself. Empty table: no rows. Other columns are
    ignored.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("text", T.StringType())])
    return own.mapInArrow(_decode(read_model(model)), kind).withColumnRenamed("id", id_col)


def _round_trip(data: bytes, n_best: int, held: int):
    """Encodes and decodes in one pass: a text crosses to Python once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(data, n_best, held)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                rows: list[list] = [[] for _ in range(9)]
                for text in part.column(1).to_pylist():
                    every, scores = encode(text, units)
                    ids = every[0]
                    back = decode(np.frombuffer(ids, dtype="<i4"), units.model)
                    found = (len(text), len(ids) // 4, hashlib.sha256(ids).hexdigest(), scores[0], scores, [hashlib.sha256(x).hexdigest() for x in every[1:]], hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == text, ids)
                    for into, x in zip(rows, found, strict=True):
                        into.append(x)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, t in zip(rows, kinds, strict=True)]], ["id", "n_chars", "n_tokens", "ids_sha256", "best_score", "scores", "others_sha256", "decoded_sha256", "exact", "ids"])

    return run


def piece_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, n_best: int = N_BEST, held: int = HELD) -> DataFrame:
    """Encode, decode and digest every row.

    ``exact`` tells that decoding gave back the text; ``ids`` are as encoded;
    ``others_sha256`` are the digests of the ids of the next best segmentations.
    ``held`` bounds the units that a worker holds.
    Edge cases are those of ``encode_pieces``.
    """
    docs = documents_of(df, id_col, text_col)
    fields = [("id", docs.schema["id"].dataType), ("n_chars", T.LongType()), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("best_score", T.DoubleType()), ("scores", T.ArrayType(T.DoubleType())), ("others_sha256", T.ArrayType(T.StringType())), ("decoded_sha256", T.StringType()), ("exact", T.BooleanType()), ("ids", T.BinaryType())]
    return docs.mapInArrow(_round_trip(read_model(model), n_best, held), T.StructType([T.StructField(*f) for f in fields])).withColumnRenamed("id", id_col)


def model_path(spark: SparkSession) -> str:
    return spark.conf.get(MODEL_SETTING, MODEL)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return piece_digests(table(spark, sf_dir, "documents"), model=model_path(spark)).drop("ids")


QUERIES = {"op3_pieces": op3_pieces}
ORACLES: dict[str, str] = {}

"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as word lists; two lines are near copies if one word edit
(insert, delete, replace) or none turns one into the other. Of lines that are
copies or near copies, the earliest stays, by (document id, row, line number);
a row is told from others of its id by a hash of its text.

A line within one edit of another shares a deletion variant with it: the same
word list without word i in both (replace), or one list is the other without a
word (insert, delete). Variants are joined as hashed keys. In a bucket of equal
keys every line is within the bound of the bucket's earliest line, so one link
to that line per bucket decides, and no bucket is expanded into pairs. Each
link is verified on the words themselves.

Emitting a variant for every word of a corpus would be wasteful: an edit leaves
one half of a line as it was, so only lines that share a hashed half with
another line (of the same place and length) emit variants, and only for the words
of their other half. No line within the bound is lost by that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, documents_of, join_heavy, mix64, prefix_sums, row_hash, sized_broadcast, small_batches, span_hashes, table, word_spans

#: Lines of fewer words are never dropped: only lines without words, so that
#: layout stays.
EXACT_WORDS = 1
#: Near copies may differ by one edit in so many words: shorter lines, of which
#: one word is a larger part, are near copies of none.
NEAR_WORDS = 10


def fold(line: str) -> str:
    """What is compared: lower case, single blanks."""
    return " ".join(line.lower().split())


def _word_hashes(line: bytes) -> np.ndarray:
    raw, start, end = word_spans(line)
    return span_hashes(prefix_sums(raw.astype(np.uint64) + np.uint64(1)), start, end)


def half_keys(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): hashes of the beginnings (odd) and endings (even) that one
    edit may leave alone, for lines of ``size`` words from ``first`` on."""
    p = prefix_sums(words)
    lines, keys = [], []
    for half in (size // 2, (size - 1) // 2):
        lines += [np.arange(len(size))] * 2
        keys += [span_hashes(p, first, first + half) | np.uint64(1), span_hashes(p, first + size - half, first + size) & ~np.uint64(1)]
    return np.concatenate(lines), np.concatenate(keys)


def variants(words: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Hashes of the list without word i, for each i, and of the whole list."""
    n = len(words)
    p = prefix_sums(words)
    # Values behind the gap move one place down.
    shifted = prefix_sums(np.concatenate([words[1:], np.zeros(1, dtype=np.uint64)]))
    i = np.arange(n)
    out = p[i] + (shifted[n - 1] - shifted[i])
    return mix64(out + np.uint64(n - 1)), mix64(p[n : n + 1] + np.uint64(n))[0]


def within_one_edit(a: list[str], b: list[str]) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _digest(folded: bytes) -> bytes:
    return hashlib.blake2b(folded, digest_size=16).digest()


def _lines(exact: int, near: int):
    """Lines of documents with their digests and half keys, many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                rows, numbers, digests, data, sizes = [], [], [], [], []
                for r, text in enumerate(part.column(2).to_pylist()):
                    for number, line in enumerate(text.lower().split("\n")):
                        words = line.split()
                        if len(words) < exact:
                            continue
                        folded = " ".join(words).encode("utf-8", "surrogatepass")
                        rows.append(r)
                        numbers.append(number)
                        digests.append(_digest(folded))
                        sizes.append(len(words))
                        data.append(folded)
                size = np.array(sizes, dtype=np.int64)
                own = np.flatnonzero(size >= near)
                words = _word_hashes(b"\n".join(data))
                line, key = half_keys(words, (np.cumsum(size) - size)[own], size[own])
                order = np.argsort(line, kind="stable")
                count = np.zeros(len(size), dtype=np.int32)
                count[own] = 4
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(key[order].astype(np.int64)))
                of = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary()), keys], ["id", "row", "number", "line", "keys"])

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wanted lines of a document: folded text and variant keys."""
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            rows, numbers, digests, texts, wholes, keys, spots = [], [], [], [], [], [], []
            for r, (text, wanted) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                lines = text.split("\n")
                for number, sides in sorted((k >> 2, k & 3) for k in set(wanted) if k >> 2 < len(lines)):
                    data = fold(lines[number]).encode("utf-8", "surrogatepass")
                    words = _word_hashes(data)
                    if not len(words):
                        continue
                    own, whole = variants(words)
                    middle = (len(words) - 1) // 2
                    places = np.arange(middle if sides == 1 else 0, len(words) - middle if sides == 2 else len(words))
                    rows.append(r)
                    numbers.append(number)
                    digests.append(_digest(data))
                    texts.append(data.decode("utf-8", "replace"))
                    wholes.append(int(whole.astype(np.int64)))
                    keys.append(own[places].astype(np.int64))
                    spots.append(places.astype(np.int32))
            of = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary()), pa.array(texts, pa.string()), pa.array(wholes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(spots, pa.list_(pa.int32()))], ["id", "row", "number", "line", "folded", "whole", "keys", "spots"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [within_one_edit(x.split(" "), y.split(" ")) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("line")], ["line"]).filter(pa.array(ok, pa.bool_()))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            kept, counts, gone = [], [], []
            for text, drops in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                lines = text.split("\n")
                out = set(drops or ())
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in out]) if out else text)
                counts.append(len(lines))
                gone.append(len(out))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), part.column(3)], ["id", "text", "n_lines", "n_dropped", "carried"])


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_words: int = EXACT_WORDS, near_words: int = NEAR_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, text without dropped lines, n_lines, n_dropped.

    Columns named in ``carry`` come along in a struct ``carried``.

    A line is dropped if an earlier line (whether itself dropped or not) is its
    copy, or within one word edit of it if both have ``near_words`` words.
    Lines are compared in lower case with single blanks. Lines of fewer than
    ``exact_words`` words, by default those of blanks only, stay.

    Null text: the empty text, one line, kept. Rows that repeat an id but not
    the text are documents of their own, the one with the lesser text hash
    first. Rows that repeat id and text count as one document: what is dropped
    of it goes in each of them. Null ids come first. Empty table: no rows.
    Other columns are ignored.
    """
    carried = F.struct(*[F.col(c) for c in carry] or [F.lit(True).alias("none")])
    docs = documents_of(df.withColumn("__carried", carried), id_col, text_col, row_hash(text_col).alias("row"), F.col("__carried").alias("carried"))
    key = [T.StructField("id", docs.schema["id"].dataType), T.StructField("row", T.LongType()), T.StructField("number", T.IntegerType()), T.StructField("line", T.BinaryType())]
    at = F.struct("id", "row", "number").alias("at")
    lines = checkpoint(docs.select("id", "row", "text").mapInArrow(_lines(exact_words, near_words), T.StructType([*key, T.StructField("keys", T.ArrayType(T.LongType()))])))
    first = checkpoint(lines.groupBy("line").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n"), F.any_value("keys").alias("keys")))

    def of_document(other: DataFrame, name: str) -> Column:
        return docs["id"].eqNullSafe(other[f"{name}.id"]) & (docs["row"] == other[f"{name}.row"])

    # Lines that share a half with another distinct line.
    keyed = first.where("size(keys) > 0").select("line", F.explode(F.array_distinct("keys")).alias("key"))
    shared = checkpoint(keyed.groupBy("key").count().where("count > 1").select("key"))
    side = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, 1).otherwise(2)
    near = checkpoint(keyed.join(sized_broadcast(shared), "key", "left_semi").groupBy("line").agg(F.bit_or(side).alias("sides")))
    asked = first.select("line", "at").join(sized_broadcast(near), "line").select(F.struct("at.id", "at.row").alias("want"), (F.col("at.number").cast("long") * 4 + F.col("sides")).alias("k"))
    wanted = checkpoint(asked.groupBy("want").agg(F.collect_list("k").alias("numbers")))
    kind = T.StructType([*key, T.StructField("folded", T.StringType()), T.StructField("whole", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("spots", T.ArrayType(T.IntegerType()))])
    small = sized_broadcast(wanted)
    asked = docs.join(small, of_document(small, "want")).select("id", "row", "text", "numbers")
    found = asked.mapInArrow(_variants, kind).groupBy("line").agg(F.min(at).alias("at"), *[F.any_value(c).alias(c) for c in ("folded", "whole", "keys", "spots")])
    found = checkpoint(found)

    # Replace: the same list without the word at the same place.
    # A bucket's earliest line is found by partial aggregates; buckets of one
    # line, nearly all, are gone before anything is joined.
    each = found.select("line", "at", F.explode(F.arrays_zip("keys", "spots")).alias("v")).select("line", "at", F.col("v.keys").alias("key"), F.col("v.spots").alias("place"))
    placed = each.select("line", "at", F.xxhash64("key", "place").alias("key"))
    earliest = checkpoint(placed.groupBy("key").agg(F.min(F.struct("at", "line")).alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    replaced = join_heavy(placed, earliest, "key", "n").where("to.at < at").select("line", "to")
    # Insert and delete: a whole list against lists without a word.
    whole = found.select(F.col("whole").alias("key"), F.struct("at", "line").alias("own"))
    cut = checkpoint(each.join(sized_broadcast(checkpoint(whole.select("key").distinct())), "key", "left_semi").select("key", F.struct("at", "line").alias("longer")))
    longer = cut.groupBy("key").agg(F.min("longer").alias("longer"))
    shorter = whole.groupBy("key").agg(F.min("own").alias("own"))
    one_less = cut.join(shorter, "key").where("own.at < longer.at").select(F.col("longer.line").alias("line"), F.col("own").alias("to"))
    one_more = whole.join(longer, "key").where("longer.at < own.at").select(F.col("own.line").alias("line"), F.col("longer").alias("to"))
    links = replaced.union(one_less).union(one_more).groupBy("line").agg(F.min("to").alias("to")).select("line", F.col("to.line").alias("other"))
    texts = found.select("line", "folded")
    pairs = links.join(texts.withColumnRenamed("folded", "x"), "line").join(texts.select(F.col("line").alias("other"), F.col("folded").alias("y")), "other")
    dropped = pairs.select("line", "x", "y").mapInArrow(_verified, "line binary")

    # Later copies of a line, and near copies wherever they first stand. A line
    # of very many copies is met by a broadcast of the heavy lines.
    again = checkpoint(first.where("n > 1").select("line", "at", "n"))
    later = join_heavy(lines.select("id", "row", "number", "line"), again, "line", "n")
    later = later.where(~F.struct("id", "row", "number").eqNullSafe(F.col("at"))).select("id", "row", "number")
    gone = later.union(first.join(dropped, "line", "left_semi").select("at.id", "at.row", "at.number"))
    drops = checkpoint(gone.groupBy(F.struct("id", "row").alias("of")).agg(F.collect_set("number").alias("numbers")))
    # Most documents have drops, so their texts are shuffled once here at any size.
    out = docs.join(drops, of_document(drops, "of"), "left").select("id", "text", "numbers", "carried")
    kind = T.StructType([key[0], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("carried", docs.schema["carried"].dataType)])
    return out.mapInArrow(_rebuild, kind).withColumnRenamed("id", id_col)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES: dict[str, str] = {}

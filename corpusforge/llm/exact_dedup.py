"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Every partition hashes its texts, cuts the digests to short fingerprints and
   sends each owner of a fingerprint range one sorted, Golomb-Rice coded list.
2. An owner decodes the lists of its range and answers each partition with a
   bitmap: which of its fingerprints some other partition sent as well.
3. Rows whose fingerprint repeats are suspects. Only their texts are grouped,
   byte by byte; all other rows are unique without any text leaving its task.

Rows, digests and bitmaps go through shuffles; nothing is gathered on the
driver but counts. A group of copies of any size meets as partial aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, documents_of, join_heavy, sized_broadcast, small_batches, table

FINGERPRINT_BITS = 48


def golomb_encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of ascending distinct non-negative integers.

    One byte of parameter, the unary quotients, then the remainders.
    """
    if not len(values):
        return b"\0"
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    k = max(0, int(gaps.mean()).bit_length() - 1)
    quotients = gaps >> k
    unary = np.zeros(int(quotients.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    bits = (((gaps & ((1 << k) - 1))[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return bytes([k]) + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def golomb_decode(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.int64)
    k = blob[0]
    bits = np.unpackbits(np.frombuffer(blob, dtype=np.uint8, offset=1))
    stops = np.flatnonzero(bits)[:n]
    quotients = np.diff(stops, prepend=-1) - 1
    at = (int(stops[-1]) // 8 + 1) * 8
    rest = bits[at : at + n * k].reshape(n, k).astype(np.int64)
    gaps = (quotients.astype(np.int64) << k) + (rest << np.arange(k)).sum(axis=1)
    return np.cumsum(gaps + 1) - 1


def _fingerprints(digests: list[bytes]) -> np.ndarray:
    head = np.frombuffer(b"".join(x[:8] for x in digests), dtype=">u8")
    return (head.astype(np.uint64) >> np.uint64(64 - FINGERPRINT_BITS)).astype(np.int64)


def _owner_bounds(owners: int) -> np.ndarray:
    return (np.arange(owners + 1, dtype=object) * (1 << FINGERPRINT_BITS) // owners).astype(np.int64)


def _send(id_type: pa.DataType, owners: int):
    """Rows of a partition, then its coded fingerprint list for each owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: list[np.ndarray] = []
        names = ["id", "sha", "part", "owner", "n", "blob"]
        for b in batches:
            digests = [hashlib.sha256((x.as_buffer().to_pybytes() if x.is_valid else b"").lower()).digest() for x in b.column(1)]
            if not digests:
                continue
            seen.append(np.unique(_fingerprints(digests)))
            none = pa.nulls(len(digests), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(np.full(len(digests), part, np.int32)), none, none, pa.nulls(len(digests), pa.binary())], names)
        if seen:
            own, bounds = np.unique(np.concatenate(seen)), _owner_bounds(owners)
            cut = np.searchsorted(own, bounds)
            to = np.flatnonzero(np.diff(cut))
            blobs = [golomb_encode(own[cut[o] : cut[o + 1]] - bounds[o]) for o in to]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(to), id_type), pa.nulls(len(to), pa.binary()), pa.array(np.full(len(to), part, np.int32)), pa.array(to.astype(np.int32)), pa.array(np.diff(cut)[to].astype(np.int32)), pa.array(blobs, pa.binary())], names)

    return run


def _answer(group: pa.Table) -> pa.Table:
    """An owner's bitmaps: fingerprints that two or more partitions sent."""
    lists = [golomb_decode(b, n) for b, n in zip(group["blob"].to_pylist(), group["n"].to_pylist(), strict=True)]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    repeated = values[counts > 1]
    maps = [np.packbits(np.isin(x, repeated, assume_unique=True)).tobytes() for x in lists]
    return pa.table({"part": group["part"], "owner": group["owner"], "n": group["n"], "bitmap": pa.array(maps, pa.binary())})


def _mark(rows: pa.Table, maps: pa.Table) -> pa.Table:
    """Rows of a partition with the verdict of its bitmaps."""
    digests = rows["sha"].to_pylist()
    suspect = np.zeros(0, dtype=bool)
    if digests:
        _, inverse, counts = np.unique(_fingerprints(digests), return_inverse=True, return_counts=True)
        maps = maps.sort_by("owner")
        flags = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for b, n in zip(maps["bitmap"].to_pylist(), maps["n"].to_pylist(), strict=True)]
        suspect = (np.concatenate(flags).astype(bool) | (counts > 1))[inverse]
    return pa.table({"id": rows["id"], "sha": pa.array([x.hex() for x in digests], pa.string()), "suspect": pa.array(suspect, pa.bool_())})


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; of equal texts
    the row with the largest id stays.

    * null text: the empty text; all empty texts are one group.
    * ties: rows that repeat an id and a text are each counted in group_size;
      of those with the largest id one is kept, the first as they were read.
    * null id: the row takes part; it stays only if no row of its group has an
      id, and ``keep_id`` is then null.
    * empty table: no rows. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    docs = documents_of(df, id_col, text_col)
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    id_type = docs.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    sent_type = T.StructType([T.StructField("id", id_type), T.StructField("sha", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("owner", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("blob", T.BinaryType())])
    sent = checkpoint(docs.mapInArrow(_send(to_arrow_type(id_type), owners), sent_type))
    maps = sent.where("owner IS NOT NULL").select("part", "owner", "n", "blob").groupBy("owner").applyInArrow(_answer, "part int, owner int, n int, bitmap binary")
    rows = sent.where("owner IS NULL").select("id", "sha", "part")
    marked_type = T.StructType([T.StructField("id", id_type), T.StructField("sha", T.StringType()), T.StructField("suspect", T.BooleanType())])
    marked = checkpoint(rows.groupBy("part").cogroup(maps.groupBy("part")).applyInArrow(_mark, marked_type))

    ids = checkpoint(marked.where("suspect").select(F.col("id").alias("suspect_id")).distinct())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    folded = F.translate("text", upper, upper.lower())
    texts = docs.join(sized_broadcast(ids), docs["id"].eqNullSafe(F.col("suspect_id")), "left_semi").select("id", folded.alias("folded"))
    groups = texts.groupBy("folded").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select(F.sha2("folded", 256).alias("sha"), "keep_id", "group_size")
    # A text of very many copies is met by a broadcast of the heavy groups.
    numbered = checkpoint(marked.where("suspect").select("id", "sha", F.monotonically_increasing_id().alias("at")))
    twins = join_heavy(numbered, checkpoint(groups), "sha", "group_size").withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
    # One row of a group stays, so repeats of the largest id do not.
    tied = twins.where("kept").groupBy("sha").agg(F.min("at").alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "stays")
    twins = twins.join(sized_broadcast(checkpoint(tied)), "sha", "left").select("id", "keep_id", "group_size", (F.col("kept") & (F.col("at") == F.coalesce("stays", "at"))).alias("kept"), "sha")
    single = marked.where("NOT suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return twins.unionByName(single).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": """
        WITH folded AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM folded WINDOW w AS (PARTITION BY text_sha256)""",
}

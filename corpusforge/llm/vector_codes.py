"""Vector code compression: product codes by a delta-maintained Lloyd iteration.

1. Vectors become integers and are packed into blocks, which are written once as
   a table bucketed by block.
2. A round reads the blocks and the assignments of the round before, bucketed
   alike, so that they meet without a shuffle, and writes the new assignments.
   Beside them stand, for each block, the plus and minus contributions of the
   parts whose assignment changed: numbers and integer sums for each entry.
3. Only these contributions are shuffled, pre-aggregated. The running sums, one
   for each entry, take them up; entries are sums divided by numbers. A round
   without a change ends the iteration, since all later ones would equal it.

The driver holds the codebooks and their running sums: PARTS x ENTRIES of them,
whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, join_heavy, remove_folder, shared_folder, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block: a row of the bucketed tables.
BLOCK = 4096
_DELTA = "array<struct<part:int,entry:int,n:bigint,sums:array<bigint>>>"


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), within the bound at which an error still fits a long."""
    bound = math.isqrt((2**63 - 1) // (4 * vectors.shape[1]))
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -min(bound, 2**31 - 1), min(bound, 2**31 - 1)).astype(np.int64)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (n x parts) of vectors (n x parts x width);
    of entries that are equally near the first one counts."""
    codes, far = np.empty(x.shape[:2], dtype=np.uint8), np.empty(x.shape[:2], dtype=np.int64)
    for p in range(x.shape[1]):
        part, book = x[:, p], books[p]
        distance = (book * book).sum(axis=1) - 2 * (part @ book.T)
        codes[:, p] = distance.argmin(axis=1)
        far[:, p] = np.take_along_axis(distance, codes[:, p, None].astype(np.int64), 1)[:, 0] + (part * part).sum(axis=1)
    return codes, far


def contributions(x: np.ndarray, new: np.ndarray, old: np.ndarray | None, entries: int) -> list[dict]:
    """What parts that changed take from their old entries and give to their new ones."""
    n, parts, width = x.shape
    out = []
    for p in range(parts):
        moved = np.ones(n, dtype=bool) if old is None else new[:, p] != old[:, p]
        if not moved.any():
            continue
        counts, sums = np.zeros(entries, dtype=np.int64), np.zeros((entries, width), dtype=np.int64)
        for codes, sign in ((new, 1), (old, -1)):
            if codes is not None:
                np.add.at(counts, codes[moved, p], sign)
                np.add.at(sums, codes[moved, p], sign * x[moved, p])
        out += [{"part": p, "entry": int(e), "n": int(counts[e]), "sums": sums[e].tolist()} for e in np.flatnonzero((counts != 0) | sums.any(axis=1))]
    return out


def _pack(dim: int, id_type: pa.DataType, label_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        ids: list = []
        labels: list = []
        data: list[np.ndarray] = []
        seq = held = 0

        def block() -> pa.RecordBatch:
            nonlocal ids, labels, data, seq, held
            columns = [pa.array([base + seq], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([labels], pa.list_(label_type)), pa.array([np.concatenate(data).astype("<i4").tobytes()], pa.binary())]
            ids, labels, data, seq, held = [], [], [], seq + 1, 0
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "labels", "data"])

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                data.append(integers(flat))
                ids += part.column("id").to_pylist()
                labels += part.column("label").to_pylist()
                held += part.num_rows
                if held >= BLOCK:
                    yield block()
        if held:
            yield block()

    return run


def _parts(data: bytes, dim: int, parts: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i4").astype(np.int64).reshape(-1, parts, dim // parts)


def _round(books: np.ndarray, dim: int):
    """A block with its assignments of the round before, if there was one."""
    parts, entries = books.shape[:2]

    def run(block: pa.Table, before: pa.Table) -> pa.Table:
        x = _parts(block["data"][0].as_py(), dim, parts)
        old = np.frombuffer(before["codes"][0].as_py(), dtype=np.uint8).reshape(-1, parts) if before.num_rows else None
        new, _ = nearest(x, books)
        kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
        return pa.table({"block": block["block"], "codes": pa.array([new.tobytes()], pa.binary()), "deltas": pa.array([contributions(x, new, old, entries)], kind)})

    return run


def _coded(books: np.ndarray, dim: int, id_type: pa.DataType, label_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, data in zip(b.column("ids"), b.column("labels"), b.column("data"), strict=True):
                codes, far = nearest(_parts(data.as_buffer(), dim, books.shape[0]), books)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(far.sum(axis=1), pa.int64())], ["id", "label", "code", "error"])

    return run


@dataclass
class Codes:
    """vectors: id, label, code, error, label_error; codebooks: part x entry x width."""

    vectors: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


class _Tables:
    """Tables bucketed by block, in the shared folder, under names of their own."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.run = spark, buckets, f"vector_codes_{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(spark)}/{self.run}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        full = f"{self.run}_{name}"
        df.write.format("parquet").bucketBy(self.buckets, "block").sortBy("block").option("path", f"{self.folder}/{name}").saveAsTable(full)
        return self.spark.table(full)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.run}_{name}")
        remove_folder(self.spark, f"{self.folder}/{name}")


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all vectors, and the codebooks after the last round.

    Each component x becomes floor(4096 * x). Every part position has a codebook
    of its own, begun with that part of the ``entries`` vectors of least id. A
    round assigns each part to the nearest entry (squared Euclidean distance,
    ties to the first), then makes each entry the floor of its parts' mean;
    entries without a part stay. After the rounds parts are assigned once more:
    ``code`` has two hex digits for each part, ``error`` is the sum of its
    distances, ``label_error`` that of all vectors of equal label, nulls together.

    Left out are vectors that are null or have null or infinite components or
    NaN. All kept vectors have the length of the one with least id whose length is
    a positive multiple of ``parts``; others are left out. Fewer vectors than
    ``entries``: so many entries. Rows that repeat an id are vectors of their own,
    in the order of their components; null ids are last. Components so large that
    an error could exceed a long count as the largest that do not; a label whose
    errors exceed one has a null ``label_error``. Empty table: no rows. Other
    columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & sound & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    id_type, label_type = rows.schema["id"].dataType, rows.schema["label"].dataType
    order = [F.col("id").asc_nulls_last(), "vector"]
    first = rows.orderBy(*order).select(F.size("vector").alias("dim")).first()
    out_type = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if first is None:
        none = spark.createDataFrame([], out_type).withColumn("label_error", F.lit(None).cast("long"))
        return Codes(none.withColumnRenamed("id", id_col).withColumnRenamed("label", label_col), np.zeros((parts, 0, 0), dtype=np.int64))
    dim = first["dim"]
    rows = rows.where(F.size("vector") == dim)
    start = integers(np.array([r["vector"] for r in rows.orderBy(*order).select("vector").limit(entries).collect()]))
    books = np.ascontiguousarray(start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2))

    arrow_id, arrow_label = to_arrow_type(id_type), to_arrow_type(label_type)
    packed_type = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), T.StructField("data", T.BinaryType())])
    packed = rows.mapInArrow(_pack(dim, arrow_id, arrow_label), packed_type)
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()), 100_000)
    tables = _Tables(spark, buckets)
    blocks = tables.write(packed.repartition(buckets, "block"), "blocks")
    width = dim // parts
    numbers = np.zeros(books.shape[:2], dtype=object)
    sums = np.zeros(books.shape, dtype=object)
    before = spark.createDataFrame([], f"block long, codes binary, deltas {_DELTA}")
    for r in range(rounds):
        joined = blocks.select("block", "data").groupBy("block").cogroup(before.select("block", "codes").groupBy("block"))
        now = tables.write(joined.applyInArrow(_round(books, dim), f"block long, codes binary, deltas {_DELTA}"), f"round_{r}")
        changes = now.select(F.explode("deltas").alias("d")).groupBy("d.part", "d.entry").agg(F.sum("d.n").alias("n"), *[F.sum(F.get("d.sums", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in range(width)])
        found = changes.collect()  # at most a row for each entry
        if r:
            tables.drop(f"round_{r - 1}")
        before = now
        for c in found:
            numbers[c["part"], c["entry"]] += c["n"]
            sums[c["part"], c["entry"]] += np.array([int(c[f"s{k}"]) for k in range(width)], dtype=object)
        if not found:
            break
        for p, e in zip(*np.nonzero(numbers), strict=True):
            books[p, e] = [s // numbers[p, e] for s in sums[p, e]]
    # Bucketed scans are not needed here, so files are split by size.
    coded = checkpoint(blocks.mapInArrow(_coded(books, dim, arrow_id, arrow_label), out_type).withColumn("key", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))))
    for name in ("blocks", *(f"round_{r}" for r in range(rounds))):
        tables.drop(name)
    per_label = checkpoint(coded.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    out = join_heavy(coded, per_label, "key", "n").select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error")
    return Codes(out, books)


def decode_codes(code: str, codebooks: np.ndarray) -> list[float]:
    """The vector that a code stands for."""
    return (np.concatenate([codebooks[p, e] for p, e in enumerate(bytes.fromhex(code))]) / SCALE).tolist()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes(table(spark, sf_dir, "embeddings"))
    return found.vectors.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _sql(width: int = 8) -> str:
    """Every round as tables of its own, with all sums taken anew."""
    out = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS v, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cut AS MATERIALIZED (SELECT v, p, x[p * {width} + 1:p * {width} + {width}] AS x FROM kept, range({PARTS}) t(p))",
        f"book0 AS (SELECT p, v AS e, x AS c FROM cut WHERE v < {ENTRIES})",
    ]
    mean = ", ".join(f"(sum(x[{k}]) - ((sum(x[{k}]) % count(*)) + count(*)) % count(*)) // count(*)" for k in range(1, width + 1))
    for r in range(ROUNDS + 1):
        square = " + ".join(f"(x[{k}] - c[{k}]) * (x[{k}] - c[{k}])" for k in range(1, width + 1))
        out.append(f"near{r} AS MATERIALIZED (SELECT v, p, any_value(x) AS x, min(({square}) * {ENTRIES} + e) AS best FROM cut JOIN book{r} USING (p) GROUP BY v, p)")
        if r < ROUNDS:
            out.append(f"mean{r} AS (SELECT p, best % {ENTRIES} AS e, CAST([{mean}] AS BIGINT[]) AS c FROM near{r} GROUP BY 1, 2)")
            out.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)")
    coded = f"SELECT v, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY v"
    digest = f"SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}"
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, ({digest}) AS codebooks_sha256 FROM kept JOIN ({coded}) USING (v)"


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": _sql()}

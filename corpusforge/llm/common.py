"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if its measured size stays below this many
#: bytes; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
#: A key is heavy if it holds at least this share of all rows, so there are at
#: most so many heavy keys.
HEAVY_KEYS = 4096

_U = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = _U(0x9E3779B97F4A7C15)
BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: whole texts are long, and a batch is held several times.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Sets small Arrow batches for a session; queries do this, operators never.

    Batches are cut by a setting of the session alone, so whoever owns the run
    sets it. Results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_of(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents_of(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, text, more) for a Python operator."""
    return df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *more)


def row_hash(name: str = "text") -> Column:
    """With the id this tells rows apart: rows equal in both have one text."""
    return F.xxhash64(text_of(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` as the session has it. Only on one machine does a
    temporary folder do where it is unset (tests): on a cluster each executor
    would see another one, so that is refused.
    """
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpusforge-")
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _width(of: Column, kind: T.DataType) -> Column | int:
    """Bytes of a value: a number for fixed widths, else a measure."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(of), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
        return F.greatest(F.size(of), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        parts = [_width(of[f.name], f.dataType) for f in kind.fields]
        return sum(parts[1:], parts[0]) + 8
    if isinstance(kind, T.ArrayType | T.MapType):
        return F.coalesce(F.octet_length(F.to_json(of)), F.lit(0)) + 16
    return 16


def fits(small: DataFrame) -> bool:
    """True if the rows take at most BROADCAST_BYTES, by a measuring pass.

    ``small`` should be checkpointed, so that the pass is cheap.
    """
    widths = [_width(F.col(f.name), f.dataType) for f in small.schema.fields]
    row = small.agg(F.sum(sum(widths[1:], widths[0]) + F.lit(16)).alias("bytes")).first()
    return (row["bytes"] or 0) <= BROADCAST_BYTES


def sized_broadcast(small: DataFrame) -> DataFrame:
    """``small`` with a broadcast hint if its measured size allows one."""
    return F.broadcast(small) if fits(small) else small


def join_heavy(big: DataFrame, small: DataFrame, key: str, n: str) -> DataFrame:
    """``big`` joined to ``small`` (one row per key) by key, hot keys apart.

    ``n`` is a column of ``small`` with the rows of ``big`` that hold its key.
    Where ``small`` is too large to be broadcast, the rows of heavy keys, at
    most HEAVY_KEYS of them, are broadcast and only the rest is shuffled.
    """
    if fits(small):
        return big.join(F.broadcast(small), key)
    total = small.agg(F.sum(n)).first()[0] or 0
    heavy = F.col(n) * HEAVY_KEYS >= total
    hot = F.broadcast(small.where(heavy))
    cold = big.join(F.broadcast(small.where(heavy).select(key)), key, "left_anti").join(small.where(~heavy), key)
    return big.join(hot, key).unionByName(cold)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64 arrays."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, dtype=_U)
_inverse_powers = np.ones(1, dtype=_U)


def _grow(n: int) -> None:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 12)
        for name, base in (("_powers", BASE), ("_inverse_powers", BASE_INV)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def powers(n: int) -> np.ndarray:
    _grow(n)
    return _powers[:n]


def inverse_powers(n: int) -> np.ndarray:
    _grow(n)
    return _inverse_powers[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of the first i values, modulo 2**64."""
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, equal for equal spans."""
    if not len(start):
        return np.zeros(0, dtype=_U)
    at = inverse_powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * at[start] + (end - start).astype(_U))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte array of a text, and the start and end of each run of non-blanks.

    Blanks are the ASCII ones; callers that want others fold them first.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = np.ones(len(raw) + 2, dtype=bool)
    blank[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    change = np.flatnonzero(blank[1:] != blank[:-1])
    return raw, change[0::2], change[1::2]

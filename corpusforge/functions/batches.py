"""Arrow batches of whole texts and files, in pieces of bounded size.

Ten thousand rows, Spark's usual batch, are gigabytes of long texts, and a task
holds a batch several times over: as Arrow, as Python objects, as what it makes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch that Spark hands to Python.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Bytes that are turned into Python objects at a time.
PIECE_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets small Arrow batches for a session; queries do this, operators never."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if int(spark.conf.get(size).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of at most ``most`` bytes or of one row."""
    for b in batches:
        todo = [b]
        while todo:
            b = todo.pop()
            if b.num_rows <= 1 or b.nbytes <= most:
                yield b
            else:
                half = b.num_rows // 2
                todo += [b.slice(half), b.slice(0, half)]

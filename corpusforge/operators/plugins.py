"""Cleaners in plain Python that may fail, in one chain with the column cleaners.

A plug-in takes the text and the document's path and returns the text. What it
raises ends the chain for that document alone: its text stays as it was before
the first cleaner, and a row tells which plug-in failed and why. Neighbouring
plug-ins run in one pass of Arrow batches, neighbouring column cleaners in one
projection. Columns cannot fail for a row: an error in one of them ends the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import pieces
from ..functions.cleaners import CHAIN, CLEANERS, Cleaner, clean_frame

#: (text, path) -> text; both may be None.
Plugin = Callable[[str | None, str | None], str | None]
PLUGINS: dict[str, Plugin] = {}
BEFORE, FAILED, ERROR, DELTAS = "__before", "failed", "error", "deltas"
_DELTA = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("delta", T.LongType())]))


def register_plugin(name: str, plugin: Plugin) -> None:
    """Add a plug-in; name it in a chain to use it."""
    if name in CLEANERS:
        raise ValueError(f"{name} is the name of a column cleaner")
    PLUGINS[name] = plugin


def has_plugins(chain: Sequence[str | Cleaner]) -> bool:
    return any(s in PLUGINS for s in chain if isinstance(s, str))


def _pass(df: DataFrame, steps: list[tuple[str, Plugin]], content: str, path: str) -> DataFrame:
    """One pass of plug-ins over the rows that have not failed yet."""
    own = pa.struct([("name", pa.string()), ("delta", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            at = {n: b.schema.get_field_index(n) for n in (content, FAILED, ERROR, DELTAS)}
            texts, failed, errors, deltas = (b.column(at[n]).to_pylist() for n in (content, FAILED, ERROR, DELTAS))
            for i, where in enumerate(b.column(path).to_pylist()):
                if failed[i] is not None:
                    continue
                text, found = texts[i], list(deltas[i] or [])
                for name, plugin in steps:
                    try:
                        out = plugin(text, where)
                        if out is not None and not isinstance(out, str):
                            raise TypeError(f"{type(out).__name__} is no text")
                        if out is not None:
                            out.encode()
                    except Exception as e:  # whatever it is, the document stays and the run goes on
                        failed[i], errors[i] = name, str(e) or type(e).__name__
                        break
                    found.append({"name": name, "delta": len(out or "") - len(text or "")})
                    text = out
                texts[i], deltas[i] = text, found
            new = {content: pa.array(texts, pa.string()), FAILED: pa.array(failed, pa.string()), ERROR: pa.array(errors, pa.string()), DELTAS: pa.array(deltas, pa.list_(own))}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(k)) for k, n in enumerate(b.schema.names)], b.schema.names)

    return df.mapInArrow(run, df.schema)


def clean_with_plugins(df: DataFrame, content: str = "content", path: str = "path", chain: Sequence[str | Cleaner] = CHAIN) -> DataFrame:
    """``df`` with ``content`` through the chain, and failed, error, deltas.

    ``chain`` holds names of column cleaners and of plug-ins, in any order.
    ``failed`` names the plug-in that ended a row's chain and ``error`` says why;
    both are null for all other rows. A failed row keeps its content. ``deltas``
    tells how many characters each plug-in that was run added or took. Null
    contents go through the plug-ins as None. No columns of ``df`` may have the
    three names.
    """
    taken = {BEFORE, FAILED, ERROR, DELTAS} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here")
    none = F.lit(None).cast("string")
    out = df.withColumns({BEFORE: F.col(content), FAILED: none, ERROR: none, DELTAS: F.array().cast(_DELTA)})
    for python, steps in groupby(chain, lambda s: isinstance(s, str) and s in PLUGINS):
        if python:
            out = _pass(out, [(s, PLUGINS[s]) for s in steps], content, path)
        else:
            out = clean_frame(out, content, path, list(steps))
    return out.withColumn(content, F.when(F.col(FAILED).isNull(), F.col(content)).otherwise(F.col(BEFORE))).drop(BEFORE)


def plugin_errors(cleaned: DataFrame, path: str = "path") -> DataFrame:
    """path, stage, error of the rows whose chain ended early."""
    return cleaned.where(F.col(FAILED).isNotNull()).select(F.col(path).alias("path"), F.concat(F.lit("clean "), F.col(FAILED)).alias("stage"), F.col(ERROR).alias("error"))

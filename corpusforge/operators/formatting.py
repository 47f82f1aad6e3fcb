"""Markdown through an external formatter, in Arrow batches."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A formatter that reads a text and writes it formatted.
COMMAND = ("prettier", "--parser", "markdown")
#: One that formats the files that it is given, where they are.
IN_PLACE = ("prettier", "--parser", "markdown", "--write")
#: Files of one call of the latter.
FILES = 256


def _one(command: list[str], text: str | None, timeout: float) -> str | None:
    if text is None:
        return None
    try:
        done = subprocess.run(command, input=text.encode(), capture_output=True, timeout=timeout, check=True)
        return done.stdout.decode()
    except (OSError, subprocess.SubprocessError, UnicodeError):
        return text


def _many(command: list[str], texts: list[str | None], timeout: float) -> list[str | None]:
    """Texts as files of one folder, formatted by one process.

    Where that process fails, halves are tried apart, down to single files, so a
    text that it cannot read costs the others nothing but time.
    """
    with tempfile.TemporaryDirectory() as folder:
        names = [Path(folder) / f"{k}.md" for k, t in enumerate(texts) if t is not None]
        for name, text in zip(names, (t for t in texts if t is not None), strict=True):
            name.write_bytes(text.encode())
        if not names:
            return texts
        try:
            subprocess.run([*command, *map(str, names)], capture_output=True, timeout=timeout * len(names), check=True)
            out = iter([n.read_bytes().decode() for n in names])
            return [None if t is None else next(out) for t in texts]
        except OSError:
            return texts
        except (subprocess.SubprocessError, UnicodeError):
            pass
    if len(texts) == 1:
        return texts
    half = len(texts) // 2
    return _many(command, texts[:half], timeout) + _many(command, texts[half:], timeout)


def format_markdown(df: DataFrame, content: str = "content", command: Sequence[str] = COMMAND, timeout: float = 30.0, in_place: bool = False) -> DataFrame:
    """``df`` with ``content`` as the command gives it back.

    The command must be on every executor's path. Where it is not, fails, takes
    longer than ``timeout`` seconds a text or writes no text, the content stays as
    it is: a formatter's failure never ends a run. Null contents stay null. With
    ``in_place`` the command is called with up to FILES files at a time, which it
    rewrites (see IN_PLACE); otherwise once for each text, which it reads.
    """
    command = list(command)

    def formatted(texts: list[str | None]) -> list[str | None]:
        if not in_place:
            return [_one(command, t, timeout) for t in texts]
        return [x for at in range(0, len(texts), FILES) for x in _many(command, texts[at : at + FILES], timeout)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(content)
            texts = pa.array(formatted(b.column(at).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else b.column(k) for k in range(b.num_columns)], b.schema.names)

    kind = T.StructType([T.StructField(f.name, T.StringType() if f.name == content else f.dataType) for f in df.schema.fields])
    return df.mapInArrow(run, kind)

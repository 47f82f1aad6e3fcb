"""Archive members as rows. Zip and gzip are read; other formats plug in."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces

#: (name of the archive, its bytes, password) -> (member name, bytes) pairs.
Extractor = Callable[[str, bytes, str | None], Iterator[tuple[str, bytes]]]


def _zip(name: str, data: bytes, password: str | None) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield info.filename, z.read(info, pwd=password.encode() if password else None)


def _gzip(name: str, data: bytes, password: str | None) -> Iterator[tuple[str, bytes]]:
    yield name.rsplit("/", 1)[-1].removesuffix(".gz"), gzip.decompress(data)


#: Extension -> extractor. The 7z format has no reader in the standard library;
#: without one registered here its archives give a row with status "unsupported".
EXTRACTORS: dict[str, Extractor] = {".zip": _zip, ".gz": _gzip}


def register_extractor(ext: str, extractor: Extractor) -> None:
    EXTRACTORS[ext] = extractor


def extract(files: DataFrame, password: str | None = None) -> DataFrame:
    """path, member, content, status, error of archives (path, content).

    A failed archive is one row with a status ("unsupported", "timeout" or
    "error"); it never ends the job.
    """
    known = dict(EXTRACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ext = "." + path.rsplit(".", 1)[-1].lower() if "." in path else ""
                rows: list[tuple] = []
                try:
                    if ext not in known:
                        rows.append((path, None, None, "unsupported", f"no reader for {ext or 'this name'}"))
                    else:
                        rows += [(path, m, d, "ok", None) for m, d in known[ext](path, data or b"", password)]
                except TimeoutError as e:
                    rows = [(path, None, None, "timeout", str(e))]
                except Exception as e:
                    rows = [(path, None, None, "error", str(e) or type(e).__name__)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.string(), pa.string(), pa.binary(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "member", "content", "status", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, content binary, status string, error string")


def _open(path: str):
    """A file for reading at any place: of a shared disk, or what Arrow's file systems know."""
    if "://" not in path:
        return open(path.removeprefix("file:"), "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def zip_members(paths: DataFrame) -> DataFrame:
    """path, member, at, packed, size, method, flags, crc, error of zip archives.

    Only the directory at an archive's end is read. An archive without one gives
    a row with an error, an empty one none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
        names = ["path", "member", "at", "packed", "size", "method", "flags", "crc", "error"]
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with _open(path) as f, zipfile.ZipFile(f) as z:
                        rows = [(path, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.flag_bits, i.CRC, None) for i in z.infolist() if not i.is_dir()]
                except Exception as e:
                    rows = [(path, *[None] * 7, str(e) or type(e).__name__)]
                for k in range(0, len(rows), 10_000):
                    columns = zip(*rows[k : k + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return paths.select("path").mapInArrow(run, "path string, member string, at long, packed long, size long, method int, flags int, crc long, error string")


def _member(f, member: str, at: int, packed: int, method: int, flags: int, crc: int, password: str | None) -> bytes:
    """One member, by its byte range; rare kinds are left to the standard library."""
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or flags & 1:
        with zipfile.ZipFile(f) as z:
            return z.read(member, pwd=password.encode() if password else None)
    f.seek(at)
    head = f.read(30)
    if head[:4] != b"PK\3\4":
        raise zipfile.BadZipFile(f"no member at byte {at}")
    f.seek(at + 30 + sum(struct.unpack("<HH", head[26:30])))
    data = f.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    if zlib.crc32(data) != crc:
        raise zipfile.BadZipFile(f"Bad CRC-32 for file {member!r}")
    return data


def extract_split(paths: DataFrame, password: str | None = None, tasks: int | None = None) -> DataFrame:
    """path, member, content, status, error of zip archives that are read in place.

    The directories are read first; then members are dealt over ``tasks`` by their
    numbers (by default as many as the session shuffles to) and each is read by its
    byte range. So one archive is spread over tasks, and none is ever held whole.
    A member that cannot be read is a row with an error; the others are read.
    """
    spark = paths.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "member", "content", "status", "error"], (pa.string(), pa.string(), pa.binary(), pa.string(), pa.string())
        opened, f = None, None
        for b in batches:
            for r in b.to_pylist():
                row = (r["path"], None, None, "error", r["error"])
                if r["error"] is None:
                    try:
                        if r["path"] != opened:
                            if f is not None:
                                f.close()
                            opened, f = r["path"], _open(r["path"])
                        row = (r["path"], r["member"], _member(f, *(r[k] for k in ("member", "at", "packed", "method", "flags", "crc")), password), "ok", None)
                    except Exception as e:
                        row = (r["path"], r["member"], None, "error", str(e) or type(e).__name__)
                # A batch for each member: it is handed on before the next one is read.
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    members = zip_members(paths)
    dealt = members.repartition(tasks, F.xxhash64("path", "at")).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(run, "path string, member string, content binary, status string, error string")

"""Media columns: AVI files of motion JPEG.

The reader parses the RIFF indexes (idx1 and OpenDML's, or the chunks in order
where there is none), decodes intra frames (baseline JPEG, any Huffman tables, the
standard ones where a frame has none) and cuts shots where the luma histogram
changes by more than an adaptive threshold; each shot is a timed clip row.

``store_payload`` keeps bytes losslessly in such a file: a frame's quantised
coefficients are its units. Amplitudes of size 8 are exactly 256 values, so a
coefficient carries one byte, and a 4:4:4 unit of three 8x8 blocks carries 192.
Every frame has one Huffman code per table (one bit), restart markers after each
unit keep the DC predictions small, and the quantiser is 1 for all places.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents_of, small_batches, table

UNIT = 192
FRAME_UNITS = 64
FPS = 25
#: Shots: a frame cuts if its histogram differs by more than this many standard
#: deviations above the mean of the WINDOW differences before it.
WINDOW, DEVIATIONS, LEAST_CHANGE, BINS = 8, 3.0, 0.25, 16
#: The zigzag order of an 8x8 block.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])

def _symbols(head: str) -> bytes:
    """A standard AC table: the symbols named first, then all others in order."""
    first = bytes.fromhex(head)
    every = {0x00, 0xF0} | {run << 4 | size for run in range(16) for size in range(1, 11)}
    return first + bytes(sorted(every - set(first)))


#: The Huffman tables of the JPEG standard, for frames without any;
#: table -> (codes of each length, symbols). The AC tables end in number order.
STANDARD = {
    0x00: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x10: (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), _symbols("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")),
    0x11: (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), _symbols("0001020311040521310612415107617113223281081442" + "91a1b1c109233352f0156272d10a162434e125f1")),
}
_k = np.arange(8)
#: DCT[u, x]: the orthonormal cosine basis.
DCT = (np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)[:, None]).astype(np.float32)


# --- storing -----------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=256)
def _jpeg_head(width: int, height: int) -> bytes:
    one_code = bytes([1] + [0] * 15) + bytes([8])  # a single one-bit code: symbol 0/8
    parts = [b"\xff\xd8", _segment(0xDB, b"\0" + b"\1" * 64)]
    parts.append(_segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])))
    parts += [_segment(0xC4, bytes([0x00]) + one_code), _segment(0xC4, bytes([0x10]) + one_code)]
    parts += [_segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))]
    return b"".join(parts)


def _scans(units: np.ndarray) -> list[bytes]:
    """Entropy-coded unit segments of an (n, 192) byte array, 0xFF stuffed."""
    bits = np.zeros((len(units), UNIT, 9), dtype=np.uint8)
    bits[:, :, 1:] = np.unpackbits(units[:, :, None], axis=2)
    coded = np.packbits(bits.reshape(len(units), UNIT * 9), axis=1)
    return [row.tobytes().replace(b"\xff", b"\xff\0") for row in coded]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(chunks))


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS, extra: bytes = b"") -> bytes:
    """An AVI 1.0 file of one MJPG stream with an idx1 index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    index, body, at = [], [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    riff = b"AVI " + _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf))) + extra + _list(b"movi", *body) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", riff)


def pad(text: bytes) -> bytes:
    """The payload of a text: blanks up to a positive multiple of UNIT."""
    return text + b" " * (UNIT - len(text) if not text else -len(text) % UNIT)


def store_payload(payload: bytes) -> bytes:
    """An AVI file that holds the payload (a positive multiple of UNIT)."""
    units = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    n = min(FRAME_UNITS, len(units))
    across = min(8, n)
    n = -(-n // across) * across
    scans = _scans(np.concatenate([units, np.zeros((-len(units) % n, UNIT), dtype=np.uint8)]))
    width, height = across * 8, n // across * 8
    head = _jpeg_head(width, height)
    marks = [bytes([0xFF, 0xD0 + i % 8]) for i in range(n - 1)] + [b"\xff\xd9"]
    frames = [head + b"".join([x for pair in zip(scans[i : i + n], marks, strict=True) for x in pair]) for i in range(0, len(scans), n)]
    return write_avi(frames, width, height, extra=_chunk(b"plen", struct.pack("<Q", len(payload))))


# --- reading -----------------------------------------------------------------


@dataclass
class Avi:
    fps: float
    width: int
    height: int
    frames: list[bytes]
    chunks: dict[bytes, bytes]


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first, past last byte) of the chunks of a list, in order."""
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > end:
            raise ValueError("the file is cut")
        yield name, at + 8, at + 8 + n
        at += 8 + n + n % 2


def _in_order(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """The chunks of a list of frames and of the lists in it."""
    for name, a, b in _walk(data, at, end):
        if name == b"LIST":
            yield from _in_order(data, a + 4, b)
        else:
            yield name, a, b


def _open_index(data: bytes, a: int, b: int) -> Iterator[tuple[int, int]]:
    """(place, size) of what an OpenDML index lists, through its sub-indexes."""
    wide, kind, n = struct.unpack_from("<HxBI", data, a)
    if kind == 0:
        for k in range(n):
            at = struct.unpack_from("<Q", data, a + 24 + 4 * wide * k)[0]
            yield from _open_index(data, at + 8, at + 8 + struct.unpack_from("<I", data, at + 4)[0])
    elif kind == 1:
        base = struct.unpack_from("<Q", data, a + 12)[0]
        for k in range(n):
            offset, size = struct.unpack_from("<II", data, a + 24 + 4 * wide * k)
            yield base + offset, size & 0x7FFFFFFF


def read_avi(data: bytes) -> Avi:
    """Parse a RIFF AVI file; frames come by an index, or by order without one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, width, height, stream, seen = float(FPS), 0, 0, None, 0
    movi, index, opened, chunks = [], b"", None, {}
    # A long file has further RIFF parts behind the first.
    for part, first, end in _walk(data, 0, len(data)):
        for name, a, b in _walk(data, first + 4, end) if part == b"RIFF" else ():
            kind = data[a : a + 4] if name == b"LIST" else None
            if kind == b"movi":
                movi.append((a, b))
            elif kind == b"hdrl":
                for n2, a2, b2 in _walk(data, a + 4, b):
                    if n2 == b"avih":
                        fps = 1_000_000 / (struct.unpack_from("<I", data, a2)[0] or 1_000_000 // FPS)
                        width, height = struct.unpack_from("<II", data, a2 + 32)
                    elif n2 == b"LIST" and data[a2 : a2 + 4] == b"strl":
                        own = {n3: (a3, b3) for n3, a3, b3 in _walk(data, a2 + 4, b2)}
                        head = own.get(b"strh", (a2, a2))
                        if stream is None and data[head[0] : head[0] + 4] == b"vids":
                            stream, opened = seen, own.get(b"indx")
                            scale, rate = struct.unpack_from("<II", data, head[0] + 20)
                            fps = rate / scale if scale and rate else fps
                        seen += 1
            elif name == b"idx1":
                index = data[a:b]
            elif kind is None:
                chunks[name] = data[a:b]
    prefix = f"{stream or 0:02d}".encode()
    ours = lambda name: name[:2] == prefix and name[2:] in (b"dc", b"db")
    if opened:
        frames = [data[at : at + n] for at, n in _open_index(data, *opened)]
    elif index and movi:
        entries = list(struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]))
        # Offsets count from the list's type; some writers count from the file.
        at = movi[0][0]
        base = at if entries and data[at + entries[0][2] : at + entries[0][2] + 4] == entries[0][0] else 0
        frames = [data[base + o + 8 : base + o + 8 + n] for name, _, o, n in entries if ours(name)]
    else:
        frames = [data[a:b] for m in movi for name, a, b in _in_order(data, m[0] + 4, m[1]) if ours(name)]
    return Avi(fps, width, height, frames, chunks)


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


@dataclass
class Head:
    width: int
    height: int
    components: list[tuple[int, int, int, int, int, int]]  # id, h, v, quantiser, dc table, ac table
    quantisers: dict[int, np.ndarray]
    tables: dict[int, dict[tuple[int, int], int]]
    restart: int


@lru_cache(maxsize=256)
def _read_head(head: bytes) -> Head:
    width = height = restart = 0
    components, quantisers, tables, at = {}, {}, {}, 2
    while at + 4 <= len(head):
        marker, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + n]
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, q = body[k] >> 4, body[k] & 15
                step = 64 << wide
                quantisers[q] = np.frombuffer(body, dtype=">u2" if wide else "u1", count=64, offset=k + 1).astype(np.int32)
                k += 1 + step
        elif marker in (0xC0, 0xC1):
            height, width, m = struct.unpack_from(">HHB", body, 1)
            for i in range(m):
                c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                components[c] = [c, hv >> 4, hv & 15, q, 0, 0]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG frames are read")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                m = sum(body[k + 1 : k + 17])
                tables[body[k]] = _codes(body[k + 1 : k + 17], body[k + 17 : k + 17 + m])
                k += 17 + m
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            for i in range(body[0]):
                c, t = body[1 + 2 * i : 3 + 2 * i]
                components[c][4:] = [t >> 4, 16 + (t & 15)]
        at += 2 + n
    # Most writers of motion JPEG leave the standard tables out.
    for c in components.values():
        for t in c[4:]:
            if t not in tables and t in STANDARD:
                tables[t] = _codes(*STANDARD[t])
    return Head(width, height, [tuple(c) for c in components.values()], quantisers, tables, restart)


def _split_frame(frame: bytes) -> tuple[Head, bytes]:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while frame[at + 1] != 0xDA:
        if frame[at] != 0xFF:
            raise ValueError("a JPEG frame has no scan")
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    end = len(frame) - 2 if frame[-2:] == b"\xff\xd9" else len(frame)
    return _read_head(frame[:at]), frame[at:end]


def _segments(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Unstuffed bytes of a scan, and where each restart segment ends."""
    raw = np.frombuffer(scan, dtype=np.uint8)
    after = np.zeros(len(raw), dtype=bool)
    after[1:] = raw[:-1] == 0xFF
    mark = after & (raw >= 0xD0) & (raw <= 0xD7)
    drop = mark | (after & (raw == 0))
    drop[:-1] |= mark[1:]
    keep = ~drop
    ends = np.append(np.cumsum(keep)[mark], keep.sum())
    return raw[keep], ends


def _slow_segment(data: bytes, head: Head, units: int) -> list[list[list[int]]]:
    """Coefficients of a restart segment by plain Huffman decoding."""
    bits, n = int.from_bytes(data, "big"), 8 * len(data)
    at = 0

    def take(k: int) -> int:
        nonlocal at
        at += k
        if at > n:
            raise ValueError("a JPEG scan ends early")
        return (bits >> (n - at)) & ((1 << k) - 1)

    def symbol(codes: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("a JPEG scan has an unknown code")

    def amplitude(size: int) -> int:
        v = take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    blocks, last = [], dict.fromkeys((c[0] for c in head.components), 0)
    for _ in range(units):
        for c, h, v, _, dc, ac in head.components:
            for _ in range(h * v):
                block = [0] * 64
                last[c] += amplitude(symbol(head.tables[dc]))
                block[0], k = last[c], 1
                while k < 64:
                    run, size = divmod(symbol(head.tables[ac]), 16)
                    if not size and run < 15:
                        break
                    k += run
                    if size:
                        block[k] = amplitude(size)
                    k += 1
                blocks.append(block)
    return blocks


def decode_coefficients(frame: bytes) -> tuple[Head, np.ndarray]:
    """Quantised coefficients in zigzag order: (unit, block of unit, 64)."""
    head, scan = _split_frame(frame)
    high, wide = max(c[2] for c in head.components), max(c[1] for c in head.components)
    units = -(-head.width // (8 * wide)) * -(-head.height // (8 * high))
    per_unit = sum(c[1] * c[2] for c in head.components)
    raw, ends = _segments(scan)
    bits = per_unit * 64 * 9
    fixed = head.restart == 1 and all(t == {(1, 0): 8} for t in head.tables.values())
    if fixed and len(ends) == units and bits % 8 == 0 and len(raw) == units * bits // 8 and (np.diff(ends, prepend=0) == bits // 8).all():
        # Every coefficient is one code bit and eight amplitude bits.
        cut = np.unpackbits(raw).reshape(units, per_unit, 64, 9)
        if cut[..., 0].any():
            raise ValueError("a JPEG scan has an unknown code")
        v = np.packbits(cut[..., 1:], axis=-1)[..., 0].astype(np.int32)
        return head, np.where(v & 0x80, v, v - 255)
    out, start, left = [], 0, units
    for end in ends.tolist():
        n = min(left, head.restart or units)
        out += _slow_segment(raw[start:end].tobytes(), head, n)
        start, left = end, left - n
    return head, np.array(out, dtype=np.int32).reshape(units, per_unit, 64)


def luma(head: Head, coefficients: np.ndarray) -> np.ndarray:
    """Decoded samples of the first component, one row per 8x8 block."""
    c = head.components[0]
    own = coefficients[:, : c[1] * c[2]].reshape(-1, 64) * head.quantisers[c[3]]
    square = np.zeros((len(own), 64), dtype=np.float32)
    square[:, ZIGZAG] = own
    square = DCT.T @ square.reshape(-1, 8, 8) @ DCT
    return np.clip(np.rint(square + 128), 0, 255).astype(np.uint8).reshape(-1, 64)


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """[first, past last) frames of each shot."""
    if not len(histograms):
        return []
    shares = histograms / np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    change = 0.5 * np.abs(np.diff(shares, axis=0)).sum(axis=1)
    cuts, recent = [0], []
    for i, d in enumerate(change.tolist(), 1):
        # Without a history of a shot a cut only has to be a large change.
        limit = LEAST_CHANGE
        if recent:
            mean = sum(recent) / len(recent)
            limit = max(limit, mean + DEVIATIONS * (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5)
        if d > limit:
            cuts.append(i)
            recent = []
        else:
            recent = [*recent[1 - WINDOW :], d]
    return list(zip(cuts, [*cuts[1:], len(histograms)], strict=True))


def _histograms(avi: Avi) -> tuple[list[tuple[Head, np.ndarray]], np.ndarray]:
    decoded = [decode_coefficients(f) for f in avi.frames]
    out = [np.bincount(luma(h, c).ravel() >> 4, minlength=BINS) for h, c in decoded]
    return decoded, np.array(out).reshape(-1, BINS)


def read_payload(data: bytes) -> tuple[bytes, np.ndarray, Avi]:
    """The stored payload, the luma histograms of its frames, and the file."""
    avi = read_avi(data)
    decoded, histograms = _histograms(avi)
    # The value of a size-8 amplitude back to its eight bits.
    units = [np.where(c < 0, c + 255, c).astype(np.uint8).tobytes() for _, c in decoded]
    return b"".join(units)[: struct.unpack("<Q", avi.chunks[b"plen"])[0]], histograms, avi


def _clips(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(8)]
            for i, media in zip(b.column(0), b.column(1), strict=True):
                try:
                    if not media.is_valid:
                        raise ValueError("no media")
                    avi = read_avi(media.as_buffer().to_pybytes())
                    found, error = shots(_histograms(avi)[1]), None
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    # A key or place that is missing says little by itself.
                    found, error = [(0, 0)], str(e) if type(e) is ValueError else f"broken file: {type(e).__name__} {e}"
                    avi = Avi(FPS, 0, 0, [], {})
                for k, (a, z) in enumerate(found):
                    for into, x in zip(rows, (i.as_py(), k, a, z, a / avi.fps, z / avi.fps, "MJPG" if error is None else None, error), strict=True):
                        into.append(x)
            kinds = (id_type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], ["id", "clip", "first_frame", "end_frame", "start_s", "end_s", "codec", "error"])

    return run


def clip_rows(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of AVI files: id, clip, frames, seconds, codec, error.

    Null, cut, broken or foreign media give one row with an ``error`` and no
    frames; a file without frames gives none. Repeated rows: each by itself.
    Empty table: no rows. Other columns are ignored, whatever their names. A
    file is read whole in one task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    own = df.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media"))
    kind = own.schema["id"].dataType
    fields = [("id", kind), ("clip", T.IntegerType()), ("first_frame", T.IntegerType()), ("end_frame", T.IntegerType()), ("start_s", T.DoubleType()), ("end_s", T.DoubleType()), ("codec", T.StringType()), ("error", T.StringType())]
    return own.mapInArrow(_clips(to_arrow_type(kind)), T.StructType([T.StructField(*f) for f in fields])).withColumnRenamed("id", id_col)


def feature_of(histograms: np.ndarray, avi: Avi) -> str:
    """Frames, size, shot bounds in seconds and the mean luma bin of a file."""
    cut = shots(histograms)
    mean = float((histograms.sum(axis=0) * np.arange(BINS)).sum() / max(1, histograms.sum()))
    times = ",".join(f"{a / avi.fps:.2f}-{z / avi.fps:.2f}" for a, z in cut)
    return f"{avi.width}x{avi.height} frames={len(avi.frames)} shots={len(cut)} luma={mean:.4f} clips={times}"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[] for _ in range(7)]
        for text in b.column(1):
            own = text.as_buffer().to_pybytes() if text.is_valid else b""
            media = store_payload(pad(own))
            payload, histograms, avi = read_payload(media)
            found = (len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(histograms, avi))
            for into, x in zip(rows, found, strict=True):
                into.append(x)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(rows, kinds, strict=True)]], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text through a stored AVI file and back: digests and features.

    Null text: the empty text, stored as one unit of blanks. Ties and repeated
    rows: each by itself, equal texts give equal values. Empty table: no rows.
    Other columns are ignored. A text of any length is one file in one task.
    """
    docs = documents_of(df, id_col, text_col)
    fields = [("id", docs.schema["id"].dataType), ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    return docs.mapInArrow(_digests, T.StructType([T.StructField(*f) for f in fields])).withColumnRenamed("id", id_col)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return text_media(table(spark, sf_dir, "documents"))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            media = [store_payload(pad((t or "").encode("utf-8", "surrogatepass"))) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["id", "media"])


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip rows of the files that whole texts are stored in."""
    small_batches(spark)
    docs = documents_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    files = docs.mapInArrow(_stored, T.StructType([docs.schema["id"], T.StructField("media", T.BinaryType())]))
    return clip_rows(files.withColumnRenamed("id", "doc_id"))


QUERIES = {"op7_media": op7_media, "media_clips": media_clips}
ORACLES: dict[str, str] = {}

"""Texts as PNG images in a binary column, and what is read back from them.

The bytes of a text, with zeros up to a positive multiple of ``WIDTH``, are the grey samples of an image of that width.
The image is a PNG: signature, IHDR, IDAT with zlib data and IEND, each chunk with its CRC-32. Each row takes the
filter with the least sum of absolute differences among those asked for. The reader tests the signature, every
chunk's checksum, the header and the length, then undoes the filters with numpy: None, Sub and Up for all rows at
once, images that hold Average or Paeth rows by diagonals. The feature is the sign pattern of low cosine frequencies.
All rows are independent: there is no shuffle.
"""

from __future__ import annotations

import struct
import zlib
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlark.llm.common import fresh, whole

WIDTH = 64
#: Fixed values of the format: the signature; filter types by name.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
FILTERS = {"none": 0, "sub": 1, "up": 2, "average": 3, "paeth": 4}


class BadImage(ValueError):
    """The bytes are no whole 8-bit grey PNG."""


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype("int16") for x in (a, b, c))
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype("uint8")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, width: int = WIDTH, filters: tuple[str, ...] = ("none", "sub", "up"), level: int = 6) -> bytes:
    """A grey PNG whose samples are payload, a positive multiple of width bytes."""
    rows = np.frombuffer(payload, "uint8").reshape(-1, width)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
    made = {"none": lambda: rows, "sub": lambda: rows - left, "up": lambda: rows - above}
    made["average"] = lambda: rows - ((left.astype("uint16") + above) // 2).astype("uint8")

    def paeth():
        corner = np.zeros_like(rows)
        corner[1:, 1:] = rows[:-1, :-1]
        return rows - _paeth(left, above, corner)

    made["paeth"] = paeth
    tried = np.stack([made[f]() for f in filters])
    cost = np.abs(tried.view("int8").astype("int16")).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), width + 1), "uint8")
    lines[:, 0] = np.array([FILTERS[f] for f in filters], "uint8")[best]
    lines[:, 1:] = tried[best, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if (kinds > 2).any():
        return _unfilter_by_diagonals(kinds, rows)
    out = np.where((kinds == 1)[:, None], np.cumsum(rows, axis=1, dtype="uint8"), rows)
    start = kinds != 2
    start[:1] = True  # above the first row there are zeros
    if start.all():
        return out
    sums = np.cumsum(out, axis=0, dtype="uint8")
    base = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
    before = np.zeros_like(out)
    before[1:] = sums[:-1]
    return sums - before[base]


def _unfilter_by_diagonals(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each sample needs those to the left, above and above left: all on earlier diagonals."""
    h, w = rows.shape
    out = np.zeros((h + 1, w + 1), "uint8")
    for d in range(h + w - 1):
        r = np.arange(max(0, d - w + 1), min(h, d + 1))
        c = d - r
        a, b, x, k = out[r + 1, c], out[r, c + 1], out[r, c], kinds[r]
        add = np.select([k == 0, k == 1, k == 2, k == 3], [np.zeros_like(a), a, b, ((a.astype("uint16") + b) // 2).astype("uint8")], _paeth(a, b, x))
        out[r + 1, c + 1] = rows[r, c] + add
    return out[1:, 1:]


def decode(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG, rows by columns; BadImage where anything is wrong."""
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise BadImage("a chunk is cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise BadImage(f"checksum of {kind!r}")
        at += 12 + n
        if kind == b"IHDR" and header is None:
            if n != 13:
                raise BadImage("header")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT" and header:
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[:1].islower():
            raise BadImage(f"unknown critical chunk {kind!r}")
    if not header or not ended or at != len(data):
        raise BadImage("header, end or length")
    w, h, *rest = header
    if rest != [8, 0, 0, 0, 0] or not w or not h:
        raise BadImage("not 8-bit grey without interlace")
    reader = zlib.decompressobj()
    try:
        raw = reader.decompress(b"".join(packed), h * (w + 1) + 1)
    except zlib.error as e:
        raise BadImage(str(e)) from None
    if len(raw) != h * (w + 1) or not reader.eof:
        raise BadImage("length of the samples")
    lines = np.frombuffer(raw, "uint8").reshape(h, w + 1)
    if (lines[:, 0] > 4).any():
        raise BadImage("filter type")
    return _unfilter(lines[:, 0], lines[:, 1:])


_N = 32
_COSINES = np.sqrt(2 / _N) * np.cos(np.pi / _N * (np.arange(_N) + 0.5) * np.arange(_N)[:, None])


def _means(image: np.ndarray) -> np.ndarray:
    """Means of _N equal stretches of the rows; rows repeat where there are fewer."""
    h = len(image)
    if h < _N:
        return image[np.arange(_N) * h // _N].astype("float64")
    edges = np.arange(_N + 1) * h // _N
    return np.add.reduceat(image, edges[:-1], axis=0, dtype="float64") / np.diff(edges)[:, None]


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine frequencies of the image, brought to 32 x 32, are above their median."""
    small = _means(_means(image).T).T
    low = (_COSINES[:9] @ small @ _COSINES[:9].T)[:8, :8].round(6).ravel()
    low[0] = 0.0  # the mean says nothing of the pattern
    return np.packbits(low > np.median(low[1:])).tobytes()


def _padded(text: str, width: int) -> bytes:
    data = text.encode()
    return data + bytes(-len(data) % width if data else width)


def to_png(docs: DataFrame, *, text_col: str = "text", media_col: str = "media", width: int = WIDTH, filters: tuple[str, ...] = ("none", "sub", "up")) -> DataFrame:
    """docs with one more column, media_col: the PNG (binary) of the whole text. A null or empty text gives one row of zeros."""

    @F.pandas_udf("binary")
    def png(text: pd.Series) -> pd.Series:
        return pd.Series([encode(_padded(t, width), width, filters) for t in text], dtype=object)

    return docs.withColumn(fresh(docs, media_col), png(whole(text_col)))


def media_features(media: str | Column) -> Column:
    """Of a column of PNGs, a struct: error, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes,
    media_sha256, hash (8 bytes) and feature (its hexadecimal digits). Where a PNG is null or broken, error says why and
    what is read from the samples is null."""

    @F.pandas_udf("error string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary, feature string")
    def features(media: pd.Series) -> pd.DataFrame:
        rows = []
        for m in media:
            if m is None:
                rows.append(("null", None, None, None, None, None, None, None))
                continue
            stored = (len(m), sha256(m).hexdigest())
            try:
                image = decode(m)
            except BadImage as e:
                rows.append((str(e), None, None, None, *stored, None, None))
                continue
            payload, bits = image.tobytes(), cosine_hash(image)
            rows.append((None, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, bits, bits.hex()))
        out = pd.DataFrame(rows, columns=["error", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash", "feature"])
        return out.astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})

    return features(F.col(media) if isinstance(media, str) else media)


def media_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id_col, n_bytes (of the text) and what media_features reads back from the text's PNG.

    Null and empty texts are one row of zeros. Repeated rows stay, an empty table stays empty, other columns are ignored.
    """
    text = whole(text_col)
    slim = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    stored = to_png(slim, width=width).select("id", "n_bytes", "media")
    return stored.select(F.col("id").alias(id_col), "n_bytes", media_features("media").alias("_m")).select(id_col, "n_bytes", "_m.*")

"""Texts or bytes stored losslessly as PNG images in binary columns, read back and hashed.

The writer makes 8-bit grey images: signature, header, zlib-compressed rows and end, each chunk with its CRC-32. It filters every row
by that filter of the five whose result has the smallest sum of absolute values, as writers commonly do. The reader
tests signature, chunk order, every checksum and the zlib stream's own, then undoes the filters with numpy: a byte needs those to its
left, above, and at the corner, so all bytes of a diagonal are computed together, and those of many images at once.

The feature is a low-frequency cosine-transform hash: the image's mean over a 32 x 32 grid, the 8 x 8 lowest frequencies of its
cosine transform, one bit for each of the 63 without the constant that is over their median.

Defined results: a null payload is an empty one; payloads are filled up with bytes 255 to a positive multiple of 576; equal payloads
give equal images and hashes; a file that fails a test raises ``ValueError`` naming the test; repeated rows are kept; an empty table gives
no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from askwell.llm.common import map_batches, slices, table

#: Payloads are filled up to a multiple of this; rows have a twelfth of it.
UNIT = 576
WIDTH = 48
FILL = b"\xff"
LEVEL = 1
GRID, LOW = 32, 8
# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
FILTERS = ("none", "sub", "up", "average", "paeth")


def padded(data: bytes) -> bytes:
    """``data`` filled up with bytes 255 to a positive multiple of ``UNIT``."""
    return data + FILL * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, kind: str) -> np.ndarray:
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
    if kind == "none":
        return rows
    if kind == "sub":
        return rows - left
    if kind == "up":
        return rows - above
    if kind == "average":
        return rows - ((left.astype("i2") + above) >> 1).astype("u1")
    corner = np.zeros_like(rows)
    corner[1:, 1:] = rows[:-1, :-1]
    return rows - _paeth(left.astype("i2"), above.astype("i2"), corner.astype("i2"))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The one of left, above and corner that is nearest to left + above - corner; ties in that order."""
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype("u1")


def _chosen(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's filter, and the rows filtered."""
    every = np.stack([_filtered(rows, kind) for kind in FILTERS])
    size = np.minimum(every, -every).sum(2, dtype="i8")
    kinds = size.argmin(0)
    return kinds, every[kinds, np.arange(len(rows))]


def encode_png(payload: bytes, width: int = WIDTH, kind: str = "adaptive", level: int = LEVEL) -> bytes:
    """A grey image whose samples are ``payload``, a multiple of ``width`` bytes; ``kind`` is a filter, or ``adaptive``."""
    rows = np.frombuffer(payload, "u1").reshape(-1, width)
    raw = np.empty((len(rows), width + 1), "u1")
    raw[:, 0], raw[:, 1:] = _chosen(rows) if kind == "adaptive" else (FILTERS.index(kind), _filtered(rows, kind))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(f"PNG: {what}")


def decode_png(data: bytes) -> np.ndarray:
    """The samples (rows, columns) of an 8-bit grey image without interlacing."""
    return decode_pngs([data])[0]


def decode_pngs(files: list[bytes]) -> list[np.ndarray]:
    """The samples of each image."""
    return unfiltered_images([_opened(data) for data in files])


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The filters and the filtered rows of a file that passes all tests."""
    _need(data[:8] == SIGNATURE, "signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        _need(at + 12 <= len(data), "cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        _need(at + 12 + n <= len(data), "cut short")
        _need(zlib.crc32(part, zlib.crc32(kind)) == struct.unpack_from(">I", data, at + 8 + n)[0], f"checksum of {kind!r}")
        _need((head is None) == (kind == b"IHDR"), "header not first")
        if kind == b"IHDR":
            _need(n == 13, "header's size")
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
        else:
            _need(bool(kind[0] & 0x20), f"unknown critical chunk {kind!r}")
        at += 12 + n
    _need(ended and head is not None, "no end")
    width, height, *rest = head
    _need(rest == [8, 0, 0, 0, 0] and width > 0, "kind of image")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError(f"PNG: {e}") from e
    _need(len(raw) == height * (width + 1), "size of the data")
    raw = np.frombuffer(raw, "u1").reshape(height, width + 1)
    _need(not height or int(raw[:, 0].max()) < 5, "filter")
    return raw[:, 0], raw[:, 1:]


def _skewed(flat: np.ndarray, first: int, height: int, width: int) -> np.ndarray:
    """A view (row, column) of an image whose diagonals are rows of ``flat`` from ``first`` on: place (y, x) lies in row y + x."""
    return np.lib.stride_tricks.as_strided(flat[first:], (height, width), (width * flat.itemsize, (width + 1) * flat.itemsize))


def unfiltered_images(raws: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Images from their filters and filtered rows; those of one width together, one diagonal of all of them at a time."""
    out: list = [None] * len(raws)
    by_width: dict[int, list[int]] = {}
    for k, (_, rows) in enumerate(raws):
        by_width.setdefault(rows.shape[1], []).append(k)
    for width, members in by_width.items():
        members.sort(key=lambda k: -len(raws[k][0]))
        heights = np.array([len(raws[k][0]) for k in members])
        diagonals = heights + width - 1
        first = np.cumsum(diagonals) - diagonals
        flat, filters = np.zeros((diagonals.sum(), width), "u1"), np.zeros((diagonals.sum(), width), "u1")
        for k, f, h in zip(members, first.tolist(), heights.tolist(), strict=True):
            if h:
                _skewed(flat, f, h, width)[:] = raws[k][1]
                _skewed(filters, f, h, width)[:] = raws[k][0][:, None]
        open_ = np.searchsorted(-diagonals, -np.arange(diagonals.max(initial=0)), "left").tolist()  # images that have the diagonal
        # The last two diagonals, with a place without a byte before each; beyond an image's edges all bytes are zero.
        last, before = np.zeros((len(members), width + 1), "u1"), np.zeros((len(members), width + 1), "u1")
        for d, n in enumerate(open_):
            at = first[:n] + d
            kind = filters[at]
            left, above, corner = last[:n, :-1], last[:n, 1:], before[:n, :-1]
            now = flat[at]
            now += left * (kind == 1)
            now += above * (kind == 2)
            now += ((left.astype("u2") + above) >> 1).astype("u1") * (kind == 3)
            if (paeth := kind == 4).any():
                now[paeth] += _paeth(left[paeth].astype("i2"), above[paeth].astype("i2"), corner[paeth].astype("i2"))
            flat[at] = now
            last, before = before, last
            last[:n, 1:] = now
        for k, f, h in zip(members, first.tolist(), heights.tolist(), strict=True):
            out[k] = np.ascontiguousarray(_skewed(flat, f, h, width)) if h else raws[k][1]
    return out


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * GRID))


@lru_cache(maxsize=4096)
def _grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and number of those of n samples that each grid line averages; fewer samples than lines are repeated."""
    first = np.arange(GRID) * n // GRID
    last = np.maximum((np.arange(GRID) + 1) * n // GRID, first + 1)
    return first, last - first


def dct_hash(image: np.ndarray) -> str:
    """Low-frequency cosine-transform hash, 16 hexadecimal digits."""
    (rows, height), (cols, width) = _grid(image.shape[0]), _grid(image.shape[1])
    down = np.concatenate([np.zeros((1, image.shape[1]), "i8"), np.cumsum(image, axis=0, dtype="i8")])
    mean = (down[rows + height] - down[rows]) / height[:, None]
    right = np.concatenate([np.zeros((GRID, 1)), np.cumsum(mean, axis=1)], axis=1)
    mean = (right[:, cols + width] - right[:, cols]) / width
    low = np.round((_cosines() @ mean @ _cosines().T).ravel()[1:], 6)
    bits = np.append(low > np.median(low), False)
    return np.packbits(bits).tobytes().hex()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "adaptive") -> DataFrame:
    """``(id, n_bytes, media binary)``: every text as an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, data), pa.int64()), pa.array([encode_png(padded(x), kind=kind) for x in data], pa.binary())], [id_col, "n_bytes", "media"]
            )

    t = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {t}, n_bytes long, media binary")


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``(id, width, height, feature, error)`` of images in a binary column; a null or a bad image has only its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for data in b.column(1).to_pylist():
                try:
                    _need(data is not None, "null")
                    image = decode_png(data)
                    out.append((image.shape[1], image.shape[0], dct_hash(image), None))
                except ValueError as e:
                    out.append((None, None, None, str(e)))
            cols = [*zip(*out, strict=True)] or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], [id_col, "width", "height", "feature", "error"])

    t = media.schema[id_col].dataType.simpleString()
    return map_batches(media.select(id_col, media_col), run, f"`{id_col}` {t}, width long, height long, feature string, error string")


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of stored images ``(doc_id, n_bytes, media)`` and of the payloads read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in slices(batches, 2000, 2, 1 << 23):
            out, files = [], b.column(2).to_pylist()
            for data, image in zip(files, decode_pngs(files), strict=True):
                payload = image.tobytes()
                out.append((len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), sha(data).hexdigest(), dct_hash(image)))
            cols = [*zip(*out, strict=True)] or [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(media.select("doc_id", "n_bytes", "media"), run, schema)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(store_texts(table(spark, sf_dir, "documents")))

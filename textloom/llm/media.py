"""Media columns: grey-scale PNG images in binary columns, with low-frequency cosine hashes.

``png_encode`` stores bytes as an 8-bit grey PNG: signature, IHDR, the zlib stream cut into IDAT
chunks, IEND, each chunk with its CRC-32. ``png_decode`` walks the chunks, tests every checksum
(CRC-32 of each chunk and zlib's Adler-32), inflates and undoes the row filters with numpy.
``cosine_hash`` averages the picture down to 32 x 32, takes a 2-D cosine transform and compares
its 8 x 8 low frequencies with their median: 64 bits.

Defined cases: a null or empty text is 576 bytes of 255; equal payloads give equal images and
hashes; texts of any length are stored whole; a broken image raises ``ValueError``. Columns other
than the id and text columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents

# fixed values of the PNG format
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 24
BLOCK = WIDTH * 24
PAD = 255
IDAT_BYTES = 1 << 16
_SIDE = 32
_K = np.arange(_SIDE)
_COS = np.cos(np.pi / _SIDE * (_K[None, :] + 0.5) * _K[:8, None])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_encode(samples: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """``samples`` (a positive multiple of ``width`` bytes) as a PNG; rows carry the "up" filter."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    body = np.empty((len(rows), width + 1), np.uint8)
    body[:, 0] = 2
    body[0, 1:] = rows[0]
    np.subtract(rows[1:], rows[:-1], out=body[1:, 1:])
    packed = zlib.compress(body.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    parts = [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def unfilter(body: np.ndarray, width: int) -> np.ndarray:
    """Undo PNG row filters on (rows, 1 + width) bytes of one-byte pixels.

    Runs of rows without a filter or with "up" are undone as a whole by a running sum modulo 256.
    """
    kinds, data = body[:, 0], body[:, 1:]
    if (kinds == 2).all():
        return np.cumsum(data, axis=0, dtype=np.uint8)
    out = np.zeros((len(body) + 1, width), np.uint8)
    for y, kind in enumerate(kinds):
        row, up = data[y], out[y]
        if kind == 0:
            out[y + 1] = row
        elif kind == 1:
            out[y + 1] = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = row + up
        elif kind == 3:
            left, line = 0, out[y + 1]
            for x in range(width):
                left = (int(row[x]) + (left + int(up[x])) // 2) & 255
                line[x] = left
        elif kind == 4:
            left, line = 0, out[y + 1]
            for x in range(width):
                b, c = int(up[x]), int(up[x - 1]) if x else 0
                guess = left + b - c
                near = min((abs(guess - left), 0, left), (abs(guess - b), 1, b), (abs(guess - c), 2, c))[2]
                left = (int(row[x]) + near) & 255
                line[x] = left
        else:
            raise ValueError(f"PNG row filter {kind}")
    return out[1:]


def png_decode(image: bytes) -> np.ndarray:
    """The (rows, width) grey samples of an 8-bit grey PNG; every checksum is tested."""
    if image[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, inflate, parts, ended = 8, None, zlib.decompressobj(), [], False
    while at < len(image):
        if at + 12 > len(image):
            raise ValueError("PNG chunk cut off")
        length, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + length]
        if len(data) < length or image[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError("PNG chunk checksum")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
            if size[2:] != (8, 0, 0, 0, 0):
                raise ValueError("not an 8-bit grey PNG without interlace")
        elif kind == b"IDAT":
            try:
                parts.append(inflate.decompress(data))
            except zlib.error as e:
                raise ValueError(str(e)) from e
        elif kind == b"IEND":
            ended = True
        at += 12 + length
    body = b"".join(parts)
    if size is None or not ended or not inflate.eof or len(body) != size[1] * (size[0] + 1):
        raise ValueError("PNG incomplete")
    return unfilter(np.frombuffer(body, np.uint8).reshape(size[1], size[0] + 1), size[0])


def cosine_hash(picture: np.ndarray) -> bytes:
    """8 bytes: bit k tells if the k-th low frequency (row-major, 8 x 8) exceeds their median."""
    h, w = picture.shape
    total = np.zeros((h + 1, w), np.float64)
    np.cumsum(picture, axis=0, out=total[1:])
    rows = np.arange(_SIDE + 1) * h / _SIDE
    lo = np.minimum(rows.astype(np.int64), h - 1)
    at = total[lo] + (rows - lo)[:, None] * picture[lo]
    cells = np.diff(at, axis=0) * (_SIDE / h)
    cols = (np.arange(_SIDE) * w) // _SIDE
    low = _COS @ cells[:, cols] @ _COS.T
    flat = low.ravel()
    return np.packbits(flat > np.median(flat)).tobytes()


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's padded UTF-8 bytes as a PNG in a binary column."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                ids, texts = (b.column(k).slice(at, 500) for k in range(2))
                sizes, media = [], []
                for t in texts:
                    raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                    sizes.append(len(raw))
                    media.append(png_encode(raw + bytes([PAD]) * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode the ``media`` column and add what is read back: payload size and digests, hash."""
    kind = dict(df.dtypes)[id_col]
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash"]
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for b in batches:
            out = [[] for _ in names[2:]]
            for m in b.column(2):
                image = m.as_buffer().to_pybytes()
                picture = png_decode(image)
                raw = picture.tobytes()
                for put, v in zip(out, (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(image), hashlib.sha256(image).hexdigest(), cosine_hash(picture)), strict=True):
                    put.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(out, types[2:], strict=True))], names)

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary"
    return df.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = encode_column(read_documents(spark, sf_dir))
    return media_features(stored).withColumn("feature", F.lower(F.hex("phash"))).drop("phash")

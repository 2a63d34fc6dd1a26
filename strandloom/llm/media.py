"""Media columns: PNG images in binary columns, decoded with numpy, and perceptual hashes of their pixels.

encode() writes 8-bit grey PNG: filtered rows in one zlib stream, cut into IDAT chunks, each chunk with its CRC.
decode() walks the chunks, tests every checksum, inflates and undoes the five row filters. image_hash() takes block
means of the image, a two-dimensional cosine transform and the signs of its low frequencies against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _arrow_schema, free_name, map_batches, map_text, slices

#: Fixed values of the PNG format: the signature and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Samples in a row, and the multiple that payloads are padded to.
WIDTH = 576
IDAT_BYTES = 1 << 16
#: Rows that are filtered or summed at once.
ROWS = 4096
#: Side of the reduced image and of its block of low frequencies.
SIDE, LOW = 32, 8


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(pixels: np.ndarray, level: int = 4) -> bytes:
    """PNG of a (height, width) uint8 array; each row by the filter of none, sub and up with the least absolute sum."""
    height, width = pixels.shape
    squeeze, body = zlib.compressobj(level), []
    for at in range(0, height, ROWS):
        part = pixels[at : at + ROWS]
        sub, up = part.copy(), part.copy()
        sub[:, 1:] -= part[:, :-1]
        up[1:] -= part[:-1]
        if at:
            up[0] -= pixels[at - 1]
        options = [part, sub, up]
        best = np.array([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in options]).argmin(axis=0)
        rows = np.empty((len(part), width + 1), np.uint8)
        rows[:, 0] = best
        for k, x in enumerate(options):
            rows[best == k, 1:] = x[best == k]
        body.append(squeeze.compress(rows.tobytes()))
    body = b"".join([*body, squeeze.flush()])
    parts = [SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    parts += [chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)]
    return b"".join([*parts, chunk(b"IEND", b"")])


def decode(data: bytes) -> np.ndarray:
    """Samples (height, width * channels) of an 8-bit PNG without interlace; ValueError for what is damaged or of another kind."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut off in a chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(part, zlib.crc32(kind)):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if head is None or not ended:
        raise ValueError("no header or no end")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only 8-bit samples without interlace are read")
    step = CHANNELS[colour]
    size = height * (width * step + 1)
    inflate = zlib.decompressobj()
    try:
        raw = np.frombuffer(inflate.decompress(b"".join(body), size + 1), np.uint8)  # never more than the header promises
    except zlib.error as e:
        raise ValueError("damaged samples") from e
    if len(raw) != size or not inflate.eof:
        raise ValueError("size doesn't fit the header")
    rows = raw.reshape(height, width * step + 1)
    return unfilter(rows[:, 0], rows[:, 1:], step)


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undo row filters: runs of none and sub at once, runs of up by a running sum down the columns, average and Paeth sample by sample."""
    out = rows.copy()
    plain = kinds == 0
    sub = kinds == 1
    if sub.any():
        x = rows[sub].reshape(sub.sum(), -1, step)
        out[sub] = np.cumsum(x, axis=1, dtype=np.uint8).reshape(x.shape[0], -1)
    i = 0
    while i < len(kinds):
        if plain[i] or sub[i]:
            i += 1
            continue
        above = out[i - 1] if i else np.zeros(rows.shape[1], np.uint8)
        if kinds[i] == 2:
            j = i
            while j < len(kinds) and kinds[j] == 2:
                j += 1
            out[i:j] = np.cumsum(rows[i:j], axis=0, dtype=np.uint8) + above
            i = j
            continue
        if kinds[i] > 4:
            raise ValueError("unknown filter")
        now = out[i].astype(np.int64).reshape(-1, step)
        up = above.astype(np.int64).reshape(-1, step)
        left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
        for x in range(len(now)):
            if kinds[i] == 3:
                guess = (left + up[x]) >> 1
            else:
                p = left + up[x] - corner
                a, b, c = abs(p - left), abs(p - up[x]), abs(p - corner)
                guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
            now[x] = (now[x] + guess) & 255
            left, corner = now[x], up[x]
        out[i] = now.reshape(-1)
        i += 1
    return out


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None]
    return np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))


def _means(n: int) -> np.ndarray:
    """(SIDE, n) weights of the means of SIDE equal stretches of n samples."""
    low, high = np.linspace(0, n, SIDE + 1)[:-1, None], np.linspace(0, n, SIDE + 1)[1:, None]
    x = np.arange(n)[None]
    return np.clip(np.minimum(high, x + 1) - np.maximum(low, x), 0, None) * (SIDE / n)


def image_hash(pixels: np.ndarray) -> str:
    """16 hex digits: signs of the lowest 8 x 8 cosine coefficients of the image's block means, against their median without the first."""
    across = _means(pixels.shape[1])
    x = np.concatenate([pixels[i : i + ROWS] @ across.T for i in range(0, len(pixels), ROWS)])
    edges = np.linspace(0, len(x), SIDE + 1)
    sums = np.concatenate((np.zeros((1, SIDE)), np.cumsum(x, axis=0)))
    whole = np.floor(edges).astype(int)
    cut = sums[whole] + (edges - whole)[:, None] * (sums[np.minimum(whole + 1, len(x))] - sums[whole])
    x = np.diff(cut, axis=0) * (SIDE / len(x))
    c = _cosines(SIDE, LOW)
    low = np.round(c @ x @ c.T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload(text: bytes | None) -> np.ndarray:
    """The text's bytes, filled with 255 to a positive multiple of WIDTH, as rows of samples."""
    text = text or b""
    n = max(1, -(-len(text) // WIDTH)) * WIDTH
    out = np.full(n, 255, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(-1, WIDTH)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media binary) for each row: the whole text as a PNG; null and empty texts give one row of filling."""

    def made(_, texts):
        return [[len(t or b"") for t in texts], [encode(payload(t)) for t in texts]]

    return map_text(docs, key, text, made, "n_bytes long, media binary", binary=True)


def media_features(media: DataFrame, column: str = "media") -> DataFrame:
    """media with the columns payload, media_bytes, media_sha256, feature and error; the media column is dropped.

    payload is a struct of what the stored bytes decode to: bytes, sha256, tail_crc32 (of the last 32 samples). Null
    media give nulls; damaged ones give a null payload and feature and say so in error.
    """
    place = media.columns.index(column)
    rest = [f for f in media.schema.fields if f.name != column]
    names = [free_name([f.name for f in rest], n) for n in ("payload", "media_bytes", "media_sha256", "feature", "error")]
    kinds = ["struct<bytes:long,sha256:string,tail_crc32:long>", "long", "string", "string", "string"]
    schema = T.StructType(rest + [T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds, strict=True)])
    arrow = _arrow_schema(schema)

    def one(data):
        if data is None:
            return None, None, None, None, None
        about = len(data), hashlib.sha256(data).hexdigest()
        try:
            pixels = decode(data)
        except (ValueError, zlib.error, struct.error) as e:
            return None, *about, None, str(e)
        raw = pixels.tobytes()
        return {"bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest(), "tail_crc32": zlib.crc32(raw[-32:])}, *about, image_hash(pixels), None

    def run(batches):
        for batch in batches:
            for part in slices(batch, place):
                made = zip(*[one(x) for x in part.column(place).to_pylist()], strict=True)
                own = [part.column(i) for i in range(part.num_columns) if i != place]
                fields = list(arrow)[len(own) :]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(x), f.type) for x, f in zip(made, fields, strict=True))], schema=arrow)

    return map_batches(media, run, schema)


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of the stored form of each row's text: what was stored, what was read back, and the hash of its pixels.

    Equal texts give equal values; repeated rows and null keys stay; a null text counts as empty, a long one is stored
    whole. An empty table gives an empty result; other columns play no part.
    """
    out = media_features(encode_texts(docs, key, text))
    return out.select(key, "n_bytes", F.col("payload.bytes").alias("payload_bytes"), F.col("payload.sha256").alias("payload_sha256"), F.col("payload.tail_crc32").alias("tail_crc32"), "media_bytes", "media_sha256", "feature")

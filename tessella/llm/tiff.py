"""Operator 10: media columns. TIFF files in a binary column become one row per page.

The reader walks the chain of image directories (both byte orders, cycles are cut), decodes strips or tiles
that are raw, PackBits, LZW or deflate, undoes horizontal differencing, joins planes, and gives interleaved
samples of 8 or 16 bits. The writer stores samples in any of these forms without loss.

Null media give no page. Media that are no TIFF, or a page that cannot be decoded, give one row with `error`
set and null samples, so no input is lost. A page without width or height, or one that claims more samples than
its data can hold (MOST for each stored byte), is such a page; no strip is decoded beyond its own samples.
Equal media give equal rows. Only the media column is read.

For op10 a text is the payload of one RGB page 64 pixels wide (192 bytes a row, padded with blanks); the CRC
of the payload picks the form: mostly deflate in strips or tiles, some PackBits, some LZW.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import slices, table, utf8

# Fixed values of the format: tags, field types (letter, bytes), compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE = 322, 323, 324, 325
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 16: ("Q", 8)}
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

ROW, PAD = 192, b" "
STRIP, TILE = 256, (32, 128)
#: Bytes that a stored byte can stand for at most: an LZW code of 9 to 12 bits is a word of under 4,096 bytes.
MOST = 4096


def packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes become repeats, the rest literals of at most 128 bytes."""
    out, at = bytearray(), 0

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = data[i : min(b, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in re.finditer(rb"(?s)(.)\1{2,127}", data):
        literal(at, run.start())
        out += bytes([257 - (run.end() - run.start()), data[run.start()]])
        at = run.end()
    literal(at, len(data))
    return bytes(out)


def unpackbits(data: bytes, most: int = 1 << 62) -> bytes:
    """The bytes of a strip, or their begin if there are most of them before its end."""
    out, i, n, done = [], 0, len(data), 0
    while i < n and done < most:
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += 2 + head
            done += head + 1
        elif head > 128:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i += 2
            done += 257 - head
        else:
            i += 1
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """Variable-width codes, highest bit first, widened one code early."""
    bits, held, width = 0, 0, 9
    out = bytearray()
    codes: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal bits, held
        bits = bits << width | code
        held += width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    def fresh() -> None:
        nonlocal width
        put(256)
        codes.clear()
        codes.update((bytes([i]), i) for i in range(256))
        width = 9

    fresh()
    following, word = 258, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = following
        following += 1
        if following == 4094:
            fresh()
            following = 258
        elif following + 1 > 1 << width:
            width += 1
        word = longer[-1:]
    if word:
        put(codes[word])
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def unlzw(data: bytes, most: int = 1 << 62) -> bytes:
    """The bytes of a strip, or their begin if there are most of them before its end."""
    words: list[bytes] = []
    out: list[bytes] = []
    bits, held, width, last, done = 0, 0, 9, b"", 0
    for byte in data:
        bits = bits << 8 | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            words = [bytes([i]) for i in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if not words:
            raise ValueError("LZW data does not begin with a clear code")
        if not last:
            word = words[code]
        else:
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
        out.append(word)
        last = word
        done += len(word)
        if done >= most:
            break
        if len(words) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, max(1, most))


DECODERS = {RAW: lambda data, most: data[:most], LZW: unlzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpackbits}
ENCODERS = {RAW: bytes, LZW: lzw, DEFLATE: lambda data: zlib.compress(data, 1), PACKBITS: packbits}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP, tile: tuple[int, int] | None = None, big_endian: bool = False) -> bytes:
    """A TIFF file of pages (height, width, samples) of 8 or 16 bits."""
    order = ">" if big_endian else "<"
    body, directories = bytearray(b"\0" * 8), []
    for page in pages:
        height, width, samples = page.shape
        page = page.astype(page.dtype.newbyteorder(order))
        if tile:
            tw, th = tile
            blocks = [np.pad(b, ((0, th - b.shape[0]), (0, tw - b.shape[1]), (0, 0))) for y in range(0, height, th) for x in range(0, width, tw) for b in [page[y : y + th, x : x + tw]]]
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        at, size = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1).astype(page.dtype)
            data = ENCODERS[compression](block.tobytes())
            at.append(len(body))
            size.append(len(data))
            body += data
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * page.dtype.itemsize] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile[0]]), (TILE_HEIGHT, 4, [tile[1]]), (TILE_AT, 4, at), (TILE_SIZE, 4, size)] if tile else [(STRIP_AT, 4, at), (STRIP_ROWS, 4, [strip_rows]), (STRIP_SIZE, 4, size)]
        directories.append(sorted(fields))
    link = 4
    for fields in directories:
        entries = b""
        for tag, kind, values in fields:
            data = struct.pack(f"{order}{len(values)}{TYPES[kind][0]}", *values)
            if len(data) > 4:
                body += b"\0" * (len(body) % 2)
                data, body = struct.pack(f"{order}I", len(body)), body + data
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        body += b"\0" * (len(body) % 2)
        body[link : link + 4] = struct.pack(f"{order}I", len(body))
        body += struct.pack(f"{order}H", len(fields)) + entries
        link = len(body)
        body += b"\0" * 4
    body[:4] = b"MM\0*" if big_endian else b"II*\0"
    return bytes(body)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    fields = {}
    for i in range(n):
        here = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, here)
        if kind in TYPES:
            letter, size = TYPES[kind]
            place = here + 8 if count * size <= 4 else struct.unpack_from(f"{order}I", data, here + 8)[0]
            fields[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place)
    return fields, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, order: str, fields: dict[int, tuple]) -> np.ndarray:
    """The samples of one directory as (height, width, samples)."""
    width, height = fields[WIDTH][0], fields[HEIGHT][0]
    samples, bits = fields.get(SAMPLES, (1,))[0], fields.get(BITS, (1,))
    compression, predictor = fields.get(COMPRESSION, (RAW,))[0], fields.get(PREDICTOR, (1,))[0]
    if set(bits) not in ({8}, {16}) or compression not in DECODERS or predictor not in (1, 2):
        raise ValueError(f"not supported: bits {bits}, compression {compression}, predictor {predictor}")
    dtype = np.dtype(f"{order}u{bits[0] // 8}")
    if not width or not height or not samples:
        raise ValueError(f"a page of {width} by {height} by {samples} samples")
    planes = samples if fields.get(PLANAR, (1,))[0] == 2 else 1
    deep = samples // planes
    tiled = TILE_AT in fields
    tw, th = (fields[TILE_WIDTH][0], fields[TILE_HEIGHT][0]) if tiled else (width, min(fields.get(STRIP_ROWS, (height,))[0], height) or 1)
    places, sizes = (fields[TILE_AT], fields[TILE_SIZE]) if tiled else (fields[STRIP_AT], fields[STRIP_SIZE])
    if not tw or not th or width * height * samples * dtype.itemsize > MOST * sum(sizes):
        raise ValueError(f"{width} by {height} samples in {sum(sizes)} bytes of {tw} by {th}")
    across, down = -(-width // tw), -(-height // th)
    out = np.zeros((height, width, samples), dtype)
    for k, (at, size) in enumerate(zip(places, sizes, strict=True)):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * th, rest % across * tw
        rows = th if tiled else min(th, height - y)
        raw = DECODERS[compression](data[at : at + size], rows * tw * deep * dtype.itemsize)
        block = np.frombuffer(raw, dtype, rows * tw * deep).reshape(rows, tw, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        part = out[y : y + th, x : x + tw, plane * deep : (plane + 1) * deep]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return out


def read_tiff(data: bytes) -> list[tuple[np.ndarray | None, int | None, str | None]]:
    """(samples, compression, error) of each page."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        return [(None, None, "not a TIFF file")]
    pages, seen = [], set()
    try:
        (at,) = struct.unpack_from(f"{order}I", data, 4)
        while at and at not in seen:
            seen.add(at)
            fields, at = _directory(data, order, at)
            try:
                pages.append((_page(data, order, fields), fields.get(COMPRESSION, (RAW,))[0], None))
            except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                pages.append((None, None, f"{type(e).__name__}: {e}"[:200]))
    except struct.error as e:
        pages.append((None, None, f"broken directory: {e}"))
    return pages or [(None, None, "no page")]


PAGE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("samples", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("compression", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])
_ARROW = pa.list_(pa.struct([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary()), ("error", pa.string()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))


def feature(page: np.ndarray) -> str:
    """Shape, mean of each sample and mean step between neighbours, in thousandths and rounded down."""
    height, width, samples = page.shape
    total = page.reshape(-1, samples).sum(axis=0, dtype=np.int64)
    wide = page.astype(np.int32)
    step = int(np.abs(np.diff(wide, axis=1)).sum(dtype=np.int64))
    means = ",".join(str(int(t) * 1000 // max(1, height * width)) for t in total)
    return f"{width}x{height}x{samples};mean={means};step={step * 1000 // max(1, page.size)}"


def _rows(media: bytes) -> list[dict]:
    same = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
    out = []
    for i, (page, compression, error) in enumerate(read_tiff(media)):
        if page is None:
            out.append({"page": i, "error": error} | same)
        else:
            height, width, samples = page.shape
            out.append({"page": i, "width": width, "height": height, "samples": samples, "bits": 8 * page.dtype.itemsize, "compression": compression, "pixels": page.tobytes(), "feature": feature(page)} | same)
    return out


def _read(column: pa.Array) -> pa.Array:
    parts = [pa.array([], _ARROW)]
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        parts.append(pa.array([_rows(data[x:y].tobytes()) if ok else [] for x, y, ok in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), column.slice(a, b - a).is_valid().to_pylist(), strict=True)], _ARROW))
    return pa.concat_arrays(parts)


def _store(column: pa.Array) -> pa.Array:
    data, offsets = utf8(column)
    return pa.array([stored(data[a:b].tobytes()) for a, b in pairwise(offsets.tolist())], pa.binary())


_read.__annotations__ = {"column": pa.Array, "return": pa.Array}
_store.__annotations__ = {"column": pa.Array, "return": pa.Array}


def stored(text: bytes) -> bytes:
    """The TIFF file of a text; its form follows from the payload alone."""
    payload = text + PAD * (-len(text) % ROW or (0 if text else ROW))
    page = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    pick = zlib.crc32(payload) % 16
    form = {0: (LZW, 2, None), 1: (LZW, 1, TILE), 2: (PACKBITS, 1, None), 3: (PACKBITS, 2, TILE)}.get(pick, (DEFLATE, 2, TILE) if pick % 2 else (DEFLATE, 1, None))
    return write_tiff([page], *form[:2], tile=form[2])


def media_pages(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: the columns named in keep and those of PAGE."""
    read = F.arrow_udf(_read, T.ArrayType(PAGE))
    return media.select(*keep, F.explode(read(media_col)).alias("_page")).select(*keep, "_page.*")


def store_text(text) -> "F.Column":
    """The TIFF file of a text column; null counts as empty."""
    return F.arrow_udf(_store, "binary")(F.coalesce(text, F.lit("")))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    media = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), store_text(F.col("text")).alias("media"))
    pages = media_pages(media, keep=("doc_id", "n_bytes"))
    size = F.octet_length("pixels").cast("long")
    return pages.select("doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.expr("substring(pixels, greatest(length(pixels) - 15, 1), 16)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "compression")

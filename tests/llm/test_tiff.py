import hashlib
import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import tiff


@pytest.mark.parametrize("codec", [(tiff.packbits, tiff.unpackbits), (tiff.lzw, tiff.unlzw)])
def test_codecs_round_trip(codec):
    rng = np.random.default_rng(3)
    pack, unpack = codec
    cases = [b"", b"a", b"aaaa" * 3000, b"abcabc" * 2000, rng.integers(0, 256, 30_000, dtype=np.uint8).tobytes(), rng.integers(0, 3, 20_000, dtype=np.uint8).tobytes()]
    cases += [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (*range(250, 270), *range(505, 515), *range(3830, 3842))]
    for data in cases:
        assert unpack(pack(data)) == data


@pytest.mark.parametrize(("dtype", "compression", "predictor"), list(itertools.product((np.uint8, np.uint16), tiff.ENCODERS, (1, 2))))
def test_forms_round_trip(dtype, compression, predictor):
    rng = np.random.default_rng(4)
    pages = [rng.integers(0, np.iinfo(dtype).max, (37, 29, k)).astype(dtype) for k in (1, 3, 4)]
    for tile, big in itertools.product((None, (16, 16)), (False, True)):
        found = tiff.read_tiff(tiff.write_tiff(pages, compression, predictor, strip_rows=7, tile=tile, big_endian=big))
        assert all((a == b).all() and e is None for a, (b, _, e) in zip(pages, found, strict=True))


def test_pages_of_a_column(spark):
    good = tiff.write_tiff([np.full((2, 3, 1), 7, np.uint8), np.zeros((1, 1, 3), np.uint16)])
    cyclic = bytearray(tiff.write_tiff([np.zeros((1, 1, 1), np.uint8)]))
    cyclic[-4:] = cyclic[4:8]
    rows = [(1, good, "x"), (2, None, "x"), (3, b"", "x"), (4, b"II*\0\xff\xff\0\0", "x"), (5, bytes(cyclic), "x"), (6, good[:40], "x")]
    media = spark.createDataFrame(rows, "doc_id long, media binary, page string")
    found = tiff.media_pages(media.select("doc_id", "media"), keep=("doc_id",)).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert [(p.page, p.width, p.height, p.samples, p.bits, bytes(p.pixels)) for p in by[1]] == [(0, 3, 2, 1, 8, b"\7" * 6), (1, 1, 1, 3, 16, b"\0" * 6)]
    assert 2 not in by and len(by[5]) == 1 and by[5][0].error is None
    assert all(by[i][0].error and by[i][0].pixels is None for i in (3, 4, 6))


def test_texts_come_back(odd, empty):
    stored = lambda docs: tiff.media_pages(docs.select("doc_id", tiff.store_text(F.col("text")).alias("media")), keep=("doc_id",))
    want = []
    for r in odd.collect():
        text = (r.text or "").encode()
        want.append(hashlib.sha256(text + b" " * (-len(text) % 192 or (0 if text else 192))).hexdigest())
    assert sorted(hashlib.sha256(bytes(r.pixels)).hexdigest() for r in stored(odd).collect()) == sorted(want)
    assert stored(empty).count() == 0


def test_all_forms_are_used_and_equal_texts_are_equal():
    forms = {tiff.read_tiff(tiff.stored(b"text %d" % i))[0][1] for i in range(200)}
    assert forms == {tiff.DEFLATE, tiff.LZW, tiff.PACKBITS}
    assert tiff.stored(b"same") == tiff.stored(b"same") and zlib.crc32(tiff.stored(b"a")) != zlib.crc32(tiff.stored(b"b"))


def field(data, tag, value):
    """data with another value in the field of that tag of its only directory."""
    out = bytearray(data)
    (at,) = struct.unpack_from("<I", data, 4)
    for i in range(struct.unpack_from("<H", data, at)[0]):
        here = at + 2 + 12 * i
        if struct.unpack_from("<H", data, here)[0] == tag:
            struct.pack_into("<I", out, here + 8, value)
    return bytes(out)


@pytest.mark.parametrize("tag", [tiff.WIDTH, tiff.HEIGHT, tiff.STRIP_ROWS, tiff.SAMPLES])
@pytest.mark.parametrize("value", [0, 0x7FFFFFFF])
def test_forged_sizes_give_an_error_row_or_the_page(tag, value):
    for compression in tiff.ENCODERS:
        page = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
        ((found, _, error),) = tiff.read_tiff(field(tiff.write_tiff([page], compression), tag, value))
        assert (found is None) == (error is not None)
        if tag != tiff.STRIP_ROWS:
            assert error


def test_zip_bombs_are_not_unpacked():
    bomb = zlib.compress(bytes(200 << 20), 9)
    assert len(tiff.inflate(bomb, 192)) == 192
    assert len(tiff.unlzw(tiff.lzw(b"a" * 1_000_000), 5000)) < 10_000
    assert len(tiff.unpackbits(tiff.packbits(b"a" * 1_000_000), 5000)) < 6_000


def test_streams_written_by_hand():
    # 9-bit codes clear, 7, 258 (7 7), 8, end: bits 100000000 000000111 100000010 000001000 100000001
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 257))
    raw = int(bits.ljust(48, "0"), 2).to_bytes(6, "big")
    assert tiff.unlzw(raw) == bytes([7, 7, 7, 8])
    # the example of the format's own description
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpackbits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == plain


def test_a_file_made_by_hand():
    # big-endian, 2 x 1 pixels, one sample of 8 bits, raw, one strip after the directory
    fields = [(256, 4, 2), (257, 4, 1), (258, 3, 8 << 16), (259, 3, 1 << 16), (262, 3, 1 << 16), (273, 4, 8 + 2 + 12 * 8 + 4), (278, 4, 1), (279, 4, 2)]
    data = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 8) + b"".join(struct.pack(">HHII", t, k, 1, v) for t, k, v in fields) + bytes(4) + b"\x05\x09"
    ((page, compression, error),) = tiff.read_tiff(data)
    assert error is None and compression == 1 and page.tolist() == [[[5], [9]]]

"""Operator 4: removal of repeated byte strings with suffix arrays.

A window is LENGTH bytes that start at some byte of a text. Windows that are equal contain the same bytes at
the same places, so the least hash among the GRAM-byte strings of a window (the leftmost of equal ones), its
anchor, is the same for all of them. Consecutive windows with one anchor form a segment. Then:

1. Anchors that occur once in all texts are dropped: none of their windows can repeat.
2. Equal segments are counted. All windows of a segment with copies repeat; one of the copies stands for all below,
   where segments without copies are held against those of the same anchor.
3. Segments go to partitions by anchor. A task takes the stretches whose middle bytes also occur in another segment
   of the anchor, sorts the suffixes of many anchors' stretches at once (two-stage sorting) and reads repeated
   windows off adjacent common prefixes.
4. An anchor with over HOT distinct segments (a passage that very many texts share) never meets in one task:
   its windows are told apart by shared cores, in blocks of 64, 8 and 1, each level a pre-aggregated count.
5. Repeated windows come back to all texts as byte spans and are cut out.

All counts are over all occurrences, copies included; equality is of 128-bit hashes of the bytes, or of the
bytes themselves in suffix arrays. A null text counts as empty; texts under LENGTH bytes are never cut;
repeated rows are copies like any others. Equal texts are worked on once and give equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import MIX, SpanHash, cut, fresh, spans, table, utf8, write_and_read
from tessella.llm.suffixes import repeated

LENGTH, GRAM, HOT = 400, 64, 2_000
#: Bytes of segments whose suffixes are sorted together (a single anchor may exceed it: up to HOT segments).
CHUNK_BYTES = 1 << 20
#: Groups of places that an anchor may have in a window; the windows of one group share all but few bytes.
PARTS = 8
BLOCKS = (64, 8, 1)
#: Words of the passages that are also removed on request, whatever their bytes.
WORDS, GRAM_WORDS = 51, 8
_BYTES = np.arange(256)
_IS_BLANK = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
_IS_LETTER = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
_KIND = np.where(_IS_LETTER, 1, np.where(_IS_BLANK, 2, 0)).astype(np.uint8)
PLACE_BITS = 24
_PLACE = np.uint64((1 << PLACE_BITS) - 1)
#: Groups of one content's segments, at least, and segments of a group if all were of one content.
SALTS, PACKED = 1024, 10_000


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values, from those of 1, 2, 4 and more."""
    n, w = len(values) - width + 1, 1
    while 2 * w <= width:
        values = np.minimum(values[:-w], values[w:])
        w *= 2
    return np.minimum(values[:n], values[width - w : width - w + n])


def segments(data: np.ndarray, hasher: SpanHash, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, place of the anchor and hash of the anchor, for each segment of a text."""
    found = []
    step = 1 << (PLACE_BITS - 1)
    for a in range(0, max(0, len(data) - length + 1), step):
        part = data[a : a + step + length - 1]
        value = hasher.each(hasher.totals(part), gram)
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        ranked = value & ~_PLACE
        ranked |= np.arange(len(value), dtype=np.uint64)
        place = (_least(ranked, length - gram + 1) & _PLACE).view(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        found.append((first + a, np.diff(np.append(first, len(place))), place[first] + a, value[place[first]].view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


def _anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (anchor) of all segments of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            found = [segments(data[a:b], hasher, length, gram)[3] for a, b in pairwise(offsets.tolist()) if b - a >= length]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["anchor"])

    return texts.select("text").mapInArrow(run, "anchor long")


def _occurrences(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (anchor, key, start, n, lead, content) of all segments of (key, text); lead is the anchor's place in a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, digest = SpanHash(), xxhash.xxh3_128_digest
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows, columns, contents, size = [], [], [], 0

            def packed(rows=rows, columns=columns, contents=contents, batch=batch):
                start, n, place, anchor = (np.concatenate([c[i] for c in columns]) for i in range(4))
                keys = batch.column(0).take(pa.array(np.repeat(rows, [len(c[0]) for c in columns])))
                return pa.RecordBatch.from_arrays([pa.array(anchor), keys, pa.array(start), pa.array(n.astype(np.int32)), pa.array((place - start).astype(np.int32)), pa.array(contents, pa.binary())], names=["anchor", "key", "start", "n", "lead", "content"])

            for i, (a, b) in enumerate(pairwise(offsets.tolist())):
                if b - a < length:
                    continue
                text = data[a:b]
                found = segments(text, hasher, length, gram)
                raw = text.tobytes()
                rows.append(i)
                columns.append(found)
                contents += [digest(raw[x : x + n + length - 1]) for x, n in zip(found[0].tolist(), found[1].tolist(), strict=True)]
                size += len(found[0])
                if size > 50_000:
                    yield packed()
                    rows.clear(), columns.clear(), contents.clear()
                    size = 0
            if rows:
                yield packed()

    return texts.mapInArrow(run, "anchor long, key binary, start long, n int, lead int, content binary")


def _pieces(parts: DataFrame, length: int) -> DataFrame:
    """Rows (anchor, key, start, n, lead, copies, contents, bytes) of the segments in parts, of rows (key, text, parts)."""
    names = ("anchor", "start", "n", "lead", "copies", "contents")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, (a, b) in enumerate(pairwise(offsets.tolist())):
                found, raw = batch.column(2)[i].as_py(), data[a:b].tobytes()
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    cut_ = [raw[p["start"] : p["start"] + p["n"] + length - 1] for p in some]
                    columns = [pa.array([p[c] for p in some], kind) for c, kind in zip(names, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(some))), *columns, pa.array(cut_, pa.binary())], names=["key", *names, "bytes"])

    return parts.select("key", "text", "parts").mapInArrow(run, "key binary, anchor long, start long, n int, lead int, copies long, contents long, bytes binary")


def _word_segments(texts: DataFrame) -> DataFrame:
    """Rows (anchor, key, first, n, c, d): segments of consecutive word windows of (key, text), with hashes c and d.

    Its anchor is the least hash among the spans of GRAM_WORDS runs at a window's begin; segments are as in segments().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, digest = SpanHash(), xxhash.xxh3_128_digest
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            offsets = offsets.tolist()
            rows, columns, contents = [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                first, last = word_windows(data[a:b])
                if not len(last):
                    continue
                raw = data[a:b].tobytes()
                value = hasher.of(hasher.totals(data[a:b]), first[0, : first.shape[1] - GRAM_WORDS + 1], first[1, GRAM_WORDS - 1 :])
                value ^= value >> np.uint64(32)
                value *= np.uint64(0xD6E8FEB86659FD93)
                least = _least(value, WORDS - GRAM_WORDS + 1)[: len(last)]
                start = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
                n = np.diff(np.append(start, len(least)))
                rows += [i] * len(start)
                columns.append((start, n, least[start].view(np.int64)))
                contents += [digest(raw[x:y]) for x, y in zip(first[0, start].tolist(), last[start + n - 1].tolist(), strict=True)]
            if rows:
                start, n, anchor = (np.concatenate([c[j] for c in columns]) for j in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), batch.column(0).take(pa.array(rows)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), *_halves(contents)], names=["anchor", "key", "first", "n", "c", "d"])

    return texts.mapInArrow(run, "anchor long, key binary, first int, n int, c long, d long")


def _halves(digests: list[bytes]) -> list[pa.Array]:
    """The first and the last eight bytes of digests of 16."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)]


def word_windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last bytes (two rows) of the runs of letters and digits of a text, and past-last bytes of its windows.

    A word is what white space parts and holds a run; a window goes from the begin of a run to the end of the first run
    of the word WORDS - 1 words on. So signs around a passage, or a text that it follows after a full stop, do not hide it.
    """
    code = _KIND[data]
    kind = np.zeros(len(data) + 2, bool)
    np.equal(code, 1, out=kind[1:-1])
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    runs = np.stack([edge[::2], edge[1::2]])
    if runs.shape[1] < WORDS:
        return runs, edge[:0]
    blanks = np.searchsorted(np.flatnonzero(code == 2), runs[0])
    new = np.append(True, blanks[1:] != blanks[:-1])
    word, head = np.cumsum(new) - 1, np.flatnonzero(new)
    start = word[: np.searchsorted(word, word[-1] - WORDS + 1, "right")]
    return runs, runs[1, head[start + WORDS - 1]]


def _word_windows(parts: DataFrame) -> DataFrame:
    """Rows (c, d, key, at, copies) of all windows of the segments (first, n, copies) of (key, text, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            offsets = offsets.tolist()
            rows, at, copies, hashes = [], [], [], []

            def packed(rows=rows, at=at, copies=copies, hashes=hashes, batch=batch):
                keys = batch.column(0).take(pa.array(np.repeat(rows, [len(x) for x in at])))
                columns = pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(copies))
                return pa.RecordBatch.from_arrays([*_halves(hashes), keys, *columns], names=["c", "d", "key", "at", "copies"])

            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                first, last = word_windows(data[a:b])
                raw, parts = data[a:b].tobytes(), batch.column(2)[i].as_py()
                n = np.array([p["n"] for p in parts])
                w = spans(np.array([p["first"] for p in parts]), n)
                rows.append(i)
                at.append(w)
                copies.append(np.repeat(np.array([p["copies"] for p in parts], np.int64), n))
                hashes += [digest(raw[x:y]) for x, y in zip(first[0, w].tolist(), last[w].tolist(), strict=True)]
                if len(hashes) > 50_000:
                    yield packed()
                    rows.clear(), at.clear(), copies.clear(), hashes.clear()
            if rows:
                yield packed()

    return parts.select("key", "text", "parts").mapInArrow(run, "c long, d long, key binary, at int, copies long")


def passages(texts: DataFrame) -> DataFrame:
    """Rows (key, at, n): runs of n word windows from at on that repeat, of (key, text) with all copies; see _word_segments().

    Segments are as for bytes. A window of an anchor whose segments are not all alike is counted by its hash, over
    as many rows as there are windows.
    """
    all_ = _word_segments(texts)
    same = [F.min(h) == F.max(h) for h in ("c", "d")]
    anchors = all_.groupBy("anchor").agg(F.count("*").alias("m"), (same[0] & same[1]).alias("alike")).where("m > 1").select("anchor", "alike")
    kept = write_and_read(all_.join(write_and_read(anchors), "anchor").select("key", "first", "n", "alike"))
    alike = kept.where("alike").select("key", F.col("first").alias("at"), "n").distinct()
    mixed = kept.where("not alike").groupBy("key", "first", "n").agg(F.count("*").alias("copies"))
    parts = mixed.groupBy("key").agg(F.collect_list(F.struct("first", "n", "copies")).alias("parts"))
    # joined before copies go, so that texts are sorted by their keys once
    open_ = write_and_read(_word_windows(texts.join(parts, "key").dropDuplicates(["key"])))
    often = open_.groupBy("c", "d").agg(F.sum("copies").alias("m")).where("m > 1").select("c", "d")
    return alike.unionByName(open_.join(often, ["c", "d"]).select("key", "at", F.lit(1).alias("n")))


def _runs(flags: np.ndarray) -> list[int]:
    """First and past-last places of the runs of true values, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge.tolist()


def stretches(text: np.ndarray, first: np.ndarray, anchor: np.ndarray, n: np.ndarray, lead: np.ndarray, copies: np.ndarray, length: int, gram: int, hasher: SpanHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, first and past-last window of the runs of windows that may be equal to windows of another segment.

    first is where each segment begins in text. Windows whose anchors stand at places of one of PARTS groups share all
    bytes but few at both ends; a group whose shared bytes no other segment of its anchor has is left out, as is
    one that segments with copies alone have, all of whose windows are known to repeat.
    """
    step = -(-(length - gram + 1) // PARTS)
    low, high = (lead - n + 1) // step, lead // step
    count = high - low + 1
    row = np.repeat(np.arange(len(n)), count)
    part = spans(low, count)
    begin = first[row] + lead[row] - part * step
    key = hasher.of(hasher.totals(text), begin, begin + length - step + 1)
    key = (key ^ (anchor[row].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * MIX + part.astype(np.uint64)
    _, group = np.unique(key, return_inverse=True)
    several, alone = np.bincount(group), np.bincount(group, copies[row] == 1)
    open_ = np.flatnonzero((several[group] > 1) & (alone[group] > 0))
    # from the last group to the first, windows are in order
    order = open_[np.lexsort((-part[open_], row[open_]))]
    row, part = row[order], part[order]
    a = np.maximum(0, lead[row] - (part + 1) * step + 1)
    z = np.minimum(n[row], lead[row] - part * step + 1)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (a[1:] != z[:-1])
    head = np.flatnonzero(new)
    return row[head], a[head], z[np.append(head[1:], len(row)) - 1] if len(row) else z


def _by_suffixes(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (key, start, runs): repeated windows of the segments without copies among those of each anchor, by suffix array."""

    def solved(rows: list[tuple], hasher: SpanHash) -> pa.RecordBatch:
        anchor, n, lead, copies = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        sizes = n + length - 1
        text, first = np.frombuffer(b"".join(r[6] for r in rows), np.uint8), np.cumsum(sizes) - sizes
        row, a, z = stretches(text, first, anchor, n, lead, copies, length, gram, hasher)
        sizes = z - a + length - 1
        text, first = text[spans(first[row] + a, sizes)], np.cumsum(sizes) - sizes
        valid, weight = np.zeros(len(text), bool), np.repeat(copies[row], sizes)
        valid[spans(first, z - a)] = True
        found = repeated(text, valid, weight, length, hasher)
        runs: dict[int, list[int]] = {}
        for i in np.flatnonzero(copies[row] == 1).tolist():
            at = _runs(found[first[i] : first[i] + z[i] - a[i]])
            if at:
                runs.setdefault(int(row[i]), []).extend((np.array(at) + a[i]).tolist())
        return pa.RecordBatch.from_arrays([pa.array([rows[i][4] for i in runs], pa.binary()), pa.array([rows[i][5] for i in runs], pa.int64()), pa.array(runs.values(), pa.list_(pa.int64()))], names=["key", "start", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rows, size = SpanHash(), [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > CHUNK_BYTES and r[0] != rows[-1][0]:
                    yield solved(rows, hasher)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[6])
        if rows:
            yield solved(rows, hasher)

    sorted_ = pieces.select("anchor", "n", "lead", "copies", "key", "start", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return sorted_.mapInArrow(run, "key binary, start long, runs array<long>")


def _blocks(active: DataFrame, block: int, length: int) -> DataFrame:
    """Rows (core, whole, key, start, a, z, copies): the windows a to z of a segment that lie in one block.

    active has a row for each segment, with its open runs of windows (a, z) and what each stands for (n).
    Blocks are laid out from the anchor, so equal windows are in blocks of one number. core hashes the bytes
    that all windows of the block share, whole those of all of its windows that are in the segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            out: list[tuple] = []
            for anchor, key, start, lead, raw, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for run_ in runs:
                    a, end, copies = run_["a"], run_["z"], run_["n"]
                    while a < end:
                        number = (a - lead) // block
                        z = min(end, (number + 1) * block + lead)
                        mark = b"%d %d " % (anchor, number)
                        core = digest(mark + raw[(number + 1) * block + lead - 1 : number * block + lead + length])
                        out.append((core, digest(mark + b"%d %d " % (a - lead, z - lead) + raw[a : z - 1 + length]), key, start, a, z, copies))
                        a = z
            kinds = pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
            names = ["core", "whole", "key", "start", "a", "z", "copies"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return active.select("anchor", "key", "start", "lead", "bytes", "runs").mapInArrow(run, "core binary, whole binary, key binary, start long, a long, z long, copies long")


def _by_blocks(pieces: DataFrame, length: int) -> DataFrame:
    """Rows (key, start, runs) for anchors with very many segments; no task holds the segments of one anchor."""
    pieces = write_and_read(pieces)
    active = pieces.withColumn("runs", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("z"), F.col("copies").alias("n"))))
    found: DataFrame | None = None
    for block in (b for b in BLOCKS if b <= length // 2):
        rows = write_and_read(_blocks(active, block, length))
        counted = rows.groupBy("core", "whole").agg(F.sum("copies").alias("n"), F.min(F.struct("key", "start", "a", "z")).alias("one"))
        hits = rows.join(counted.where("n > 1").select("core", "whole"), ["core", "whole"]).select("key", "start", "a", "z")
        found = hits if found is None else found.unionByName(hits)
        if block > 1:
            # of each kind of block in a core with several kinds one goes on, with the count of all it stands for
            several = counted.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core")
            open_ = counted.join(several, "core").groupBy("one.key", "one.start").agg(F.sort_array(F.collect_list(F.struct("one.a", "one.z", "n"))).alias("runs"))
            active = pieces.join(open_, ["key", "start"])
    return found.groupBy("key", "start").agg(F.flatten(F.sort_array(F.collect_list(F.array("a", "z")))).alias("runs"))


def _settled(kept: DataFrame, distinct: DataFrame) -> DataFrame:
    """Rows (key, start, n) of the segments in kept whose content has copies.

    A passage that very many texts share has as many segments of one content. They are packed into groups of bounded
    size, so that the join meets groups, and unpacked in even parts.
    """
    salts = max(SALTS, kept.count() // PACKED)
    packed = kept.groupBy("content", F.pmod(F.xxhash64("key"), F.lit(salts)).alias("salt")).agg(F.collect_list(F.struct("key", "start", "n")).alias("rows"))
    found = packed.join(distinct.where("copies > 1").select("content"), "content", "left_semi")
    return found.select("rows").hint("rebalance").select(F.inline("rows"))


def _key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _spans(found: pa.ListArray, i: int, length: int) -> list[tuple[int, int]]:
    """The maximal covered runs of bytes of text i, from the repeated windows of its segments (start, runs)."""
    if not found[i].is_valid:
        return []
    some = found.values.slice(found.offsets[i].as_py(), found.value_lengths()[i].as_py())
    runs = some.field("runs")
    pairs = runs.flatten().to_numpy().reshape(-1, 2)
    start = np.repeat(some.field("start").to_numpy(), runs.value_lengths().to_numpy() // 2)
    return _joined(start + pairs[:, 0], start + pairs[:, 1] - 1 + length)


def _word_spans(data: np.ndarray, found: pa.ListArray, i: int) -> list[tuple[int, int]]:
    """The bytes of the runs of word windows (at, n) of text i."""
    if not found[i].is_valid:
        return []
    some = found.values.slice(found.offsets[i].as_py(), found.value_lengths()[i].as_py())
    first, last = word_windows(data)
    at, n = some.field("at").to_numpy(), some.field("n").to_numpy()
    return _joined(first[0, at], last[at + n - 1])


def _joined(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Spans of bytes in order, those that touch as one."""
    if not len(begin):
        return []
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate(end[order])
    head = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    return list(zip(begin[head].tolist(), end[np.append(head[1:], len(end)) - 1].tolist(), strict=True))


def _without(raw: bytes, spans: list[tuple[int, int]], whole_signs: bool) -> bytes:
    """The bytes outside the spans; with whole_signs a sign that a span cuts through stays whole."""
    out, at = [], 0
    for a, b in spans:
        if whole_signs:
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, words: bool = False) -> DataFrame:
    """Rows (key, n_removed, n_spans, kept_sha256, kept) of the distinct texts that lose bytes.

    key is the first half of the text's SHA-256; kept is the remaining text, without halves of signs.
    With words, kept is without the passages of WORDS words and more that repeat, too, if shorter than length as well; the
    numbers and the digest are of the repeats of length bytes alone, so a text that loses words only has none removed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(_key(text).alias("key"), text.alias("text"))
    long = docs.select(_key(text).alias("key"), text.alias("text")).where(F.octet_length("text") >= length)
    anchors = _anchors(long, length, gram).groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor")
    # written, so that the join shuffles both sides and may split a frequent anchor's rows
    kept = write_and_read(_occurrences(long, length, gram).join(write_and_read(anchors), "anchor"))
    distinct = cut(kept.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("key", "start", "n", "lead")).alias("one")))
    per_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("contents"), F.min("copies").alias("fewest")).where("contents > 1 and fewest = 1")
    open_ = distinct.join(per_anchor.select("anchor", "contents"), "anchor").select("anchor", "copies", "contents", "one.*")
    keys, source = kept.select("key"), long
    if words:
        in_words = write_and_read(passages(every).groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("passages")))
        keys, source = keys.unionByName(in_words.select("key")), every
    texts = write_and_read(source.join(keys.distinct(), "key", "left_semi").dropDuplicates(["key"]))

    def pieces(some: DataFrame) -> DataFrame:
        needed = some.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "n", "lead", "copies", "contents")).alias("parts"))
        return _pieces(texts.join(needed, "key"), length)

    few = _by_suffixes(pieces(open_.where(F.col("contents") <= hot)), length, gram)
    found = few.unionByName(_by_blocks(pieces(open_.where(F.col("contents") > hot)), length))
    whole = _settled(kept, distinct).groupBy("key", "start").agg(F.first("n").cast("long").alias("n")).select("key", "start", F.array(F.lit(0).cast("long"), "n").alias("runs"))
    spanned = whole.unionByName(found).groupBy("key").agg(F.collect_list(F.struct("start", "runs")).alias("starts"))
    if words:
        spanned = spanned.join(in_words, "key", "full_outer")
    else:
        spanned = spanned.withColumn("passages", F.lit(None).cast("array<struct<at: int, n: int>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, in_words_ = batch.column(0), batch.column(2), batch.column(3)
            out: list[tuple] = []
            data, offsets = utf8(batch.column(1))
            offsets = offsets.tolist()
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                raw = data[a:b].tobytes()
                cuts = _spans(starts, i, length)
                kept_bytes = _without(raw, cuts, False)
                counts = len(raw) - len(kept_bytes), len(cuts), hashlib.sha256(kept_bytes).hexdigest()
                if more := _word_spans(data[a:b], in_words_, i):
                    cuts = _joined(*np.array(cuts + more).T)
                out.append((*counts, _without(raw, cuts, True).decode()))
            kinds = pa.int64(), pa.int64(), pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.join(spanned, "key").select("key", "text", "starts", "passages").mapInArrow(run, "key binary, n_removed long, n_spans long, kept_sha256 string, kept string")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remaining: bool = False, **how) -> DataFrame:
    """Rows (id_col, n_bytes, n_removed, n_spans, kept_sha256) of all documents, if remaining with (text), what is left of it.

    text is null where it was, and without the passages of words too if these are asked for; see repeats().
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = [F.col(text_col).alias("text")] if remaining else []
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"), _key(text).alias("key"), *whole)
    found = repeats(docs, text_col, **how)
    found = rows.join(found if remaining else found.drop("kept"), "key", "left")
    left = [F.coalesce("kept", "text").alias("text")] if remaining else []
    return found.select(id_col, "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), *left)


def without_repeats(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """All documents with all their columns; the text column without its repeated bytes (null stays null)."""
    key, kept = fresh(docs, "_key", "_kept")
    found = repeats(docs, text_col, **how).select(F.col("key").alias(key), F.col("kept").alias(kept))
    joined = docs.withColumn(key, _key(F.coalesce(F.col(text_col), F.lit("")))).join(found, key, "left")
    return joined.withColumn(text_col, F.coalesce(kept, text_col)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers and digests of repeats of LENGTH bytes, and the text without these and without passages of WORDS words that repeat."""
    return removed(table(spark, sf_dir, "documents"), remaining=True, words=True)

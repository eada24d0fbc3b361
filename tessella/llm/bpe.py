"""Operator 1: byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut at character-class borders by array operations, equal pieces are encoded once a slice,
pieces of like length stand in one matrix, and in each round every row merges its leftmost pair of least
rank; pair ranks come from an open-addressed hash table, and finished rows leave the matrix.

Null text counts as empty and gives no ids; repeated rows give repeated results; other columns are not
read, so their names cannot clash. A piece of over LONG_PIECE bytes (one run of letters, say) would need
as many rounds as it has bytes; such rare pieces are merged with a heap, with the same result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import MIX, SpanHash, by_value, slices, spans, table, utf8

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
LONG_PIECE = 1024
NO_RANK = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
#: Cells of a matrix that is merged at once.
CELLS = 1 << 21


def character_classes() -> np.ndarray:
    """The class of each code point in the pattern that precedes the merges: letter, number, white space, other."""
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, points))
    single = {bytes([b]): b for b in range(256)}
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(probe.encode_ordinary(everything)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


class Vocabulary:
    """Ranks as arrays: byte ids, a hash table from pairs of ids to the merged id, and the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, EMPTY, np.uint64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        self._fill(np.array(keys, np.uint64), np.array(values, np.int32))
        n = max(ranks.values()) + 1
        ordered = [b""] * n
        for token, rank in ranks.items():
            ordered[rank] = token
        self.token_len = np.array([len(t) for t in ordered], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(ordered), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        at, mask = self._slot(keys), (1 << self.bits) - 1
        while len(keys):
            free = np.flatnonzero(self.keys[at] == EMPTY)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NO_RANK if there is none (negative ids are padding)."""
        keys = (left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).view(np.uint64)
        at, mask = self._slot(keys), (1 << self.bits) - 1
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found != EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != EMPTY)]
        return out


def pieces(points: np.ndarray, classes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in joined texts; a piece ends where the next one starts.

    The pattern: an apostrophe with s, t, re, ve, m, ll or d; runs of letters, of numbers or of other signs,
    each with at most one blank before it; white space, whose last sign is left to what follows it.
    """
    n = len(points)
    kind = classes[points]
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    opens = np.zeros(n + 1, bool)
    opens[text_starts] = True
    opens[n] = True
    first |= opens[:n]
    run = np.flatnonzero(first)
    length = np.diff(np.append(run, n))
    of = kind[run]
    follows = ~opens[run + length]  # the next run is of the same text
    start = first.copy()
    space = (of == SPACE) & follows
    last = run[space] + length[space] - 1
    start[last] = True
    joined = points[last] == 0x20
    start[last[joined] + 1] = False
    lone = np.flatnonzero((of == OTHER) & (length == 1) & follows & (points[run] == 0x27) & start[run])
    if len(lone):
        lone = lone[of[lone + 1] == LETTER]
        at, room = run[lone], length[lone + 1]
        one = points[at + 1]
        two = np.where(room >= 2, points[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        taken = np.where(short, 1, np.where(long, 2, 0))
        hit = taken > 0
        at, room, taken = at[hit], room[hit], taken[hit]
        start[at + 1] = False
        more = room > taken
        start[(at + 1 + taken)[more]] = True
    return np.flatnonzero(start)


def _merged(matrix: np.ndarray, vocabulary: Vocabulary) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Merge all rows to the end: (row numbers, ids) of each width at which rows were finished."""
    rows = np.arange(len(matrix))
    done_rows, done_ids = [], []
    ranks = vocabulary.ranks(matrix[:, :-1].ravel(), matrix[:, 1:].ravel()).reshape(len(matrix), -1)
    while len(rows):
        width = matrix.shape[1]
        if width == 1:
            done_rows.append(rows)
            done_ids.append(matrix)
            break
        best = ranks.argmin(axis=1)
        rank = ranks[np.arange(len(rows)), best]
        live = rank != NO_RANK
        if not live.all():
            done_rows.append(rows[~live])
            done_ids.append(matrix[~live])
            rows, matrix, ranks, best, rank = rows[live], matrix[live], ranks[live], best[live], rank[live]
            if not len(rows):
                break
        each = np.arange(len(rows))
        matrix[each, best] = rank
        keep = np.ones(matrix.shape, bool)
        keep[each, best + 1] = False
        matrix = matrix[keep].reshape(len(rows), width - 1)
        keep = keep[:, 1:]  # the pair that went is the one in the middle
        ranks = ranks[keep].reshape(len(rows), width - 2)
        left = best > 0
        ranks[each[left], best[left] - 1] = vocabulary.ranks(matrix[each[left], best[left] - 1], rank[left])
        right = best < width - 2
        ranks[each[right], best[right]] = vocabulary.ranks(rank[right], matrix[each[right], best[right] + 1])
    return done_rows, done_ids


def _merged_long(ids: list[int], vocabulary: Vocabulary) -> list[int]:
    """One long piece: the same merges, the next one taken from a heap of (rank, place)."""
    n = len(ids)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    start = np.array(ids, np.int32)
    heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(vocabulary.ranks(start[:-1], start[1:])) if r != NO_RANK]
    heapq.heapify(heap)
    alive = [True] * n

    def push(i: int, j: int) -> None:
        r = int(vocabulary.ranks(np.array([ids[i]], np.int32), np.array([ids[j]], np.int32))[0])
        if r != NO_RANK:
            heapq.heappush(heap, (r, i, ids[i], ids[j]))

    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = rank, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            push(i, after[i])
        if before[i] >= 0:
            push(before[i], i)
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


def encode_pieces(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, one after another, and how many each has."""
    count = np.ones(len(starts), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    single = np.flatnonzero(lengths == 1)
    found.append((single, vocabulary.byte_id[data[starts[single]]].reshape(-1, 1)))
    bucket = np.where(lengths <= 24, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    order = np.argsort(bucket, kind="stable")
    widths, first = np.unique(bucket[order], return_index=True)
    for width, group in zip(widths, np.split(order, first[1:]), strict=True):
        if width <= 1:
            continue
        if width > LONG_PIECE:
            for i in group:
                ids = vocabulary.byte_id[data[starts[i] : starts[i] + lengths[i]]].tolist()
                found.append((np.array([i]), np.array([_merged_long(ids, vocabulary)], np.int32)))
            continue
        step = max(1, CELLS // int(width))
        for a in range(0, len(group), step):
            part = group[a : a + step]
            matrix = np.full((len(part), width), -1, np.int32)
            filled = np.arange(width) < lengths[part][:, None]
            matrix[filled] = vocabulary.byte_id[data[spans(starts[part], lengths[part])]]
            found += [(part[r], m) for r, m in zip(*_merged(matrix, vocabulary), strict=True)]
    for rows, ids in found:
        count[rows] = (ids >= 0).sum(axis=1)
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int32)
    for rows, ids in found:
        out[spans(at[rows], count[rows])] = ids[ids >= 0]
    return out, count


class Codec:
    """Encodes and decodes slices of texts; made in each task from broadcast arrays."""

    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray) -> None:
        self.vocabulary, self.classes = vocabulary, classes
        self.hashes = SpanHash(), SpanHash(0xD6E8FEB86659FD93)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and n + 1 offsets into them."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), n)
        begins = np.searchsorted(byte_at, offsets[:-1][np.diff(offsets) > 0])
        starts = byte_at[pieces(points, self.classes, begins)]
        lengths = np.diff(np.append(starts, n))
        h1, h2 = (h.of(h.totals(data), starts, starts + lengths) for h in self.hashes)
        _, first, which = np.unique(h1, return_index=True, return_inverse=True)
        if (h2[first][which] != h2).any():  # two pieces share one hash: tell them apart by both
            _, first, which = np.unique(np.stack([h1, h2], 1), axis=0, return_index=True, return_inverse=True)
        ids, count = encode_pieces(data, starts[first], lengths[first], self.vocabulary)
        at = np.cumsum(count) - count
        each = count[which]
        out = ids[spans(at[which], each)]
        total = np.append(0, np.cumsum(each))
        return out, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        v = self.vocabulary
        return v.token_bytes[spans(v.token_at[ids], v.token_len[ids])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


_FIELDS = [("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def encode_documents(docs: DataFrame, rank_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids_sha256", "decoded_sha256")) -> DataFrame:
    """Encode each whole text and decode its ids again: id_col, n_tokens and the columns named in keep.

    keep may name ids (little-endian unsigned 32-bit integers), decoded (the decoded bytes) and the SHA-256
    of either. The rank file (about 1 MB) is read on the driver and broadcast; nothing is shuffled.
    """
    spark = docs.sparkSession
    shared = by_value(spark, (Vocabulary(read_ranks(rank_file or default_path())), character_classes()))
    names = ("n_tokens", *keep)
    kinds = dict(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared())
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ids, id_at = codec.encode(part, at)
                raw = codec.decode(ids).tobytes()
                byte_at = np.append(0, np.cumsum(codec.vocabulary.token_len[ids]))[id_at]
                packed = ids.astype("<u4").tobytes()
                out: dict[str, list] = {"n_tokens": np.diff(id_at).tolist()}
                bounds = [("ids", packed, id_at * 4), ("decoded", raw, byte_at)]
                for name, whole, ends in bounds:
                    cells = [whole[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    out[name] = cells
                    out[f"{name}_sha256"] = [hashlib.sha256(c).hexdigest() for c in cells] if f"{name}_sha256" in names else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(out[n], kinds[n]) for n in names)], names=[id_col, *names])

    sql = {"n_tokens": "long", "ids": "binary", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} {sql[n]}" for n in names)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))

"""Which entries of a dictionary stand in texts: many patterns against many texts, without a product of both.

The dictionary is dealt to parts of at most PART_SIGNS signs. A part is one automaton after Aho and Corasick, as flat
arrays: its states are the beginnings of the patterns, and a table leads from each state and sign to the longest
beginning that the text then ends with. A task reads many texts at once: at each step one look-up moves all of them by a
sign. Long texts are cut into stretches that overlap by the longest pattern, so a step always has many texts to move.

Null and empty texts hold nothing; null and empty patterns are found nowhere; equal patterns are found each. Signs are
code points; places count from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Signs of the patterns of one part; signs of a stretch and of the stretches that are read at once.
PART_SIGNS, STRETCH, TOGETHER = 1 << 19, 2048, 1 << 21


class Automaton:
    """The patterns of one part; patterns are told apart by their places in the list."""

    def __init__(self, patterns: list[str]) -> None:
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in patterns]
        self.sizes = np.array([len(c) for c in codes], np.int64)
        joined, first = np.concatenate([np.zeros(0, np.uint32), *codes]), np.cumsum(self.sizes) - self.sizes
        self.alphabet = np.unique(joined)
        signs = np.searchsorted(self.alphabet, joined) + 1  # 0 is any other sign
        width = len(self.alphabet) + 1
        # level by level: the beginnings of one length, their parents and last signs
        node, here, depth = np.zeros(len(codes), np.int64), np.flatnonzero(self.sizes), 0
        levels, count, ends = [], 1, np.zeros(len(codes), np.int64)
        while len(here):
            found, at = np.unique(node[here] * width + signs[first[here] + depth], return_inverse=True)
            node[here] = count + at
            levels.append((found // width, found % width, count))
            count += len(found)
            depth += 1
            over = here[self.sizes[here] == depth]
            ends[over] = node[over]
            here = here[self.sizes[here] > depth]
        self.table = np.zeros((count, width), np.int32)
        fail = np.zeros(count, np.int64)
        #: the longest other beginning that a state ends with and at which patterns end
        self.shorter = np.zeros(count, np.int64)
        ended = np.zeros(count, bool)
        ended[ends[self.sizes > 0]] = True
        for parent, sign, start in levels:
            child = np.arange(start, start + len(parent))
            # a level's states follow the table of their longest other beginning, which is of a level before
            fail[child] = np.where(parent == 0, 0, self.table[fail[parent], sign])
            self.table[parent, sign] = child
            self.table[child] = self.table[fail[child]]
            self.shorter[child] = np.where(ended[fail[child]], fail[child], self.shorter[fail[child]])
        order = np.argsort(ends, kind="stable")
        order = order[self.sizes[order] > 0]
        self.by_state, self.first_of = order, np.searchsorted(ends[order], np.arange(count + 1))
        self.hit = ended | (self.shorter > 0)
        self.longest = int(self.sizes.max(initial=0))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pattern and end (signs up to the pattern's last one) of all places where patterns stand."""
        whole = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        at = np.searchsorted(self.alphabet, whole)
        at[at == len(self.alphabet)] = 0
        signs = np.where(self.alphabet[at] == whole, at + 1, 0) if len(self.alphabet) else np.zeros(len(whole), np.int64)
        many = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(texts)), many)
        start = STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
        # a stretch begins earlier by the longest pattern; what ends before its own signs is the stretch's before it
        early = np.minimum(start, max(0, self.longest - 1))
        size = early + np.minimum(STRETCH, sizes[text] - start)
        order = np.argsort(-size, kind="stable")
        text, start, early, size = text[order], start[order], early[order], size[order]
        base, state = begin[text] + start - early, np.zeros(len(text), np.int64)
        rows, ends, states = [], [], []
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -step))  # longer ones come first
            moved = self.table[state[:live], signs[base[:live] + step]]
            state[:live] = moved
            met = np.flatnonzero(self.hit[moved] & (step >= early[:live]))
            if len(met):
                rows.append(text[met])
                ends.append(start[met] - early[met] + step + 1)
                states.append(moved[met].astype(np.int64))
        none = np.zeros(0, np.int64)
        row, end, state = (np.concatenate([none, *x]) for x in (rows, ends, states))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, none)]
        while len(state):
            many = self.first_of[state + 1] - self.first_of[state]
            place = np.repeat(np.arange(len(state)), many)
            pattern = self.by_state[self.first_of[state][place] + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)]
            out.append((row[place], pattern, end[place]))
            more = self.shorter[state] > 0
            row, end, state = row[more], end[more], self.shorter[state[more]]
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def parts(patterns: DataFrame, entry: str, pattern: str, size: int = PART_SIGNS) -> Iterator[tuple[list, list[str]]]:
    """The ids and patterns of each part, one part in the driver at a time. A part is what one task broadcasts; a longer pattern is a part by itself."""
    rows = patterns.where(F.length(pattern) > 0).select(F.col(entry).alias("entry"), F.col(pattern).alias("pattern"))
    total = rows.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("n")).first().n
    count = -(-total // size) or 1
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("entry", "pattern"), F.lit(count))).repartition("part").sortWithinPartitions("part")
    out: list[tuple[list, list[str]]] = []
    last, held = None, 0
    for row in dealt.toLocalIterator(prefetchPartitions=False):
        if row.part != last or held > size:
            if out:
                yield out.pop()
            out.append(([], []))
            last, held = row.part, 0
        out[-1][0].append(row.entry)
        out[-1][1].append(row.pattern)
        held += len(row.pattern)
    if out:
        yield out.pop()


def found(texts: DataFrame, by: list[str], text: str, patterns: DataFrame, entry: str = "entry", pattern: str = "pattern", words: bool = False, size: int = PART_SIGNS) -> DataFrame:
    """Rows (by, entry, first, times): entries (entry, pattern) that stand in a text, their first place and how often they stand there.

    words: only where neither a letter, a digit nor `_` stands before or behind. The texts are read once for each part.
    """
    names, schema = [*by, entry], ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in by), f"`{entry}` {patterns.schema[entry].dataType.simpleString()}", "first long", "times long"])
    spark, out = texts.sparkSession, None
    for ids, listed in parts(patterns, entry, pattern, size):
        packed = spark.sparkContext.broadcast(cloudpickle.dumps((pa.array(ids, to_arrow_type(patterns.schema[entry].dataType)), listed)))
        rows = _one(texts.select(*by, text), packed, names, schema, words)
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema) if out is None else out


def _one(texts: DataFrame, packed, names: list[str], schema: str, words: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, listed = cloudpickle.loads(packed.value)
        automaton = Automaton(listed)
        for batch in batches:
            column, a = batch.column(len(names) - 1), 0
            lengths = [len(t) if (t := x.as_py()) is not None else 0 for x in column]
            while a < len(batch):
                b, held = a, 0
                while b < len(batch) and (b == a or held + lengths[b] <= TOGETHER):
                    held += lengths[b]
                    b += 1
                some = [t or "" for t in column.slice(a, b - a).to_pylist()]
                row, which, end = automaton.read(some)
                if words:
                    part = lambda r, i: 0 <= i < len(some[r]) and (some[r][i].isalnum() or some[r][i] == "_")
                    whole = np.array([not part(r, e) and not part(r, e - n - 1) for r, e, n in zip(row.tolist(), end.tolist(), automaton.sizes[which].tolist(), strict=True)], bool)
                    row, which, end = row[whole], which[whole], end[whole]
                key, inverse, times = np.unique(row * len(listed) + which, return_inverse=True, return_counts=True)
                first = np.full(len(key), np.iinfo(np.int64).max)
                np.minimum.at(first, inverse, end - automaton.sizes[which] + 1)
                row, which = key // max(1, len(listed)), key % max(1, len(listed))
                held_rows = batch.slice(a, b - a)
                columns = [held_rows.column(i).take(pa.array(row)) for i in range(len(names) - 1)]
                yield pa.RecordBatch.from_arrays([*columns, ids.take(pa.array(which)), pa.array(first), pa.array(times)], names=[*names, "first", "times"])
                a = b

    return texts.mapInArrow(run, schema)

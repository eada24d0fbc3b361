"""Near copies by the similarity of word shingles: pairs of texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more.

A SimHash of 64 bits cannot find them: two such sets differ in about ten bits, and no choice of blocks that are
equal keeps pairs that far apart and is selective; distances to pivots are alike for almost all fingerprints.
Candidates share one of BANDS keys instead, each made of ROWS minima of hashed shingles; a pair of similarity 0.8
shares none with a probability of (1 - 0.8 ** 12) ** 128, about one in 10,000, and one of 0.85 in 300 million, while texts that
have half of their shingles in common, as of a passage that very many texts hold, hardly ever share a key. Every
candidate is verified by its exact similarity.

Only distinct texts are compared (told apart by 64-bit hashes). The centre of a key is its text that shares the most
keys with others: among edited copies of one text that is the text itself. Each text is held against the best centre
of its keys, then what is not yet of one component against the centre of each key. What is still apart meets on its
rarest shingles: of two similar sets x and y at most a fifth of each is not in the other, and in one of them no more
than an eighth, since both together are at most (|x| + |y|) / 9. So a pair shares one of the rarest eighth of one and of
the rarest fifth of the other; texts that have much in common, but each more than that of its own, never meet. These
shingles have centres first, as keys have. Of the pairs that are left, those go on whose bitmaps (a bit for each of BITS parts of
the hashes) differ in no more bits than similar sets can have shingles apart.

Words and their case are as in operator 6; fewer than five words are one shingle, and wordless and null texts are
equal to one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, done, slices, utf8, write_and_read
from tessella.llm.components import components
from tessella.llm.simhash import chosen, classes

SHINGLE, BANDS, ROWS = 5, 128, 12
#: Similarity as a fraction, so that verification is in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
BITS = 1024
#: Shingles that a task remembers of texts that it compares.
REMEMBERED = 2_000_000
_FACTORS = np.random.default_rng(42).integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64)
    whole, at, start, end = b" ".join(words), 0, [], []
    for n in map(len, words):
        start.append(at)
        end.append(at + n)
        at += n + 1
    return np.unique(np.array([digest(whole[a:b], 42) for a, b in zip(start, end[size - 1 :], strict=False)], np.uint64))


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set that is not empty."""
    sizes = np.array([len(s) for s in sets])
    first, values = np.cumsum(sizes) - sizes, np.concatenate(sets)
    values = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    mixed = np.empty_like(values)
    out = np.zeros((len(sets), BANDS), np.uint64)
    for i, factor in enumerate(_FACTORS):
        np.multiply(values, factor, out=mixed)
        band = out[:, i // ROWS]
        band *= np.uint64(0x9E3779B97F4A7C15)
        band ^= np.minimum.reduceat(mixed, first)
        band ^= band >> np.uint64(29)
        if i % ROWS == 0:
            band += np.uint64((i // ROWS + 1) << 33)
    return out * np.uint64(0xD6E8FEB86659FD93)


def sketch(texts: DataFrame) -> DataFrame:
    """Rows (fp, n, keys) of (fp, text): the number of distinct shingles, and the keys (one, zero, for no shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                whole, at = data[offsets[a] : offsets[b]].tobytes(), (offsets[a : b + 1] - offsets[a]).tolist()
                sets = [shingles(whole[x:y]) for x, y in pairwise(at)]
                filled = [s for s in sets if len(s)]
                keys = iter(_keys(filled).view(np.int64)) if filled else iter(())
                of = [next(keys) if len(s) else np.zeros(1, np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int32()), pa.array(of, pa.list_(pa.int64()))], names=["fp", "n", "keys"])

    return texts.select("fp", "text").mapInArrow(run, "fp long, n int, keys array<long>")


class Sets:
    """The shingles of texts that a task meets again and again; forgets all beyond REMEMBERED shingles."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.known: dict[int, np.ndarray] = {}
        self.held, self.size = 0, size

    def of(self, fp: int, text: pa.Scalar) -> np.ndarray:
        if fp not in self.known:
            if self.held > REMEMBERED:
                self.known, self.held = {}, 0
            self.known[fp] = shingles(text.as_buffer().to_pybytes(), self.size)
            self.held += len(self.known[fp])
        return self.known[fp]


def _similar(pairs: DataFrame) -> DataFrame:
    """The rows (a, b) of (a, b, x, y) whose texts x and y have a similarity of at least NUMERATOR / DENOMINATOR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in batches:
            a, b, x, y = batch.columns
            keep = []
            for i, (p, q) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                both = np.sort(np.concatenate([sets.of(p, x[i]), sets.of(q, y[i])]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if DENOMINATOR * shared >= NUMERATOR * (len(both) - shared):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], names=["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _elements(texts: DataFrame) -> DataFrame:
    """Rows (fp, element) of all shingles of (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_buffer().to_pybytes()) for t in batch.column(1)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["fp", "element"])

    return texts.select("fp", "text").mapInArrow(run, "fp long, element long")


def _bitmaps(texts: DataFrame) -> DataFrame:
    """Rows (fp, bits) of (fp, text): BITS bits in words of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            set_ = np.zeros((len(batch), BITS), bool)
            for i, t in enumerate(batch.column(1)):
                set_[i, (shingles(t.as_buffer().to_pybytes()) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = True
            words = np.packbits(set_, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(words), pa.list_(pa.int64()))], names=["fp", "bits"])

    return texts.select("fp", "text").mapInArrow(run, "fp long, bits array<long>")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b), each once, with their texts x and y."""
    left = texts.select(F.col("fp").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("fp").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The similar ones of pairs (a, b), each once."""
    return cut(_similar(_with_texts(pairs, texts)))


def _sized(x: str, y: str) -> Column:
    """Whether sets of x and y shingles can be that similar."""
    return DENOMINATOR * F.least(x, y) >= NUMERATOR * F.greatest(x, y)


class Groups:
    """The components of links found so far; worked out anew only when there are new links."""

    def __init__(self, links: DataFrame) -> None:
        self.links, self.of = links, cut(components(links))

    def add(self, more: DataFrame) -> None:
        if not more.isEmpty():
            self.links = self.links.unionByName(more)
            self.of = cut(components(self.links))

    def rooted(self, rows: DataFrame, *names: tuple[str, str]) -> DataFrame:
        """rows with the component of each first name's text under the second name."""
        for fp, root in names:
            found = self.of.select(F.col("node").alias(fp), F.col("component").alias("_c"))
            rows = rows.join(found, fp, "left").withColumn(root, F.coalesce("_c", fp)).drop("_c")
        return rows

    def apart(self, spokes: DataFrame) -> DataFrame:
        return self.rooted(spokes, ("fp", "root"), ("centre", "centre_root")).where("root <> centre_root").drop("root", "centre_root")


def _hung(keyed: DataFrame, texts: DataFrame, groups: Groups | None = None) -> Groups:
    """The groups with the similar ones of pairs of a text and a centre of its keys; keyed has (key, fp, n, weight)."""
    centres = keyed.groupBy("key").agg(F.max(F.struct("weight", "fp", "n")).alias("c"))
    rows = keyed.join(centres, "key").select("fp", "n", F.col("c.fp").alias("centre"), F.col("c.weight").alias("weight"), F.col("c.n").alias("m"))
    spokes = write_and_read(rows.where((F.col("fp") != F.col("centre")) & _sized("n", "m")).distinct())
    apart = spokes if groups is None else groups.apart(spokes)
    best = apart.groupBy("fp").agg(F.max(F.struct("weight", "centre")).alias("c")).select(F.col("c.centre").alias("a"), F.col("fp").alias("b"))
    first = _verified(best, texts)
    if groups is None:
        groups = Groups(first)
    else:
        groups.add(first)
    groups.add(_verified(groups.apart(spokes).select(F.col("centre").alias("a"), F.col("fp").alias("b")), texts))
    done(spokes)
    return groups


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """rows of the keys that hold texts of several components."""
    several = rows.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(key)
    return rows.join(several, key)


def grouped(texts: DataFrame) -> DataFrame:
    """Rows (node, component) of the texts (fp, text) that have links: the components of all similar pairs that share a key."""
    found = write_and_read(sketch(texts).dropDuplicates(["fp"]))
    rows = found.select("fp", "n", F.explode("keys").alias("key"))
    shared = write_and_read(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    keyed = write_and_read(rows.join(shared, "key"))
    done(found)
    weights = keyed.groupBy("fp").agg(F.sum("m").alias("weight"))
    texts = write_and_read(texts.join(weights.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))
    groups = _hung(keyed.join(weights, "fp"), texts)

    open_ = write_and_read(_mixed(groups.rooted(keyed.select("key", "fp", "n"), ("fp", "root")), "key").select("fp", "n", "root").distinct())
    elements = write_and_read(_elements(texts.join(open_.select("fp"), "fp", "left_semi")))
    frequent = elements.groupBy("element").agg(F.count("*").alias("df"))
    rarest = F.row_number().over(Window.partitionBy("fp").orderBy("df", "element"))
    ranked = elements.join(frequent, "element").withColumn("place", rarest).join(open_, "fp")
    # of n shingles a fifth and one, of which an eighth and one are enough on one side
    prefix = write_and_read(ranked.where((5 * (F.col("place") - 1) <= F.col("n")) & (F.col("df") > 1)).select(F.col("element").alias("key"), "fp", "n", "df", "place"))
    prefix = prefix.join(prefix.groupBy("fp").agg(F.sum("df").alias("weight")), "fp")
    _hung(prefix.select("key", "fp", "n", "weight"), texts, groups)
    rest = write_and_read(_mixed(groups.rooted(prefix.select("key", "fp", "n", "place"), ("fp", "root")), "key"))
    rest = write_and_read(rest.join(_bitmaps(texts.join(rest.select("fp").distinct(), "fp", "left_semi")), "fp"))
    x, y = rest.where(8 * (F.col("place") - 1) <= F.col("n")).alias("x"), rest.alias("y")
    # what comes before the places is not shared, as a pair meets on the first of its common shingles too
    few = 9 * (F.col("x.place") + F.col("y.place") - 2) <= F.col("x.n") + F.col("y.n")
    bits = reduce(lambda a, b: a + b, [F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(BITS // 64)])
    like = few & (9 * bits <= F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _sized("x.n", "y.n") & like)
    groups.add(_verified(pairs.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")), texts))
    return groups.of


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, with all its columns: a row of the group's least id, or of none if none has one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.xxhash64(text)
    linked = grouped(docs.select(mark.alias("fp"), text.alias("text")))
    found = docs.select(F.col(id_col).alias("id"), mark.alias("fp"))
    return chosen(docs, found, classes(found, "id", linked), id_col, mark)

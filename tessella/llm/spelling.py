"""Operator 11: spelling variants: near words by a trie self-join with active-node sets, forms and roots.

Two words are near if one inserted, deleted or replaced code point makes one the other. Take the length l of the shorter:
near words agree in a code points at the front and b at the back with a + b >= l - 1, so either in the first half or in the
last. The vocabulary is dealt to tries by that: each word goes to the trie of its prefix, and, for pairs that differ inside
the prefix, to the one of its suffix, under its own length and the one below. What lies between prefix and suffix is the
word's middle, and two words of a trie are near if their middles are. A trie of over BOUND words is dealt out once more by
half of what may still differ, and so on; where one place only may differ, the alphabet bounds a trie (middles of one or two signs).

Within a trie, nodes are taken level by level. A node's active nodes are those whose strings are one edit away (the node
itself is at distance zero). Its child c has as active nodes the children c of those, the node itself (c deleted), the
child's siblings (c replaced) and its own children (one inserted). Pairs of active nodes at which words end are near.

A form has at least RATIO times the word's occurrences, so chains of forms are short; roots are found by pointer doubling.

Null texts have no words. A null id counts as an empty text in the hash. Repeated rows count each. Words of any length are
taken whole. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, done, table, write_and_read

#: Code points of a word and its occurrences, at least; every DELETED-th run loses a code point; a form's occurrences to the word's.
LENGTH, LEAST, DELETED, RATIO = 7, 2, 31, 10
#: Words of a trie, and rows that a task builds tries of at once.
BOUND, ROWS = 4096, 1 << 17
#: Distinct words that a task counts before it gives them out.
COUNTED = 1 << 18


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """Rows (word, n): runs of Latin letters, A-Z lower-cased, some with one code point deleted, as the module says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, crc32 = re.compile("[a-zÀ-ÿ]{%d,}" % length), zlib.crc32
        found: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                start = crc32(f"{id_.as_py()}:".encode())
                # bytes.lower() changes A-Z only
                for word, n in Counter(letters.findall(text.as_buffer().to_pybytes().lower().decode())).items():
                    h = crc32(word.encode(), start)
                    if h % DELETED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < length:
                            continue
                    found[word] += n
                if len(found) > COUNTED:
                    yield given()
                    found.clear()
        yield given()

    id_, text = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(id_.alias("id"), text.alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _dealt(words: DataFrame, front: Column, back: Column) -> DataFrame:
    """words with prefixes of front code points and suffixes of back: rows (base, front, back, trie, middle, word, n)."""
    rows = words.withColumns({"front": front.cast("int"), "back": back.cast("int")})
    rows = rows.withColumn("trie", F.concat_ws("\0", "base", "front", F.expr("substring(word, 1, front)"), F.expr("right(word, back)")))
    return rows.withColumn("middle", F.expr("substring(word, front + 1, char_length(word) - front - back)"))


def tries(words: DataFrame, bound: int = BOUND) -> DataFrame:
    """Rows (trie, middle, word, n) of (word, n), so that near words share a trie; tries have at most bound words where they can be dealt out further."""
    rows = words.withColumn("base", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1))).where("base >= 0")
    rows = rows.withColumns({"front": F.lit(0), "back": F.lit(0)})
    ended = None
    while True:
        open_ = F.expr("base - 1 - front - back")  # what of the base may still differ
        half = F.ceil(open_ / 2)
        kept = ["word", "n", "base"]
        rows = rows.withColumn("side", F.explode(F.when(open_ > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        front = F.when(F.col("side") == 0, F.col("front") + half).otherwise(F.col("front"))
        back = F.when(F.col("side") == 1, F.col("back") + F.floor(open_ / 2) + 1).otherwise(F.col("back"))
        rows = write_and_read(_dealt(rows.select(*kept, F.greatest(front, F.lit(0)).alias("front"), back.alias("back")), F.col("front"), F.col("back")))
        large = rows.groupBy("trie").agg(F.count("*").alias("m"), F.max(F.expr("base - 1 - front - back")).alias("open")).where((F.col("m") > bound) & (F.col("open") > 0)).select("trie")
        large = cut(large)
        if large.isEmpty():
            rows = rows.select("trie", "middle", "word", "n")
            return rows if ended is None else ended.unionByName(rows)
        small = rows.join(large, "trie", "left_anti").select("trie", "middle", "word", "n")
        ended = small if ended is None else ended.unionByName(small)
        rows = rows.join(large, "trie", "left_semi").select(*kept, "front", "back")


class Tries:
    """Tries of strings; all tries are roots of one forest whose nodes are numbered level by level."""

    def __init__(self, trie: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> None:
        """trie: the number of each string's trie; codes: the code points of all strings, from offsets[i] to offsets[i + 1]."""
        size, alphabet = np.diff(offsets), np.unique(codes)
        codes = np.searchsorted(alphabet, codes)
        self.base = len(alphabet) + 1
        roots = int(trie.max(initial=-1)) + 1
        node, here = trie.astype(np.int64), np.arange(len(size))
        keys, self.levels, self.ends, depth = [], [0, roots], [], 0
        while True:
            end = size[here] == depth
            self.ends.append((node[end], here[end]))
            node, here = node[~end], here[~end]
            if not len(here):
                break
            found, at = np.unique(node * self.base + codes[offsets[here] + depth], return_inverse=True)
            node = self.levels[-1] + at
            keys.append(found)
            self.levels.append(self.levels[-1] + len(found))
            depth += 1
        #: parent * base + code of each node that is no root, ascending, as parents of a later level have greater numbers
        self.keys = np.concatenate([np.zeros(0, np.int64), *keys])
        self.roots, self.count = roots, self.levels[-1]
        parents = self.keys // self.base
        self.first = roots + np.searchsorted(parents, np.arange(self.count))
        self.children = np.bincount(parents, minlength=self.count)
        #: the string that ends at a node, or -1
        self.string = np.full(self.count, -1)
        for at, string in self.ends:
            self.string[at] = string

    def _below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all children of nodes: the places in nodes, and the children."""
        many = self.children[nodes]
        place = np.repeat(np.arange(len(nodes)), many)
        return place, self.first[nodes][place] + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)

    def _child(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node by its code, or -1."""
        key = nodes * self.base + codes
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.roots + at, -1) if len(self.keys) else np.full(len(key), -1)

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """All ordered pairs of strings of a trie at distance one."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        node = np.arange(self.roots)
        place, active = self._below(node)
        owner = node[place]
        while len(node):
            both = (self.string[owner] >= 0) & (self.string[active] >= 0)
            left.append(self.string[owner[both]])
            right.append(self.string[active[both]])
            place, child = self._below(owner)
            code = self.keys[child - self.roots] % self.base
            same = self._child(active[place], code)
            at, new = self._below(node)
            fellow, sibling = self._below(node[at])
            other = new[fellow] != sibling
            over, after = self._below(new)
            owners = np.concatenate([child[same >= 0], new, new[fellow][other], new[over]])
            actives = np.concatenate([same[same >= 0], node[at], sibling[other], after])
            pair = np.unique(owners * self.count + actives)
            owner, active, node = pair // self.count, pair % self.count, new
        return np.concatenate(left), np.concatenate(right)


def _met(rows: pa.Table) -> pa.RecordBatch:
    """Rows (word, near, near_n) of the pairs in whole tries (trie, middle, word, n)."""
    trie = rows.column("trie").combine_chunks().dictionary_encode().indices.to_numpy()
    several = np.bincount(trie)[trie] > 1
    rows, trie = rows.filter(pa.array(several)), np.unique(trie[several], return_inverse=True)[1]
    middle = [m.encode("utf-32-le") for m in rows.column("middle").to_pylist()]
    offsets = np.append(0, np.cumsum([len(m) // 4 for m in middle])).astype(np.int64)
    a, b = Tries(trie, np.frombuffer(b"".join(middle), np.uint32), offsets).near()
    word, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
    return pa.RecordBatch.from_arrays([word.take(pa.array(a)), word.take(pa.array(b)), n.take(pa.array(b))], names=["word", "near", "near_n"])


def near_words(words: DataFrame, bound: int = BOUND) -> DataFrame:
    """Rows (word, near, near_n): all ordered pairs of distinct words (word, n) that are near, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ROWS:
                rows = pa.Table.from_batches(held)
                # the last trie may go on in the next batch
                last = rows.column("trie")[-1]
                whole = int(np.argmax(pc.equal(rows.column("trie"), last).to_numpy()))
                if whole:
                    yield _met(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
        if held and sum(map(len, held)):
            yield _met(pa.Table.from_batches(held))

    rows = tries(words, bound).repartition("trie").sortWithinPartitions("trie")
    return rows.mapInArrow(run, "word string, near string, near_n long").repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of (word, form): the last of the forms that follow one another, by pointer doubling."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = further.select("word", "root")
        if further.where("moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = RATIO, bound: int = BOUND) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of the distinct words (word, n)."""
    words = write_and_read(words)
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near")))
    found = near_words(words, bound).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fit = -F.col("best.rank") >= ratio * F.col("n")
    found = write_and_read(words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fit, F.col("best.near")).alias("form"), F.when(fit, -F.col("best.rank")).alias("form_n")))
    done(words)
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(occurrences(table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::UBIGINT], range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
bytes AS (
  SELECT id, run, k, flatten(list_transform(string_split(concat(id, ':', run), ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::UBIGINT] ELSE [195::UBIGINT, (unicode(ch) - 64)::UBIGINT] END)) AS b
  FROM counted),
hashed AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295::UBIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h
  FROM bytes, crc_table),
made AS (
  SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, (h % length(run))::BIGINT), substr(run, (h % length(run))::BIGINT + 2)) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS (SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM words, unnest(range(1, length(word) + 1)) AS r(i)),
pairs AS (
  SELECT less.word, w.word AS near FROM less JOIN words w ON rest = w.word
  UNION SELECT w.word, less.word FROM less JOIN words w ON rest = w.word
  UNION SELECT a.word, b.word FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
ranked AS (
  SELECT p.word, p.near, w.n AS near_n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place, count(*) OVER (PARTITION BY p.word) AS n_near
  FROM pairs p JOIN words w ON p.near = w.word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT c.word, c.root FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NULL) USING (word)
"""

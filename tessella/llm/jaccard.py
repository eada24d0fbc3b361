"""Operator 13: documents linked by the Jaccard similarity of their word shingles: an exact set join with set-relation skipping.

Texts of one set are one class, and only distinct sets are joined. Shingles have one order for all: by how often their
bucket of a table of counts over all documents is met, rare ones first, then by hash. Two sets of n and m shingles that are
similar share over 0.9 / 1.9 * (n + m), so each has a common one among its first n - 0.9 n + 1: these make an inverted
index of entries (shingle, set, n, position).

Skipping in lists: from a common shingle at positions p and q on, no more than min(n - p, m - q) can be shared. Lists are in
order of position; for each entry the list is left where positions are too far for a set of any size, and pairs whose
sizes or positions rule them out are skipped. A list of over LIST entries is dealt to parts by hash, and each two parts meet
in a task.

Answers from answers: each list has a leader, the set that meets most others, and the exact overlap of every set with the
leaders of its lists comes first. A set y then derives what it can from the leader x that it shares most with: for any z,
|x and z| + |x and y| - |x| <= |y and z| <= |x and z| + |y| - |x and y|. Pairs that are above the bound by this are links
without a look at the sets, pairs below are none, and pairs that links join already need no answer of their own (only
classes are asked for). Just the rest is verified.

Null and wordless texts have an empty set and are linked with nothing, not even one another. Fewer than three words are one
shingle. A null id is kept, with the class of its copies, null if none has an id; repeated rows are one class. Other
columns are not read. Shingles are told apart by 64-bit hashes, sets and texts by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import by_value, cut, done, slices, table, utf8, write_and_read
from tessella.llm.shingles import Groups, Sets, _with_texts, shingles
from tessella.llm.simhash import classes

SHINGLE = 3
#: Similarity as a fraction.
PART, WHOLE = 90, 100
#: The table of counts has 2 ** TABLE_BITS buckets and is summed in PIECES pieces.
TABLE_BITS, PIECES = 20, 64
#: Entries of a part of a list, and rows that a task compares at once.
LIST, ROWS = 2048, 1 << 16


def _sets(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of about a slice of text, and their shingles."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        for a, b in slices(offsets):
            whole, at = data[offsets[a] : offsets[b]].tobytes(), (offsets[a : b + 1] - offsets[a]).tolist()
            yield batch.slice(a, b - a), [shingles(whole[x:y], SHINGLE) for x, y in pairwise(at)]


def rarity(texts: DataFrame) -> Callable[[], np.ndarray]:
    """A broadcast array: for each bucket of shingles a rank that grows with how often it is met, in half powers of two."""
    size = 1 << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for _, sets in _sets(batches, 0):
            counts += np.bincount((np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64), minlength=size)
        if counts.any():
            for i, piece in enumerate(np.split(np.minimum(counts, 2**32 - 1).astype(np.uint32), PIECES)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
        ranks = [np.floor(2 * np.log2(np.maximum(s, 1))).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], names=["piece", "counts"])

    kind = "piece int, counts binary"
    rows = texts.mapInArrow(count, kind).repartition("piece").mapInArrow(add, kind).collect()
    out = np.zeros((PIECES, size // PIECES), np.uint8)
    for row in rows:
        out[row.piece] = np.frombuffer(row["counts"], np.uint8)
    return by_value(texts.sparkSession, out.ravel())


def sketch(rows: DataFrame, ranks: Callable[[], np.ndarray]) -> DataFrame:
    """Rows (id, key, set, n, first) of (id, key, text): the digest of a text's set, its size and its first shingles in the order of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks().astype(np.uint64) << np.uint64(56)
        low, mask = np.uint64((1 << 56) - 1), np.uint64(len(rank) - 1)
        for batch, sets in _sets(batches, 2):
            first = []
            for s in sets:
                ordered = np.sort(rank[(s & mask).astype(np.int64)] | (s & low))
                first.append(ordered[: len(s) - -(-PART * len(s) // WHOLE) + 1].view(np.int64))
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            columns = [batch.column(0), batch.column(1), digests, pa.array([len(s) for s in sets], pa.int32()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "set", "n", "first"])

    return rows.select("id", "key", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key binary, set binary, n int, first array<long>")


def _sized(n: str, m: str) -> Column:
    return WHOLE * F.least(n, m) >= PART * F.greatest(n, m)


def _placed(n: str, p: str, m: str, q: str) -> Column:
    """Whether sets that share a shingle at places p and q, and none before, can be similar."""
    return (PART + WHOLE) * F.least(F.col(n) - F.col(p), F.col(m) - F.col(q)) >= PART * (F.col(n) + F.col(m))


def _linked(shared: Column) -> Column:
    return (PART + WHOLE) * shared >= PART * (F.col("n") + F.col("m"))


def _overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (a, b, n, m, shared) of distinct pairs (a, b): the sizes of their sets and of what these share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sets(SHINGLE)
        for batch in batches:
            a, b, x, y = batch.columns
            found = []
            for i, (p, q) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                s, t = known.of(p, x[i]), known.of(q, y[i])
                both = np.sort(np.concatenate([s, t]), kind="stable")
                found.append((len(s), len(t), int((both[1:] == both[:-1]).sum())))
            columns = [pa.array(c, pa.int32()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int32())] * 3
            yield pa.RecordBatch.from_arrays([a, b, *columns], names=["a", "b", "n", "m", "shared"])

    return cut(_with_texts(pairs, texts).mapInArrow(run, "a long, b long, n int, m int, shared int"))


def index(sets: DataFrame) -> DataFrame:
    """Entries (token, sid, n, pos, m) of lists with m entries, two or more, from (sid, n, first)."""
    rows = sets.select("sid", "n", F.posexplode("first").alias("pos", "token"))
    lists = rows.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    return rows.join(lists, "token").select("token", "sid", "n", "pos", "m")


def _led(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's leader and the sets that its sizes and positions allow."""
    weights = lists.groupBy("sid").agg(F.sum("m").alias("weight"))
    entries = lists.join(weights, "sid")
    leaders = entries.groupBy("token").agg(F.max(F.struct("weight", "sid", "n", "pos")).alias("x"))
    rows = entries.join(leaders, "token").select("sid", "n", "pos", F.col("x.sid").alias("lead"), F.col("x.n").alias("n_lead"), F.col("x.pos").alias("pos_lead"))
    return rows.where((F.col("sid") != F.col("lead")) & _sized("n", "n_lead") & _placed("n", "pos", "n_lead", "pos_lead")).select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct()


def _skipped(rows: pa.Table) -> pa.RecordBatch:
    """Rows (a, b, sure) of the pairs in whole parts that nothing rules out; sure: a link by the bound from below."""
    part, side, sid, n, pos, root, lead, n_lead, shared = (rows.column(c).to_numpy().astype(np.int64) for c in ("part", "side", "sid", "n", "pos", "root", "lead", "n_lead", "shared"))
    split = rows.column("split").to_numpy()
    # part hashes may collide: a list is its token, too
    token, low, high = (rows.column(c).to_numpy() for c in ("token", "low", "high"))
    begins = np.append(True, (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (part[1:] != part[:-1]))
    part = np.cumsum(begins)
    found, active, step = [], np.arange(len(sid)), 1
    while len(active):
        active = active[active + step < len(sid)]
        other = active + step
        # left where the list ends, or where no set of any size can be similar from that position on
        stay = (part[active] == part[other]) & (PART * pos[other] <= (WHOLE - PART) * n[active])
        active, other = active[stay], other[stay]
        total = PART * (n[active] + n[other])
        fit = (root[active] != root[other]) & (~split[active] | (side[active] != side[other]))
        fit &= WHOLE * np.minimum(n[active], n[other]) >= PART * np.maximum(n[active], n[other])
        fit &= (PART + WHOLE) * np.minimum(n[active] - pos[active], n[other] - pos[other]) >= total
        one = (lead[active] == lead[other]) & (lead[active] >= 0)
        most = np.minimum(shared[other] + n[active] - shared[active], shared[active] + n[other] - shared[other])
        fit &= ~one | ((PART + WHOLE) * most >= total)
        sure = one & ((PART + WHOLE) * (shared[active] + shared[other] - n_lead[active]) >= total)
        found.append(np.stack([sid[active[fit]], sid[other[fit]], sure[fit]], 1))
        step += 1
    pairs = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)
    a, b = np.minimum(pairs[:, 0], pairs[:, 1]), np.maximum(pairs[:, 0], pairs[:, 1])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(pairs[:, 2] != 0)], names=["a", "b", "sure"])


def _rest(lists: DataFrame, groups: Groups, known: DataFrame) -> DataFrame:
    """Rows (a, b, sure) of the pairs of lists that links do not join yet and the leaders' answers do not rule out."""
    entries = groups.rooted(lists.select("token", "sid", "n", "pos"), ("sid", "root"))
    mixed = entries.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many")).where("low <> high")
    best = known.groupBy(F.col("b").alias("sid")).agg(F.max(F.struct("shared", F.col("a").alias("lead"), F.col("n").alias("n_lead"))).alias("best"))
    rows = entries.join(mixed.select("token", F.ceil(F.col("many") / LIST).cast("int").alias("parts")), "token").join(best, "sid", "left")
    rows = rows.select("token", "sid", "n", "pos", "root", "parts", *[F.coalesce(f"best.{c}", F.lit(-1)).alias(c) for c in ("lead", "n_lead", "shared")])
    rows = rows.withColumn("side", F.expr("cast(pmod(xxhash64(sid), parts) AS int)")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"low": F.least("side", "with"), "high": F.greatest("side", "with")}).withColumn("split", F.col("low") != F.col("high"))
    rows = rows.withColumn("part", F.xxhash64("token", "low", "high")).drop("with", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ROWS:
                rows = pa.Table.from_batches(held)
                part = rows.column("part").to_numpy()
                whole = int(np.argmax(part == part[-1]))  # the last part may go on in the next batch
                if whole:
                    yield _skipped(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
        if sum(map(len, held)):
            yield _skipped(pa.Table.from_batches(held))

    return rows.repartition("part").sortWithinPartitions("part", "token", "low", "high", "pos", "n").mapInArrow(run, "a long, b long, sure boolean")


def similar(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (node, component) of the sets (sid, n, first) that have links; texts (fp, text) gives a text for each set by its sid."""
    lists = write_and_read(index(sets))
    texts = write_and_read(texts.join(lists.select(F.col("sid").alias("fp")).distinct(), "fp", "left_semi"))
    known = _overlaps(_led(lists), texts)
    groups = Groups(known.where(_linked(F.col("shared"))).select("a", "b"))
    rest = cut(_rest(lists, groups, known).groupBy("a", "b").agg(F.max("sure").alias("sure")))
    asked = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    checked = _overlaps(rest.where("NOT sure").join(asked, ["a", "b"], "left_anti"), texts)
    groups.add(checked.where(_linked(F.col("shared"))).select("a", "b").unionByName(rest.where("sure").select("a", "b")))
    done(lists)
    done(texts)
    return groups.of


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_shingles, component_id) for each row of docs: the size of its set, and the smallest id reachable over links."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    found = write_and_read(sketch(rows, rarity(rows.select("text"))))
    sets = found.where("n > 0").groupBy("set").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("first").alias("first"))
    sets = write_and_read(sets.withColumn("sid", F.monotonically_increasing_id()))
    texts = rows.select("key", "text").dropDuplicates(["key"]).join(sets.select("key", F.col("sid").alias("fp")), "key").select("fp", "text")
    linked = similar(sets.select("sid", "n", "first"), texts)
    members = found.join(sets.select("set", F.col("sid").alias("fp")), "set", "left").select("id", "n", "fp")
    of = classes(members.where("n > 0").select("id", "fp"), "id", linked).select("fp", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return members.join(of, "fp", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
rows AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) END AS s FROM words),
sets AS (SELECT s, len(s) AS n, row_number() OVER () AS id FROM (SELECT DISTINCT s FROM rows WHERE len(s) > 0)),
tokens AS (SELECT id, n, unnest(s) AS t FROM sets),
pairs AS (SELECT a.id AS x, b.id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.id < b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT id AS x, id AS y FROM sets UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
owned AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN sets ON y = id JOIN rows USING (s) GROUP BY x)
SELECT doc_id, len(rows.s)::BIGINT AS n_shingles, CASE WHEN len(rows.s) = 0 THEN doc_id ELSE component_id END AS component_id
FROM rows LEFT JOIN sets ON rows.s = sets.s LEFT JOIN owned ON id = x
"""

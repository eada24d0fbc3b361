"""Readers of gzipped text dumps: MySQL inserts and Turtle records.

Gzip files cannot be split, so a file is one task; many files are read in parallel, and what follows should be
repartitioned. Statements are parsed record by record in mapInArrow, never as a whole file in memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELD = re.compile(r"'((?:[^'\\]|\\.|'')*)'|([^,()']+)", re.S)
_ESCAPE = re.compile(r"\\(.)|''", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "Z": "\x1a", "b": "\b"}


def _value(quoted: str | None, plain: str | None) -> str | None:
    if quoted is None:
        return None if plain.strip().upper() == "NULL" else plain.strip()
    return _ESCAPE.sub(lambda m: _ESCAPED.get(m[1], m[1]) if m[1] else "'", quoted)


def tuples(line: str) -> Iterator[list[str | None]]:
    """The value lists of an INSERT line, or of a line that holds one value list of a longer statement."""
    start = line.find("VALUES")
    at = line.find("(", start + 6 if start >= 0 else 0)
    while at >= 0:
        fields, at = [], at + 1
        while at < len(line) and line[at] != ")":
            found = _FIELD.match(line, at)
            if not found:
                return
            fields.append(_value(found[1], found[2]))
            at = found.end() + (line[found.end() : found.end() + 1] == ",")
        yield fields
        at = line.find("(", at)


def column_names(spark: SparkSession, path: str, table: str) -> list[str]:
    """The columns of a table in the order of its CREATE TABLE statement (which precedes the first INSERT)."""
    lines = spark.read.text(path).where(F.rlike(F.trim("value"), F.lit(r"^(CREATE TABLE|`|\))")))
    names, inside = [], False
    for row in lines.toLocalIterator():
        line = row.value.strip()
        if line.startswith("CREATE TABLE"):
            inside = f"`{table}`" in line
        elif inside and line.startswith("`"):
            names.append(line.split("`")[1])
        elif inside and line.startswith(")"):
            break
    return names


def mysql_dump(spark: SparkSession, path: str, table: str, wanted: list[str], keep: str | None = None) -> DataFrame:
    """Rows of the wanted columns, as strings, of a gzipped MySQL dump in either layout (one tuple a line or many).

    keep is a piece of text that a line must hold to be parsed: most lines of a large dump can be passed over.
    """
    places = [column_names(spark, path, table).index(c) for c in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for line in batch.column(0).to_pylist() for r in tuples(line) if len(r) > max(places)]
            yield pa.RecordBatch.from_arrays([pa.array([r[p] for r in rows], pa.string()) for p in places], names=wanted)

    line = F.ltrim("value")
    lines = spark.read.text(path).where(F.startswith(line, F.lit(f"INSERT INTO `{table}`")) | F.startswith(line, F.lit("(")))
    if keep:
        lines = lines.where(F.contains("value", F.lit(keep)))
    return lines.mapInArrow(run, ", ".join(f"`{c}` string" for c in wanted))


_TURTLE = re.compile(r'"""((?:[^"\\]|\\.|"(?!""))*)"""|"((?:[^"\\]|\\.)*)"|<([^>]*)>|(#[^\n]*)|([;,.])(?=\s|$)|([^\s;,"<]+)', re.S)
_UNICODE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


def _literal(text: str) -> str:
    return _UNICODE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPED.get(m[3], m[3]), text)


def turtle_triples(statement: str) -> Iterator[tuple[str, str, str]]:
    """(subject, predicate, object) of one statement that may run over several lines."""
    subject = predicate = None
    for long, short, iri, comment, mark, word in (m.groups() for m in _TURTLE.finditer(statement)):
        if comment is not None:
            continue
        if mark == ";":
            predicate = None
        elif mark == ".":
            subject = predicate = None
        elif mark is None:
            if word is not None and (word.startswith("@") or word.startswith("^^")):
                continue
            term = _literal(long) if long is not None else _literal(short) if short is not None else iri if iri is not None else word
            if subject is None:
                subject = term
            elif predicate is None:
                predicate = term
            else:
                yield subject, predicate, term


# A line read from one of the states OUTSIDE, IN_DOUBLE and IN_SINGLE (long literals, the only ones that go over lines).
OUTSIDE, IN_DOUBLE, IN_SINGLE = range(3)
_OUTER = re.compile(r'"""|\'\'\'|"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|<[^<>"\s]*>|#.*|\.(?=\s|$|#)')
_INNER = {IN_DOUBLE: re.compile(r'\\.|"""'), IN_SINGLE: re.compile(r"\\.|'''")}
_OPENED = {'"""': IN_DOUBLE, "'''": IN_SINGLE}


def cut_line(line: str, state: int) -> tuple[list[str], int]:
    """The parts of a line between the full stops that end statements, and the state behind it; comments go."""
    parts, begin, at = [], 0, 0
    while True:
        found = (_OUTER if state == OUTSIDE else _INNER[state]).search(line, at)
        if not found:
            return [*parts, line[begin:]], state
        at = found.end()
        if state != OUTSIDE:
            state = state if found[0][0] == "\\" else OUTSIDE
        elif found[0] in _OPENED:
            state = _OPENED[found[0]]
        elif found[0][0] == "#":
            return [*parts, line[begin : found.start()]], state
        elif found[0] == ".":
            parts.append(line[begin : found.start()])
            begin = at


def _blocks(lines: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """For each block of a file the state in which it begins, and the number of its first statement.

    A task tells for its blocks, from each state, in which one they end and how many statements end in them; these
    functions are composed block by block. There is a row for each block of a file, not for each line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], list[list[int]]] = {}
        for batch in batches:
            for line, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                of = ends.setdefault((file, start), [[s, 0] for s in range(3)])
                for one in of:
                    parts, one[0] = cut_line(line, one[0])
                    one[1] += len(parts) - 1
        columns = [pa.array([k[0] for k in ends], pa.string()), pa.array([k[1] for k in ends], pa.int64())]
        columns += [pa.array([[one[i] for one in v] for v in ends.values()], pa.list_(pa.int64())) for i in range(2)]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "state", "count"])

    told = lines.mapInArrow(run, "file string, start long, state array<long>, count array<long>")
    begun: dict[tuple[str, int], tuple[int, int]] = {}
    last, state, number = None, OUTSIDE, 0
    for r in told.orderBy("file", "start").toLocalIterator():
        if r.file != last:
            last, state, number = r.file, OUTSIDE, 0
        begun[r.file, r.start] = state, number
        state, number = r.state[state], number + r["count"][state]
    return begun


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object) of Turtle files, which may be cut anywhere: in a literal, a list or a comment.

    Lines are read twice: once for the state in which each block begins, once to number the statements. The parts of a
    statement then meet, so it may run over lines and blocks. Directives give nothing; names keep their prefixes.
    """
    # Spark cuts a file at line ends; a block's first byte and its place give the order of lines
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    begun = spark.sparkContext.broadcast(_blocks(lines))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = begun.value, {}
        for batch in batches:
            out = []
            for line, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state, statement, place = at.get((file, start)) or (*known[file, start], 0)
                parts, state = cut_line(line, state)
                for i, part in enumerate(parts):
                    out.append((file, statement + i, start, place + i, part + ("\n" if i == len(parts) - 1 else "")))
                at[file, start] = state, statement + len(parts) - 1, place + len(parts)
            kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["file", "statement", "start", "place", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [t for s in batch.column(0).to_pylist() if not s.lstrip().startswith("@") for t in turtle_triples(s + " .")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["subject", "predicate", "object"])

    parts = lines.mapInArrow(number, "file string, statement long, start long, place long, part string")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "place", "part"))), lambda p: p["part"]), "")
    return parts.groupBy("file", "statement").agg(whole.alias("text")).select("text").mapInArrow(read, "subject string, predicate string, object string")

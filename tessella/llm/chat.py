r"""Operator 8: chat formatting by tool-call linking, with DataFrame functions only.

Messages (conv_id, turn, role, text) become events. A text that is a JSON object may carry `tool_calls`
(id, and name and arguments, at the top or under `function`) or a `tool_call_id`; then it is a message with
calls, or a result. With pair_turns, a plain user message is a call of the tool `reply` and a plain assistant
message the result of the call one turn before, so plain dialogue is linked by the same joins.

Calls and results meet in a hash join on (conv_id, call_id), against one pre-aggregated row for each
identifier, so a repeated identifier never multiplies rows; the earliest call of an identifier is the linked
one. Arguments refer to the result of another call as {"$ref": "id"}. Kahn's rounds over these references
give each call a level and an effective turn not before that of what it waits for; rows in the order
(order_turn, order_level, turn, seq) are a topological order. Arguments are checked against the schema
of the called tool; each event is written as JSON with sorted keys and no blanks.

Null text counts as empty, null roles as 'user'; null identifiers are never linked; broken JSON is plain text;
a reference to no call is an error of the call; calls on a cycle keep their own turn, level 0 and an error.
Repeated rows give repeated events. Only the four columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, table

_CALLS = "array<struct<id: string, name: string, arguments: string, function: struct<name: string, arguments: string>>>"
_SHAPE = f"content string, tool_call_id string, tool_calls {_CALLS}"
REFERENCE = r'"\$ref"\s*:\s*"([^"]+)"'

#: Tools by name: required arguments, and the JSON type of each allowed one.
REPLY_SCHEMA = [("reply", ["text"], {"text": "string"})]
SCHEMA_COLUMNS = "name string, required array<string>, properties map<string, string>"


def events(messages: DataFrame, pair_turns: bool = True) -> DataFrame:
    """Rows (conv_id, turn, seq, role, kind, call_id, name, arguments, content); kind is message, call or result."""
    text = F.coalesce("text", F.lit(""))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), text.alias("text"))
    rows = rows.withColumn("json", F.when(F.ltrim("text").startswith("{"), F.from_json("text", _SHAPE)))
    plain = F.col("json").isNull() | F.coalesce("json.content", "json.tool_call_id").isNull() & F.col("json.tool_calls").isNull()
    # null without a conversation or a turn: such messages are never linked
    here, before = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")), F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - 1).cast("string"))
    asks, answers = F.lit(pair_turns) & plain & (F.col("role") == "user"), F.lit(pair_turns) & plain & (F.col("role") == "assistant")
    none = F.lit(None).cast("string")
    entry = lambda kind, call, name, arguments, content: F.struct(kind.alias("kind"), call.alias("call_id"), name.alias("name"), arguments.alias("arguments"), content.alias("content"))
    result = F.col("json.tool_call_id").isNotNull() | answers
    whole = entry(
        F.when(asks, F.lit("call")).when(result, F.lit("result")).otherwise(F.lit("message")),
        F.when(asks, here).when(answers, before).otherwise(F.col("json.tool_call_id")),
        F.when(asks, F.lit("reply")).otherwise(none),
        F.when(asks, F.to_json(F.struct("text"))).otherwise(none),
        F.when(asks, none).when(plain, F.col("text")).otherwise(F.col("json.content")),
    )
    calls = F.transform(
        F.coalesce("json.tool_calls", F.array().cast(_CALLS)),
        lambda c: entry(F.lit("call"), c["id"], F.coalesce(c["name"], c["function"]["name"]), F.coalesce(c["arguments"], c["function"]["arguments"]), none),
    )
    return rows.select("conv_id", "turn", "role", F.posexplode(F.concat(F.array(whole), calls)).alias("seq", "e")).select("conv_id", "turn", "seq", "role", "e.*")


def _ordered(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, turn, arguments, answer) with level, eff (effective turn) and tangled (unknown or cyclic references).

    answer is the turn of the first result or null; a call waits for the results that it refers to.
    """
    refs = F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(REFERENCE), F.lit(1)))
    calls = calls.withColumn("refs", refs).select("conv_id", "call_id", "turn", "answer", "refs")
    edges = calls.where(F.size("refs") > 0).select("conv_id", "call_id", "turn", "answer", F.size("refs").alias("needs"), F.explode("refs").alias("ref"))
    state = lambda level, eff, tangled: ["conv_id", "call_id", F.lit(level).alias("level"), eff.alias("eff"), F.greatest(eff, "answer").alias("out"), F.lit(tangled).alias("tangled")]
    free = calls.where(F.size("refs") == 0).select(*state(0, F.col("turn"), False))
    if edges.isEmpty():
        return free
    edges, done = cut(edges), free
    level = 0
    while True:
        level += 1
        ready = edges.join(done.select("conv_id", F.col("call_id").alias("ref"), "out"), ["conv_id", "ref"])
        ready = ready.groupBy("conv_id", "call_id").agg(F.max("turn").alias("turn"), F.max("answer").alias("answer"), F.max("needs").alias("needs"), F.count("*").alias("met"), F.max("out").alias("wait"))
        ready = ready.where("met = needs").join(done.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        fresh = cut(ready.select(*state(level, F.greatest("turn", "wait"), False)))
        if fresh.isEmpty():
            break
        done = cut(done.unionByName(fresh)) if level % 4 == 0 else done.unionByName(fresh)
    rest = calls.join(done, ["conv_id", "call_id"], "left_anti").select(*state(0, F.col("turn"), True))
    return done.unionByName(rest)


def _json_type(kind: Column) -> Column:
    """The JSON type of a value from its variant schema."""
    return (
        F.when(kind.rlike(r"^OBJECT<`?\$ref`?: ?STRING>$"), "reference").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number").when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", "null").otherwise("string")
    )


def _errors(call: DataFrame) -> Column:
    """What is wrong with the arguments of a call, in a fixed order; empty if they fit the schema."""
    types = F.transform_values("values", lambda k, v: _json_type(F.schema_of_variant(v)))
    keys, known = F.map_keys("values"), F.map_keys("properties")
    fits = lambda k: F.element_at("properties", k).isNull() | (F.element_at(types, k) == "reference") | (F.element_at(types, k) == F.element_at("properties", k)) | ((F.element_at("properties", k) == "number") & (F.element_at(types, k) == "integer"))
    wrong = F.concat(
        F.transform(F.array_sort(F.array_except("required", keys)), lambda k: F.concat(F.lit("missing:"), k)),
        F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unexpected:"), k)),
        F.transform(F.array_sort(F.filter(F.array_intersect(keys, known), lambda k: ~fits(k))), lambda k: F.concat(F.lit("type:"), k)),
    )
    return F.when(F.col("required").isNull(), F.array(F.lit("unknown tool"))).when(F.col("values").isNull(), F.array(F.lit("arguments are no object"))).otherwise(wrong)


def format_chat(messages: DataFrame, schemas: DataFrame, pair_turns: bool = True) -> DataFrame:
    """One row per event: conv_id, turn, seq, role, kind, call_id, linked, errors, order_turn, order_level, json.

    schemas has SCHEMA_COLUMNS, one row for each tool name.
    """
    rows = events(messages, pair_turns)
    is_call = F.col("kind") == "call"
    first = F.min(F.when(is_call, F.struct("turn", "seq", "arguments")))
    groups = rows.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(first.alias("call"), F.count(F.when(F.col("kind") == "result", 1)).alias("results"), F.min(F.when(F.col("kind") == "result", F.col("turn"))).alias("answer"))
    ordered = _ordered(groups.where(F.col("call").isNotNull()).select("conv_id", "call_id", "call.turn", "call.arguments", "answer"))
    groups = groups.join(ordered, ["conv_id", "call_id"], "left").select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("call").isNotNull().alias("_called"), "results", "level", "eff", "tangled")
    joined = rows.join(groups.hint("shuffle_hash"), (rows.conv_id == groups._conv) & (rows.call_id == groups._call), "left")
    joined = joined.withColumn("values", F.when(is_call, F.expr("from_json(CASE WHEN try_parse_json(arguments) IS NOT NULL THEN arguments END, 'map<string, variant>')")))
    unique = schemas.groupBy("name").agg(F.min(F.struct("required", F.map_entries("properties").alias("p"))).alias("s"))
    tools = unique.select(F.col("name").alias("_name"), "s.required", F.map_from_entries("s.p").alias("properties"))
    joined = joined.join(tools, joined.name == tools._name, "left")
    loose = F.when(is_call & F.col("tangled"), F.array(F.lit("tangled references"))).otherwise(F.array().cast("array<string>"))
    checked = joined.withColumn("errors", F.when(is_call, F.concat(_errors(joined), loose)).otherwise(F.array().cast("array<string>")))
    linked = F.when(is_call, F.coalesce(F.col("results") > 0, F.lit(False))).when(F.col("kind") == "result", F.coalesce("_called", F.lit(False)))
    turn = F.when(is_call, F.greatest("turn", "eff")).when(F.col("kind") == "result", F.greatest("turn", F.coalesce("eff", "turn"))).otherwise(F.col("turn"))
    level = F.when(is_call, 2 * F.coalesce("level", F.lit(0))).when(F.col("kind") == "result", 2 * F.coalesce("level", F.lit(0)) + 1).otherwise(F.lit(0))
    value = F.try_parse_json("arguments")
    json = F.to_json(F.struct(value.alias("arguments"), F.when(value.isNull(), F.col("arguments")).alias("arguments_text"), "call_id", "content", "conv_id", "kind", "name", "role", "turn"))
    return checked.select("conv_id", "turn", "seq", "role", "kind", "call_id", linked.alias("linked"), F.array_join("errors", ",").alias("errors"), turn.cast("long").alias("order_turn"), level.cast("int").alias("order_level"), json.alias("json"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(table(spark, sf_dir, "conversations"), spark.createDataFrame(REPLY_SCHEMA, SCHEMA_COLUMNS))


OP8_SQL = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
e AS (
  SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
  FROM m),
g AS (
  SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS call_turn, count(*) FILTER (kind = 'result') AS results
  FROM e WHERE call_id IS NOT NULL GROUP BY conv_id, call_id)
SELECT e.conv_id, turn, 0 AS seq, role, kind, e.call_id,
       CASE kind WHEN 'call' THEN coalesce(results > 0, false) WHEN 'result' THEN call_turn IS NOT NULL END AS linked, '' AS errors,
       greatest(turn, coalesce(call_turn, turn)) AS order_turn, CASE kind WHEN 'result' THEN 1 ELSE 0 END AS order_level,
       CASE kind
         WHEN 'call' THEN '{"arguments":{"text":' || to_json(text) || '},"call_id":' || to_json(e.call_id) || ',"conv_id":' || e.conv_id || ',"kind":"call","name":"reply","role":' || to_json(role) || ',"turn":' || turn || '}'
         WHEN 'result' THEN '{"call_id":' || to_json(e.call_id) || ',"content":' || to_json(text) || ',"conv_id":' || e.conv_id || ',"kind":"result","role":' || to_json(role) || ',"turn":' || turn || '}'
         ELSE '{"content":' || to_json(text) || ',"conv_id":' || e.conv_id || ',"kind":"message","role":' || to_json(role) || ',"turn":' || turn || '}' END AS json
FROM e LEFT JOIN g ON e.conv_id = g.conv_id AND e.call_id = g.call_id
"""


TOOL_SCHEMA = [("search", ["q"], {"q": "string", "n": "number", "after": "string"})]


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with calls put in by rule: every fourth turn becomes a call that waits for the one four turns
    before, the turn behind it its result; of the calls some name an unknown tool, some have wrong arguments."""
    n = F.col("turn")
    ident = lambda k: F.concat(F.lit("t"), k.cast("string"))
    after = F.when(n >= 4, F.struct(ident(n - 4).alias("$ref")))
    args = F.when((F.col("conv_id") + n) % 3 == 0, F.to_json(F.struct(F.col("role").alias("q"), n.alias("n"), after.alias("after")))).when((F.col("conv_id") + n) % 3 == 1, F.to_json(F.struct(F.lit(5).alias("q"), after.alias("after")))).otherwise(F.to_json(F.struct(n.alias("n"), F.lit(True).alias("x"), after.alias("after"))))
    call = F.struct(ident(n).alias("id"), F.when((F.col("conv_id") + F.floor(n / 4)) % 3 != 0, "search").otherwise("find").alias("name"), args.alias("arguments"))
    text = F.when(n % 4 == 0, F.to_json(F.struct(F.lit("asks").alias("content"), F.array(call).alias("tool_calls")))).when(n % 4 == 1, F.to_json(F.struct("text", ident(n - 1).alias("tool_call_id"), F.col("text").alias("content")))).otherwise(F.col("text"))
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"))
    found = format_chat(messages, spark.createDataFrame(TOOL_SCHEMA, SCHEMA_COLUMNS), pair_turns=False)
    return found.select("conv_id", "turn", "seq", "kind", "call_id", "linked", "errors", "order_turn", "order_level", F.when(F.col("kind") == "call", F.col("json")).alias("json"))


TOOL_CALLS_SQL = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'user') AS role FROM conversations), t AS (SELECT DISTINCT conv_id, turn FROM m),
r AS (SELECT a.conv_id, a.turn, count(b.turn) > 0 AS answered, (SELECT count(*) FROM t c WHERE c.conv_id = a.conv_id AND c.turn % 4 = 0 AND c.turn < a.turn) = a.turn // 4 AS whole FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 4 = 0 GROUP BY ALL),
c AS (SELECT m.*, answered, whole, CASE WHEN turn >= 4 THEN '"after":{"$ref":"t' || turn - 4 || '"}' END AS wait FROM m JOIN r USING (conv_id, turn)),
a AS (SELECT *, CASE (conv_id + turn) % 3 WHEN 0 THEN '{' || concat_ws(',', wait, '"n":' || turn, '"q":' || to_json(role)) || '}' WHEN 1 THEN '{' || concat_ws(',', wait, '"q":5') || '}' ELSE '{' || concat_ws(',', wait, '"n":' || turn, '"x":true') || '}' END AS args,
  CASE WHEN (conv_id + turn // 4) % 3 = 0 THEN 'unknown tool' WHEN (conv_id + turn) % 3 = 1 THEN 'type:q' WHEN (conv_id + turn) % 3 = 2 THEN 'missing:q,unexpected:x' ELSE '' END AS wrong FROM c)
SELECT conv_id, turn, 1 AS seq, 'call' AS kind, 't' || turn AS call_id, answered AS linked, concat_ws(',', nullif(wrong, ''), CASE WHEN NOT whole THEN 'tangled references' END) AS errors, turn AS order_turn, CASE WHEN whole THEN turn // 2 ELSE 0 END::INTEGER AS order_level,
  '{"arguments":' || args || ',"call_id":"t' || turn || '","conv_id":' || conv_id || ',"kind":"call","name":"' || CASE WHEN (conv_id + turn // 4) % 3 <> 0 THEN 'search' ELSE 'find' END || '","role":' || to_json(role) || ',"turn":' || turn || '}' AS json FROM a
UNION ALL SELECT m.conv_id, m.turn, 0, CASE WHEN m.turn % 4 = 1 THEN 'result' ELSE 'message' END, CASE WHEN m.turn % 4 = 1 THEN 't' || m.turn - 1 END, CASE WHEN m.turn % 4 = 1 THEN r.turn IS NOT NULL END, '', m.turn, CASE WHEN m.turn % 4 = 1 THEN CASE WHEN r.whole THEN r.turn // 2 + 1 ELSE 1 END ELSE 0 END, NULL
FROM m LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn - 1 AND m.turn % 4 = 1
"""

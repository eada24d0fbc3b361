import json

import pytest

from tessella.llm import chat


@pytest.fixture(scope="module")
def schemas(spark):
    rows = [("add", ["a", "b"], {"a": "integer", "b": "number", "c": "string"}), ("look", [], {"q": "string"}), ("look", [], {"q": "string"})]
    return spark.createDataFrame(rows, chat.SCHEMA_COLUMNS)


def message(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)})


def run(spark, rows, schemas, pair=False):
    messages = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    return chat.format_chat(messages, schemas, pair_turns=pair).orderBy("conv_id", "order_turn", "order_level", "turn", "seq").collect()


def test_links_order_and_validation(spark, schemas):
    rows = run(
        spark,
        [
            (1, 0, "user", "hi"),
            (1, 1, "assistant", message({"id": "x", "name": "add", "arguments": {"b": 2, "a": 1}}, {"id": "y", "function": {"name": "look", "arguments": '{"q": {"$ref": "x"}}'}}, content="calling")),
            (1, 2, "tool", json.dumps({"tool_call_id": "y", "content": "second"})),
            (1, 3, "tool", json.dumps({"tool_call_id": "x", "content": "first"})),
            (1, 4, "tool", json.dumps({"tool_call_id": "nope", "content": "?"})),
        ],
        schemas,
    )
    order = [(r.kind, r.call_id) for r in rows]
    assert order == [("message", None), ("message", None), ("call", "x"), ("result", "x"), ("call", "y"), ("result", "y"), ("result", "nope")]
    assert [r.linked for r in rows] == [None, None, True, True, True, True, False]
    assert all(not r.errors for r in rows)
    assert rows[2].json == '{"arguments":{"a":1,"b":2},"call_id":"x","conv_id":1,"kind":"call","name":"add","role":"assistant","turn":1}'


def test_errors_cycles_and_odd_rows(spark, schemas):
    rows = run(
        spark,
        [
            (2, 0, "assistant", message({"id": "p", "name": "look", "arguments": {"q": {"$ref": "q"}}}, {"id": "q", "name": "look", "arguments": {"q": {"$ref": "p"}}}, {"id": "z", "name": "none", "arguments": "[1]"}, {"id": None, "name": "add", "arguments": {"a": "s", "d": 1}}, {"id": "w", "name": "add", "arguments": "broken"})),
            (3, None, None, None),
            (None, 0, "user", "{broken"),
            (4, 0, "assistant", message({"id": "r", "name": "look", "arguments": {}})),
            (4, 0, "assistant", message({"id": "r", "name": "look", "arguments": {}})),
            (4, 1, "tool", json.dumps({"tool_call_id": "r", "content": "x" * 50_000})),
        ],
        schemas,
    )
    by = {(r.conv_id, r.call_id, r.kind): r for r in rows}
    assert by[2, "p", "call"].errors == by[2, "q", "call"].errors == "tangled references"
    assert by[2, "z", "call"].errors == "unknown tool"
    assert by[2, None, "call"].errors == "missing:b,unexpected:d,type:a" and by[2, None, "call"].linked is False
    assert by[2, "w", "call"].errors == "arguments are no object"
    assert sum(r.kind == "call" and r.call_id == "r" for r in rows) == 2 and sum(r.kind == "result" for r in rows) == 1
    assert json.loads(by[None, None, "message"].json)["content"] == "{broken"
    assert len(rows) == 6 + 5 + 1 + 1


def test_plain_dialogue_and_empty_table(spark, schemas):
    reply = spark.createDataFrame(chat.REPLY_SCHEMA, chat.SCHEMA_COLUMNS)
    rows = run(spark, [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "last")], reply, pair=True)
    assert [(r.kind, r.linked) for r in rows] == [("message", None), ("call", True), ("result", True), ("call", False)]
    assert run(spark, [(1, 0, "user", "x")], reply.where("false"), pair=True)[0].errors == "unknown tool"
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    formatted = chat.format_chat(messages, schemas)
    assert formatted.count() == 0
    plan = formatted._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_messages_without_a_turn_or_a_conversation_are_not_linked(spark, schemas):
    rows = run(spark, [(1, None, "user", "a"), (1, None, "assistant", "b"), (None, 0, "user", "c"), (None, 1, "assistant", "d"), (1, 4, "user", "e"), (1, 5, "assistant", "f")], schemas, pair=True)
    assert {(r.conv_id, r.turn, r.linked, r.call_id) for r in rows} == {(1, None, False, None), (None, 0, False, None), (None, 1, False, None), (1, 4, True, "1:4"), (1, 5, True, "1:4")}

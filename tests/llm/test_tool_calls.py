from __future__ import annotations

import json
import random

from dayrank.llm import tool_calls
from dayrank.llm.catalog import QUERIES, REPLY, tool_messages
from tests.conftest import SF
from tests.llm.helpers import sorted_rows

SCHEMAS = {
    "add": {
        "type": "object", "required": ["a", "b"], "additionalProperties": False,
        "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["number", "null"]}, "note": {"type": "string", "maxLength": 3}},
    },
    "list": {"type": "object", "properties": {"of": {"type": "array", "items": {"type": "string"}, "maxItems": 2}}},
}


def message(conv, turn, value):
    return conv, turn, "any", value if isinstance(value, str) or value is None else json.dumps(value)


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, call_id string, errors string"
    )


def call(name, args, after=None, id_="c"):
    return {"id": id_, "name": name, "arguments": args, "after": after}


def linked(spark, rows):
    return {(r.conv_id, r.call_id): r for r in tool_calls.link(frame(spark, rows), SCHEMAS).collect()}


def test_links_order_and_errors(spark):
    rows = [
        message(1, 5, {"tool_calls": [call("add", {"b": 1.0, "a": 2}, "late", "x"), call("add", {"a": -1, "c": 1}, None, "y")]}),
        message(1, 9, {"tool_calls": [call("list", {"of": ["p", 3, "q"]}, None, "late")]}),
        message(1, 2, {"tool_call_id": "x", "content": {"z": [1.0, 2.5], "é": "\n"}}),
        message(1, 6, {"tool_call_id": "x", "content": "second"}),
        message(1, 7, {"tool_call_id": "nobody", "content": 1}),
        message(2, 1, {"tool_calls": [call("add", {"a": 1, "b": None}, "b", "a"), call("add", {"a": 1, "b": 1}, "a", "b")]}),
        message(2, 1, {"tool_calls": [call("gone", {}, "a", "rests"), call("add", {"a": True, "b": "s", "note": "long"}, "who", "d")]}),
        message(2, 3, {"tool_calls": [call("add", {"a": 1, "b": 2}, None, "d")]}),
        message(3, 0, None), message(3, 1, ""), message(3, 2, "{not json"), message(3, 3, "[1]"), message(None, 1, {"tool_calls": [call("add", {})]}),
        message(3, 4, {"tool_calls": "none"}), message(3, 5, {"tool_calls": [1, {"id": 7}, {"id": "ok"}]}), message(3, 6, '{"tool_calls":[{"id":"nan","arguments":NaN}]}'),
    ]
    got = linked(spark, rows)
    assert set(got) == {(1, "x"), (1, "y"), (1, "late"), (2, "a"), (2, "b"), (2, "rests"), (2, "d"), (3, "ok")}
    x, late = got[1, "x"], got[1, "late"]
    assert x.linked and x.valid and x.result_turn == 2 and x.repeated == 1
    assert x.json == '{"after":"late","arguments":{"a":2,"b":1},"conversation":"1","errors":[],"id":"x","name":"add","result":{"z":[1,2.5],"é":"\\n"}}'
    assert (late.order_turn, late.order_depth) < (x.order_turn, x.order_depth) == (9, 1)
    assert got[1, "y"].errors == "$.b: missing; $.a: out of range; $.c: unknown"
    assert late.errors == "$.of: wrong length; $.of[1]: not string" and not late.linked
    assert got[2, "a"].errors == got[2, "b"].errors == "needs itself"
    assert got[2, "rests"].errors == "unknown tool; needs itself"
    assert got[2, "d"].errors == "$.a: not integer; $.b: not number or null; $.note: wrong length; needs an unknown call"
    assert got[2, "d"].repeated == 1
    assert got[3, "ok"].errors == "unknown tool" and json.loads(got[3, "ok"].json)["arguments"] is None


def test_order_of_random_forests(spark):
    r = random.Random(4)
    rows, needs = [], {}
    for conv in range(5):
        for k in range(120):
            after = f"c{r.randrange(k)}" if k and r.random() < 0.95 else None
            needs[conv, f"c{k}"] = (conv, after)
            rows.append(message(conv, r.randrange(40), {"tool_calls": [call("list", {}, after, f"c{k}")]}))
    chain = [message(9, 500 - k, {"tool_calls": [call("list", {}, f"c{k - 1}" if k else None, f"c{k}")]}) for k in range(300)]
    needs |= {(9, f"c{k}"): (9, f"c{k - 1}" if k else None) for k in range(300)}
    got = linked(spark, rows + chain)
    assert set(got) == set(needs)
    key = {at: (x.order_turn, x.order_depth, x.turn, x.place, x.call_id) for at, x in got.items()}
    for at, up in needs.items():
        if up[1] is not None:
            assert key[up] < key[at]
    assert got[9, "c299"].order_depth == 299


def test_canonical_json():
    assert tool_calls.canonical({"b": 1.0, "a": [True, None, "é\"\\ ", 1e300, -0.0]}) == '{"a":[true,null,"é\\"\\\\ ",1e+300,0],"b":1}'


def test_strings_are_escaped_alike(spark):
    texts = ["".join(map(chr, range(0x80))), "é🙂 ", "", 'a"b\\c']
    rows = [message(i, 0, {"tool_calls": [call(t, {}, None, t)]}) for i, t in enumerate(texts)]
    for r in linked(spark, rows).values():
        value = json.loads(r.json)
        assert value["id"] == value["name"] == r.call_id
        assert r.json == tool_calls.canonical(value)


def test_empty_table(spark):
    assert tool_calls.link(frame(spark, []), SCHEMAS).count() == 0
    assert tool_calls.link(frame(spark, [message(1, 1, "{}")]), SCHEMAS).count() == 0


def test_query_against_brute_force(spark):
    """One call for each user turn; it rests on those before it in steps of two turns."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    messages = {(r.conv_id, r.turn): r.text for r in tool_messages(turns).collect()}
    roles = {(r.conv_id, r.turn): (r.role, r.text) for r in turns.collect()}
    wanted = []
    for (conv, turn), (role, _) in roles.items():
        if role != "user":
            continue
        made = json.loads(messages[conv, turn])["tool_calls"][0]
        errors = tool_calls.faults(made["arguments"], REPLY["reply"])
        depth = 0
        while roles.get((conv, turn - 2 * depth - 2), ("", ""))[0] == "user":
            depth += 1
        if turn >= 2 and roles.get((conv, turn - 2), ("", ""))[0] != "user":
            errors = [*errors, "needs an unknown call"]
        reply = roles.get((conv, turn + 1))
        result = reply[1] if reply and reply[0] == "assistant" else None
        line = tool_calls.canonical(
            {"after": made.get("after"), "arguments": made["arguments"], "conversation": str(conv), "errors": errors,
             "id": f"c{turn}", "name": "reply", "result": result}
        )
        wanted.append((conv, f"c{turn}", turn, depth, not errors, line))
    got = sorted_rows(QUERIES["op1_tool_calls"](spark, SF), "conv_id", "call_id", "order_turn", "order_depth", "valid", "json")
    assert got == sorted(wanted, key=repr)

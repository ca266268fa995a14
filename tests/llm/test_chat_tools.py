import json

import pytest
from support import DATA, connection, same

from plenum.llm import chat_tools as C

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}, **C.SCHEMAS}


def call(ident, x=1, after=(), name="add"):
    return "<tool_call>" + json.dumps({"id": ident, "name": name, "arguments": {"x": x}, "after": list(after)}) + "</tool_call>"


def rows(frame, messages):
    found = C.linked(frame(messages, SCHEMA), TOOLS).collect()
    return sorted(found, key=lambda r: (r["conv_id"] or 0, r["order_turn"] if r["order_turn"] is not None else -1, r["level"] if r["level"] is not None else 99, r["turn"] or 0, r["part"]))


def test_links(frame):
    found = rows(frame, [
        (1, 0, "user", "hi"), (1, 1, "assistant", call("a") + call("b", "q", ["a"]) + call("c", 2, ["b", "zz"])), (1, 2, "tool", '{"id": "a", "content": 3}'), (1, 3, "tool", '{"id": "a", "content": 4}'),
        (1, 4, "tool", '{"id": "none", "content": 0}'), (1, 5, "assistant", call("a", 9)), (1, 6, "assistant", call("d", 1, name="other")), (1, 7, "tool", "text"),
    ])
    assert [(r["kind"], r["call_id"], r["status"], r["level"]) for r in found if r["role"] != "user"] == [
        ("call", "a", "linked", 0), ("call", "b", "invalid", 1), ("call", "c", "pending", 2), ("result", "a", "linked", 1), ("result", "a", "repeated", 1), ("result", "none", "orphan", 0), ("call", "a", "repeated", 0),
        ("call", "d", "invalid", 0), ("result", None, "orphan", 0),
    ]
    assert found[1]["json"] == '{"arguments":{"x":1},"id":"a","name":"add"}'
    assert found[2]["problems"] == "$.x: not integer"


def test_order_and_cycles(frame):
    chain = [(1, k, "assistant", call(f"c{k}", after=[f"c{k + 1}"])) for k in range(6)] + [(2, 0, "assistant", call("a", after=["b"])), (2, 1, "assistant", call("b", after=["a"])), (2, 2, "assistant", call("e", after=["a"])), (3, 0, "assistant", call("s", after=["s"]))]
    found = {(r["conv_id"], r["call_id"]): r for r in rows(frame, chain)}
    assert [found[1, f"c{k}"]["level"] for k in range(6)] == [5, 4, 3, 2, 1, 0]
    assert all(found[1, f"c{k}"]["order_turn"] == 5 for k in range(6))
    assert {k: r["status"] for k, r in found.items() if k[0] > 1} == {(2, "a"): "cycle", (2, "b"): "cycle", (2, "e"): "cycle", (3, "s"): "cycle"}


def test_odd_rows(frame):
    found = rows(frame, [(None, None, None, None), (None, 0, "user", "x"), (5, 0, "user", None), (5, 0, "user", ""), (5, 1, "assistant", "y"), (5, 1, "assistant", "y"), (6, 3, "assistant", "<tool_call>not json</tool_call>"), (7, 0, "system", 'é "q"\n')])
    assert len(found) == 8
    by = lambda c: [(r["kind"], r["status"]) for r in found if r["conv_id"] == c]
    assert by(5) == [("call", "invalid"), ("call", "invalid"), ("result", "linked"), ("result", "linked")] and by(6) == [("call", "invalid")]
    assert [r["json"] for r in found if r["conv_id"] == 7] == ['{"content":"é \\"q\\"\\n","role":"system"}']
    assert C.linked(frame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("value, schema, expected", [(1, {"type": "number"}, []), (True, {"type": "integer"}, ["$: not integer"]), ("ab", {"maxLength": 1}, ["$: too long"]), ([1, "x"], {"type": "array", "items": {"type": "integer"}}, ["$[1]: not integer"]), ({"a": 1}, {"properties": {}, "additionalProperties": False}, ["$.a: unknown"]), (5, {"enum": [1, 2]}, ["$: not in enum"]), (5, {"minimum": 6}, ["$: too small"]), (10**400, {"type": "integer"}, []), (1.5, {"type": "integer"}, ["$: not integer"]), (2.0, {"type": "integer"}, []), (None, {"type": ["string", "null"]}, []), (1, {"type": ["string", "null"]}, ["$: not string or null"]), (True, {"enum": [1]}, ["$: not in enum"]), (1.0, {"enum": [1]}, []), ([True], {"enum": [[1]]}, ["$: not in enum"]), ({"a": 1}, {"additionalProperties": {"type": "string"}}, ["$.a: not string"]), ({"a": 1}, {"properties": {"a": False}}, ["$.a: not allowed"]), ([], {"minItems": 1}, ["$: too few"]), ({"a": {"b": 1}}, {"const": {"a": {"b": True}}}, ["$: not the constant"])])
def test_schemas(value, schema, expected):
    assert C.problems(value, schema) == expected


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_as_sql(spark):
    same(C.op4_chat_tools(spark, str(DATA)), C.ORACLE["op4_chat_tools"], connection())


def test_long_chains_are_no_cycles(frame, spark):
    n = 1200
    schema = "conv_id long, call_id string, turn long, after array<string>"
    chain = [(1, f"c{k}", n - k, [f"c{k - 1}"] if k else []) for k in range(n)]
    cycle = [(2, f"c{k}", k, [f"c{(k + 1) % 5}"]) for k in range(5)] + [(2, "behind", 9, ["c0"]), (2, "free", 9, [])]
    wide = [(3, f"c{k}", k, [f"c{j}" for j in range(max(0, k - 2), k)]) for k in range(6)] + [(3, "x", 0, ["c5", "c1", "c1", "none"])]
    found = {(r["conv_id"], r["call_id"]): (r["order_turn"], r["level"]) for r in C.ordered(spark.createDataFrame(chain + cycle + wide, schema)).collect()}
    assert len(found) == len(chain + cycle + wide)
    assert all(found[1, f"c{k}"] == (n, k) for k in range(n))
    assert {k[1]: x for k, x in found.items() if k[0] == 2} == {**{f"c{k}": (None, None) for k in range(5)}, "behind": (None, None), "free": (9, 0)}
    assert {k[1]: x for k, x in found.items() if k[0] == 3} == {**{f"c{k}": (k, k) for k in range(6)}, "x": (5, 6)}


def test_hostile_json(frame):
    deep = "[" * 20000
    objects = '{"id":"d","content":' + "[" * 900 + "]" * 900 + "}"
    messages = [(1, 0, "tool", deep), (1, 1, "tool", '{"id":"x","content":"\\ud800"}'), (1, 2, "tool", '{"id":"x","content":NaN}'), (1, 3, "tool", '{"id":"y","content":1e999}'), (1, 4, "assistant", '<tool_call>{"id":"\\udfff","name":"add","arguments":{"x":1' + "0" * 400 + "}}</tool_call>"),
                (1, 5, "assistant", "<tool_call>" + '{"a":' * 5000 + "</tool_call>"), (1, 6, "tool", objects), (1, 7, "assistant", '<tool_call>{"id":true,"name":"add","arguments":"{\\"x\\": 2}","after":"x"}</tool_call>'), (1, 8, "tool", '{"id":"' + "9" * 5000 + '","content":' + "9" * 5000 + "}")]
    found = {r["turn"]: r for r in rows(frame, messages)}
    assert [found[k]["problems"] for k in (0, 2, 3, 5, 8)] == ["not a JSON object"] * 5
    assert found[1]["json"] == '{"call_id":"x","content":"\\ud800"}' and json.loads(found[1]["json"])["content"] == "\ud800"
    assert found[4]["call_id"] == "\\udfff" and found[4]["problems"] is None and "0" * 400 in found[4]["json"]
    assert found[7]["call_id"] == "true" and found[7]["json"] == '{"arguments":{"x":2},"id":"true","name":"add"}' and found[7]["problems"] is None
    assert all(json.loads(r["json"]) is not None for k, r in found.items() if k != 6)


def longest(calls):
    """Places of calls {id: (turn, after)} by brute force."""
    out = {k: (t, 0) for k, (t, _) in calls.items()}
    for _ in calls:
        for k, (t, after) in calls.items():
            for b in after:
                if b in calls:
                    out[k] = max(out[k][0], out[b][0]), max(out[k][1], out[b][1] + 1)
    stuck = {k for k in calls if out[k][1] >= len(calls)}
    for _ in calls:
        stuck |= {k for k, (_, after) in calls.items() if set(after) & stuck}
    return {k: (None, None) if k in stuck else x for k, x in out.items()}


def test_generated_markup(frame):
    import random

    rng, messages, expected = random.Random(4), [], {}
    for conv in range(12):
        ids, calls = [f"c{k}" for k in range(rng.randrange(2, 14))], {}
        for turn, ident in enumerate(rng.sample(ids, len(ids))):
            after = rng.sample(ids if conv % 3 == 0 else ids[: ids.index(ident)], min(rng.randrange(3), len(ids if conv % 3 == 0 else ids[: ids.index(ident)])))
            calls[ident] = (2 * turn, after)
            messages.append((conv, 2 * turn, "assistant", "so " + call(ident, 1, after)))
            if rng.random() < 0.7:
                messages.append((conv, 2 * turn + 1, "tool", json.dumps({"id": ident, "content": turn})))
        expected |= {(conv, k): x for k, x in longest(calls).items()}
    found = rows(frame, messages)
    assert {(r["conv_id"], r["call_id"]): (r["order_turn"] if r["status"] != "cycle" else None, r["level"]) for r in found if r["kind"] == "call"} == expected
    answered = {(r["conv_id"], r["call_id"]) for r in found if r["kind"] == "result"}
    assert all(r["status"] == ("cycle" if expected[r["conv_id"], r["call_id"]][1] is None else "linked" if (r["conv_id"], r["call_id"]) in answered else "pending") for r in found if r["kind"] == "call")
    place = {}
    for n, r in enumerate(found):
        place.setdefault((r["conv_id"], r["call_id"], r["kind"]), n)
    for (conv, ident), (turn, _) in expected.items():
        if turn is not None and (conv, ident) in answered:
            assert place[conv, ident, "call"] < place[conv, ident, "result"]

"""Tool-call linking for chats: calls joined to results, ordered, validated and serialised.

Messages (conv_id, turn, role, text) are read in one pass. An assistant's `<tool_call>{...}</tool_call>` is
a call with id, name, arguments and the ids it comes `after`; a message of role tool, or a
`<tool_result>{...}</tool_result>`, is a result with id and content. Where a message has neither and
`exchange` is set, a conversation is itself an exchange: a user's turn calls the tool `reply`, and an
assistant's answers the call of the turn before it. All else is a plain message.

Calls and results meet by a hash join on (conv_id, call id). Of calls that repeat an id the one of the
smallest turn counts, and it is found by a partial aggregate before the join, so a conversation or id that
holds a third of all rows is neither gathered nor multiplied.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import written

CALL, RESULT = (re.compile(rf"<{tag}>(.*?)</{tag}>", re.DOTALL) for tag in ("tool_call", "tool_result"))

SCHEMAS = {"reply": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False}}

#: Halves of surrogate pairs, which JSON's escapes can name and UTF-8 can not hold.
HALF = re.compile("[\ud800-\udfff]")

KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys and without blanks; letters stay as they are, but halves of surrogate pairs are escaped."""
    return sound(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def sound(text: str) -> str:
    """A text that UTF-8 can hold: halves of surrogate pairs as JSON escapes."""
    return HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def equal(a, b) -> bool:
    """Whether two JSON values are the same: 1 is 1.0, but not true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    return a == b


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return kind in KINDS and isinstance(value, KINDS[kind])


def problems(value, schema: dict | bool, at: str = "$") -> list[str]:
    """What is wrong with a value under a schema: type (one or several), enum, const, required, properties,
    additionalProperties, items, minItems, maxItems, minLength, maxLength, minimum, maximum. A schema may be true or false."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = [f"{at}: not in enum"] if "enum" in schema and not any(equal(value, x) for x in schema["enum"]) else []
    found += [f"{at}: not the constant"] if "const" in schema and not equal(value, schema["const"]) else []
    if isinstance(value, str):
        found += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{at}: too small"] * (value < schema.get("minimum", value)) + [f"{at}: too large"] * (value > schema.get("maximum", value))
    elif isinstance(value, list):
        found += [f"{at}: too few"] * (len(value) < schema.get("minItems", 0)) + [f"{at}: too many"] * (len(value) > schema.get("maxItems", len(value)))
        for k, x in enumerate(value):
            found += problems(x, schema.get("items", {}), f"{at}[{k}]")
    elif isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{at}.{k}")
            elif more is False:
                found.append(f"{at}.{k}: unknown")
            else:
                found += problems(value[k], more, f"{at}.{k}")
    return found


def _refused(constant: str):
    raise ValueError(f"{constant} is not JSON")


def _finite(text: str) -> float:
    value = float(text)
    return value if abs(value) < float("inf") else _refused(text)


def _parsed(text: str):
    """The JSON object in a text, or null: numbers that JSON or doubles do not know, and nesting beyond the reader's depth, make none."""
    try:
        value = json.loads(text, parse_constant=_refused, parse_float=_finite)
        return value if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        return None


def _ident(value) -> str | None:
    """An id as a text; what is no text as JSON."""
    return None if value is None else sound(value) if isinstance(value, str) else canonical(value)


def _call(value: dict | None, schemas: dict) -> tuple:
    if value is None:
        return "call", None, [], "not a JSON object", canonical({"arguments": None, "id": None, "name": None})
    ident, name, arguments = _ident(value.get("id")), value.get("name"), value.get("arguments")
    if isinstance(arguments, str):
        arguments = _parsed(arguments)
    wrong = problems(arguments, schemas[name]) if isinstance(name, str) and name in schemas else ["no such tool"]
    after = value.get("after")
    after = [_ident(x) for x in after if x is not None] if isinstance(after, list) else []
    if ident is None:
        wrong.append("no id")
    return "call", ident, after, sound("; ".join(wrong)) or None, canonical({"arguments": arguments, "id": value.get("id") if ident is None else ident, "name": name})


def _result(value: dict | None) -> tuple:
    if value is None:
        return "result", None, [], "not a JSON object", canonical({"call_id": None, "content": None})
    ident = _ident(value.get("id"))
    return "result", ident, [], "no id" if ident is None else None, canonical({"call_id": ident, "content": value.get("content")})


def _safely(make, text: str, *more) -> tuple:
    """make() of the object in a text; one that is nested too deeply to be checked or written is no object."""
    try:
        return make(_parsed(text), *more)
    except RecursionError:
        return make(None, *more)


def read_message(turn: int | None, role: str | None, text: str | None, schemas: dict, exchange: bool) -> list[tuple]:
    """(kind, call_id, after, problems, json) of what a message holds."""
    body = text or ""
    found = [_safely(_call, x, schemas) for x in CALL.findall(body)] if role == "assistant" else []
    found += [_safely(_result, x) for x in RESULT.findall(body)]
    if found:
        return found
    if role == "tool":
        return [_safely(_result, body)]
    if exchange and role == "user" and turn is not None:
        return [_call({"id": turn, "name": "reply", "arguments": {"text": text}}, schemas)]
    if exchange and role == "assistant" and turn is not None:
        return [_result({"id": turn - 1, "content": text})]
    return [("message", None, [], None, canonical({"content": text, "role": role}))]


def parsed(messages: DataFrame, schemas: dict = SCHEMAS, exchange: bool = True) -> DataFrame:
    """(conv_id, turn, role, part, kind, call_id, after, problems, json), one row for each call, result or plain message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
        for batch in batches:
            rows, at = [], []
            for k, (turn, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("turn", "role", "text")))):
                for part, x in enumerate(read_message(turn, role, text, schemas, exchange)):
                    rows.append((part, *x))
                    at.append(k)
            own = batch.select(["conv_id", "turn", "role"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["conv_id", "turn", "role", "part", "kind", "call_id", "after", "problems", "json"])

    rows = messages.select("conv_id", "turn", "role", "text")
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:3])
    return rows.mapInArrow(run, f"{own}, part int, kind string, call_id string, after array<string>, problems string, json string")


def ordered(calls: DataFrame) -> DataFrame:
    """Distinct calls (conv_id, call_id, turn, after) -> (conv_id, call_id, order_turn, level).

    A call comes after those that it names: its order_turn is the largest turn of itself and all before it,
    its level the longest way to it. Ids that are no call of the conversation are ignored. Calls on a cycle,
    or behind one, have null. Each round replaces an edge to a call that has at most one open edge left by
    that call's own, the way's length added, so a chain takes a logarithmic number of rounds; rounds go on
    until no edge can be replaced. Calls that all come after two or more others each settle one level a
    round. A way longer than there are calls holds a cycle, and its edge is never replaced again.
    """
    key = ["conv_id", "call_id"]
    edges = calls.select(*key, F.explode(F.array_distinct("after")).alias("before"), F.lit(1).cast("long").alias("way"))
    edges = written(edges.join(calls.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"]).select(*key, "before", "way"), "after")
    if edges.isEmpty():
        return calls.select(*key, F.col("turn").alias("order_turn"), F.lit(0).alias("level"))
    most = edges.select(*key).distinct().count() + 1
    nodes = written(calls.select(*key, F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("level")), "places")
    while True:
        open_ = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("before").alias("next"), F.max("way").alias("step"))
        short = nodes.join(open_, key, "left").where("n is null or n = 1 and next <> call_id").where(F.coalesce("step", F.lit(0)) <= most)
        short = short.select("conv_id", F.col("call_id").alias("before"), "order_turn", "level", "next", "step", F.lit(True).alias("is_short"))
        seen = written(edges.join(short, ["conv_id", "before"], "left").withColumn("is_short", F.col("is_short").isNotNull() & (F.col("way") <= most)), "seen")
        passed = seen.where("is_short")
        if passed.isEmpty():
            break
        gained = passed.groupBy(*key).agg(F.max("order_turn").alias("t"), F.max(F.col("way") + F.col("level")).alias("l"))
        nodes = written(nodes.join(gained, key, "left").select(*key, F.greatest("order_turn", "t").alias("order_turn"), F.greatest("level", "l").alias("level")), "places")
        further = passed.where("next is not null").select(*key, F.col("next").alias("before"), (F.col("way") + F.col("step")).alias("way"))
        edges = written(seen.where("not is_short").select(*key, "before", "way").union(further).groupBy(*key, "before").agg(F.max("way").alias("way")), "after")
    stuck = edges.select(*key).distinct().withColumn("stuck", F.lit(True))
    known = F.col("stuck").isNull()
    return nodes.join(stuck, key, "left").select(*key, F.when(known, F.col("order_turn")).alias("order_turn"), F.when(known, F.col("level").cast("int")).alias("level"))


def linked(messages: DataFrame, schemas: dict = SCHEMAS, exchange: bool = True) -> DataFrame:
    """Every call, result and plain message of messages with its link, place and canonical JSON.

    Columns: conv_id, turn, role, part (place in the message), kind, call_id, status, order_turn, level,
    problems, json. status of a call: linked, pending (no result), repeated (its id was called before),
    cycle or invalid (no id, or problems); of a result: linked, repeated (not the first of its call) or
    orphan; of a message: plain. Sorted by (conv_id, order_turn, level, turn, part) nothing stands before
    what it depends on: a result follows its call, a call those that it names. Rows that repeat a call's
    turn are all `linked`, being the same call; null conversations are one conversation, without links.
    """
    rows = written(parsed(messages, schemas, exchange), "messages")
    key = ["conv_id", "call_id"]
    usable = rows.where("call_id is not null and conv_id is not null")
    first = usable.where("kind = 'call'").groupBy(*key).agg(F.min_by(F.struct("turn", "part", "after", "problems"), F.struct("turn", "part", "json")).alias("c"))
    first = written(first.select(*key, "c.turn", "c.part", "c.after", F.col("c.problems").isNull().alias("good")), "calls")
    answers = usable.where("kind = 'result'").groupBy(*key).agg(F.min(F.struct("turn", "part")).alias("r")).select(*key, "r.turn", "r.part")
    places = ordered(first.select(*key, "turn", "after"))
    heads = first.join(places, key).join(answers.select(*key, F.col("turn").alias("a_turn"), F.col("part").alias("a_part")), key, "left")
    heads = heads.select(*key, F.col("turn").alias("c_turn"), F.col("part").alias("c_part"), "good", "order_turn", "level", "a_turn", "a_part")
    # messages and what has no id meet nothing, and do not go to one task by their null key
    linkable = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    both = rows.where(linkable).join(heads, key, "left").unionByName(rows.where(~linkable), allowMissingColumns=True)
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    own = F.col("turn").eqNullSafe(F.col("c_turn")) & F.col("part").eqNullSafe(F.col("c_part"))
    answer = F.col("turn").eqNullSafe(F.col("a_turn")) & F.col("part").eqNullSafe(F.col("a_part"))
    status = (
        F.when(is_call & (F.col("problems").isNotNull() | F.col("c_part").isNull()), "invalid")
        .when(is_call & ~own, "repeated")
        .when(is_call & F.col("level").isNull(), "cycle")
        .when(is_call & F.col("a_part").isNull(), "pending")
        .when(is_result & F.col("c_part").isNull(), "orphan")
        .when(is_result & ~answer, "repeated")
        .when(is_call | is_result, "linked")
        .otherwise("plain")
    )
    level = F.when(is_call, F.col("level")).when(is_result & F.col("c_part").isNotNull(), F.col("level") + 1).otherwise(0)
    turn = F.when(is_call | is_result, F.coalesce(F.greatest("turn", "order_turn"), F.col("turn"))).otherwise(F.col("turn"))
    return both.select("conv_id", "turn", "role", "part", "kind", "call_id", status.alias("status"), turn.alias("order_turn"), level.cast("int").alias("level"), "problems", "json")


def op4_chat_tools(spark, sf_dir: str) -> DataFrame:
    """Every message of all conversations as call, result or plain message, linked and serialised."""
    return linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = {
    "op4_chat_tools": """
with m as (select conv_id, turn, role, text,
             case role when 'user' then 'call' when 'assistant' then 'result' else 'message' end as kind,
             case role when 'user' then cast(turn as varchar) when 'assistant' then cast(turn - 1 as varchar) end as call_id
           from conversations),
c as (select conv_id, call_id, count(*) as n from m where kind = 'call' group by all),
a as (select conv_id, call_id, min(turn) as turn from m where kind = 'result' group by all)
select m.conv_id, m.turn, m.role, cast(0 as integer) as part, m.kind, m.call_id,
       case when kind = 'message' then 'plain'
            when kind = 'call' and length(text) = 0 then 'invalid'
            when kind = 'call' and a.turn is null then 'pending'
            when kind = 'result' and c.n is null then 'orphan' else 'linked' end as status,
       m.turn as order_turn, cast(case when kind = 'result' and c.n is not null then 1 else 0 end as integer) as level,
       case when kind = 'call' and length(text) = 0 then '$.text: too short' end as problems,
       case kind when 'call' then '{"arguments":{"text":' || cast(to_json(text) as varchar) || '},"id":"' || m.call_id || '","name":"reply"}'
                 when 'result' then '{"call_id":"' || m.call_id || '","content":' || cast(to_json(text) as varchar) || '}'
                 else '{"content":' || cast(to_json(text) as varchar) || ',"role":"' || role || '"}' end as json
from m left join c on m.conv_id = c.conv_id and m.call_id = c.call_id left join a on m.conv_id = a.conv_id and m.call_id = a.call_id"""
}

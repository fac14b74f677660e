"""Tool calls of conversations: linked to their results, ordered, validated, written as JSON.

Messages hold JSON texts. A message with ``{"tool_calls": [{"id", "name", "arguments", "after"}]}``
makes calls (``after``, optional, names the call whose result this one needs); a message with
``{"tool_call_id", "content"}`` gives a result. Calls and results are joined by conversation and
identifier. Arguments are checked against the tool's schema. A call comes after the call it needs
and after everything that one needs; the order is a key, not a number of rows: (latest turn among the
calls it rests on, how many there are, own turn and place) sorts every call behind those it needs.
Both parts are found for all calls at once by doubling: each round a call takes over what its
current ancestor has gathered and that one's ancestor, so a chain of n calls takes log n rounds and
a conversation of any length is never brought together in one task.

Defined results: a text that is null or not such JSON makes no calls; the first call (by turn and
place) with an identifier counts, and the first result; further ones are counted in ``repeated``; a
result without a call is left out; a call without a result has a null one and is not linked;
a call that needs an unknown one is in error and ordered as if it needed none; calls in a circle, or
resting on one, are in error and come last; null conversations and identifiers make no calls;
an empty table gives an empty table; columns beyond those named are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrank.llm.common import column, map_arrow, slices
from dayrank.session import materialize

Schema = dict[str, Any]

_TYPES = {
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v == int(v),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}


def faults(value: Any, schema: Schema, path: str = "$") -> list[str]:
    """Where a value does not fit a JSON schema (the keywords below; others are ignored)."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of the values")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            out.append(f"{path}: out of range")
    if isinstance(value, str | list):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if not schema.get(low, 0) <= len(value) <= schema.get(high, math.inf):
            out.append(f"{path}: wrong length")
    if isinstance(value, list) and "items" in schema:
        for at, item in enumerate(value):
            out += faults(item, schema["items"], f"{path}[{at}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{name}: missing" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in known:
                out += faults(value[name], known[name], f"{path}.{name}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{name}: unknown")
    return out


def canonical(value: Any) -> str:
    """JSON with sorted names, no spaces, whole floats as integers, characters unescaped where
    JSON lets them."""

    def plain(v: Any) -> Any:
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("not a JSON number")
            return int(v) if v == int(v) and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _parsed(text: str | None) -> dict[str, Any]:
    if not text or not text.lstrip().startswith("{"):
        return {}
    try:
        value = json.loads(text)
        canonical(value).encode("utf-8")
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def records(messages: DataFrame, schemas: dict[str, Schema], conv_col: str, turn_col: str, text_col: str) -> DataFrame:
    """The calls and results of all messages, arguments checked and written as canonical JSON."""
    names = ["conv_id", "call_id", "turn", "place", "is_call", "name", "after", "body", "errors"]
    kind = messages.schema[conv_col].dataType.simpleString()
    schema = (
        f"conv_id {kind}, call_id string, turn bigint, place int, is_call boolean, name string, "
        "after string, body string, errors array<string>"
    )

    def of(text: str | None) -> Iterator[tuple]:
        value = _parsed(text)
        calls = value.get("tool_calls")
        for place, call in enumerate(calls if isinstance(calls, list) else []):
            if not isinstance(call, dict) or not isinstance(call.get("id"), str):
                continue
            name, after = call.get("name"), call.get("after")
            arguments = call.get("arguments")
            known = isinstance(name, str) and name in schemas
            errors = faults(arguments, schemas[name]) if known else ["unknown tool"]
            yield (
                call["id"], place, True, name if isinstance(name, str) else None,
                after if isinstance(after, str) else None, canonical(arguments), errors,
            )
        if isinstance(value.get("tool_call_id"), str):
            yield value["tool_call_id"], 0, False, None, None, canonical(value.get("content")), []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            convs, turns, texts = (column(batch, c).to_pylist() for c in ("conv", "turn", "text"))
            rows = [
                (conv, call_id, turn, place, *rest)
                for conv, turn, text in zip(convs, turns, texts, strict=True)
                if conv is not None
                for call_id, place, *rest in of(text)
            ]
            types = [column(batch, "conv").type, pa.string(), pa.int64(), pa.int32(), pa.bool_(), *[pa.string()] * 3, pa.list_(pa.string())]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    chosen = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text")
    )
    return map_arrow(chosen, run, schema)


def _first(rows: DataFrame, *fields: str) -> DataFrame:
    """The first row of each identifier, and how many there are."""
    order = F.struct("turn", "place", *fields)
    return rows.groupBy("conv_id", "call_id").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n")
    )


def ordered(calls: DataFrame) -> DataFrame:
    """The calls (conv_id, call_id, turn, after) with the parts of their order and whether the call
    needed is known and there is no circle."""
    ids = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    now = materialize(
        calls.select("conv_id", "call_id", "turn", "after")
        .join(ids, ["conv_id", "after"], "left")
        .select(
            "conv_id",
            "call_id",
            F.col("turn").alias("order_turn"),
            F.col("known").cast("long").alias("order_depth"),
            F.when(F.col("known"), F.col("after")).alias("up"),
            (F.col("after").isNotNull() & F.col("known").isNull()).alias("unknown"),
        )
        .withColumn("order_depth", F.coalesce("order_depth", F.lit(0).cast("long"))),
        "calls",
    )
    waiting = now.filter("up IS NOT NULL").count()
    while waiting:
        up = now.select(
            "conv_id",
            F.col("call_id").alias("up"),
            F.col("order_turn").alias("up_turn"),
            F.col("order_depth").alias("up_depth"),
            F.col("up").alias("next"),
        )
        moved = now.join(up, ["conv_id", "up"]).select(
            "conv_id",
            "call_id",
            F.greatest("order_turn", "up_turn").alias("order_turn"),
            # A circle's depth doubles each round; only its being large matters.
            F.least(F.col("order_depth") + F.col("up_depth"), F.lit(1 << 61)).alias("order_depth"),
            F.col("next").alias("up"),
            "unknown",
        )
        now = materialize(now.filter("up IS NULL").unionByName(moved), "calls")
        still = now.filter("up IS NOT NULL").count()
        if still == waiting:  # only circles and what rests on them are left
            break
        waiting = still
    return now.withColumn("circle", F.col("up").isNotNull()).drop("up")


def link(
    messages: DataFrame,
    schemas: dict[str, Schema],
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    text_col: str = "text",
) -> DataFrame:
    """A row for each call: its order, whether it is linked and valid, its errors, and call and
    result as one line of canonical JSON."""
    rows = materialize(records(messages, schemas, conv_col, turn_col, text_col), "tool_records")
    calls = _first(rows.filter("is_call"), "name", "after", "body", "errors")
    calls = materialize(calls.select("conv_id", "call_id", "first.*", F.col("n").alias("calls")), "tool_calls")
    results = _first(rows.filter("NOT is_call"), "body").select(
        "conv_id", "call_id", F.col("first.body").alias("result"), F.col("first.turn").alias("result_turn"),
        F.col("n").alias("results"),
    )
    circle = F.col("circle")
    more = F.array_compact(
        F.array(F.when(F.col("unknown"), "needs an unknown call"), F.when(circle, "needs itself"))
    )
    joined = (
        calls.join(ordered(calls), ["conv_id", "call_id"])
        .join(results, ["conv_id", "call_id"], "left")
        .withColumn("errors", F.concat("errors", more))
    )
    pieces = {
        "after": _string("after"),
        "arguments": F.col("body"),
        "conversation": _string(F.col("conv_id").cast("string")),
        "errors": F.concat(F.lit("["), F.array_join(F.transform("errors", _string), ","), F.lit("]")),
        "id": _string("call_id"),
        "name": _string("name"),
        "result": F.coalesce("result", F.lit("null")),
    }
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in sorted(pieces.items())]
    big = F.lit((1 << 62) - 1)
    return joined.select(
        F.col("conv_id").alias(conv_col),
        "call_id",
        F.when(circle, big).otherwise(F.col("order_turn")).alias("order_turn"),
        F.when(circle, F.lit(0)).otherwise(F.col("order_depth")).alias("order_depth"),
        F.col("turn"),
        F.col("place"),
        F.col("result_turn"),
        F.col("results").isNotNull().alias("linked"),
        (F.size("errors") == 0).alias("valid"),
        F.array_join("errors", "; ").alias("errors"),
        (F.col("calls") + F.coalesce("results", F.lit(1)) - 2).alias("repeated"),
        F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"),
    )


#: What JSON must escape, with its canonical form.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"} | {
    chr(c): f"\\u{c:04x}" for c in range(0x20) if chr(c) not in "\b\f\n\r\t"
}


def _string(value: str | Column) -> Column:
    """A text as a JSON string; null as null."""
    value = F.col(value) if isinstance(value, str) else value
    out = value
    for raw, escaped in _ESCAPES.items():
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))

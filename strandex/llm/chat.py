"""Chat formatting with tool-call linking.

Turns of conversations become canonical JSON (keys sorted, no white space, absent values left out), one row a message.
An assistant turn whose text is a JSON object with `tool_calls` [{"id", "name", "arguments", "depends_on"}] makes calls;
a tool turn whose text is a JSON object with `tool_call_id` and `content` is a result.  Calls and results meet in a hash
join on conversation and identifier.  Messages are ordered so that a result follows its call, and calls are levelled: a
call lies one level above the deepest call it depends on.  Arguments are held against the tools' schemas (a JSON-schema
subset: type, required, properties, additionalProperties, items, enum, minimum, maximum, minLength, maxLength).

Messages stay rows: their places come from a sort in ranges, so that a conversation (or all rows without conv_id, which
count as one) that holds a third of all messages is spread over many tasks.  The order of calls is given as the field
`level`; calls of a turn are serialised by place.

Edge cases: null texts give a message without content; null roles and turns sort first; text that is no JSON object is
plain content; a call id used twice in a conversation links its first call (by turn, then place) and marks the others
duplicate; calls without id stay calls, and nothing links to them; results without call and calls without result are kept
and marked; calls in a cycle or behind one get a null level; with no schema for a tool the arguments count as valid if
they are an object; equal rows are messages of their own, each with its own calls; a text of any length is one message;
an empty table gives none; columns beside conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, placed_within, read, stored

ROUNDS = 30  # of the topological order, before small conversations are followed whole
FOLLOWED = 200_000  # dependencies left in a conversation that one task follows
_CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def faults(value, schema: dict, where: str = "$") -> list[str]:
    """What is wrong with a value, in the schema's terms."""
    out = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        fits = any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) or k == "integer" and isinstance(value, float) and value.is_integer() for k in kinds)
        if not fits:
            return [f"{where}: not {'/'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{where}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{where}: under minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{where}: over maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{where}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{where}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{where}: not the pattern")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{where}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += faults(v, known[k], f"{where}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{where}.{k}: unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += faults(v, schema["additionalProperties"], f"{where}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, v in enumerate(value):
            out += faults(v, schema["items"], f"{where}[{i}]")
    return out


def canonical(text: str | None) -> str | None:
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError):
        return None


def _with_calls(text: pd.Series, content: pd.Series, calls: pd.Series) -> pd.Series:
    """The canonical message of a turn with calls: its other fields stay, tool_calls is given as serialised."""
    out = []
    for t, c, made in zip(text, content, calls, strict=True):
        if t is None:
            out.append(None)
            continue
        try:
            fields = json.loads(canonical(t))
        except TypeError:  # only Spark reads it
            fields = {"content": c}
        parts = {k: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for k, v in fields.items() if v is not None}
        parts |= {"role": '"assistant"', "tool_calls": f"[{made}]"}
        out.append("{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{parts[k]}" for k in sorted(parts)) + "}")
    return pd.Series(out, dtype=object)


def parse(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) with calls (array), content (beside calls), result_id, result, row (a number for each message) and conv (conv_id, never null)."""
    looks = F.col("text").rlike(r"^\s*\{")
    made = F.when((F.col("role") == "assistant") & looks, F.from_json("text", _CALLS))
    result = F.when((F.col("role") == "tool") & looks, F.from_json("text", _RESULT))
    out = messages.select("conv_id", "turn", "role", "text", made["tool_calls"].alias("calls"), made["content"].alias("content"), result["tool_call_id"].alias("result_id"), result["content"].alias("result"))
    return stored(out.withColumns({"row": F.monotonically_increasing_id(), "conv": F.to_json(F.struct("conv_id"))}), "messages")


def link(parsed: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row a call: conv_id, turn, place, call_id, name, arguments (canonical), errors, duplicate, level, result_turn, n_results."""
    schemas = schemas or {}

    @F.pandas_udf(T.StructType([T.StructField("arguments", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType()))]))
    def judged(name: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        out = []
        for n, a in zip(name, arguments, strict=True):
            c = canonical(a)
            if c is None:
                out.append((None, ["$: no JSON"]))
            else:
                out.append((c, faults(json.loads(c), schemas.get(n, {"type": "object"}))))
        return pd.DataFrame(out, columns=["arguments", "errors"])

    each = parsed.where(F.size("calls") > 0).select("conv_id", "conv", "row", "turn", F.posexplode("calls").alias("place", "c"))
    each = each.select("conv_id", "conv", "row", "turn", "place", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), judged(F.col("c.name"), F.col("c.arguments")).alias("j"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    each = each.select("conv_id", "conv", "row", "turn", "place", "call_id", "name", "j.arguments", "j.errors", "depends_on")
    own = F.struct("turn", "place", "arguments", "row")
    first = each.where(F.col("call_id").isNotNull()).groupBy("conv", "call_id").agg(F.min(own).alias("first"))
    each = checkpoint(each.join(first, ["conv", "call_id"], "left").withColumn("duplicate", F.col("first").isNotNull() & (own != F.col("first"))).drop("first"))
    results = parsed.where(F.col("result_id").isNotNull()).groupBy("conv", F.col("result_id").alias("call_id")).agg(F.min("turn").alias("result_turn"), F.count(F.lit(1)).alias("n_results"))
    each = each.join(results, ["conv", "call_id"], "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    return each.join(levels(each.where(~F.col("duplicate"))), ["conv", "call_id"], "left").drop("depends_on")


def levels(calls: DataFrame) -> DataFrame:
    """conv, call_id, level: rounds of the topological order; calls in or behind a cycle stay out.

    After ROUNDS rounds, conversations with at most FOLLOWED dependencies left are followed whole, each in one task; in
    larger ones the rounds go on until no call is ready.
    """
    nodes = calls.select("conv", "call_id").where(F.col("call_id").isNotNull()).distinct()
    edges = calls.select("conv", "call_id", F.explode(F.array_distinct("depends_on")).alias("before")).join(nodes.withColumnRenamed("call_id", "before"), ["conv", "before"])
    edges = checkpoint(edges)
    waiting = edges.select("conv", "call_id").distinct()
    done = checkpoint(nodes.join(waiting, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    left, depth = checkpoint(waiting), 0
    while not left.isEmpty():
        if depth == ROUNDS:
            inner = edges.join(left, ["conv", "call_id"], "left_semi").join(left.withColumnRenamed("call_id", "before"), ["conv", "before"], "left_semi")
            large = checkpoint(inner.groupBy("conv").count().where(F.col("count") > FOLLOWED).select("conv"))
            small = left.join(large, "conv", "left_anti")
            done = done.union(checkpoint(followed(inner.join(large, "conv", "left_anti"), small, depth + 1)))
            left = checkpoint(left.join(large, "conv", "left_semi"))
        depth += 1
        open_ = edges.join(left.withColumnRenamed("call_id", "before"), ["conv", "before"], "left_semi").select("conv", "call_id").distinct()
        ready = checkpoint(left.join(open_, ["conv", "call_id"], "left_anti"))
        if ready.isEmpty():
            break
        done = done.union(ready.withColumn("level", F.lit(depth)))
        if depth % ROUNDS == 0:
            done = checkpoint(done)
        left = checkpoint(left.join(ready, ["conv", "call_id"], "left_anti"))
    return done


def followed(inner: DataFrame, left: DataFrame, first: int) -> DataFrame:
    """conv, call_id, level of the calls `left` from level `first` on, conversation by conversation; inner: the dependencies among them."""

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        behind, waits, level = {}, {}, {}
        for call, before in zip(group["call_id"], group["before"], strict=True):
            waits.setdefault(call, 0)
            if before is not None:
                waits[call] += 1
                behind.setdefault(before, []).append(call)
        ready, at = [c for c, n in waits.items() if not n], first
        while ready:
            level |= dict.fromkeys(ready, at)
            following = []
            for c in (x for r in ready for x in behind.get(r, [])):
                waits[c] -= 1
                if not waits[c]:
                    following.append(c)
            ready, at = following, at + 1
        return pd.DataFrame({"conv": group["conv"].iloc[0], "call_id": list(level), "level": list(level.values())})

    rest = inner.select("conv", "call_id", "before").union(left.select("conv", "call_id", F.lit(None).cast("string").alias("before")))
    return rest.groupBy("conv").applyInPandas(follow, "conv string, call_id string, level int")


def format_messages(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, position, turn, role, message (canonical JSON), call_ids, linked (of a result: its call is there), n_errors, n_calls."""
    parsed = parse(messages)
    calls = link(parsed, schemas)
    made = F.to_json(F.struct(F.coalesce(F.col("arguments"), F.lit("")).alias("arguments"), F.col("call_id").alias("id"), F.col("level"), F.col("name")))
    of_turn = calls.groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", made.alias("json")))), lambda x: x["json"]), ",").alias("tool_calls"),
        F.array_sort(F.collect_list("call_id")).alias("call_ids"), F.sum(F.size("errors")).alias("n_errors"),
    )
    called = calls.where(~F.col("duplicate")).select("conv", F.col("call_id").alias("result_id"), F.col("turn").alias("call_turn"))
    both = parsed.join(of_turn, "row", "left").join(called, ["conv", "result_id"], "left")
    # A result that comes before its call goes right behind it.
    both = both.withColumns({"key": F.greatest("turn", "call_turn"), "late": F.coalesce(F.col("call_turn") >= F.col("turn"), F.lit(False)).cast("int")})
    placed = placed_within(both, ["conv"], ["key", "late", "turn", "role", "text"], "position")
    plain = F.to_json(F.struct(F.when(F.col("result_id").isNotNull(), F.col("result")).otherwise(F.col("text")).alias("content"), "role", F.col("result_id").alias("tool_call_id")))
    with_calls = F.pandas_udf(_with_calls, T.StringType())(F.when(F.size("calls") > 0, F.col("text")), "content", "tool_calls")
    return placed.select(
        "conv_id", "position", "turn", "role", F.when(F.size("calls") > 0, with_calls).otherwise(plain).alias("message"),
        F.coalesce("call_ids", F.array().cast("array<string>")).alias("call_ids"), F.when(F.col("result_id").isNotNull(), F.col("call_turn").isNotNull()).alias("linked"), F.coalesce("n_errors", F.lit(0)).cast("long").alias("n_errors"),
        F.when(F.size("calls") > 0, F.size("calls")).otherwise(0).cast("long").alias("n_calls"),
    )


def query(spark, sf_dir) -> DataFrame:
    out = format_messages(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return out.select("conv_id", "position", "turn", "role", "message", "n_calls", "n_errors")


SQL = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position, turn, role,
  '{' || concat_ws(',', '"content":' || to_json(text)::VARCHAR, '"role":' || to_json(role)::VARCHAR) || '}' AS message, 0::BIGINT AS n_calls, 0::BIGINT AS n_errors
FROM conversations
"""

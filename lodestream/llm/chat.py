"""Chat formatting: tool calls and results linked by identifier, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.common import Written, table, tidy


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, whole numbers without a point and characters as they are."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v)}" for k, v in sorted(value.items(), key=lambda x: x[0].encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float) and math.isfinite(value) and value == int(value) and abs(value) < 1e16:
        value = int(value)
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": (int, float)}
#: Keywords that say nothing about validity, that hold one schema, a list or a mapping of them, and the others that are known.
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "deprecated", "readOnly", "writeOnly"}
_ONE, _LIST, _MAP = {"items", "additionalProperties", "not"}, {"anyOf", "allOf", "oneOf"}, {"properties"}
_KNOWN = _NOTES | _ONE | _LIST | _MAP | {"type", "enum", "const", "required", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems", "minProperties", "maxProperties"}


def checked(schema):
    """schema itself; ValueError for a keyword or type that fits() doesn't know, so that none is passed over."""
    if isinstance(schema, bool):
        return schema
    kinds = schema.get("type", [])
    if (odd := set(schema) - _KNOWN) or (odd := ({kinds} if isinstance(kinds, str) else set(kinds)) - set(_TYPES)):
        raise ValueError(f"a schema with {', '.join(sorted(odd))}")
    for k, v in schema.items():
        for x in [v] if k in _ONE else v if k in _LIST else v.values() if k in _MAP else []:
            checked(x)
    return schema


def _is(value, kind: str) -> bool:
    if isinstance(value, bool) and kind != "boolean":
        return False
    return isinstance(value, _TYPES[kind]) and (kind != "integer" or value == int(value))


def fits(value, schema) -> bool:
    """Whether a value is valid under a schema of the keywords that checked() lets pass."""
    if isinstance(schema, bool):
        return schema
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return False
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]) or "const" in schema and canonical(value) != canonical(schema["const"]):
        return False
    if not all(fits(value, x) for x in schema.get("allOf", [])) or "anyOf" in schema and not any(fits(value, x) for x in schema["anyOf"]):
        return False
    if "oneOf" in schema and sum(fits(value, x) for x in schema["oneOf"]) != 1 or "not" in schema and fits(value, schema["not"]):
        return False
    least, most = -math.inf, math.inf
    if _is(value, "number"):
        n = schema.get("multipleOf")
        return schema.get("minimum", least) <= value <= schema.get("maximum", most) and schema.get("exclusiveMinimum", least) < value < schema.get("exclusiveMaximum", most) and (not n or value % n == 0)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", most) and ("pattern" not in schema or re.search(schema["pattern"], value) is not None)
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", most) and all(fits(v, schema.get("items", True)) for v in value)
    if isinstance(value, dict):
        own, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        return schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", most) and all(k in value for k in schema.get("required", [])) and all(fits(v, own.get(k, more)) for k, v in value.items())
    return True


def _name(value) -> str:
    """An identifier as JSON, so that 1 isn't "1"; TypeError for what can't be one."""
    if isinstance(value, bool) or not isinstance(value, str | int | float):
        raise TypeError("no identifier")
    return canonical(value)


def _references(value) -> set[str]:
    """The calls whose results arguments ask for, as {"$result": id}."""
    if isinstance(value, dict):
        own = {_name(value["$result"])} if "$result" in value else set()
        return own.union(*map(_references, value.values()))
    return set().union(*map(_references, value)) if isinstance(value, list) else set()


def _strict(text: str):
    def no(x):
        raise ValueError(x)

    return json.loads(text, parse_constant=no)


def parsed(role: str | None, text: str | None, schemas: dict[str, dict]) -> dict:
    """A message's calls or result, its canonical JSON and what is wrong with it (or null)."""
    out = {"calls": [], "needs": [], "result_id": None, "wrong": None}
    body: dict = {"role": role, "content": text}
    try:
        got = _strict(text) if text and text.lstrip()[:1] == "{" and role in ("assistant", "tool") else None
        if role == "assistant" and isinstance(got, dict) and isinstance(got.get("tool_calls"), list):
            calls, needs = [], set()
            for c in got["tool_calls"]:
                f = c["function"]
                args = _strict(f["arguments"]) if isinstance(f["arguments"], str) else f["arguments"]
                if f["name"] not in schemas:
                    out["wrong"] = out["wrong"] or "unknown tool"
                elif not fits(args, schemas[f["name"]]):
                    out["wrong"] = out["wrong"] or "bad arguments"
                needs |= _references(args)
                out["calls"].append(_name(c["id"]))
                calls.append({"id": c["id"], "type": "function", "function": {"name": f["name"], "arguments": canonical(args)}})
            out["needs"] = sorted(needs)
            body = {"role": role, "content": got.get("content"), "tool_calls": calls}
        elif role == "tool" and isinstance(got, dict) and "tool_call_id" in got:
            out["result_id"] = _name(got["tool_call_id"])
            body = {"role": role, "tool_call_id": got["tool_call_id"], "content": got.get("content")}
        return out | {"json": canonical(body)}
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError, OverflowError):
        return {"calls": [], "needs": [], "result_id": None, "wrong": "bad JSON", "json": canonical({"role": role, "content": text})}


_PARSED = "turn bigint, role string, calls array<string>, needs array<string>, result_id string, wrong string, json string"


def _parse(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    fields = {"calls": pa.list_(pa.string()), "needs": pa.list_(pa.string()), "result_id": pa.string(), "wrong": pa.string(), "json": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parsed(r, t, schemas) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([g[n] for g in got], kind) for n, kind in fields.items())], names=["conv_id", "turn", "role", *fields])

    kind = messages.schema["conv_id"].dataType.simpleString()
    picked = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return picked.mapInArrow(tidy(run), f"conv_id {kind}, {_PARSED}").withColumn("mid", F.monotonically_increasing_id())


#: Linked messages of a conversation that a task orders by itself; longer ones go in rounds of joins.
MOST_ALONE = 10_000
#: The level of what waits for itself: after all others.
CYCLE = 1 << 30


def levels(nodes: list[tuple[int, int | None]], edges: list[tuple[int, int]]) -> list[tuple[int, int | None, int]]:
    """(message, at, level) of nodes (message, turn): one stands after all that lead to it, at the latest of their turns
    and its own; level is the length of the longest way to it, CYCLE where there is no end to it."""
    at, level, after, waits = dict(nodes), {}, defaultdict(list), Counter()
    for a, b in edges:
        after[a].append(b)
        waits[b] += 1
    turns, ready = dict(nodes), [n for n, _ in nodes if not waits[n]]
    while ready:
        n = ready.pop()
        level[n] = 0
        for b in after[n]:
            at[b] = max((x for x in (at[b], at[n]) if x is not None), default=None)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    # Levels of the longest ways, in the order in which messages became free.
    for n in level:
        for b in after[n]:
            if b in level:
                level[b] = max(level[b], level[n] + 1)
    return [(n, at[n], level[n]) if n in level else (n, turns[n], CYCLE) for n, _ in nodes]


def _alone(some: DataFrame, edges: DataFrame) -> DataFrame:
    """(mid, at, level) of the messages of conversations with MOST_ALONE of them at most, each ordered in one go."""
    nodes = some.groupBy("conv").agg(F.collect_list(F.struct("mid", "turn")).alias("nodes"))
    ways = edges.groupBy("conv").agg(F.collect_list(F.struct("a", "b")).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, e in zip(b.column(0), b.column(1), strict=True):
                got = levels([(x["mid"], x["turn"]) for x in n.as_py()], [(x["a"], x["b"]) for x in e.as_py() or []])
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["mid", "at", "level"])

    return nodes.join(ways, "conv", "left").select("nodes", "edges").mapInArrow(tidy(run), "mid bigint, at bigint, level int")


def _in_rounds(some: DataFrame, edges: DataFrame) -> DataFrame:
    """(mid, at, level) as levels() has them, by a round of joins per level. What waits, and for what, shrinks by the round."""
    waits = Written(edges.select("a", "b"), "waits")
    left = Written(some.select("mid", "turn", F.col("turn").alias("at")), "left")
    done, level = [], 0
    while True:
        ready = Written(left.df.join(waits.df.select(F.col("b").alias("mid")).distinct(), "mid", "left_anti").select("mid", "at", F.lit(level).alias("level")), "ready").df
        if ready.isEmpty():
            break
        done.append(ready)
        met = waits.df.join(ready.select(F.col("mid").alias("a"), F.col("at").alias("since")), "a").groupBy(F.col("b").alias("mid")).agg(F.max("since").alias("since"))
        now = Written(left.df.join(ready.select("mid"), "mid", "left_anti").join(met, "mid", "left").select("mid", "turn", F.greatest("at", "since").alias("at")), "left")
        rest = Written(waits.df.join(ready.select(F.col("mid").alias("a")), "a", "left_anti"), "waits")
        left.drop()
        waits.drop()
        left, waits, level = now, rest, level + 1
        if len(done) >= 32:  # many small tables become one
            done = [Written(reduce(DataFrame.unionByName, done), "placed").df]
    # No message became ready: what is left waits for itself.
    return reduce(DataFrame.unionByName, done, left.df.select("mid", F.col("turn").alias("at"), F.lit(CYCLE).alias("level")))


def _linked(rows: DataFrame, most_alone: int = MOST_ALONE) -> DataFrame | None:
    """(mid, at, level, fault) of messages with calls or results: when and in what round each can stand. None: there are none.

    Calls and results meet in a hash join by conversation and identifier. An identifier stands for its earliest call.
    """
    linked = rows.where("size(calls) > 0 OR result_id IS NOT NULL")
    # A struct of a null is like another one: rows without conversation are one.
    some = Written(linked.select("mid", F.struct("conv_id").alias("conv"), "turn", "calls", "needs", "result_id"), "tool-messages").df
    if some.isEmpty():
        return None
    called = some.select("conv", "mid", "turn", F.explode("calls").alias("id")).groupBy("conv", "id").agg(F.min(F.struct(F.col("turn").isNull(), "turn", "mid")).alias("c"), F.count(F.lit(1)).alias("n"))
    answered = some.where("result_id IS NOT NULL").groupBy("conv", F.col("result_id").alias("id")).agg(F.min(F.struct(F.col("turn").isNull(), "turn", "mid")).alias("r"))
    links = Written(called.join(answered, ["conv", "id"], "full").select("conv", "id", F.col("c.mid").alias("call"), F.col("r.mid").alias("result"), "n"), "links").df
    results = some.where("result_id IS NOT NULL").select("mid", "conv", F.col("result_id").alias("id")).join(links, ["conv", "id"])
    needs = some.select("conv", "mid", F.explode("needs").alias("id")).join(links, ["conv", "id"], "left")
    edges = results.where("call IS NOT NULL").select("conv", F.col("call").alias("a"), F.col("mid").alias("b"))
    edges = Written(edges.unionByName(needs.where("result IS NOT NULL").select("conv", F.col("result").alias("a"), F.col("mid").alias("b"))).distinct(), "edges").df
    faults = (
        results.where("call IS NULL").select("mid", F.lit("result without call").alias("fault"))
        .union(needs.where("result IS NULL").select("mid", F.lit("missing result")))
        .union(links.where("result IS NULL AND call IS NOT NULL").select(F.col("call").alias("mid"), F.lit("call without result")))
        .union(links.where("n > 1").select(F.col("call").alias("mid"), F.lit("repeated identifier")))
        .groupBy("mid").agg(F.min("fault").alias("fault"))
    )
    size = some.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    big = Written(size.where(F.col("n") > most_alone).select("conv"), "long-conversations").df
    out = _alone(some.join(big, "conv", "left_anti"), edges.join(big, "conv", "left_anti"))
    if not big.isEmpty():
        out = out.unionByName(_in_rounds(some.join(big, "conv", "left_semi"), edges.join(big, "conv", "left_semi")))
    cycle = F.when(F.col("level") == CYCLE, F.lit("cycle"))
    return out.join(faults, "mid", "left").select("mid", "at", "level", F.coalesce(cycle, "fault").alias("fault"))


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None, most_alone: int = MOST_ALONE) -> DataFrame:
    """conv_id, turn, role, position, n_calls, wrong, json for each row of messages (conv_id, turn, role, text, and more).

    An assistant's text that is a JSON object with tool_calls holds calls, a tool's text with tool_call_id a result; any
    other text is plain. position (from 0) orders a conversation: by turn (null last), but a call comes before its results
    and after the results that its arguments ask for as {"$result": id}; ties by role, then JSON; repeated rows side by
    side. wrong: null, or why a message can't be used: bad JSON, unknown tool, bad arguments, result without call, call
    without result, missing result, repeated identifier, cycle. An identifier is a JSON string or number (else bad JSON).
    Null texts are null contents; rows with a null conversation are one. schemas: of tools' arguments, with none every
    tool is unknown; ValueError for a keyword that isn't supported. A row is a message, and a conversation may be of any
    length: rows are sorted over tasks by range, and only the links of conversations with most_alone linked messages at
    most are gathered; longer ones are ordered in rounds.
    """
    rows = Written(_parse(messages, {k: checked(v) for k, v in (schemas or {}).items()}), "messages").df
    links = _linked(rows, most_alone)
    if links is None:
        rows = rows.select("*", F.col("turn").alias("at"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("fault"))
    else:
        rows = rows.join(links, "mid", "left").withColumn("at", F.coalesce("at", "turn")).withColumn("level", F.coalesce("level", F.lit(0)))
    order = [F.col("conv_id").asc_nulls_last(), F.col("at").asc_nulls_last(), F.col("level").asc(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("json").asc()]
    ordered = Written(rows.repartitionByRange(*order).sortWithinPartitions(*order), "ordered").df
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint")
    # Of each file and conversation: how many rows files before hold of it, from a row per file and conversation.
    placed = ordered.select("*", number.alias("file"), F.col("_metadata.row_index").alias("row"))
    parts = placed.groupBy("conv_id", "file").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("conv_id").alias("c"), F.col("file").alias("f"), (before - F.col("first")).alias("shift"))
    out = placed.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("file") == F.col("f")))
    return out.select("conv_id", "turn", "role", (F.col("row") + F.col("shift")).alias("position"), F.size("calls").alias("n_calls"), F.coalesce("wrong", "fault").alias("wrong"), "json")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


#: Holds where no message has a tool call or result, as in the tables.
OP9_SQL = """
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position, 0::INTEGER AS n_calls,
  NULL::VARCHAR AS wrong, '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' AS json FROM conversations
"""

"""Tool-call linking: calls and results joined by identifier, ordered topologically, validated and written as canonical JSON.

Calls and results are two tables that a hash join links by (conversation, identifier); the join is a full outer one over
keys that are made unique first, so a call without result, a result without call and repeats of either all get a status and
none is lost. A call is ordered after the calls it depends on: its level is one more than the largest level below it. Edges
between two calls that a third call lies between don't matter for that and go first. Calls with one dependency point to it, and
pointers double until they reach an anchor, a call with none or with several, so chains take rounds by the logarithm of their
length; rounds over the anchors then follow the longest chain of calls with several dependencies. All of it are joins by
(conversation, call), so no task holds a conversation. Calls on a cycle, or above one, never come to rest and are told so.
Arguments are validated against a JSON schema of their tool and written
with sorted keys and no blanks, in Arrow batches.

Defined results: a null or empty identifier links with nothing (status unnamed); of calls, or results, that repeat an
identifier the first by position is linked and others are repeats; arguments that are not JSON objects, or are null, are
invalid and written as null; a tool without schema takes any object; a dependency that no call has is reported as missing
and doesn't count for the order. Empty tables give an empty table. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curato.llm import shared

LINKED = "conv_id long, call_id string, position long, status string, tool string, level long, missing int, valid boolean, errors array<string>, message string"
#: Type names of JSON schemas.
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What of value breaks schema: type, enum, const, required, properties, additionalProperties, items, lengths and bounds."""
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    is_kind = lambda k: isinstance(value, KINDS[k]) and not (isinstance(value, bool) and k in ("number", "integer")) or k == "integer" and isinstance(value, float) and value.is_integer()
    if kinds and not any(is_kind(k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not const")
    if isinstance(value, dict):
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        known, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif other is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(other, dict):
                out += problems(value[k], other, f"{at}.{k}")
    if isinstance(value, list):
        for i, x in enumerate(value):
            out += problems(x, schema.get("items", {}), f"{at}[{i}]")
    size = len(value) if isinstance(value, (str, list, dict)) else None
    for word, low in (("minLength", True), ("minItems", True), ("minProperties", True), ("maxLength", False), ("maxItems", False), ("maxProperties", False)):
        if word in schema and size is not None and isinstance(value, {"L": str, "I": list, "P": dict}[word[3]]) and (size < schema[word] if low else size > schema[word]):
            out.append(f"{at}: {word}")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: {w}" for w, bad in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b)) if w in schema and bad(schema[w])]
    return out


def firsts(df: DataFrame, by: str) -> DataFrame:
    """df with turn: 0 for the first row of each (conv_id, by), else how many came before; rows without by are all first."""
    w = Window.partitionBy("conv_id", by).orderBy("position")
    # rows without by stay out of the window, in which they would be one group
    named = df.where(F.col(by).isNotNull()).withColumn("turn", F.row_number().over(w) - 1)
    return named.unionByName(df.where(F.col(by).isNull()).withColumn("turn", F.lit(0)))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls (conv_id, call_id, position; unique); null for calls on a cycle or above one.

    edges: conv_id, call_id, needs.
    """
    at = calls.select("conv_id", F.col("call_id").alias("needs"), F.col("position").alias("needs_at"))
    every = shared.keep(edges.join(at, ["conv_id", "needs"]).join(calls, ["conv_id", "call_id"]).select("conv_id", "call_id", "needs", (F.col("needs_at") < F.col("position")).alias("back")).distinct(), "edges")
    # an edge back over two others back can't be on a longest chain; edges back make no cycle, so their longest chains stay
    back = every.where("back").select("conv_id", "call_id", "needs")
    over = back.withColumnRenamed("needs", "mid").join(back.select("conv_id", F.col("call_id").alias("mid"), "needs"), ["conv_id", "mid"]).select("conv_id", "call_id", "needs").distinct()
    real = shared.keep(every.drop("back").join(over, ["conv_id", "call_id", "needs"], "left_anti"), "edges")
    fan = real.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("one"))
    own = calls.select("conv_id", "call_id").join(fan, ["conv_id", "call_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    single = F.col("n") == 1
    # an anchor points to itself; others to their need, some steps up
    now = shared.keep(own.select("conv_id", "call_id", "n", F.when(single, F.col("one")).otherwise(F.col("call_id")).alias("up"), F.when(single, 1).otherwise(0).cast("long").alias("steps"), (~single).alias("rest")), "chains")
    longest = now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(longest + 1)) + 1):
        if not shared.has_rows(now.where("not rest")):
            break
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"), ((F.col("n") != 1) | F.col("rest")).alias("there"))
        last, now = now, shared.keep(now.join(above, ["conv_id", "up"]).select("conv_id", "call_id", "n", F.col("up2").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("rest") | F.col("there")).alias("rest")), "chains")
        shared.forget(last)
    flat = now.where("rest").select("conv_id", "call_id", F.col("up").alias("anchor"), "steps")
    placed = shared.keep(now.where("n = 0").select("conv_id", F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("level")), "placed")
    several = real.join(now.where("n > 1").select("conv_id", "call_id"), ["conv_id", "call_id"])
    # a need on a cycle has no anchor, so what is above it is never placed
    left = shared.keep(several.join(flat.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left").select("conv_id", "call_id", "anchor", (F.col("steps") + 1).alias("w")), "left")
    while shared.has_rows(left):
        met = left.join(placed, ["conv_id", "anchor"], "left").groupBy("conv_id", "call_id").agg(F.bool_and(F.col("level").isNotNull()).alias("all"), F.max(F.col("level") + F.col("w")).alias("level"))
        fresh = shared.keep(met.where("all").select("conv_id", F.col("call_id").alias("anchor"), "level"), "fresh")
        if not shared.has_rows(fresh):
            break
        placed = shared.keep(placed.union(fresh), "placed")
        left = shared.keep(left.join(fresh.select("conv_id", F.col("anchor").alias("call_id")), ["conv_id", "call_id"], "left_anti"), "left")
    told = flat.join(placed, ["conv_id", "anchor"]).select("conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level"))
    return calls.select("conv_id", "call_id").join(told, ["conv_id", "call_id"], "left")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """LINKED rows of calls (conv_id, call_id, position, tool, arguments JSON, needs array<string>) and results (conv_id, call_id, position, content)."""
    named = lambda df: firsts(df.withColumn("key", F.when(F.col("call_id") != "", F.col("call_id"))), "key")
    c, r = named(calls), named(results)
    one_c, one_r = c.where("key is not null and turn = 0"), r.where("key is not null and turn = 0")
    edges = one_c.select("conv_id", "call_id", F.explode("needs").alias("needs"))
    depth = levels(one_c.select("conv_id", "call_id", "position"), edges)
    lost = edges.join(one_c.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti").groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).cast("int").alias("missing"))
    both = one_c.join(one_r.select("conv_id", "call_id", F.col("content").alias("content"), F.col("position").alias("answered"), F.lit(True).alias("has")), ["conv_id", "call_id"], "left").join(depth, ["conv_id", "call_id"], "left").join(lost, ["conv_id", "call_id"], "left")
    status = F.when(F.col("level").isNull(), "cycle").when(F.col("has").isNull(), "no_result").when(F.col("answered") <= F.col("position"), "result_before_call").otherwise("linked")
    cols = ("conv_id", "call_id", "position", "status", "tool", "arguments", "content", "level", "missing", "kind")
    good = both.withColumn("status", status).withColumn("missing", F.coalesce("missing", F.lit(0))).withColumn("kind", F.lit("call")).select(*cols)
    rest = lambda df, kind, extra: df.withColumns({"kind": F.lit(kind), "level": F.lit(None).cast("long"), "missing": F.lit(0), **extra}).select(*cols)
    odd_c = rest(c.where("key is null or turn > 0"), "call", {"status": F.when(F.col("key").isNull(), "unnamed").otherwise("repeat"), "content": F.lit(None).cast("string")})
    orphan = one_r.join(one_c, ["conv_id", "call_id"], "left_anti")
    odd_r = r.where("key is null or turn > 0").withColumn("status", F.when(F.col("key").isNull(), "unnamed").otherwise("repeat")).unionByName(orphan.withColumn("status", F.lit("no_call")))
    odd_r = rest(odd_r, "result", {"tool": F.lit(None).cast("string"), "arguments": F.lit(None).cast("string")})
    told = good.unionByName(odd_c).unionByName(odd_r)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.string()]
        names = [x.split()[0] for x in LINKED.split(", ")]
        for batch in batches:
            out = []
            for conv, call, at, state, tool, raw, content, level, missing, kind in zip(*(batch.column(n).to_pylist() for n in cols), strict=True):
                value, errors = None, []
                if kind == "call":
                    try:
                        value = json.loads(raw, parse_constant=_refuse) if raw is not None else None
                    except ValueError:
                        errors = ["$: not JSON"]
                    if not errors:
                        errors = problems(value, {"type": "object"}) or problems(value, schemas.get(tool or "", {}))
                    text = {"arguments": value if not errors or isinstance(value, dict) else None, "id": call, "level": level, "name": tool, "result": content}
                else:
                    text = {"id": call, "result": content}
                out.append((conv, call, at, state, tool, level, missing, kind != "call" or not errors, errors, canonical(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types, strict=True)], names=names)

    return told.mapInArrow(write, LINKED)


def _refuse(word: str):
    raise ValueError(word)


#: The tools that turns of a conversation are read as calls of: a user's turn asks for a reply, any other sets up.
TOOLS = {
    "reply": {"type": "object", "required": ["role", "text"], "additionalProperties": False, "properties": {"role": {"enum": ["user"]}, "text": {"type": "string", "minLength": 1}}},
    "setup": {"type": "object", "required": ["role", "text"], "additionalProperties": False, "properties": {"role": {"enum": ["system"]}, "text": {"type": "string", "minLength": 1}}},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns that aren't an assistant's are calls, which need the calls one and two turns before, as far as those are calls; an
    assistant's turn is the result of the call one turn before. A turn's number is its identifier."""
    t = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("position"), "role", turns["text"].cast("string").alias("text"))
    asked = t.where("role is null or role != 'assistant'").withColumn("call_id", F.coalesce(F.col("position").cast("string"), F.lit("")))
    # equal keys of a conversation are told by turn, so a long conversation is no one group
    there = asked.where("position is not null").select("conv_id", "position", "call_id").distinct()
    before = [there.select("conv_id", (F.col("position") + i).alias("position"), F.col("call_id").alias(f"b{i}")) for i in (1, 2)]
    linked = asked.join(before[0], ["conv_id", "position"], "left").join(before[1], ["conv_id", "position"], "left")
    tool = F.when(F.col("role") == "user", "reply").otherwise("setup")
    calls = linked.select("conv_id", "call_id", "position", tool.alias("tool"), F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("arguments"), F.array_compact(F.array("b1", "b2")).alias("needs"))
    results = t.where("role = 'assistant'").select("conv_id", F.coalesce((F.col("position") - 1).cast("string"), F.lit("")).alias("call_id"), "position", F.col("text").alias("content"))
    return calls, results


def link_conversations(turns: DataFrame) -> DataFrame:
    return link(*conversation_calls(turns), TOOLS)

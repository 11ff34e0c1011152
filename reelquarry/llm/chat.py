"""Chat formatting with tool-call linking.

A turn whose text is a JSON object with `tool_calls` (objects with id, name and arguments) makes calls; a turn of
role `tool` whose text is a JSON object with `tool_call_id` answers one. Calls and results are hash-joined by
conversation and identifier. Turns are ordered topologically: by turn, but a result that comes before its call goes
directly after it. Arguments are validated against the tools' schemas, and every turn is serialised as
canonical JSON: keys in order of code points, no spaces, no escapes but those that JSON asks for.

One row per turn comes out, with its dense position in the conversation, so that no conversation has to fit into one
row or task: turns are dealt by ranges of their order, and positions are counted in each range and added up.

Defined results: a text that isn't such an object, or is no JSON (NaN, numbers beyond a double), is plain content; a null text is the
content null and a null role stays null; null conversations form one conversation, and null turns come first in it. Of calls that
repeat an identifier the first counts. A call without result and a result without call are reported in `problem` and stay in
place. Turns that tie are ordered by role and text; repeated rows each have a position. Lone surrogates are
written as escapes. Conversations and turns are cast to long.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bound_batches, hot_keys, keep, partitions, spread_join

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
SURROGATE = re.compile("[\ud800-\udfff]")


def whole(text: str) -> str:
    """text with lone surrogates, which UTF-8 can't hold, as JSON's escapes."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    return whole(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")))


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _number(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise ValueError("beyond the doubles")
    return x


def _is(value: object, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, KINDS[kind]) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def _limits(value: object, schema: dict, at: str) -> str | None:
    """The first limit of size that value breaks."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    for applies, size, least, most, what in (
        (number, value, "minimum", "maximum", ""), (isinstance(value, str), value, "minLength", "maxLength", "the length of "), (isinstance(value, list), value, "minItems", "maxItems", "the number of items of "),
    ):
        if applies:
            n = size if number else len(size)
            if least in schema and n < schema[least]:
                return f"{what}{at} is below {schema[least]}"
            if most in schema and n > schema[most]:
                return f"{what}{at} is above {schema[most]}"
    return None


def invalid(value: object, schema: object, at: str = "arguments") -> str | None:
    """The first way in which value breaks the schema, or None.

    Checked are type, enum, const, minimum, maximum, minLength, maxLength, pattern, required, properties, additionalProperties,
    minItems, maxItems and items; other keywords are passed over. A schema may be true or false. An unknown type is reported.
    """
    if isinstance(schema, bool):
        return None if schema else f"{at} is not allowed"
    if not isinstance(schema, dict):
        return f"the schema of {at} is no schema"
    kinds = schema.get("type") or ()
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    for k in kinds:
        if k not in KINDS:
            return f"the schema of {at} has the unknown type {k}"
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{at} is no {' or '.join(kinds)}"
    listed = schema["enum"] if "enum" in schema else [schema["const"]] if "const" in schema else None
    if listed is not None and canonical(value) not in map(canonical, listed):
        return f"{at} is none of the listed values"
    if why := _limits(value, schema, at):
        return why
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        return f"{at} doesn't match the pattern"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at} lacks {name}"
        for name in sorted(value):
            rest = known[name] if name in known else schema.get("additionalProperties", True)
            if name not in known and rest is False:
                return f"{at} has {name}"
            if why := invalid(value[name], rest, f"{at}.{name}"):
                return why
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if why := invalid(x, schema["items"], f"{at}[{i}]"):
                return why
    return None


def parse(role: str | None, text: str | None, tools: dict[str, dict]) -> tuple[str, list[dict], str | None, str | None]:
    """Canonical message, calls, identifier that the turn answers, first problem."""
    body = None
    if text and text.lstrip()[:1] == "{":
        try:
            body = json.loads(text, parse_constant=_constant, parse_float=_number)
        except (ValueError, RecursionError):
            body = None
    message: dict = {"role": role, "content": text}
    calls, answers, problem = [], None, None
    if isinstance(body, dict) and isinstance(body.get("tool_calls"), list):
        message["content"] = body.get("content")
        message["tool_calls"] = body["tool_calls"]
        for c in body["tool_calls"]:
            if not isinstance(c, dict) or not isinstance(c.get("id"), str) or not isinstance(c.get("name"), str):
                problem = problem or "a call lacks id or name"
                continue
            calls.append({"id": whole(c["id"]), "name": whole(c["name"])})
            if c["name"] not in tools:
                problem = problem or (f"no tool {c['name']}" if tools else None)
            else:
                problem = problem or invalid(c.get("arguments"), tools[c["name"]])
        problem = whole(problem) if problem else None
    elif role == "tool" and isinstance(body, dict) and isinstance(body.get("tool_call_id"), str):
        answers = whole(body["tool_call_id"])
        message["content"], message["tool_call_id"] = body.get("content"), body["tool_call_id"]
    return canonical(message), calls, answers, problem


def _parse(batches: Iterator[pa.RecordBatch], tools: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [parse(r, t, tools) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        message, calls, answers, problem = zip(*rows, strict=True) if rows else ((), (), (), ())
        kind = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string())]))
        made = [pa.array(message, pa.string()), pa.array(calls, kind), pa.array(answers, pa.string()), pa.array(problem, pa.string())]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], ["conv_id", "turn", "role", "message", "calls", "answers", "problem"])


def format_chats(turns: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) to conv_id, position, turn, role, message, n_calls, n_linked and problem.

    tools: JSON schema of the arguments by tool name; with none, arguments aren't validated.
    """
    bound_batches(turns.sparkSession)
    given = tools or {}
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = keep(rows.mapInArrow(lambda it: _parse(it, given), "conv_id long, turn long, role string, message string, calls array<struct<id:string,name:string>>, answers string, problem string"), "turns")
    link = lambda identifier: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), identifier).alias("link")
    count = F.count(F.lit(1)).alias("m")
    answering = parsed.where("answers is not null").withColumn("link", link(F.col("answers")))
    callers = keep(parsed.where("size(calls) > 0").withColumn("__row", F.monotonically_increasing_id()), "callers")
    made = callers.select("__row", "turn", "conv_id", F.explode("calls.id").alias("call")).select("__row", "turn", link(F.col("call")))
    calls = made.groupBy("link").agg(F.min("turn").alias("call_turn"))
    linked = keep(calls.join(answering.select("link").distinct(), "link").select("link", "call_turn", F.lit(True).alias("__found")), "linked")
    # Few turns make or answer calls; only these take part in the joins.
    plain = parsed.where("size(calls) = 0 and answers is null").withColumns({"n_linked": F.lit(0).cast("long"), "call_turn": F.lit(None).cast("long")})
    results = spread_join(answering, linked, "link", hot_keys(answering.groupBy("link").agg(count), "link"), "left")
    results = results.withColumns({"n_linked": F.col("__found").isNotNull().cast("long"), "problem": F.coalesce("problem", F.when(F.col("__found").isNull(), "no call of this result"))})
    per = spread_join(made, linked.drop("call_turn"), "link", hot_keys(made.groupBy("link").agg(count), "link"), "left")
    per = per.groupBy("__row").agg(F.count("__found").alias("n_linked"))
    callers = callers.join(per, "__row").withColumns({
        "problem": F.coalesce("problem", F.when(F.col("n_linked") < F.size("calls"), "a call without result")), "call_turn": F.lit(None).cast("long"),
    })
    names = ["conv_id", "turn", "role", "message", "calls", "problem", "n_linked", "call_turn"]
    every = plain.select(*names).unionByName(results.select(*names)).unionByName(callers.select(*names))
    late = F.col("call_turn") > F.col("turn")
    placed = every.withColumns({"__at": F.when(late, F.col("call_turn")).otherwise(F.col("turn")), "__after": F.coalesce(late, F.lit(False))})
    return _positions(placed).select("conv_id", "position", "turn", "role", "message", F.size("calls").cast("long").alias("n_calls"), "n_linked", "problem")


def _positions(placed: DataFrame) -> DataFrame:
    """placed with the position of each turn in its conversation. Equal turns are told apart by a number, so that they share no range."""
    order = ["__at", "__after", "turn", "role", "message", "__nth"]
    rows = keep(placed.withColumn("__nth", F.monotonically_increasing_id()), "placed")
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "conv_id", *order).withColumn("__range", F.spark_partition_id())
    dealt = keep(dealt, "ranges")
    sizes = dealt.groupBy("conv_id", "__range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("__range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "__range").orderBy(*order))
    out = dealt.withColumn("__in", inside).join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("__range") == F.col("r")))
    return out.withColumn("position", F.col("before") + F.col("__in") - 1)


#: Tools of the query's calls.
COUNTED = {
    "count": {"type": "object", "properties": {"conversation": {"type": "integer"}, "turn": {"type": "integer"}, "n_chars": {"type": "integer", "minimum": 40}}, "required": ["turn", "n_chars"], "additionalProperties": False},
    "find": {"type": "object", "properties": {"turn": {"type": "integer"}, "n_chars": {"type": ["integer", "null"]}}, "required": ["conversation"]},
}


def with_calls(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) of plain conversations with calls and results between them.

    Before each turn of an assistant comes a turn that calls a tool with facts about it, and a turn with the result. By
    remainders of conv_id + turn, names are unknown, arguments break the schemas, and results are missing, answer no
    call or come before their call. Turns are numbered in steps of four.
    """
    own = turns.select("conv_id", (F.col("turn") * 4).alias("turn"), "role", "text")
    asked = turns.where("role = 'assistant'")
    n = F.col("conv_id") + F.col("turn")
    name = F.when(n % 17 == 0, "erase").when(n % 2 == 0, "find").otherwise("count")
    size = F.coalesce(F.length("text").cast("string"), F.lit("null"))
    given = F.when(n % 7 == 0, F.concat(F.lit('"'), size, F.lit('"'))).otherwise(size)
    call = F.concat(
        F.lit('{"tool_calls": [{"name": "'), name, F.lit('", "id": "call_'), F.col("turn").cast("string"), F.lit('", "arguments": {"turn": '), F.col("turn").cast("string"), F.lit(', "n_chars": '), given,
        F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(', "conversation": '), F.col("conv_id").cast("string"))), F.lit('}}], "content": null}'),
    )
    of = F.when(n % 13 == 0, "lost_").otherwise("call_")
    result = F.concat(F.lit('{"tool_call_id": "'), of, F.col("turn").cast("string"), F.lit('", "content": '), size, F.lit("}"))
    calls = asked.select("conv_id", (F.col("turn") * 4 - 2).alias("turn"), "role", call.alias("text"))
    at = F.when(n % 5 == 0, F.col("turn") * 4 - 3).otherwise(F.col("turn") * 4 - 1)
    results = asked.where(n % 11 != 0).select("conv_id", at.alias("turn"), F.lit("tool").alias("role"), result.alias("text"))
    return own.unionByName(calls).unionByName(results)


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations. The table holds no tool calls, so the query makes some from its turns: see with_calls."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return format_chats(with_calls(turns), COUNTED)

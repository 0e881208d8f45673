"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON.

DataFrame and SQL functions only. Calls and results are hash-joined on (conv_id, call_id). A call may need the results of
others: ``step`` is its topological level, found in rounds of joins, with calls and results taking turns (a call that needs
nothing has step 0, its result 1). Arguments are checked against a schema for each tool. Canonical JSON has no white space
and object keys in sorted order.

Where turns hold no calls (JSON with ``tool_calls``, answered by turns of the role ``tool``), a user's turn is a call of
the tool ``reply`` and an assistant's turn right after it is its result.

Defined results: a row for each part of each distinct turn; ``copies`` counts equal rows, so nothing is dropped. Of calls (or
results) that share an id the first by turn, arguments or content, place and a digest of the whole turn counts, so exactly
one does; the others have the status ``duplicate``. A null id, conversation or turn never links (``unanswered`` or
``orphan``); a result before its call is ``early``; calls that wait for each other, or for a call that the conversation lacks,
are ``blocked`` and have no step. A null text is a null content. Arguments that aren't a JSON object are invalid; JSON of
another kind is written as it is, what isn't JSON as a string. An empty table gives no rows; other columns are not read.
conv_id and turn are integers (a text that isn't one is an error).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch


@dataclass(frozen=True)
class Field:
    """What a tool's argument must be. ``kind``: string, integer, number, boolean, object or array."""

    kind: str
    required: bool = True
    most_chars: int | None = None
    least: int | None = None


SCHEMAS = {"reply": {"text": Field("string", most_chars=400), "turn": Field("integer", least=0)}}

# Names that Spark gives the types of JSON values.
_KINDS = {"string": r"^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "object": r"^OBJECT", "array": r"^ARRAY"}
_CALL = "tool_calls array<struct<id: string, name: string, arguments: string, needs: array<string>>>"
_RESULT = "tool_call_id string, content string"


def quoted(text: Column) -> Column:
    """A JSON string; null for null."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1))


def canonical(json: Column) -> Column:
    """JSON without white space and with sorted keys; null if it can't be read."""
    return F.to_json(F.try_parse_json(json))


def errors(name: Column, arguments: Column, schemas: dict[str, dict[str, Field]]) -> Column:
    """What is wrong with the arguments, as a sorted array."""
    value = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(value).rlike("^OBJECT")
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        found = []
        for key, f in fields.items():
            at = F.try_variant_get(value, f"$['{key}']", "variant")
            kind = F.schema_of_variant(at)
            absent = at.isNull() | (kind == "VOID")
            found.append(F.when(absent, F.lit(f"{key}: missing") if f.required else F.lit(None)).when(~kind.rlike(_KINDS[f.kind]), F.lit(f"{key}: not of type {f.kind}")))
            if f.most_chars is not None:
                found.append(F.when(kind.rlike("^STRING$") & (F.length(F.try_variant_get(value, f"$['{key}']", "string")) > f.most_chars), F.lit(f"{key}: longer than {f.most_chars}")))
            if f.least is not None:
                found.append(F.when(kind.rlike(_KINDS["number"]) & (F.try_variant_get(value, f"$['{key}']", "double") < f.least), F.lit(f"{key}: less than {f.least}")))
        extra = F.transform(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in fields])), lambda k: F.concat(k, F.lit(": unknown")))
        checked = F.when(value.isNull() | ~is_object, F.array(F.lit("not an object"))).otherwise(F.array_sort(F.concat(F.array_compact(F.array(*found)), extra)))
        out = F.when(name == tool, checked).otherwise(out)
    return out


def _distinct(turns: DataFrame) -> DataFrame:
    chosen = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return chosen.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))


def _parts(turns: DataFrame) -> DataFrame:
    """Each turn's parts: kind (call, result or message), call_id, name, arguments, needs, content."""
    body = F.when(F.ltrim(F.col("text")).startswith("{"), F.col("text"))
    parsed = turns.withColumn("c", F.from_json(body, _CALL)["tool_calls"]).withColumn("r", F.from_json(body, _RESULT))
    none, needs = F.lit(None).cast("string"), F.array().cast("array<string>")

    def part(kind: str, call_id: Column = none, name: Column = none, arguments: Column = none, needs: Column = needs, content: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"), needs.alias("needs"), content.alias("content"))

    calls = F.transform("c", lambda x: part("call", x["id"], x["name"], x["arguments"], F.coalesce(x["needs"], needs)))
    own = F.concat_ws("-", F.lit("turn"), "conv_id", "turn")
    own = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), own)
    before = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.concat_ws("-", F.lit("turn"), "conv_id", F.col("turn") - 1))
    asked = F.concat(F.lit('{"text":'), quoted(F.col("text")), F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"))
    parts = (
        F.when((F.col("role") == "assistant") & (F.size("c") > 0), calls)
        .when((F.col("role") == "tool") & F.col("r.tool_call_id").isNotNull(), F.array(part("result", F.col("r.tool_call_id"), content=F.col("r.content"))))
        .when(F.col("role") == "user", F.array(part("call", own, F.lit("reply"), asked)))
        .when(F.col("role") == "assistant", F.array(part("result", before, content=F.col("text"))))
        .otherwise(F.array(part("message", content=F.col("text"))))
    )
    whole = F.sha2(F.to_json(F.struct("role", "text")), 256)  # tells two turns of one number apart
    return parsed.select("conv_id", "turn", "role", "copies", whole.alias("whole"), F.posexplode(parts).alias("place", "p")).select("conv_id", "turn", "role", "copies", "whole", "place", "p.*")


def _rank() -> Column:
    """Which part comes first; no two parts of a conversation have the same."""
    return F.struct("turn", F.coalesce("arguments", "content", F.lit("")).alias("body"), "place", "whole")


def _firsts(parts: DataFrame, kind: str) -> DataFrame:
    """The first part of this kind with each id."""
    known = parts.filter((F.col("kind") == kind) & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    return known.groupBy("conv_id", "call_id").agg(F.min(_rank()).alias("rank"))


def steps(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls (conv_id, call_id, needs) that have a place in a topological order.

    A round for each level, so as many as the longest chain of needs; none where nothing needs anything.
    """
    ids = calls.select("conv_id", "call_id", F.array_distinct("needs").alias("needs"))
    roots = ids.filter(F.size("needs") == 0).select("conv_id", "call_id", F.lit(0).alias("level"))
    edges = ids.select("conv_id", "call_id", F.explode("needs").alias("need"))
    if edges.isEmpty():
        return roots
    edges = scratch.table(edges, "needs")
    degree = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("degree"))
    frontier, met, level = scratch.table(roots, "steps"), None, 0
    done = scratch.table(frontier, "done")
    while not frontier.isEmpty():  # each round places a call at least, so this ends
        level += 1
        now = edges.join(frontier.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"]).groupBy("conv_id", "call_id").agg(F.count("*").alias("n"))
        old, met = met, scratch.table(now if met is None else met.unionByName(now).groupBy("conv_id", "call_id").agg(F.sum("n").alias("n")), "met")
        ready = met.join(degree, ["conv_id", "call_id"]).filter("n = degree").select("conv_id", "call_id")
        was, frontier = frontier, scratch.table(ready.join(done, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)), "steps")
        scratch.extend(done, frontier)
        done = scratch.again(done)
        for x in (old, was):
            if x is not None:
                scratch.drop(x)
    return done


def link(turns: DataFrame, schemas: dict[str, dict[str, Field]] | None = None) -> DataFrame:
    """conv_id, turn, place (in the turn), copies, kind, call_id, step, status, valid, errors, json: a row for each part of a turn."""
    schemas = SCHEMAS if schemas is None else schemas
    parts = scratch.table(_parts(_distinct(turns)), "parts")
    calls, results = _firsts(parts, "call"), _firsts(parts, "result")
    pairs = calls.select("conv_id", "call_id", F.col("rank").alias("call")).join(results.select("conv_id", "call_id", F.col("rank").alias("result")), ["conv_id", "call_id"], "full")
    first = parts.filter("kind = 'call'").join(calls, ["conv_id", "call_id"]).filter(_rank() == F.col("rank"))
    order = steps(first.select("conv_id", "call_id", "needs"))
    pairs = pairs.join(order, ["conv_id", "call_id"], "left").withColumnsRenamed({"conv_id": "_conv", "call_id": "_id"})
    own = _rank()
    joined = parts.join(pairs, (F.col("conv_id") == F.col("_conv")) & (F.col("call_id") == F.col("_id")), "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when(~is_call & ~is_result, F.lit(None).cast("string"))
        .when(is_call & F.col("call").isNotNull() & (own != F.col("call")), "duplicate")
        .when(is_result & F.col("result").isNotNull() & (own != F.col("result")), "duplicate")
        .when(is_call & F.col("call").isNotNull() & F.col("level").isNull(), "blocked")
        .when(is_call & F.col("result").isNull(), "unanswered")
        .when(is_result & F.col("call").isNull(), "orphan")
        .when(F.col("result.turn") < F.col("call.turn"), "early")
        .otherwise("linked")
    )
    step = F.when(status.isin("linked", "unanswered", "early"), F.col("level") * 2 + F.when(is_result, 1).otherwise(0))
    wrong = F.when(is_call, errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    out = joined.select("conv_id", "turn", "place", "copies", "kind", "role", "call_id", "name", "arguments", "content", step.cast("int").alias("step"), status.alias("status"), wrong.alias("errors"))

    def number(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("null"))

    json = (
        F.when(is_call, F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), quoted(F.col("arguments"))), F.lit(',"call_id":'), quoted(F.col("call_id")), F.lit(',"kind":"call","name":'), quoted(F.col("name")), F.lit(',"step":'), number("step"), F.lit(',"turn":'), number("turn"), F.lit("}")))
        .when(is_result, F.concat(F.lit('{"call_id":'), quoted(F.col("call_id")), F.lit(',"content":'), quoted(F.col("content")), F.lit(',"kind":"result","step":'), number("step"), F.lit(',"turn":'), number("turn"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"kind":"message","role":'), quoted(F.col("role")), F.lit(',"turn":'), number("turn"), F.lit("}")))
    )
    return out.select("conv_id", "turn", "place", "copies", "kind", "call_id", "step", "status", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), json.alias("json"))

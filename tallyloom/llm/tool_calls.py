"""Linking of tool calls and results, in DataFrame functions only.

Calls and results are joined by conversation and call id.  Calls are put in a topological order of the calls
that they depend on: a call's level is the length of the longest chain of needs below it.
Arguments are JSON: they are checked against the tool's schema, and each linked call is serialised as
canonical JSON (keys in order at every depth, no blanks, numbers as numbers).

Defined results: a call without a result is 'pending', a result without a call is not returned; of several
results of one call the first (by turn, then text) counts, and of several calls with one id the first (by
turn, tool, arguments, needs; nulls first); a dependency that is no call of the conversation is ignored and
noted as an error; calls on a cycle, or behind one, get no level and come last; null ids link with nothing
and such calls are dropped.  Null arguments are the empty object; arguments that are no JSON, or name a key
twice, are an error and are written as a string.  A null in the JSON is a value of type null, not a missing
one.  Whole numbers are integers in either form (1.0 is 1); those beyond 38 digits are kept as doubles.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import stored

# A tool's schema: a JSON Schema of these keywords; others are refused.
Schema = Mapping[str, Any]
KEYWORDS = {"type", "properties", "required", "additionalProperties", "items", "enum", "minimum", "maximum", "minLength", "maxLength", "pattern"}


def _first(rows: DataFrame, *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy(*order))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def _chains(singles: DataFrame) -> DataFrame:
    """Follows single needs to where they end, by doubling. ``singles``: conv_id, call_id, needs (one a call).

    Gives conv_id, call_id, anchor (a call that isn't in ``singles``) and dist; calls on or behind a cycle of
    single needs are left out.
    """
    key = ["conv_id", "call_id"]
    inside = singles.select("conv_id", F.col("call_id").alias("anchor"), F.lit(False).alias("ends"))
    rows = singles.select(*key, F.col("needs").alias("anchor"), F.lit(1).cast("long").alias("dist")).join(inside, ["conv_id", "anchor"], "left")
    rows = stored(rows.withColumn("ends", F.col("ends").isNull()), "chains")
    for _ in range(max(1, rows.count()).bit_length() + 1):
        if rows.filter("not ends").isEmpty():
            break
        onward = rows.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("dist").alias("more"), F.col("ends").alias("done"))
        open_ = rows.filter("not ends").join(onward, ["conv_id", "anchor"])
        rows = stored(rows.filter("ends").unionByName(open_.select(*key, F.col("next").alias("anchor"), (F.col("dist") + F.col("more")).alias("dist"), F.col("done").alias("ends"))), "chains")
    return rows.filter("ends").drop("ends")


def levels(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that are on or behind no cycle; ``edges``: (conv_id, call_id, needs).

    A need that needs nothing itself says no more than another need does, and is dropped beside one.  Calls
    with one need then form chains, which are followed by doubling; calls with several are taken in rounds,
    each once all of its needs have a level.
    """
    key = ["conv_id", "call_id"]
    edges = edges.distinct()
    needing = edges.select(*key).distinct()
    roots = stored(calls.select(*key).join(needing, key, "left_anti"), "roots")
    at_root = roots.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("rooted"))
    inner = F.count(F.when(F.col("rooted").isNull(), 1)).over(Window.partitionBy(*key))
    marked = edges.join(at_root, ["conv_id", "needs"], "left").withColumn("inner", inner)
    # Beside an inner need all needs at roots go; of needs at roots alone the least stays.
    least = F.min("needs").over(Window.partitionBy(*key))
    kept = marked.withColumn("least", least).filter("(inner > 0 and rooted is null) or (inner = 0 and needs = least)")
    kept = stored(kept.select(*key, "needs", F.count("*").over(Window.partitionBy(*key)).alias("n")), "needs")
    chains = stored(_chains(kept.filter("n = 1").select(*key, "needs")), "chained")
    hop = chains.select("conv_id", F.col("call_id").alias("needs"), "anchor", "dist")
    single = kept.filter("n = 1").select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("single"))
    joins = kept.filter("n > 1").join(hop, ["conv_id", "needs"], "left").join(single, ["conv_id", "needs"], "left")
    # A need in a chain without an end is never met: its anchor is null.
    anchor = F.when(F.col("single").isNull(), F.col("needs")).otherwise(F.col("anchor"))
    waiting = stored(joins.select(*key, anchor.alias("anchor"), F.coalesce("dist", F.lit(0)).cast("long").alias("dist"), F.lit(None).cast("long").alias("level")), "waiting")
    found = stored(roots.withColumn("level", F.lit(0).cast("long")), "level")
    known = [found]
    while not waiting.isEmpty():
        met = found.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("now"))
        waiting = stored(waiting.join(met, ["conv_id", "anchor"], "left").withColumn("level", F.coalesce("level", "now")).drop("now"), "waiting")
        ready = waiting.groupBy(*key).agg(F.max(F.col("level") + F.col("dist") + 1).alias("level"), F.every(F.col("level").isNotNull()).alias("all")).filter("all")
        found = stored(ready.select(*key, "level"), "level")
        if found.isEmpty():
            break
        known.append(found)
        waiting = stored(waiting.join(found.select(*key), key, "left_anti"), "waiting")
    whole = known[0]
    for part in known[1:]:
        whole = whole.unionByName(part)
    ends = whole.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("base"))
    return whole.unionByName(chains.join(ends, ["conv_id", "anchor"]).select(*key, (F.col("base") + F.col("dist")).alias("level")))


def _plain(value: Any) -> Any:
    """Whole floats as integers, as parsed JSON has them."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def schema_errors(value: Column, schema: Schema, path: str = "") -> Column:
    """What is wrong with a variant by a schema: an array of 'path: error', with repeats; null for a null column."""
    if unknown := set(schema) - KEYWORDS:
        raise ValueError(f"keywords not supported: {sorted(unknown)}")
    name = path or "arguments"
    kind = F.schema_of_variant(value)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_text, is_number = kind == "STRING", kind.rlike("^(BIGINT|DECIMAL|DOUBLE)")
    is_type = {
        "string": is_text, "number": is_number, "integer": is_number & (number % 1 == 0), "boolean": kind == "BOOLEAN",
        "null": kind == "VOID", "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT"),
    }
    bad: list[tuple[Column, str]] = []
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        fits = F.lit(False)
        for k in kinds:
            fits = fits | is_type[k]
        bad.append((~fits, f"{name}: not a {' or '.join(kinds)}"))
    if "enum" in schema:
        allowed = [json.dumps(_plain(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in schema["enum"]]
        bad.append((~F.to_json(value).isin(*allowed), f"{name}: not one of the values"))
    if "minimum" in schema:
        bad.append((is_number & (number < float(schema["minimum"])), f"{name}: too small"))
    if "maximum" in schema:
        bad.append((is_number & (number > float(schema["maximum"])), f"{name}: too large"))
    if "minLength" in schema:
        bad.append((is_text & (F.length(text) < schema["minLength"]), f"{name}: too short"))
    if "maxLength" in schema:
        bad.append((is_text & (F.length(text) > schema["maxLength"]), f"{name}: too long"))
    if "pattern" in schema:
        bad.append((is_text & ~text.rlike(schema["pattern"]), f"{name}: not of the pattern"))
    parts = []
    if schema.keys() & {"properties", "required", "additionalProperties"}:
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        properties = schema.get("properties", {})
        at = lambda key: f"{path}.{key}" if path else key
        for key in schema.get("required", ()):
            bad.append((is_type["object"] & ~F.map_contains_key(fields, key), f"{at(key)}: missing"))
        if schema.get("additionalProperties", True) is False:
            extra = F.array_except(F.map_keys(fields), F.array(*map(F.lit, properties)).cast("array<string>"))
            parts.append(F.transform(extra, lambda k: F.concat(F.lit(at("")), k, F.lit(": not known"))))
        elif schema.get("additionalProperties", True) is not True:
            raise ValueError("additionalProperties has to be true or false")
        parts += [schema_errors(F.try_element_at(fields, F.lit(key)), inner, at(key)) for key, inner in properties.items()]
    if "items" in schema:
        elements = F.try_variant_get(value, "$", "array<variant>")
        parts.append(F.flatten(F.transform(F.when(is_type["array"], elements), lambda e: schema_errors(e, schema["items"], f"{path}[]"))))
    none = F.array().cast("array<string>")
    own = F.array_compact(F.array(*(F.when(when, F.lit(error)) for when, error in bad))) if bad else none
    return F.when(value.isNotNull(), F.concat(own, *(F.coalesce(p, none) for p in parts)))


def parsed(arguments: Column) -> Column:
    """Arguments as a variant, null where they are no JSON.

    Spark's parser stops after the first value.  In brackets a second value or other text after it is an error
    or a second element, but for text that closes the bracket itself; that is an error as a key's value.
    """
    text = F.coalesce(arguments, F.lit("{}"))
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(listed) == 1) & keyed.isNotNull(), F.try_parse_json(text))


def argument_errors(schemas: Mapping[str, Schema]) -> Column:
    """The sorted distinct errors of columns ``tool`` and ``arguments`` (JSON)."""
    value = parsed(F.col("arguments"))
    errors = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        found = F.coalesce(schema_errors(value, schema), F.array(F.lit("arguments: not JSON")))
        errors = F.when(F.col("tool") == tool, found).otherwise(errors)
    return F.array_sort(F.array_distinct(errors))


def canonical(pairs: Mapping[str, Column]) -> Column:
    """JSON with sorted keys; nulls are written."""
    return F.to_json(F.struct(*(pairs[k].alias(k) for k in sorted(pairs))), {"ignoreNullFields": "false"})


def canonical_arguments(arguments: Column) -> Column:
    """A variant, whose keys are in order; what is no JSON becomes a string."""
    return F.coalesce(parsed(arguments), arguments.cast("variant"))


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Schema]) -> DataFrame:
    """A row per call.

    ``calls``: conv_id, call_id, turn, tool, arguments string (JSON), needs array<string>;
    ``results``: conv_id, call_id, turn, text.
    """
    key = ["conv_id", "call_id"]
    whole = "conv_id is not null and call_id is not null"
    own = stored(_first(calls.filter(whole).select(*key, "turn", "tool", "arguments", "needs"), "turn", "tool", "arguments", "needs"), "calls")
    got = _first(results.filter(whole).select(*key, F.col("turn").alias("result_turn"), F.col("text").alias("result")), "result_turn", "result")
    wanted = own.select(*key, F.explode("needs").alias("needs")).filter("needs is not null").distinct()
    there = own.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    edges = stored(wanted.join(there, ["conv_id", "needs"], "left"), "edges")
    ordered = levels(edges.filter("there").select(*key, "needs"), own)
    lost = edges.filter("there is null").groupBy(*key).agg(F.sort_array(F.collect_set(F.concat(F.lit("needs "), "needs", F.lit(": no such call")))).alias("lost"))
    rows = own.hint("shuffle_hash").join(got.hint("shuffle_hash"), key, "left").join(ordered, key, "left").join(lost, key, "left")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), "turn", "call_id"))
    errors = F.concat(argument_errors(schemas), F.coalesce("lost", F.array().cast("array<string>")))
    rows = rows.withColumn("place", place.cast("long")).withColumn("errors", errors).withColumn("status", F.when(F.col("result_turn").isNull(), "pending").otherwise("linked"))
    line = canonical({
        "arguments": canonical_arguments(F.col("arguments")), "call_id": F.col("call_id"), "errors": F.col("errors"), "level": F.col("level"),
        "needs": F.array_sort(F.array_distinct(F.array_compact(F.coalesce("needs", F.array().cast("array<string>"))))), "result": F.col("result"), "tool": F.col("tool"),
    })
    return rows.select(*key, "turn", "tool", F.col("level").cast("long").alias("level"), "place", "status", F.size("errors").cast("long").alias("n_errors"), line.alias("json"))

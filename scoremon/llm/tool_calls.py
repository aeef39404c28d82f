"""Chat formatting of tool calls: link, order, validate, serialise.

Calls and results meet in a hash join on (conversation, identifier).  Results are reduced to
one per identifier before the join, so repeated identifiers do not multiply.  Calls get a
level: one more than the highest level among the calls they wait for; (level, call_id) is a
topological order.  Only identifiers are shuffled for it.  A conversation of at most
``IN_TASK`` waits and ``IN_TASK_BYTES`` is ordered inside a task.  Larger ones are ordered by
joins: calls that wait for one other call point to it, pointers are doubled, and what is left
of the graph is treated again.  A chain of any length takes one such round with as many joins
as its length has binary digits; graphs of calls that each wait for several others take a
round per level at worst.

Arguments are checked against the JSON schema of the called function, and every call is
written as one line of canonical JSON: sorted keys, no blanks, shortest numbers, text beyond
ASCII as it is, lone surrogates escaped.  Keywords that are checked: ``KEYWORDS``; keywords
that assert nothing are passed over: ``NOTES``.

Defined cases: a call without a result is ``linked`` false; results without a call are rows
with a null name; of several results of one identifier the one with the least ``place``
counts and ``n_results`` tells how many there were; null identifiers never link; calls on a
cycle, or waiting for one, have no level; waiting for an identifier that does not exist is
ignored; repeated calls are each reported; a function without a schema accepts every object.
Arguments that are null or no JSON, hold NaN or a number beyond a double, or nest deeper than
``DEPTH`` are invalid and serialised as null.  A schema that cannot be judged (no JSON, a
keyword of the wrong type or outside the two lists, a pattern that does not compile or takes
over ``PATTERN_SECONDS``) gives objects ``valid`` null.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremon.llm.common import cut, shared_folder, slots, store

IN_TASK = 1_000
IN_TASK_BYTES = 1 << 20
DEPTH = 100
PATTERN_SECONDS = 5
#: Schemas that a worker keeps compiled.
KEPT_SCHEMAS = 1_000

TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
}


class Unjudged(Exception):
    """A schema asks for something that cannot be checked."""


def parsed(text: str | None) -> Any:
    """The value of a JSON text; ValueError where it has none that is defined here."""
    if text is None:
        raise ValueError("no text")

    def number(digits: str) -> float:
        value = float(digits)
        if not math.isfinite(value):
            raise ValueError(digits)
        return value

    def constant(name: str) -> Any:
        raise ValueError(name)

    try:
        value = json.loads(text, parse_float=number, parse_constant=constant)
    except RecursionError as error:
        raise ValueError("nested too deeply") from error
    level = [value]
    for _ in range(DEPTH):
        level = [
            x for v in level if isinstance(v, (dict, list))
            for x in (v.values() if isinstance(v, dict) else v)
        ]
        if not level:
            return value
    raise ValueError("nested too deeply")


def _quoted(text: str) -> str:
    out = json.dumps(text, ensure_ascii=False)
    if any("\ud800" <= c <= "\udfff" for c in out):
        out = "".join(f"\\u{ord(c):04x}" if "\ud800" <= c <= "\udfff" else c for c in out)
    return out


def canonical(value: Any) -> str:
    """One JSON text per value: sorted keys, no blanks, numbers in their shortest form."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_quoted(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, float):
        if value == int(value) and abs(value) < 1e15:
            return str(int(value))
        return repr(value)
    return json.dumps(value)


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _length(x: Any) -> bool:
    return _number(x) and x >= 0


def _names(x: Any) -> bool:
    return isinstance(x, list) and all(isinstance(n, str) for n in x)


def _schema(x: Any) -> bool:
    return isinstance(x, bool) or (isinstance(x, dict) and all(
        k in NOTES or (k in KEYWORDS and KEYWORDS[k](v)) for k, v in x.items()
    ))


def _schemas(x: Any) -> bool:
    return isinstance(x, list) and all(map(_schema, x))


def _named_schemas(x: Any) -> bool:
    return isinstance(x, dict) and all(map(_schema, x.values()))


def _pattern(x: Any) -> bool:
    try:
        return isinstance(x, str) and regex.compile(x) is not None
    except (regex.error, RecursionError, OverflowError):
        return False


#: What each keyword must look like for a schema to be judged.
KEYWORDS = {
    "type": lambda x: all(isinstance(k, str) and (k in TYPES or k in ("integer", "number"))
                          for k in (x if isinstance(x, list) else [x])),
    "enum": lambda x: isinstance(x, list), "const": lambda x: True,
    "minLength": _length, "maxLength": _length, "pattern": _pattern,
    "minimum": _number, "maximum": _number, "exclusiveMinimum": _number, "exclusiveMaximum": _number,
    "multipleOf": lambda x: _number(x) and x > 0,
    "minItems": _length, "maxItems": _length, "uniqueItems": lambda x: isinstance(x, bool),
    "items": _schema, "prefixItems": _schemas,
    "minProperties": _length, "maxProperties": _length, "required": _names, "properties": _named_schemas,
    "patternProperties": lambda x: _named_schemas(x) and all(map(_pattern, x)),
    "additionalProperties": _schema, "propertyNames": _schema,
    "dependentRequired": lambda x: isinstance(x, dict) and all(map(_names, x.values())),
    "anyOf": _schemas, "oneOf": _schemas, "allOf": _schemas, "not": _schema,
    "if": _schema, "then": _schema, "else": _schema,
}
#: Keywords that assert nothing about a value by themselves.
NOTES = {
    "$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples",
    "deprecated", "readOnly", "writeOnly", "format",
}


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        return _number(value) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, TYPES[kind])


def _matches(pattern: str, text: str) -> bool:
    try:
        return regex.search(pattern, text, timeout=PATTERN_SECONDS) is not None
    except TimeoutError as error:
        raise Unjudged(pattern) from error


def _multiple(value: Any, of: Any) -> bool:
    if isinstance(value, int) and isinstance(of, int):
        return value % of == 0
    try:
        share = value / of
    except OverflowError:
        return False
    return math.isfinite(share) and abs(share - round(share)) <= 1e-9 * max(1.0, abs(share))


def conforms(value: Any, schema: Any) -> bool:
    """Whether a value satisfies a JSON schema; ``Unjudged`` where the schema cannot tell."""
    if schema is None:
        return True
    if not _schema(schema):
        raise Unjudged(str(schema)[:100])
    return _conforms(value, schema)


def _conforms(value: Any, schema: Any) -> bool:
    if isinstance(schema, bool):
        return schema
    s = schema
    if "type" in s:
        kinds = s["type"] if isinstance(s["type"], list) else [s["type"]]
        if not any(_is(value, k) for k in kinds):
            return False
    if "enum" in s and canonical(value) not in map(canonical, s["enum"]):
        return False
    if "const" in s and canonical(value) != canonical(s["const"]):
        return False
    if isinstance(value, str) and not _text_conforms(value, s):
        return False
    if _number(value) and not (
        s.get("minimum", value) <= value <= s.get("maximum", value)
        and ("exclusiveMinimum" not in s or value > s["exclusiveMinimum"])
        and ("exclusiveMaximum" not in s or value < s["exclusiveMaximum"])
        and ("multipleOf" not in s or _multiple(value, s["multipleOf"]))
    ):
        return False
    if isinstance(value, list) and not _list_conforms(value, s):
        return False
    if isinstance(value, dict) and not _object_conforms(value, s):
        return False
    if not all(_conforms(value, x) for x in s.get("allOf", [])):
        return False
    if "anyOf" in s and not any(_conforms(value, x) for x in s["anyOf"]):
        return False
    if "oneOf" in s and sum(_conforms(value, x) for x in s["oneOf"]) != 1:
        return False
    if "not" in s and _conforms(value, s["not"]):
        return False
    if "if" in s:
        return _conforms(value, s.get("then" if _conforms(value, s["if"]) else "else", True))
    return True


def _text_conforms(value: str, s: dict) -> bool:
    if not s.get("minLength", 0) <= len(value) <= s.get("maxLength", math.inf):
        return False
    return "pattern" not in s or _matches(s["pattern"], value)


def _list_conforms(value: list, s: dict) -> bool:
    if not s.get("minItems", 0) <= len(value) <= s.get("maxItems", math.inf):
        return False
    if s.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
        return False
    first = s.get("prefixItems", [])
    if not all(_conforms(x, rule) for x, rule in zip(value, first, strict=False)):
        return False
    return all(_conforms(x, s.get("items", True)) for x in value[len(first):])


def _object_conforms(value: dict, s: dict) -> bool:
    if not s.get("minProperties", 0) <= len(value) <= s.get("maxProperties", math.inf):
        return False
    if any(k not in value for k in s.get("required", [])):
        return False
    for k, others in s.get("dependentRequired", {}).items():
        if k in value and any(o not in value for o in others):
            return False
    for k, x in value.items():
        rules = [s["properties"][k]] if k in s.get("properties", {}) else []
        rules += [r for p, r in s.get("patternProperties", {}).items() if _matches(p, k)]
        if not all(_conforms(x, r) for r in rules or [s.get("additionalProperties", True)]):
            return False
        if not _conforms(k, s.get("propertyNames", True)):
            return False
    return True


def verdict(arguments: Any, schema: str | None, kept: dict[str, Any]) -> bool | None:
    """Whether parsed arguments fit; ``kept`` holds the schemas read so far."""
    if not isinstance(arguments, dict):
        return False
    if schema is None:
        return True
    if schema not in kept:
        if len(kept) >= KEPT_SCHEMAS:
            kept.clear()
        try:
            rule = parsed(schema)
            kept[schema] = rule if _schema(rule) else None
        except ValueError:
            kept[schema] = None
    if kept[schema] is None:
        return None
    try:
        return _conforms(arguments, kept[schema])
    except Unjudged:
        return None


LINE = (
    "conv_id long, call_id string, name string, level int, valid boolean, linked boolean, "
    "n_results long, line string"
)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schemas: dict[str, Any] = {}
    for batch in batches:
        valid, lines = [], []
        for r in batch.to_pylist():
            try:
                arguments = parsed(r["arguments"])
            except ValueError:
                arguments = None
            valid.append(verdict(arguments, r["schema"], schemas) if r["name"] is not None else None)
            lines.append(canonical({
                "arguments": arguments, "id": r["call_id"], "level": r["level"], "name": r["name"],
                "result": r["content"], "valid": valid[-1],
            }))
        keep = ["conv_id", "call_id", "name", "level", "linked", "n_results"]
        columns = {n: batch.column(batch.schema.get_field_index(n)) for n in keep}
        columns |= {"valid": pa.array(valid, pa.bool_()), "line": pa.array(lines, pa.string())}
        order = ["conv_id", "call_id", "name", "level", "valid", "linked", "n_results", "line"]
        yield pa.RecordBatch.from_arrays([columns[n] for n in order], names=order)


LEVEL = "conv_id long, call_id string, level int"


def places(waits: dict[str, set[str]]) -> dict[str, int]:
    """Level of every call of one conversation that is neither on a cycle nor behind one."""
    missing, behind = {}, {}
    for call, on in waits.items():
        known = [o for o in on if o in waits]
        missing[call] = len(known)
        for o in known:
            behind.setdefault(o, []).append(call)
    found: dict[str, int] = {}
    ready, level = [c for c, n in missing.items() if not n], 0
    while ready:
        found |= dict.fromkeys(ready, level)
        following = []
        for call in ready:
            for b in behind.get(call, ()):
                missing[b] -= 1
                if not missing[b]:
                    following.append(b)
        ready, level = following, level + 1
    return found


def _in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of conversations whose rows (conv_id, call_id, on) stand together."""
    now, waits = None, {}

    def told(done: list[tuple[int, dict[str, int]]]) -> pa.RecordBatch:
        rows = [(conv, call, level) for conv, found in done for call, level in found.items()]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32()), strict=True)],
            names=["conv_id", "call_id", "level"],
        )

    for batch in batches:
        done = []
        for conv, call, on in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != now:
                done.append((now, places(waits)))
                now, waits = conv, {}
            own = waits.setdefault(call, set())
            if on is not None:
                own.add(on)
        yield told(done)
    yield told([(now, places(waits))])


def _pointed(single: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Calls (conv_id, v, u, w, b) that wait for ``u`` alone, at the end of their pointers.

    level(v) = max(b, level(u) + w).  Doubling stops when no pointer leads to a row of the
    table; pointers that still do after enough rounds for any chain are on a cycle or lead
    into one, and are returned apart.
    """
    enough = single.count().bit_length() + 1
    for _ in range(enough):
        ends = single.select("conv_id", F.col("v").alias("u"), F.col("u").alias("u2"), F.col("w").alias("w2"), F.col("b").alias("b2"))
        further = cut(single.join(ends, ["conv_id", "u"], "left").select(
            "conv_id", "v", F.coalesce("u2", "u").alias("u"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"),
            F.greatest("b", F.col("b2") + F.col("w")).alias("b"), F.col("u2").isNotNull().alias("moved"),
        ))
        moved = further.where("moved")
        single = further.drop("moved")
        if moved.isEmpty():
            return single, None
    return further.where("NOT moved").drop("moved"), moved.select("conv_id", "v")


def _by_pointers(ids: DataFrame) -> DataFrame:
    """Levels of conversations (conv_id, call_id, on) of any size, by joins."""
    spark = ids.sparkSession
    folder = f"{shared_folder(spark)}/tool-levels-{uuid.uuid4().hex}"
    names = cut(ids.select("conv_id", "call_id").distinct())
    # A row without ``u`` is a bound: level(v) >= w.  All others: level(v) >= level(u) + w.
    rows = cut(
        ids.where("on IS NOT NULL").join(names.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi")
        .select("conv_id", F.col("call_id").alias("v"), F.col("on").alias("u"), F.lit(1).alias("w")).distinct()
        .union(names.select("conv_id", F.col("call_id").alias("v"), F.lit(None).cast("string").alias("u"), F.lit(0).alias("w")))
    )
    step = 0
    while True:
        state = cut(rows.groupBy("conv_id", "v").agg(
            F.count("u").alias("n"), F.max("u").alias("u"), F.max(F.when(F.col("u").isNotNull(), F.col("w"))).alias("w"),
            F.max(F.when(F.col("u").isNull(), F.col("w"))).alias("b"),
        ))
        known = state.where("n = 0").select("conv_id", F.col("v").alias("u"), F.col("b").alias("level"))
        pointed, lost = _pointed(state.where("n = 1").drop("n"))
        reached = cut(pointed.join(known, ["conv_id", "u"], "left").withColumn(
            "found", F.when(F.col("level").isNotNull(), F.greatest("b", F.col("level") + F.col("w")))
        ).drop("level"))
        known = cut(known.union(reached.where("found IS NOT NULL").select("conv_id", "v", "found")))
        if known.isEmpty():
            break
        known.select("conv_id", F.col("u").alias("call_id"), "level").write.parquet(f"{folder}/step={step}")
        step += 1
        # The rest waits for what is known now, for the ends of pointers, or for others as before.
        rest = rows.join(known.select("conv_id", F.col("u").alias("v")), ["conv_id", "v"], "left_anti")
        if lost is not None:
            rest = rest.join(lost, ["conv_id", "v"], "left_anti")
        ends = reached.where("found IS NULL").select(
            "conv_id", F.col("v").alias("u"), F.col("u").alias("u2"), F.col("w").alias("w2"), F.col("b").alias("b2")
        )
        far = rest.join(known, ["conv_id", "u"], "left").join(ends, ["conv_id", "u"], "left")
        bound = F.coalesce(F.col("level"), F.col("b2"))
        none = F.lit(None).cast("string")
        rows = cut(
            far.select("conv_id", "v", F.explode(F.array(
                F.struct(F.when(F.col("level").isNull(), F.coalesce("u2", "u")).otherwise(none).alias("u"),
                         (F.col("w") + F.coalesce("level", "w2", F.lit(0))).alias("w")),
                F.struct(none.alias("u"), F.coalesce(F.col("w") + bound, F.lit(0)).alias("w")),
            )).alias("e")).select("conv_id", "v", "e.u", "e.w")
            .groupBy("conv_id", "v", "u").agg(F.max("w").alias("w"))
        )
        if rows.isEmpty():
            break
    if not step:
        return spark.createDataFrame([], LEVEL)
    return spark.read.schema(LEVEL).parquet(*[f"{folder}/step={k}" for k in range(step)])


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls (conv_id, call_id, after) that can be ordered."""
    calls = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select("conv_id", "call_id", "after")
    ids = calls.select("conv_id", "call_id", F.explode_outer("after").alias("on"))
    n = F.lit(1) + F.coalesce(F.size(F.coalesce("after", F.array().cast("array<string>"))), F.lit(0))
    size = F.octet_length("call_id") + F.coalesce(F.octet_length(F.array_join("after", "")), F.lit(0))
    large = cut(
        calls.groupBy("conv_id").agg(F.sum(n).alias("n"), F.sum(size).alias("size"))
        .where((F.col("n") > IN_TASK) | (F.col("size") > IN_TASK_BYTES)).select("conv_id")
    )
    some = not large.isEmpty()
    small = ids.join(large, "conv_id", "left_anti") if some else ids
    found = small.repartition(slots(calls.sparkSession), "conv_id").sortWithinPartitions("conv_id").mapInArrow(_in_tasks, LEVEL)
    return found.union(_by_pointers(ids.join(large, "conv_id", "left_semi"))) if some else found


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per identifier with results but no call.

    ``calls``: conv_id, call_id, name, arguments (JSON text), after (identifiers it waits
    for); ``results``: conv_id, call_id, place, content; ``schemas``: name, schema.
    """
    calls = store(calls.select("conv_id", "call_id", "name", "arguments", "after"), "tool-calls")
    key = ["conv_id", "call_id"]
    best = results.groupBy(*key).agg(
        F.min(F.struct("place", "content")).alias("r"), F.count("*").alias("n")
    ).select(*key, F.col("r.content").alias("content"), F.col("n").alias("n_results"), F.lit(True).alias("_found"))
    rules = schemas.where("name IS NOT NULL").groupBy("name").agg(F.min("schema").alias("schema"))
    rows = (
        calls.drop("after").join(best, key, "full_outer")
        .join(levels(calls), key, "left").join(rules, "name", "left")
        .select(
            *key, "name", F.col("level").cast("int").alias("level"), "arguments", "schema", "content",
            (F.col("_found").isNotNull() & F.col("name").isNotNull()).alias("linked"),
            F.coalesce("n_results", F.lit(0)).alias("n_results"),
        )
    )
    return rows.mapInArrow(_lines, LINE)


# The conversations of the test tables hold plain turns.  Each turn that is not an answer is
# read as a call named after its role; an answer is the result of the turn before it.
TURN_SCHEMAS = [
    ("user", json.dumps({
        "type": "object", "required": ["text", "turn"], "additionalProperties": False,
        "properties": {
            "text": {"type": "string", "minLength": 1, "maxLength": 360},
            "turn": {"type": "integer", "minimum": 0},
            "uses": {"type": "array", "items": {"type": "string", "pattern": "^t[0-9]+$"}},
        },
    })),
    ("system", json.dumps({
        "type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}},
    })),
]


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns (conv_id, turn, role, text)."""
    name = lambda t: F.concat(F.lit("t"), t.cast("string"))
    uses = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(
        F.array().cast("array<string>")
    )
    calls = turns.where("role IS NULL OR role <> 'assistant'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), F.coalesce("role", F.lit("unknown")).alias("name"),
        F.to_json(F.struct("turn", "text", uses.alias("uses"))).alias("arguments"), uses.alias("after"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("place"),
        F.col("text").alias("content"),
    )
    return calls, results

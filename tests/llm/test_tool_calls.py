from __future__ import annotations

import json
import random

import pytest

from scoremon.llm import queries, tool_calls

SF = "/root/testdata/sf0.001"
CALLS = "conv_id long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, call_id string, place long, content string"
SCHEMA = json.dumps({"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": "integer", "minimum": 1}}})


def brute_levels(calls):
    """Longest waiting chain by repeated relaxation; None on or behind a cycle."""
    ids = {(c[0], c[1]) for c in calls if None not in c[:2]}
    waits = {k: set() for k in ids}
    for c in calls:
        if (c[0], c[1]) in ids:
            waits[c[0], c[1]] |= {(c[0], a) for a in c[4] or [] if (c[0], a) in ids}
    level: dict = {}
    while True:
        new = {k: 1 + max((level[a] for a in w), default=-1) for k, w in waits.items() if k not in level and all(a in level for a in w)}
        if not new:
            return level
        level |= new


def run(spark, calls, results, schemas=(("search", SCHEMA),)):
    out = tool_calls.linked(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS),
        spark.createDataFrame(list(schemas), "name string, schema string"),
    )
    return out.collect()


def test_links_levels_and_lines(spark):
    calls = [
        (1, "a", "search", '{"q": "é", "n": 2.0}', []),
        (1, "b", "search", '{"n":0,"q":"x"}', ["a"]),
        (1, "c", "free", '{"z":1,"a":[1.50,1e3,true,null]}', ["a", "b", "gone"]),
        (1, "d", "free", "no json", ["e"]), (1, "e", "free", None, ["d"]), (1, "f", "free", "[1]", ["e"]),
        (2, "a", "search", "{}", None), (2, "a", "search", '{"q":""}', ["zz"]),
        (None, "a", "free", "{}", []), (3, None, "free", "{}", ["a"]),
    ]
    results = [(1, "a", 5, "second"), (1, "a", 3, "first"), (2, "x", 1, "orphan"), (None, "a", 1, "n"), (3, None, 1, "n")]
    rows = run(spark, calls, results)
    assert len(rows) == len(calls) + 3
    want = brute_levels(calls)
    for r in rows:
        if r.name is not None:
            assert r.level == want.get((r.conv_id, r.call_id)), r
    by = {(r.conv_id, r.call_id): r for r in rows if r.name is not None}
    assert by[1, "a"].line == '{"arguments":{"n":2,"q":"é"},"id":"a","level":0,"name":"search","result":"first","valid":true}'
    assert '"arguments":{"a":[1.5,1000,true,null],"z":1}' in by[1, "c"].line
    assert by[1, "a"].n_results == 2 and by[1, "a"].linked and not by[1, "b"].linked
    assert [by[1, k].valid for k in "abcdef"] == [True, False, True, False, False, False]
    assert by[1, "c"].level == 2 and by[1, "d"].level is None
    orphans = [r for r in rows if r.name is None]
    assert {(r.conv_id, r.call_id) for r in orphans} == {(2, "x"), (None, "a"), (3, None)}


@pytest.mark.parametrize("value,schema,good", [
    (1, {"type": "integer"}, True), (True, {"type": "integer"}, False), (1.0, {"type": "integer"}, True),
    (1.5, {"type": ["integer", "string"]}, False), ("ab", {"maxLength": 1}, False), ("ab", {"pattern": "^a"}, True),
    ([1, "x"], {"items": {"type": "number"}}, False), ([1], {"minItems": 2}, False), ({"a": 1}, {"additionalProperties": False}, False),
    ({"a": {"b": 3}}, {"properties": {"a": {"properties": {"b": {"maximum": 2}}}}}, False), ("x", {"enum": ["x", 1]}, True),
    (None, {"type": "null"}, True), (3, {"const": 3.0}, True), (3, False, False), (3, None, True),
])
def test_schemas(value, schema, good):
    assert tool_calls.conforms(value, schema) is good


def test_canonical_round_trip():
    value = {"b": [1, 2.5, {"é": "\n\"", "a": None}], "a": -0.1, "c": 1e300, "d": 123456789012345678}
    text = tool_calls.canonical(value)
    assert json.loads(text) == value and tool_calls.canonical(json.loads(text)) == text


def test_nothing(spark):
    assert run(spark, [], []) == []
    assert [r.name for r in run(spark, [], [(1, "a", 1, "x")])] == [None]


def test_long_text_and_one_identifier_for_all(spark):
    calls = [(1, "same", "free", json.dumps({"t": "x" * 100_000}), [])] + [(1, "same", "free", "{}", ["same2"])] * 300
    rows = run(spark, calls, [(1, "same", i, str(i)) for i in range(300)])
    assert len(rows) == 301 and {r.n_results for r in rows} == {300} and max(len(r.line) for r in rows) > 100_000


def test_query_matches_brute_force(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    rows = queries.op8_tool_call_linking(spark, SF).collect()
    answers = {(t.conv_id, f"t{t.turn - 1}"): t.text for t in turns if t.role == "assistant"}
    asked = {(t.conv_id, f"t{t.turn}"): t for t in turns if t.role != "assistant"}
    want = brute_levels([(c, i, "", "", [f"t{t.turn - 2}"] if t.turn >= 2 else []) for (c, i), t in asked.items()])
    assert len(rows) == len(asked.keys() | answers.keys())
    for r in rows:
        t = asked.get((r.conv_id, r.call_id))
        if t is None:
            assert r.name is None and not r.linked
            continue
        assert r.linked == ((r.conv_id, r.call_id) in answers) and r.level == want[r.conv_id, r.call_id]
        line = json.loads(r.line)
        assert line["arguments"]["text"] == t.text and line["result"] == answers.get((r.conv_id, r.call_id))
        assert r.valid == (t.role == "system" or 1 <= len(t.text) <= 360)


def graph(seed, n):
    """Calls of several conversations: chains, forks, cycles, unknown and own identifiers."""
    rng = random.Random(seed)
    calls = [(1, f"c{i}", "free", "{}", [f"c{i - 1}"] if i else []) for i in range(n)]
    calls += [(2, f"c{i}", "free", "{}", [f"c{i - k}" for k in (1, 2) if i >= k]) for i in range(5)]
    calls += [(3, f"c{i}", "free", "{}", [f"c{(i + 1) % 7}"]) for i in range(7)] + [(3, "x", "free", "{}", ["c3"]), (3, "y", "free", "{}", ["x", "z"]), (3, "z", "free", "{}", None)]
    calls += [(4, "own", "free", "{}", ["own"]), (4, "gone", "free", "{}", ["never"]), (4, "a", "free", "{}", ["hub"]), (4, "hub", "free", "{}", [])]
    for _ in range(16):
        i = rng.randrange(10)
        calls.append((5, f"c{i}", "free", "{}", [f"c{rng.randrange(12)}" if rng.random() < 0.03 else f"c{rng.randrange(i + 1) - 1}" for _ in range(rng.randrange(3))]))
    calls += [(6, f"leaf{i}", "free", "{}", ["hub"]) for i in range(40)] + [(6, "hub", "free", "{}", ["low"]), (6, "low", "free", "{}", [])]
    return calls


@pytest.mark.parametrize("in_task", [10_000, 0])
def test_levels_in_tasks_and_by_pointers(spark, monkeypatch, in_task):
    monkeypatch.setattr(tool_calls, "IN_TASK", in_task)
    calls = graph(in_task, 40)
    rows = tool_calls.levels(spark.createDataFrame(calls, CALLS).repartition(3)).collect()
    got = {(r.conv_id, r.call_id): r.level for r in rows}
    assert len(got) == len(rows) and got == brute_levels(calls)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    whole = tool_calls.cut
    monkeypatch.setattr(tool_calls, "cut", lambda df: rounds.append(1) or whole(df))
    n = 5_000
    calls = [(1, f"c{i}", "free", "{}", [f"c{i - 1}"] if i else []) for i in range(n)]
    rows = tool_calls.levels(spark.createDataFrame(calls, CALLS)).collect()
    assert {r.call_id: r.level for r in rows} == {f"c{i}": i for i in range(n)} and len(rounds) < 30


BAD_TEXTS = [
    '{"q":"\\ud800"}', '{"\\udfff":1}', '{"q":"\\ud83d\\ude00"}', '{"q":1e400}', '{"q":NaN}', '{"q":-Infinity}', '{"q":' + "9" * 5000 + "}",
    "[" * 5000 + "]" * 5000, '{"q":' * 99 + "1" + "}" * 99, '{"q":' * 3000 + "1" + "}" * 3000, "", " ", "{", "\x00", '{"q":"\x01"}',
    '{"q":1,"q":"x"}', '{"q":12345678901234567890123}', '{"q":1e308}', '{"q":-0.0}', "null", "true", '"q"',
]
BAD_SCHEMAS = [
    "no json", "[]", "3", "null", '{"type":"text"}', '{"type":[1]}', '{"type":{}}', '{"minimum":"0"}', '{"properties":{"q":{"pattern":"("}}}', '{"$ref":"#"}',
    '{"properties":{"q":{"minLength":true}}}', '{"required":"q"}', '{"enum":1}', '{"multipleOf":0}', '{"unevaluatedProperties":false}', '{"items":[1]}',
    '{"not":' * 5000 + "{}" + "}" * 5000, '{"patternProperties":{"[":{}}}', '{"minimum":1e999}',
]


def test_no_input_ends_the_job(spark):
    names = [(f"s{i}", s) for i, s in enumerate(BAD_SCHEMAS)]
    calls = [(1, f"{n}-{i}", n, text, []) for n, _ in [*names, ("free", None), ("search", SCHEMA)] for i, text in enumerate(BAD_TEXTS)]
    rows = run(spark, calls, [(1, c[1], 1, "￾ ") for c in calls], [*names, ("search", SCHEMA), ("free", None)])
    assert len(rows) == len(calls)
    for r in rows:
        value = json.loads(r.line)["arguments"]
        assert tool_calls.canonical(json.loads(r.line)) == r.line
        if not isinstance(value, dict):
            assert r.valid is False
        elif r.name not in ("free", "search"):
            assert r.valid is None
    valid = {(r.name, int(r.call_id.split("-")[1])): r.valid for r in rows}
    assert [valid["free", i] for i in range(len(BAD_TEXTS))] == [True, True, True, *[False] * 5, True, *[False] * 6, True, True, True, True, *[False] * 3]
    assert [valid["search", i] for i in (0, 2, 15, 16)] == [True, True, True, False]


@pytest.mark.parametrize("value,schema,good", [
    (5, {"exclusiveMinimum": 9}, False), (9, {"exclusiveMaximum": 9}, False), (7, {"multipleOf": 2}, False), (0.3, {"multipleOf": 0.1}, True),
    (10**400, {"multipleOf": 0.5}, False), (10**400, {"type": "integer"}, True), (1, {"anyOf": [{"type": "string"}, {"minimum": 1}]}, True),
    (1, {"oneOf": [{"minimum": 0}, {"minimum": 1}]}, False), (1, {"allOf": [{"minimum": 0}, {"maximum": 0}]}, False), (1, {"not": {"type": "integer"}}, False),
    ([1, 1.0], {"uniqueItems": True}, False), ([1, "1"], {"uniqueItems": True}, True), (["a", 1], {"prefixItems": [{"type": "string"}], "items": {"type": "string"}}, False),
    ({"x1": 1}, {"patternProperties": {"^x": {"type": "string"}}}, False), ({"y": 1}, {"patternProperties": {"^x": {}}, "additionalProperties": False}, False),
    ({}, {"minProperties": 1}, False), ({"a": 1, "b": 1}, {"maxProperties": 1}, False), ({"ab": 1}, {"propertyNames": {"maxLength": 1}}, False),
    ({"a": 1}, {"dependentRequired": {"a": ["b"]}}, False), (5, {"if": {"minimum": 3}, "then": {"maximum": 4}}, False), (1, {"if": {"minimum": 3}, "else": {"minimum": 2}}, False),
    ("x", {"title": "t", "format": "date", "description": "d"}, True),
])
def test_more_schemas(value, schema, good):
    assert tool_calls.conforms(value, schema) is good


def test_schemas_that_cannot_be_judged(monkeypatch):
    for schema in ({"$ref": "#"}, {"dependentSchemas": {}}, {"minimum": "3"}):
        with pytest.raises(tool_calls.Unjudged):
            tool_calls.conforms(1, schema)
    monkeypatch.setattr(tool_calls, "PATTERN_SECONDS", 0.05)
    slow = json.dumps({"properties": {"q": {"pattern": "^(?:(a+)+)+\\1x$"}}})
    assert tool_calls.verdict({"q": "a" * 40 + "b"}, slow, {}) in (None, False)

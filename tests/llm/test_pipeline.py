from __future__ import annotations

import json
import subprocess
import sys
from collections import Counter, defaultdict

import __spark_entry__ as entry
import corpus_pipeline
from scoremon.llm import quality
from scoremon.llm.common import table
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_ngram_join import brute as brute_groups

SF = "/root/testdata/sf0.01"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def as_dict(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    (_, good), (_, unique), (_, clean), (_, mixed), (_, sharded) = corpus_pipeline.STAGES

    first = good(spark, docs, SF).cache()
    model = quality.train(docs, table(spark, SF, "labels"))
    want = {r.doc_id for r in quality.scored(docs, model).where("score >= 0.7").collect()}
    kept = as_dict(first)
    assert first.columns == NAMES and set(kept) == want

    second = unique(spark, first, SF).cache()
    groups = brute_groups(list(kept.items()))
    assert second.columns == NAMES and set(as_dict(second)) == {d for d in kept if groups[d][1] == d}

    third = clean(spark, second, SF).cache()
    before, after = as_dict(second), as_dict(third)
    items = [tuple(r) for r in table(spark, SF, "benchmark", "item_id", "text").collect()]
    leaks = brute_leaks(list(before.items()), items)
    assert third.columns == NAMES and any(n for _, n, _, _ in leaks.values())
    assert all(after[d] == before[d] for d in before if leaks[d][1] == 0)
    again = brute_leaks(list(after.items()), items)
    assert all(again[d][0] == leaks[d][0] - leaks[d][1] for d in after)
    assert all(r.n_chars == len(r.text) for r in third.collect() if leaks[r.doc_id][1])

    fourth = mixed(spark, third, SF).cache()
    times = Counter(r.doc_id for r in fourth.collect())
    assert fourth.columns == NAMES and set(times) <= set(after) and max(times.values()) <= 3

    last = sharded(spark, fourth, SF).collect()
    assert Counter(r.doc_id for r in last) == times
    slots, load = defaultdict(list), Counter()
    for r in last:
        assert r.text == after[r.doc_id]
        slots[r.shard].append(r.slot)
        load[r.shard] += len((r.text or "").encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert max(load.values()) - min(load.values()) < 0.03 * sum(load.values()) / 8 + 40_000


def test_odd_rows_pass_through_all_stages(spark):
    rows = [(i, f"some words of text number {i} that differ a lot {i * 7}", "en", "s", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (3, rows[3][1], "en", "s", 1), (None, "a b", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[1:]:
            frame = stage(spark, frame, SF)
            assert frame.columns[:5] == NAMES, name
        got = frame.collect()
        ids = {r.doc_id for r in got}
        assert not got or {100, 101, None} <= ids


def test_entry_works_without_this_package():
    """The driver deletes the two folders; the other queries still register."""
    code = (
        "import sys, json\n"
        "class Block:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('scoremon.llm') or name == 'corpus_pipeline': raise ImportError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=entry.__file__.rsplit("/", 1)[0])
    names, oracles = json.loads(out.stdout.splitlines()[-1])
    assert "monthly_calibration" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert "pipeline" not in names and set(oracles) <= set(names)
    assert {f"op{n}_" for n in range(1, 14)} == {n.split("_")[0] + "_" for n in entry.queries() if n[:2] == "op" and n[2].isdigit()}


def test_near_duplicates_with_repeated_and_null_ids(spark):
    (_, _), (_, unique), *_ = corpus_pipeline.STAGES
    text = "one two three four five six seven eight nine ten"
    rows = [(9, text, "en", "a", 1), (4, text, "en", "b", 1), (4, text, "en", "a", 1), (4, text, "en", "b", 1)]
    rows += [(None, "null ids alone make a group of their own here", "en", "a", 2)] * 3 + [(None, text, "en", "a", 1)]
    rows += [(7, "", "en", "a", 0), (7, "", "en", "a", 0), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(4, "another text under a repeated id stays as it is too", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [tuple(r) for r in unique(spark, docs, SF).collect()]
    assert sum(r[1] == text for r in kept) == 1 and {r[0] for r in kept if r[1] == text} == {4}
    assert sum(r[1] is not None and r[1].startswith("null ids") for r in kept) == 1
    assert sum(r[1] == "" for r in kept) == 2 and sum(r[1] is None for r in kept) == 2
    assert sum(r[1] is not None and r[1].startswith("another") for r in kept) == 1 and len(kept) == 7

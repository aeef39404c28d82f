from __future__ import annotations

import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from scoremon.llm import decontaminate, kernel, queries

SCHEMA = "doc_id long, text string, lang string, n_words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        if w:
            for j in range(max(1, len(w) - window + 1)):
                windows.setdefault(tuple(w[j : j + window]), set()).add(item)
    out = {}
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if (owners := windows.get(tuple(w[j : j + m]))):
                    hit.update(range(j, j + m))
                    found |= owners
        key = ",".join(sorted(map(str, found)))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(key.encode()).hexdigest())
    return out


def test_index_matches_plain_search():
    rng = np.random.default_rng(3)
    text = rng.integers(2, 6, 400)
    index = decontaminate.FmIndex(text, 6)
    phrases = np.array([text[i : i + 5] for i in range(0, 390, 7)] + [[2, 2, 2, 2, 2]])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(396) if (text[i : i + 5] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_find_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = np.random.default_rng(5)
    vocab = ["a", "Bé", "c1", "dd", "été", "F"]
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(1, say(12)), (2, say(3)), (3, ""), (4, None), (10, "only, ONE"), (11, say(10)), (12, "zz")]
    docs = [(i, say(rng.integers(0, 60))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "x " * 5000 + re.sub("[a-z]", lambda m: m[0].upper(), items[0][1]) + " y" * 10)]
    docs += [(103, "é" + items[0][1]), (104, "-".join(items[0][1].split())), (105, "zz"), (105, "zz")]
    df = spark.createDataFrame([(d, t, "en", "clash") for d, t in docs], SCHEMA)
    got = decontaminate.find(df, spark.createDataFrame(items, "item_id long, text string"))
    rows = got.select("*", decontaminate.n_hit().alias("hits")).collect()
    want = brute(docs, items)
    assert len(rows) == len(docs)
    for r in rows:
        n, hits, n_items, _ = want[r.doc_id]
        assert (r.n_words, r.hits, len(r.hit_items)) == (n, hits, n_items), r.doc_id
    clean = {r.doc_id: r.text for r in decontaminate.remove(got).collect()}
    assert clean[100] is None and clean[101] == "" and 105 not in clean
    assert all(clean[d] == t for d, t in docs if d in clean and not want[d][1])
    assert clean[102].split() == ["x"] * 5000 + ["y"] * 10


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b", "en", "")], SCHEMA)
    assert decontaminate.find(some, items).first().hit_spans == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op10_benchmark_decontamination(spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows} == want
    assert any(r.contaminated for r in rows)


@pytest.mark.parametrize("texts", [8000, 1])
def test_memory_of_a_task_is_bounded(texts):
    """4 MB of text, in many rows or one, take a small multiple of it."""
    rng = np.random.default_rng(9)
    all_words = rng.choice([f"word{i}" for i in range(5000)], 600_000)
    column = pa.array([" ".join(part) for part in np.array_split(all_words, texts)])
    phrases = decontaminate.Phrases.of([(1, " ".join(all_words[100:115])), (2, "not there")], 10)
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    kernel.powers(1)
    tracemalloc.start()
    hits = sum(len(s) for out in decontaminate._pass(phrases, ["text"], True)(iter([batch])) for s in out.column(2).to_pylist())
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert hits == 1 and most < 80e6, most


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_pieces_do_not_change_hashes(monkeypatch, piece):
    monkeypatch.setattr(kernel, "PIECE", piece)
    data, offsets = kernel.raw(pa.array(["one two", None, "", "  été, three-four five", "abcdefghijklmnop q"]))
    _, starts, ends = kernel.words(data, offsets, kernel.PUNCTUATION)
    want = kernel.range_hash(kernel.prefix_sums(data), starts, ends)
    assert kernel.word_hashes(data, starts, ends).tolist() == want.tolist()
    assert not len(kernel.word_hashes(data, starts[:0], ends[:0]))


def test_finding_and_removing_take_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "")], SCHEMA)
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    plan = decontaminate.remove(decontaminate.find(docs, items))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("block", [1 << 24, 10])
def test_removed_bytes(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    texts = ["Zz", "Zz!", "-Zz x", "x Zz", "é Zz ü—Q, zz. x\U0001F600 ZZ  y", "zz\U0001F600", "é ABC abc zz, 日本 zz", "", None, "!?", "zz zz", " x  "]
    want = {2: "- x", 3: "x ", 4: "é  ü—Q, . x\U0001F600   y", 6: "é ABC abc , 日本 "} | {i: texts[i] for i in (5, 7, 8, 9, 11)}
    docs = spark.createDataFrame([(i, t, "en", "") for i, t in enumerate(texts)], SCHEMA)
    items = spark.createDataFrame([(1, "zz"), (2, "É abc")], "item_id long, text string")
    assert {r.doc_id: r.text for r in decontaminate.remove(decontaminate.find(docs, items)).collect()} == want

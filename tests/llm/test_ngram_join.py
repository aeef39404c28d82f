from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

from scoremon.llm import ngram_join, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    seen = set()
    for d, s in sets.items():
        for o in {o for x in s for o in holders[x] if o > d}:
            seen.add((d, o))
    for a, b in seen:
        x, y = sets[a], sets[b]
        n = len(x & y)
        if 100 * n >= 80 * (len(x) + len(y) - n):
            i, j = sorted((root(a), root(b)))
            parent[j] = i
    return {d: (len(sets[d]), root(d)) for d in sets}


def family(rng, base, copies, rate):
    out = []
    for _ in range(copies):
        w = list(base)
        for i in range(len(w)):
            if rng.random() < rate:
                w[i] = f"e{rng.integers(1 << 30)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = [None, "", " \t ", "one two", "ONE  two", "one two three", "a a a a a a a a a"]
    texts += [" ".join(say(rng.integers(1, 200))) for _ in range(60)]
    for size, rate in ((30, 0.01), (150, 0.02), (150, 0.03), (400, 0.015), (8, 0.02), (16, 0.03)):
        texts += family(rng, say(size), 90, rate)
    line = say(40)
    texts += [" ".join(line + say(rng.integers(0, 12))) for _ in range(150)]
    texts += [" ".join(say(rng.integers(0, 6)) + line + say(rng.integers(0, 6))) for _ in range(100)]
    texts += [" ".join(say(6000) + line)] * 2 + [texts[20]] * 5
    order = rng.permutation(len(texts))
    return [(int(d), texts[i]) for d, i in enumerate(order)]


@pytest.mark.parametrize("frequent,seed", [(64, 1), (6, 2), (2, 3)])
def test_components_match_brute_force(spark, monkeypatch, frequent, seed):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 7, 7) for d, t in docs], "doc_id long, text string, node int, key int")
    rows = ngram_join.similar_groups(df).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    want = brute(docs)
    assert got == want
    assert len({c for _, c in want.values()}) < len(docs) - 100


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_groups(df).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    rows = sorted(tuple(x) for x in ngram_join.similar_groups(df).where("doc_id IS NOT NULL").collect())
    assert rows == [(1, 1, 1), (1, 1, 1), (3, 0, 3)]


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_ngram_jaccard_join(spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs)

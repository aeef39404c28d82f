from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from scoremon.llm import oracles, queries, spelling
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.01"


def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return n


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, least=2, ratio=10):
    words = {w: n for w, n in counts.items() if n >= least}
    form, near = {}, {}
    for w, n in words.items():
        others = [o for o in words if o != w and abs(len(o) - len(w)) < 2 and one_apart(o, w)]
        near[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], near[w], words.get(form[w])))
    return out


def same(got, want):
    return sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def counted(spark, counts, **more):
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    return spelling.variants(rows, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()


@pytest.mark.parametrize("seed", range(4))
def test_neighbours_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(spelling, "ROWS", 17)
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "aéß×z"
    counts = Counter()
    for _ in range(500):
        counts["".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))] = rng.choice([1, 2, 3, 20, 30, 300, 5000])
    assert same(counted(spark, counts), brute(counts))


def test_many_partitions_share_nodes(spark):
    # Words under one long prefix, so that ranges cut through shared prefixes and suffixes.
    rng = random.Random(9)
    counts = {
        "prefix" * 3 + "".join(rng.choice("abc") for _ in range(5)) + "suffix" * 3: rng.randint(2, 90) for _ in range(400)
    }
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert same(counted(spark, counts), brute(counts))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chain_of_forms_ends_in_its_root(spark):
    counts = {"wordaaa": 2, "wordaab": 20, "wordabb": 200, "wordbbb": 2000, "worbbbb": 20000, "other": 7}
    got = {r.word: (r.form, r.root) for r in counted(spark, counts)}
    assert got["wordaaa"] == ("wordaab", "worbbbb") and got["wordbbb"] == ("worbbbb", "worbbbb")
    assert got["other"] == (None, "other")


def test_ties_go_to_the_first_word(spark):
    counts = {"cassess": 2, "bassess": 50, "dassess": 50, "éassess": 50}
    got = {r.word: (r.form, r.n_near) for r in counted(spark, counts)}
    assert got["cassess"] == ("bassess", 3)


def test_very_long_words(spark):
    counts = {"a" * 200_000: 3, "a" * 199_999: 90, "a" * 100_000 + "b" + "a" * 99_999: 4, "ab" * 20: 5}
    assert same(counted(spark, counts), brute(counts))


def test_empty_and_rare(spark):
    assert counted(spark, {}) == [] or spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert counted(spark, {"onlyone": 1}) == []


def test_words_of_odd_documents(spark):
    rng = random.Random(4)
    words = ["Spelling", "VARIANTS", "ÉCLAIRÉ", "straße×÷", "grouping", "exİmple", "sévérité"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(200)]
    docs += [(None, "Spelling spelling"), (None, None), (5, ""), (5, "Spelling," * 3000), (5, "Spelling," * 3000)]
    docs += [(6, "x" * 50_000), (7, "1234 ..."), (8, "shorter")]
    frame = spark.createDataFrame([(i, t, "c", 1, "p") for i, t in docs], "doc_id long, text string, word string, n int, run string")
    got = {r.word: r.n for r in spelling.spoilt_words(frame).collect()}
    assert got == brute_words(docs)
    assert same(spelling.variants(spelling.spoilt_words(frame)).collect(), brute(brute_words(docs)))


def test_query_matches_its_sql(spark):
    ok, note = compare(queries.QUERIES["op13_spelling_variants"](spark, SF), connect(SF), oracles.SPELLING)
    assert ok, note

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoremon.llm import merkle, oracles, queries, topk_search
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """(root, per node the list of (left, right) siblings up to it)."""
    tiers = [nodes]
    while len(tiers[-1]) > 1:
        below = tiers[-1]
        tiers.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    paths = []
    for k in range(len(nodes)):
        path = []
        for tier in tiers[:-1]:
            run = tier[k // 16 * 16 : k // 16 * 16 + 16]
            path.append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
            k //= 16
        paths.append(path)
    return tiers[-1][0], paths


def brute(rows):
    def leaf(row, low=False):
        parts = []
        for name in merkle.FIELDS:
            v = row[name]
            if low and name == "text" and v is not None:
                v = "".join(c.lower() if "A" <= c <= "Z" else c for c in v)
            parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
        return sha("".join(parts))

    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        built[s] = tree([leaf(r) for r in groups[s]])
    if not order:
        return []
    root, tops = tree([built[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(groups[s], built[s][1]):
            path = path + top
            low = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            folded = leaf(r, low)
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((r["doc_id"], leaf(r), built[s][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, at string"


def built(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = F.when(merkle.tampered(), merkle.leaf_digest(text=merkle.lowered(F.col("text"))))
    return merkle.manifest(docs, found)


def many(n, sources):
    return [
        (i, f"Text {i} É ABC" if i % 7 else None, "en" if i % 5 else None, f"s{i % sources}" if i % sources else None,
         i if i % 3 else None, "x", "y", "z") for i in range(n)
    ]


def as_dicts(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]


# 5,000 leaves of one source need two passes; 300 sources need two passes of the upper tree.
@pytest.mark.parametrize(
    "rows",
    [many(700, 3), many(600, 300), many(5000, 1), many(1, 1), many(40, 40)]
    + [[(None, "A", None, "é", 1, "", "", ""), (None, "B", None, "é", 1, "", "", ""), (3, "", "", "", 0, "", "", "")]
       + [(7, "Same" * 50_000, "en", "z", 4, "", "", "")] * 300],
    ids=["few sources", "many sources", "one source", "one row", "lone leaves", "odd rows"],
)
def test_manifest_equals_brute_force(spark, rows):
    got = [tuple(r) for r in built(spark, rows).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute(as_dicts(rows)), key=key)


def test_manifest_of_an_empty_table(spark):
    assert built(spark, []).collect() == []


def test_proofs_lead_to_the_root(spark):
    docs = spark.createDataFrame(many(400, 3), SCHEMA)
    rows = merkle.manifest(docs, proofs=True).collect()
    assert all(r.verified and r.folded_root == r.root for r in rows)
    assert all(sha("".join(r.proof)) == r.proof_sha256 and all(len(d) == 64 for d in r.proof) for r in rows)


def test_one_changed_field_is_found(spark):
    docs = spark.createDataFrame(many(300, 2), SCHEMA)
    found = F.when(F.col("doc_id") == 77, merkle.leaf_digest(lang=F.lit("fr")))
    assert [r.doc_id for r in merkle.manifest(docs, found).where("NOT verified").collect()] == [77]


def test_queue_hands_digests_up_in_label_order():
    leaves = [sha(str(i)) for i in range(200)]
    tiers = merkle.sweep_up(leaves, 2)
    assert tiers[2] == [tree(leaves)[0]]
    assert merkle.sweep_down(tiers, []) == tree(leaves)[1]


def brute_top(rows, k, asked):
    """rows of (vec_id, vector); exact Python integers."""
    kept = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((n, i, [max(min(math.floor(256 * float(x)), 2**63 - 1), -(2**63)) for x in v]))
    out = []
    for n, i, q in kept:
        if not asked(i):
            continue
        found = []
        for m, j, c in kept:
            if m != n:
                s = sum(a * b for a, b in zip(q, c))
                found.append((-max(min(s, 2**63 - 1), -(2**63 - 1)), j is None, j or 0))
        found.sort()
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k])]
    return out


def search(spark, rows, k=5, asked="vec_id % 3 = 0"):
    frame = spark.createDataFrame(
        [(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, rank string, _q int"
    )
    return [tuple(r) for r in topk_search.top_k(frame, F.expr(asked), k).collect()]


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("block", [4_000_000, 160])
@pytest.mark.parametrize("full", [0.3, 2.0])
def test_topk_equals_brute_force(spark, monkeypatch, block, full):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "FULL", full)
    rng = np.random.default_rng(3)
    sparse = rng.normal(size=(120, 8)) * (rng.random((120, 8)) < 0.4)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(sparse)]
    assert sorted(search(spark, rows)) == sorted(brute_top(rows, 5, lambda i: i % 3 == 0))


def test_topk_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (3, None), (6, [1.0, None]), (9, [float("nan"), 1.0]), (12, [float("inf")]),
            (15, []), (18, [1.0, 2.0, 3.0]), (1, [0.0, 0.0]), (None, [5.0, 5.0]), (21, [-0.001, 0.001])]
    rows += [(24, [3e38, 1.0]), (25, [-3e38, -1.0]), (27, [1e15, 2.0]), (28, [1e15, 1.0])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_top(rows, 5, lambda i: i is not None and i % 3 == 0)
    assert sorted(search(spark, rows), key=key) == sorted(want, key=key)


def test_topk_ties_repeats_and_few_rows(spark):
    rows = [(i % 40, [1.0, 0.0]) for i in range(400)]
    assert sorted(search(spark, rows)) == sorted(brute_top(rows, 5, lambda i: i % 3 == 0))
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exact_topk"])
def test_queries_match_their_sql(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, SF), connect(SF), oracles_of(name))
    assert ok, note


def oracles_of(name):
    return {"op11_merkle_manifest": oracles.MERKLE, "op12_exact_topk": oracles.TOPK}[name]

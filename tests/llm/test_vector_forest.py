from __future__ import annotations

import numpy as np
import pytest

from scoremon.llm import queries, vector_forest


def brute(rows, threshold=0.93):
    """Links and smallest reachable id from all pairs of equal labels."""
    good = [
        (i, np.array(v, float), label) for i, v, label in rows
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links, low = {}, {}
    for label in {g[2] for g in good}:
        own = [g for g in good if g[2] == label]
        for size in {len(g[1]) for g in own}:
            part = [g for g in own if len(g[1]) == size]
            x = np.array([g[1] / np.linalg.norm(g[1]) for g in part])
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            comp = np.array([g[0] for g in part])
            while True:
                new = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(part))])
                if (new == comp).all():
                    break
                comp = new
            for i, g in enumerate(part):
                links[g[0]] = int(near[i].sum())
                low[g[0]] = int(comp[i])
    return {i: (links.get(i, 0), low.get(i, i)) for i, _, _ in rows}


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", "x") for r in rows],
        "vec_id long, embedding array<float>, label int, key string, node string",
    )


def clustered(rng, n, width, labels):
    rows, base = [], rng.normal(size=(n // 8, width))
    for i in range(n):
        v = base[rng.integers(len(base))] + rng.choice([0.02, 0.25, 0.4]) * rng.normal(size=width)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize("leaf", [512, 40])
def test_links_and_components(spark, monkeypatch, leaf):
    monkeypatch.setattr(vector_forest, "LEAF", leaf)
    monkeypatch.setattr(vector_forest, "BLOCK", 64)
    rng = np.random.default_rng(2)
    rows = clustered(rng, 700, 16, 3)
    rows += [(1000 + i, rows[5][1], 1) for i in range(120)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [1.0, None] * 8, 1),
             (2004, [float("nan")] * 16, 1), (2005, [float("inf")] * 16, 1), (2006, [1.0] * 16, None),
             (2007, [1.0] * 4, 1), (2008, [2.0] * 4, 1), (2009, [1e-30] * 16, 9), (2010, [1e30] * 16, 9)]
    got = {r.vec_id: r for r in vector_forest.near_duplicates(frame(spark, rows)).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    total = sum(n for n, _ in want.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= (1.0 if leaf == 512 else 0.95) * total
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    if leaf == 512:
        assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert got[2009].n_links == 1 and got[2007].n_links == 1
    assert all(got[i].n_links == 0 and got[i].kept for i in range(2000, 2007))


def test_nothing(spark):
    assert vector_forest.near_duplicates(frame(spark, [])).count() == 0


def test_query_recall(spark, monkeypatch):
    monkeypatch.setattr(vector_forest, "LEAF", 64)
    sf = "/root/testdata/sf0.1"
    rows = [
        (r.vec_id, list(r.embedding), r.label)
        for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ]
    want = brute(rows)
    got = {r.vec_id: r for r in queries.op6_embedding_near_dedup(spark, sf).collect()}
    total = sum(n for n, _ in want.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * total


@pytest.mark.parametrize("spread", [0.1, 0.26])
def test_dense_cluster_keeps_its_links(spark, monkeypatch, spread):
    """Near copies of one vector, many times a leaf, between rows without links and small groups."""
    monkeypatch.setattr(vector_forest, "LEAF", 64)
    monkeypatch.setattr(vector_forest, "PIECE", 300)
    rng = np.random.default_rng(11)
    centre = rng.normal(size=64)
    x = np.concatenate([
        centre + spread * rng.normal(size=(2500, 64)), rng.normal(size=(1000, 64)),
        np.repeat(rng.normal(size=(50, 64)), 10, axis=0) + 0.1 * rng.normal(size=(500, 64)),
    ]).astype(np.float32)
    rows = [(i, v, 1) for i, v in enumerate(x[rng.permutation(len(x))].tolist())]
    got = {r.vec_id: r for r in vector_forest.near_duplicates(frame(spark, rows)).collect()}
    want = brute(rows)
    total = sum(n for n, _ in want.values())
    assert total > 1_000_000
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * total
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.99 * len(rows)

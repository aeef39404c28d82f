from __future__ import annotations

import hashlib

import numpy as np
import pytest

from scoremon.llm import kernel, queries, suffix_family


def brute(docs, length=50):
    """Smallest document of every window, then coverage, by plain dictionaries."""
    low: dict[bytes, int] = {}
    for d, t in docs:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                if low.get(w, d) >= d:
                    low[w] = d
    out = []
    for d, t in docs:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if low[b[i : i + length]] < d:
                    cover[i : i + length] = True
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        edges = np.diff(np.concatenate([[0], cover.astype(int), [0]]))
        out.append((d, len(b), int(cover.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(rows):
    return sorted(
        ((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in rows),
        key=str,
    )


def corpus(seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdefgh éü")
    say = lambda n: "".join(rng.choice(letters, n))
    shared = [say(n) for n in (48, 50, 51, 60, 75, 120, 400)]
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 51, "ab" * 100, "ab" * 90 + "c", say(3000)]
    for _ in range(150):
        parts = [say(rng.integers(0, 90)) for _ in range(rng.integers(1, 5))]
        for _ in range(rng.integers(0, 3)):
            s = shared[rng.integers(len(shared))]
            cut = rng.integers(0, 20)
            parts.insert(rng.integers(len(parts) + 1), s[cut:] if rng.random() < 0.3 else s)
        texts.append("".join(parts))
    base = say(900)
    for _ in range(40):
        t = list(base)
        for _ in range(rng.integers(0, 6)):
            t[rng.integers(len(t))] = "Z"
        texts.append("".join(t))
    texts += [texts[20]] * 6
    order = rng.permutation(len(texts))
    return [(int(i * 3), texts[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("chunk,hot,piece", [(6 << 20, 256, 8 << 20), (4_000, 2, 500), (20_000, 0, 1_000)])
def test_matches_brute_force(spark, monkeypatch, chunk, hot, piece):
    monkeypatch.setattr(suffix_family, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_family, "HOT", hot)
    monkeypatch.setattr(suffix_family, "HOT_IN_CHUNK", max(1, hot // 2))
    monkeypatch.setattr(suffix_family, "PIECE", piece)
    docs = corpus(chunk)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, rid string")
    assert result(suffix_family.repeated(df.repartition(5)).collect()) == brute(docs)


def test_repeated_and_missing_ids(spark):
    a, b = "q" * 30 + "common text that is long enough to count here!" * 2, "w" * 70
    docs = [(1, a), (1, a), (1, a + b), (2, a), (2, b), (None, a), (None, b), (3, None), (5, b), (4, a[:40])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_family.repeated(df, with_bytes=True).collect()
    assert result(got) == brute(docs)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_nothing(spark):
    assert suffix_family.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert result(suffix_family.repeated(one).collect()) == brute([(None, None)])


def test_runs_cover_all_windows_and_agree_on_content():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    twice = np.concatenate([data[:10], data[200:900], data[50:60]])
    both = np.concatenate([data, twice])
    offsets = np.array([0, len(data), len(data), len(both)])
    doc, number, first, count, key, _ = suffix_family.runs(both, offsets)
    for i, size in ((0, len(data)), (1, 0), (2, len(twice))):
        own = doc == i
        assert count[own].sum() == max(size - 49, 0) and (number[own] == np.arange(own.sum())).all()
    by_window = {}
    for f, c, k in zip(first, count, key, strict=True):
        for p in range(f, f + c):
            assert by_window.setdefault(both[p : p + 50].tobytes(), k) == k


def test_family_levels_are_geometric():
    rng = np.random.default_rng(2)
    family, seen = suffix_family.Family(), set()
    for _ in range(40):
        codes = np.unique(rng.integers(0, 5000, rng.integers(1, 200)).astype(np.uint64))
        assert family.scan(codes).tolist() == [int(c) in seen for c in codes]
        family.add(codes)
        seen |= set(codes.tolist())
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) < 14


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op7_suffix_array_dedup(spark, sf).collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute(docs)
    assert kernel.LOWER[65] == 97

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from scoremon.llm import language, quality, queries

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    up = np.array(labels) == 1
    return (rank[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum())


def test_quality_query_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in queries.op3_quality_classifier(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == held(d) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    test = [d for d in labels if held(d)]
    assert auc([rows[d].score for d in test], [labels[d] for d in test]) > 0.97
    right = np.mean([rows[d].predicted == labels[d] for d in test])
    assert right > 0.93


def test_descent_reaches_the_optimum():
    """Duality: at the optimum no step along any coordinate lowers the primal objective."""
    rng = np.random.default_rng(4)
    n, width = 60, 5
    x = rng.normal(size=(n, width))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=n) > 0, 1.0, -1.0)
    rows, heads = np.tile(np.arange(width), n), np.arange(n + 1) * width
    w, b = quality.descend(rows, heads, x.ravel(), y, np.ones(n), 500, 1)

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + (np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()

    best = primal(w[:width], b)
    for _ in range(200):
        assert primal(w[:width] + 0.05 * rng.normal(size=width), b + 0.05 * rng.normal()) > best - 0.02


def test_indicators_by_plain_python():
    column = pa.array(["one two one", None, "", "ONE  Two!! two!! 99 x"])
    doc, dim = quality.indicators(column)
    assert len(set(zip(doc.tolist(), dim.tolist()))) == len(doc)
    assert set(doc.tolist()) == {0, 3}
    again = quality.indicators(pa.array(["ONE  Two!! two!! 99 x"]))[1]
    assert sorted(dim[doc == 3].tolist()) == sorted(again.tolist())
    # 3 distinct words and shapes a / A / Aa!! / a!! / 0 and their runs.
    words = quality.indicators(pa.array(["aa bb"]))[1]
    assert len(words) == 2 + 1 + 1


def test_quality_odd_inputs(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "good text here", "c"), (3, "good text here", "c"), (4, "bad!! bad!!", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, score string")
    got = quality.scored(docs, quality.train(docs, none)).collect()
    assert len(got) == 5 and {round(r.score, 6) for r in got} == {0.5}
    one = spark.createDataFrame([(3, 1), (None, 0), (4, None)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.scored(docs, quality.train(docs, one)).collect())
    empty = docs.where("false")
    assert quality.scored(empty, quality.train(empty, one)).count() == 0
    assert all(not held(d) for d in (3, 4))


def test_language_query_on_held_out_documents(spark):
    docs = documents(spark)
    rows = {r.doc_id: r for r in queries.op5_language_id(spark, SF).collect()}
    assert len(rows) == 1000 and all(r.held_out == held(d) for d, r in rows.items())
    test = [d for d in docs if held(d) and docs[d].lang]
    assert np.mean([rows[d].lang_pred == docs[d].lang for d in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


EN = "the and of to with which that this from there have been would their what about".split()
DE = "der die und ist nicht auch eine wird schon über nach können für durch zwischen".split()
RU = "и в не на что это как его она они был только может сказал время".split()


def model():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(v, 40)) for v in (EN, DE, RU) for _ in range(30)]
    return language.fit(texts, ["en"] * 30 + ["de"] * 30 + ["ru"] * 30)


def brute_path(score):
    """Best labelling by trying all of them."""
    import itertools

    n, k = score.shape
    best = max(
        itertools.product(range(k), repeat=n),
        key=lambda p: sum(score[i, x] for i, x in enumerate(p))
        - language.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False)),
    )
    value = sum(score[i, x] for i, x in enumerate(best))
    return value - language.SWITCH * sum(a != b for a, b in zip(best, best[1:], strict=False))


@pytest.mark.parametrize("seed", range(4))
def test_paths_are_optimal(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    m = model()
    lengths = [3, 0, 7, 1, 5]
    score = rng.normal(scale=12, size=(sum(lengths), 3)).astype(np.float32)
    monkeypatch.setattr(m, "word_scores", lambda w: score)
    doc = np.repeat(np.arange(5), lengths)
    z = np.zeros(len(doc), np.int64)
    path = m.paths(language.Words(doc, z, z, z, z), 5)
    for i in range(5):
        own, p = score[doc == i], path[doc == i]
        if len(own):
            value = own[np.arange(len(p)), p].sum() - language.SWITCH * (p[1:] != p[:-1]).sum()
            assert value == pytest.approx(brute_path(own), abs=1e-3)


def test_mixed_text_gets_spans(spark):
    m = model()
    a, b, c = " ".join(EN), " ".join(DE), " ".join(RU)
    text = f"{a} {b}, {c}."
    names, share, parts = m.predict(pa.array([text, None, "", "12 — …", "中文", "über", "x" * 70000]), spans=True)
    got = [(p["lang"], text.encode()[p["start"] : p["stop"]].decode()) for p in parts[0]]
    assert got == [("en", a), ("de", b), ("ru", c)]
    assert names[0] == "ru" and names[1:4] == ["und"] * 3 and names[4] in m.names and names[5] == "de"
    assert share[1] == 0 and 0 < share[0] < 1


def test_language_odd_inputs(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "x"), (2, "the and of", None, "x"), (3, "the and of", "en", "x"), (None, "die und", "de", "x")],
        "doc_id long, text string, lang string, score string",
    )
    got = {r.doc_id: r for r in language.labelled(docs, language.train(docs), spans=True).collect()}
    assert got[1].lang_pred == "und" and got[2].lang_pred == got[3].lang_pred == "en"
    none = language.train(docs.where("false"))
    assert {r.lang_pred for r in language.labelled(docs, none).collect()} == {"und"}


def test_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(5_000)] + [(i, "good words") for i in range(2, 60)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = quality.sample(docs, labels, "quality", 300)
    assert rows.count() == 300
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, quality.train(docs, labels, bound=300)).collect())


@pytest.mark.parametrize("text", ["٠١٢٣ ٤٥", "०१२३", "๐๑๒", "০১", "𝟎𝟏 𝟐", "́̂", "ः", "12 !?", "€ — …", "", None])
def test_texts_without_a_letter_have_no_language(text):
    names, share, _ = language.fit(["some english words"] * 3 + ["ein deutscher satz"] * 2, ["en"] * 3 + ["de"] * 2).predict(
        pa.array([text], pa.string())
    )
    assert names == ["und"] and share[0] == 0


@pytest.mark.parametrize("text", ["这是中文文本", "Это русский текст", "ℵ", "𝐀𝐁"])
def test_letters_of_unknown_scripts_go_to_the_prior(text):
    model = language.fit(["some english words"] * 3 + ["ein deutscher satz"] * 2, ["en"] * 3 + ["de"] * 2)
    names, share, _ = model.predict(pa.array([text, f"{text} das ist ein deutscher satz"], pa.string()))
    assert names[0] == "en" and share[0] == 0 and names[1] == "de" and 0 < share[1] < 1


def test_marks_stay_with_their_letters():
    words = language.split(pa.array(["हिन्दी में été 1२3"]))
    assert len(words.doc) == 3 and (words.script > 0).all()

"""Language identification by script ranges and a Viterbi path over word scores.

Each word votes with the log-likelihoods of its byte trigrams under every language whose
training texts use the word's script; other languages are out for that word.  A path over
the words with a penalty for every change of language (Viterbi) labels spans of mixed
texts; the language that covers most bytes of words names the document.

The trigram tables are counted in one task on at most ``SAMPLE`` documents per language,
those with the smallest hashes of their ids; prediction is a stateless pass over whole
texts.

Defined cases: ``und`` with score 0 for null texts and texts without a letter; letters of
scripts that no language uses leave the choice to the other words, or to the most frequent
language of the sample with score 0 where there are none; without any training text all
predictions are ``und``.  Letters and marks are those of Unicode, so digits, also of other
scripts and mathematical ones, are none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from scoremon.llm import kernel
from scoremon.llm.common import slices, store
from scoremon.llm.quality import held_out

#: Bound of the sample per language.
SAMPLE = 1_000
TABLE_BITS = 17
CHUNK_BYTES = 3 << 20
SWITCH = 12.0
FLOOR = -30.0
UNKNOWN = "und"

# First code points of blocks of letters, 0 for blocks without letters.
# Latin 1, Greek 2, Cyrillic 3, Armenian 4, Hebrew 5, Arabic 6, Devanagari 7, other Indic 8,
# Thai and Lao 9, Georgian 10, Hangul 11, Kana 12, Han 13, other scripts 14.
BLOCKS = [
    (0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xB5, 2),
    (0xB6, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1),
    (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 14),
    (0x750, 6), (0x780, 14), (0x8A0, 6), (0x900, 7), (0x980, 8), (0xE00, 9), (0xF00, 14),
    (0x10A0, 10), (0x1100, 11), (0x1200, 14), (0x1C80, 3), (0x1C90, 10), (0x1CC0, 14),
    (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C00, 14), (0x2C60, 1), (0x2C80, 14),
    (0x2DE0, 3), (0x2E00, 0), (0x3040, 12), (0x3100, 14), (0x3130, 11), (0x3190, 0),
    (0x31F0, 12), (0x3200, 0), (0x3400, 13), (0x4DC0, 0), (0x4E00, 13), (0xA000, 14),
    (0xA720, 1), (0xA800, 14), (0xAC00, 11), (0xD7B0, 14), (0xE000, 0), (0xF900, 13),
    (0xFB00, 1), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF3B, 0),
    (0xFF41, 1), (0xFF5B, 0), (0xFF66, 12), (0xFFE0, 0), (0x10000, 14), (0x1F000, 0),
    (0x20000, 13), (0x32000, 0),
]
BLOCK_FIRST = np.array([b for b, _ in BLOCKS])
BLOCK_SCRIPT = np.array([s for _, s in BLOCKS])
SCRIPTS = int(BLOCK_SCRIPT.max()) + 1
OTHER = SCRIPTS - 1

LETTER, MARK = 1, 2


@cache
def kinds() -> np.ndarray:
    """LETTER or MARK for every code point of these Unicode categories, else 0."""
    categories = (unicodedata.category(chr(c))[0] for c in range(0x110000))
    return np.fromiter((LETTER if k == "L" else MARK if k == "M" else 0 for k in categories), np.uint8, 0x110000)


NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points that start at the given bytes."""
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (padded[at + j] for j in range(4))
    two = ((b0 & 0x1F) << 6) | (b1 & 0x3F)
    three = ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F)
    four = ((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)
    return np.select([b0 < 0x80, b0 < 0xE0, b0 < 0xF0], [b0, two, three], four)


@dataclass
class Words:
    """Words of a run of texts: document, byte range, script (0 without a letter), and trigram
    code per byte."""

    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    codes: np.ndarray


def split(column: pa.Array) -> Words:
    """Runs of letters and the marks on them; digits and signs of all scripts end a word."""
    data, offsets = kernel.raw(column)
    low = kernel.LOWER[data]
    # A byte that is no letter: ASCII signs and whole characters of blocks without letters.
    sign = NOT_LETTER[low]
    wide = np.flatnonzero(low >= 0xC0)
    points = _code_points(data, wide)
    kind = kinds()[points]
    script = BLOCK_SCRIPT[np.searchsorted(BLOCK_FIRST, points, side="right") - 1]
    # Letters outside the blocks still are letters, of no script that a language has.
    script = np.where(kind == 0, 0, np.where((script == 0) & (kind == LETTER), OTHER, script))
    for at in (wide[script == 0] + j for j in range(4)):
        at = at[at < len(low)]
        sign[at[(low[at] >= 0xC0) | (low[at] < 0x80)]] |= True
    tails = wide[script == 0]
    for j in range(1, 4):
        at = tails + j
        at = at[at < len(low)]
        tails = tails[: len(at)][(low[at] & 0xC0) == 0x80] if len(at) else tails[:0]
        sign[tails + j] = True
    clean = np.where(sign, np.uint8(0x20), low)
    doc, starts, ends = kernel.words(clean, offsets, kernel.SPACE)
    first = BLOCK_SCRIPT[np.searchsorted(BLOCK_FIRST, _code_points(clean, starts), side="right") - 1]
    first = np.where(first == 0, OTHER, first)
    letters = ~NOT_LETTER[low] & (low < 0x80)
    letters[wide] = kind == LETTER
    until = np.concatenate([[0], np.cumsum(letters)])
    first = np.where(until[ends] > until[starts], first, 0)
    padded = np.concatenate([[0x20], clean, [0x20]]).astype(np.uint32)
    heads = offsets[:-1][offsets[:-1] < len(clean)]
    codes = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:]
    if len(heads):
        # Neighbours across a document border count as spaces.
        codes[heads] = (np.uint32(0x20) << np.uint32(16)) | (codes[heads] & np.uint32(0xFFFF))
        lasts = offsets[1:][offsets[1:] > 0] - 1
        codes[lasts] = (codes[lasts] & np.uint32(0xFFFF00)) | np.uint32(0x20)
    codes = (codes * np.uint32(2_654_435_761)) >> np.uint32(32 - TABLE_BITS)
    return Words(doc, starts, ends, first, codes)


@dataclass
class Model:
    names: list[str]
    #: Log-likelihood per language and trigram code.
    table: np.ndarray
    #: Whether a language uses a script.
    uses: np.ndarray
    prior: int

    def word_scores(self, w: Words) -> np.ndarray:
        out = np.empty((len(w.doc), len(self.names)), np.float32)
        edges = np.stack([w.starts, w.ends], axis=1).ravel()
        trim = len(edges) and edges[-1] == len(w.codes)
        for k, row in enumerate(self.table):
            out[:, k] = np.add.reduceat(row[w.codes], edges[:-1] if trim else edges)[::2]
        out -= out.max(axis=1, keepdims=True)
        np.maximum(out, FLOOR, out=out)
        known = self.uses[:, w.script].T
        narrow = known.any(axis=1)
        out[narrow] = np.where(known[narrow], out[narrow], 4 * FLOOR)
        out[~narrow] = 0.0
        return out

    def paths(self, w: Words, docs: int) -> np.ndarray:
        """Language number of every word, by one Viterbi pass over all texts side by side."""
        score = self.word_scores(w)
        counts = np.bincount(w.doc, minlength=docs)
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        heads = (np.cumsum(counts) - counts)[order]
        length = counts[order]
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0))
        moved = np.zeros(score.shape, bool)
        source = np.zeros(len(score), np.int16)
        total = score[heads].copy() if len(heads) else score[:0]
        for t in range(1, len(active)):
            n = active[t]
            now, at = total[:n], heads[:n] + t
            top = now.argmax(axis=1)
            jump = now.max(axis=1, keepdims=True) - SWITCH
            move = jump > now
            moved[at], source[at] = move, top
            total[:n] = np.where(move, jump, now) + score[at]
        label = np.zeros(len(score), np.int16)
        state = total.argmax(axis=1).astype(np.int16) if len(heads) else label
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            at = heads[:n] + t
            label[at] = state[:n]
            if t:
                state[:n] = np.where(moved[at, state[:n]], source[at], state[:n])
        return label

    def predict(self, column: pa.Array, spans: bool = False):
        """Language and share per text, and spans of byte ranges if asked for."""
        docs = len(column)
        w = split(column)
        names, share, parts = [UNKNOWN] * docs, np.zeros(docs), [[] for _ in range(docs)]
        if not self.names:
            return names, share, parts
        real = w.script > 0
        w = Words(w.doc[real], w.starts[real], w.ends[real], w.script[real], w.codes)
        label = self.paths(w, docs)
        size = (w.ends - w.starts).astype(float)
        # Words of scripts that no language uses have no vote, but count in the whole.
        vote = np.where(self.uses.any(axis=0)[w.script], size, 0.0)
        cover = np.bincount(
            w.doc * len(self.names) + label, vote, minlength=docs * len(self.names)
        ).reshape(docs, -1)
        total = np.bincount(w.doc, size, minlength=docs)
        best = np.where(cover.any(axis=1), cover.argmax(axis=1), self.prior)
        for i in np.flatnonzero(total > 0):
            names[i] = self.names[best[i]]
        share = np.divide(cover.max(axis=1), total, out=share, where=total > 0)
        if spans and len(label):
            new = np.ones(len(label), bool)
            new[1:] = (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])
            heads = np.flatnonzero(new)
            _, offsets = kernel.raw(column)
            for a, b in zip(heads, [*heads[1:], len(label)], strict=True):
                i = int(w.doc[a])
                parts[i].append({
                    "start": int(w.starts[a] - offsets[i]), "stop": int(w.ends[b - 1] - offsets[i]),
                    "lang": self.names[label[a]],
                })
        return names, share, parts


def fit(texts: list[str | None], langs: list[str]) -> Model:
    """Trigram tables and scripts of the languages in a bounded sample."""
    names = sorted(set(langs))
    size = 1 << TABLE_BITS
    counts = np.zeros((len(names), size))
    scripts = np.zeros((len(names), SCRIPTS))
    number = np.array([names.index(x) for x in langs], np.int64)
    base = 0
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for part in slices(iter([batch] if names else []), "text", CHUNK_BYTES):
        w = split(part.column(0))
        real = w.script > 0
        own = number[base : base + part.num_rows][w.doc[real]]
        length = (w.ends - w.starts)[real]
        np.add.at(scripts, (own, w.script[real]), length)
        at = np.repeat(w.starts[real] - np.cumsum(length) + length, length) + np.arange(length.sum())
        np.add.at(counts, (np.repeat(own, length), w.codes[at]), 1)
        base += part.num_rows
    total = counts.sum(axis=1, keepdims=True)
    table = np.log((counts + 0.2) / (total + 0.2 * size)).astype(np.float32)
    uses = scripts >= 0.02 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    prior = int(np.bincount(number, minlength=len(names)).argmax()) if names else 0
    return Model(names, table, uses, prior)


def sample(docs: DataFrame, bound: int) -> DataFrame:
    """(text, lang) of at most ``bound`` documents per language, outside the held-out part."""
    known = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()
    )
    # A row per language, stored: its size is known, so no hint is needed to keep texts in place.
    counts = store(known.groupBy("lang").agg(F.count("*").alias("_n")), "language-counts")
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)
    # Thinned to the expected number first, so the window below sees a bounded table.
    thin = known.join(counts, "lang").where(
        h * F.col("_n") < F.lit(1.2 * bound * 2**31)
    )
    over = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    return thin.withColumn("_r", F.row_number().over(over)).where(F.col("_r") <= bound).select(
        "text", "lang"
    )


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(
        (r["lang"], r["text"]) for batch in batches for r in batch.to_pylist()
    )
    model = fit([t for _, t in rows], [x for x, _ in rows])
    yield pa.RecordBatch.from_arrays([
        pa.array([model.names], pa.list_(pa.string())),
        pa.array([model.table.tobytes()], pa.binary()),
        pa.array([model.uses.tobytes()], pa.binary()), pa.array([model.prior], pa.int32()),
    ], names=["names", "table", "uses", "prior"])


def train(docs: DataFrame, bound: int = SAMPLE) -> Model:
    row = sample(docs, bound).repartition(1).mapInArrow(
        _fit_task, "names array<string>, table binary, uses binary, prior int"
    ).first()
    if row is None:
        return fit([], [])
    names, table, uses, prior = row
    return Model(
        list(names), np.frombuffer(table, np.float32).reshape(len(names), -1),
        np.frombuffer(uses, bool).reshape(len(names), -1), prior,
    )


SPANS = ArrayType(StructType([
    StructField("start", IntegerType()), StructField("stop", IntegerType()),
    StructField("lang", StringType()),
]))


def labelled(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score and, if asked for, lang_spans (UTF-8 byte ranges)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    new += [StructField("lang_spans", SPANS)] if spans else []
    kept = [n for n in docs.columns if n not in {f.name for f in new}]
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            columns = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            text = batch.column(batch.schema.get_field_index("text"))
            names, share, parts = shared.value.predict(text, spans)
            columns += [pa.array(names, pa.string()), pa.array(share)]
            columns += [pa.array(parts, span)] if spans else []
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(f.name for f in new)])

    schema = StructType([f for f in docs.schema if f.name in kept] + new)
    return docs.select(*kept).mapInArrow(run, schema)

"""Benchmark decontamination with an FM-index per shard of training texts.

A shard is a run of documents inside one task (``SHARD_BYTES`` of text).  Only words that
occur in the benchmark can be part of a match, so each shard keeps the runs of such words
as its symbol sequence, builds suffix array, Burrows-Wheeler transform and wavelet matrix
over it, searches all test phrases backward at once, locates the rows of the found
intervals through sampled suffix positions, and merges the located ranges.

The benchmark goes to the tasks in blocks of ``BLOCK_BYTES`` of text; a larger benchmark
makes more passes, chained in the same stage, instead of a larger broadcast.  Nothing is
shuffled.

Defined cases: null and empty texts, and items without words, match nothing; an item with
fewer than ``window`` words is one phrase; repeated items and repeated documents are all
reported; input columns are kept, results go to the columns named in ``RESULT``, which
replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from scoremon.llm import kernel
from scoremon.llm.common import slices

SHARD_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20
SAMPLE_EVERY = 8

SPAN = StructType([StructField(n, IntegerType()) for n in ("first", "stop", "start", "end")])
RESULT = StructType([
    StructField("n_words", LongType()),
    StructField("hit_spans", ArrayType(SPAN)),
    StructField("hit_items", ArrayType(LongType())),
])


class FmIndex:
    """Backward search and locate over an integer sequence; symbols are 2 and up."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.text = text = np.concatenate([text.astype(np.int64), [0]])
        n = len(text)
        rank, step = text.copy(), 1
        while True:
            key = np.full(n, -1, np.int64)
            key[: n - step] = rank[step:] if step < n else 0
            code = rank * (max(n, symbols) + 2) + key + 1
            order = np.argsort(code, kind="stable")
            sorted_code = code[order]
            new = np.zeros(n, np.int64)
            new[1:] = sorted_code[1:] != sorted_code[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == n - 1 or step >= n:
                break
            step *= 2
        self.size = n
        last = text[order - 1]
        self.before = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=symbols), out=self.before[1:])
        # Wavelet matrix: one bit plane per level, with counts of zeros before each place.
        self.bits = max(1, int(symbols - 1).bit_length())
        self.zeros, self.split = [], []
        level = last
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1
            count = np.zeros(n + 1, np.int64)
            np.cumsum(1 - one, out=count[1:])
            self.zeros.append(count)
            self.split.append(int(count[-1]))
            level = np.concatenate([level[one == 0], level[one == 1]])
        self.last = last
        sampled = (order % SAMPLE_EVERY == 0) | (last == 0)
        self.sampled, self.where = sampled, np.where(sampled, order, 0)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the first ``place`` rows of the transform."""
        low, high = np.zeros_like(place), place
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1).astype(bool)
            zeros, split = self.zeros[level], self.split[level]
            low = np.where(one, split + low - zeros[low], zeros[low])
            high = np.where(one, split + high - zeros[high], zeros[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of phrases of one length."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, j]
            low[alive] = self.before[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to the next sampled suffix."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            symbol = self.last[rows[open_]]
            rows[open_] = self.before[symbol] + self.rank(symbol, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.where[rows] + steps


@dataclass
class Phrases:
    """Test phrases of one benchmark block, as symbols of its vocabulary."""

    vocabulary: np.ndarray
    by_length: dict[int, tuple[np.ndarray, list[list[int]]]]

    @staticmethod
    def of(items: list[tuple[int, str]], window: int) -> Phrases:
        data, offsets = kernel.raw(pa.array([t for _, t in items], pa.string()))
        data = kernel.LOWER[data]
        doc, starts, ends = kernel.words(data, offsets, kernel.PUNCTUATION)
        h = kernel.word_hashes(data, starts, ends)
        vocabulary = np.unique(h)
        symbol = np.searchsorted(vocabulary, h) + 2
        found: dict[tuple[int, ...], set[int]] = {}
        bounds = np.searchsorted(doc, np.arange(len(items) + 1))
        for i, (item, _) in enumerate(items):
            own = symbol[bounds[i] : bounds[i + 1]].tolist()
            if own:
                for j in range(max(1, len(own) - window + 1)):
                    found.setdefault(tuple(own[j : j + window]), set()).add(item)
        by_length: dict[int, tuple[list, list]] = {}
        for phrase, owners in found.items():
            group = by_length.setdefault(len(phrase), ([], []))
            group[0].append(phrase)
            group[1].append(sorted(owners))
        return Phrases(
            vocabulary,
            {m: (np.array(p, np.int64), o) for m, (p, o) in sorted(by_length.items())},
        )

    def occurrences(
        self, doc: np.ndarray, h: np.ndarray
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[list[int]]]]:
        """For each phrase length: word numbers where a phrase starts, and which one."""
        if not self.by_length or not len(h):
            return
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == h
        first = known.copy()
        first[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
        last = known.copy()
        last[:-1] &= ~known[1:] | (doc[1:] != doc[:-1])
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        long_ = stops - starts >= min(self.by_length)
        starts, stops = starts[long_], stops[long_]
        if not len(starts):
            return
        # Every kept run, followed by the separator 1.
        size = stops - starts + 1
        heads = np.cumsum(size) - size
        place = np.repeat(starts - heads, size) + np.arange(size.sum())
        text = np.ones(len(place), np.int64)
        body = np.ones(len(place), bool)
        body[heads + size - 1] = False
        text[body] = at[place[body]] + 2
        index = FmIndex(text, len(self.vocabulary) + 2)
        for m, (phrases, owners) in self.by_length.items():
            low, high = index.search(phrases)
            count = high - low
            if count.sum():
                rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                which = np.repeat(np.arange(len(phrases)), count)
                yield m, place[index.locate(rows)], which, owners


def _pass(phrases: Phrases, names: list[str], first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD_BYTES):
            data, offsets = kernel.raw(batch.column(batch.schema.get_field_index("text")))
            data = kernel.LOWER[data]
            doc, starts, ends = kernel.words(data, offsets, kernel.PUNCTUATION)
            h = kernel.word_hashes(data, starts, ends)
            docs = batch.num_rows
            counts = np.bincount(doc, minlength=docs)
            heads = np.cumsum(counts) - counts
            spans: list = [[] for _ in range(docs)]
            items: list = [set() for _ in range(docs)]
            if not first:
                for i, (s, it) in enumerate(zip(
                    batch.column(batch.schema.get_field_index("hit_spans")).to_pylist(),
                    batch.column(batch.schema.get_field_index("hit_items")).to_pylist(),
                    strict=True,
                )):
                    spans[i] += [(x["first"], x["stop"]) for x in s]
                    items[i].update(it)
            for m, at, which, owners in phrases.occurrences(doc, h):
                own = doc[at]
                local = at - heads[own]
                for pair in set(zip(own.tolist(), which.tolist(), strict=True)):
                    items[pair[0]].update(owners[pair[1]])
                order = np.argsort(own, kind="stable")
                own, local = own[order], local[order]
                edges = np.flatnonzero(np.diff(own, prepend=-1))
                for a, b in zip(edges, [*edges[1:], len(own)], strict=True):
                    i = int(own[a])
                    spans[i] += kernel.spans_in_order(
                        int(counts[i]), local[a:b], local[a:b] + m
                    )
            merged = []
            for i, s in enumerate(spans):
                if len(s) > 1:
                    x = np.array(s, np.int64)
                    s = kernel.spans_in_order(int(counts[i]), x[:, 0], x[:, 1])
                head, base = heads[i], offsets[i]
                merged.append([
                    {"first": a, "stop": b, "start": starts[head + a] - base, "end": ends[head + b - 1] - base}
                    for a, b in s
                ])
            span = pa.list_(pa.struct([(n, pa.int32()) for n in SPAN.names]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names]
                + [
                    pa.array(counts, pa.int64()),
                    pa.array(merged, span),
                    pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                ],
                names=[*names, *RESULT.names],
            )

    return run


def find(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with the words of ``text`` that stand in a phrase of ``items``.

    ``items`` has ``item_id`` and ``text``.  Adds ``n_words``, ``hit_spans`` (word number
    ranges, merged, with the bytes from the first word's start to the last one's end) and
    ``hit_items`` (sorted).
    """
    kept = [n for n in docs.columns if n not in RESULT.names]
    size, n = items.where("item_id IS NOT NULL AND text IS NOT NULL").agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")
    ).first()
    blocks = -(-size // BLOCK_BYTES) or 1
    out = docs.select(*kept)
    for b in range(blocks):
        rows = (
            items.where("item_id IS NOT NULL AND text IS NOT NULL")
            .where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
            .select("item_id", "text").collect()
        )
        phrases = Phrases.of([(r[0], r[1]) for r in rows], window)
        schema = StructType([f for f in out.schema if f.name in kept] + RESULT.fields)
        out = out.mapInArrow(_pass(phrases, kept, b == 0), schema)
    return out


def n_hit(spans: str = "hit_spans") -> F.Column:
    return F.aggregate(
        spans, F.lit(0).cast("long"), lambda t, s: t + (s["stop"] - s["first"])
    )


def _between(text: str, spans: str) -> F.Column:
    """What stands before, between and after the byte ranges of ``spans``; each byte is copied once."""

    def joined(data: F.Column) -> F.Column:
        before = F.transform(spans, lambda s, i: F.substring(
            data, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0) + 1,
            s["start"] - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0),
        ).cast("string"))
        last = F.element_at(spans, -1)["end"]
        after = F.substring(data, last + 1, F.octet_length(data) - last).cast("string")
        return F.array_join(F.concat(before, F.array(after)), "")

    # A lambda variable: the bytes of the text are taken once, not once a span.
    return F.transform(F.array(F.col(text).cast("binary")), joined)[0]


def remove(found: DataFrame) -> DataFrame:
    """Result of ``find`` without its hit words; a text with nothing left but space goes.

    The bytes from the first to the last word of each span are cut out of the text, by
    Spark's own functions: a second Arrow function would run a second worker beside ``find``'s.
    """
    kept = [n for n in found.columns if n not in RESULT.names]
    text = F.when(F.size("hit_spans") > 0, _between("text", "hit_spans")).otherwise(F.col("text"))
    left = (n_hit() == 0) | F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    return found.withColumn("text", text).where(left).select(*kept)

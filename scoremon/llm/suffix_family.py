"""Exact repeated byte strings by a logarithmic family of sparse suffix arrays.

A suffix of a text is indexed where the hash of its first ``GRAM`` bytes is the least among
the starts of some ``length``-byte window, so every window holds exactly one indexed suffix,
the same one wherever the window's bytes occur.  One entry stands for the run of windows of
one suffix: the suffix key, and the hash of the bytes that the run covers.

Entries are dealt out by key.  Inside a part, documents arrive in batches of ascending ids.
A batch's entries are sorted, merge-scanned against the levels of the family for runs that
are already there (then all their windows repeat a smaller document), and become a new
level; levels of like size merge, so there are logarithmically many.  What is left are
suffixes that several documents share with different surroundings: the ends of matches.
For these the bytes of the runs themselves are compared window by window.  A suffix in very
many documents has its windows dealt out one by one, so that no part meets them all; copies
inside one chunk of texts are settled before anything is sent.

Passes over the texts: entries, surroundings of shared suffixes, removal.  Everything sent
is packed in arrays, and all three passes are stateless per document.

Defined cases: null reads as empty; texts shorter than ``length`` bytes and rows without
doc_id neither lose bytes nor give any; rows of one doc_id do not count as earlier for each
other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremon.llm import kernel
from scoremon.llm.common import release, slices, slots, store

LENGTH = 50
GRAM = 20
CHUNK_BYTES = 3 << 20
#: Longer texts are looked at in pieces of this many windows.
PIECE = 8 << 20
BATCHES = 8
#: A suffix with more different surroundings than this in a part or chunk is a hot one.
HOT = 256
HOT_IN_CHUNK = 16
PLACE = np.uint64((1 << 24) - 1)
U = np.uint64


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Entries of texts: document number, number in it, first window, windows, key, run hash."""
    if (np.diff(offsets) > PIECE + length).any():
        # Long texts go in pieces, cut alike whatever else is in the chunk.
        cuts = [
            (i, s, min(s + PIECE + length - 1, int(b)))
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))
            for s in range(int(a), int(b) - length + 1, PIECE)
        ]
        parts = [_short_runs(data[s:e], np.array([0, e - s]), length) for _, s, e in cuts]
        first, count, key, run = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
        sizes = [len(p[0]) for p in parts]
        doc = np.repeat([i for i, _, _ in cuts], sizes)
        first = first + np.repeat([s for _, s, _ in cuts], sizes)
    else:
        doc, first, count, key, run = _short_runs(data, offsets, length)
    return doc, np.arange(len(doc)) - np.searchsorted(doc, doc), first, count, key, run


def _short_runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """Document number, first window, windows, key and run hash of every entry."""
    n = len(data)
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    if not windows.sum():
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U), z.astype(U)
    sums = kernel.prefix_sums(data)
    _, down = kernel.powers(n + 1)
    gram = kernel.mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    least = (gram & ~PLACE) | np.arange(len(gram), dtype=U)
    span, width = 1, length - GRAM + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    # All windows that lie inside one text.
    doc = np.repeat(np.arange(len(windows)), windows)
    at = np.repeat(offsets[:-1] - np.cumsum(windows) + windows, windows) + np.arange(len(doc))
    place = (least[at] & PLACE).astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    count = np.diff(heads, append=len(doc))
    doc, first = doc[heads], at[heads]
    run = kernel.range_hash(sums, first, first + count - 1 + length)
    return doc, first, count, gram[place[heads]], run


# --- entries, packed -------------------------------------------------------------------


def _packed(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64)
    kinds = "".join(f"{x.dtype.str[1:]:4}" for x in arrays).encode()
    return b"".join([head.tobytes(), kinds, *(x.tobytes() for x in arrays)])


def _unpacked(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    at = 8 + 8 * n
    kinds = [blob[at + 4 * i : at + 4 * i + 4].decode().strip() for i in range(n)]
    at += 4 * n
    out = []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, np.dtype(kind), size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _slim(x: np.ndarray) -> list[np.ndarray]:
    """Integers as a base and small differences."""
    base = int(x.min()) if len(x) else 0
    wide = int(x.max()) - base if len(x) else 0
    kind = np.uint16 if wide < 1 << 16 else np.uint32 if wide < 1 << 32 else np.uint64
    return [np.array([base], np.int64), (x - base).astype(kind)]


def _wide(base: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) + base[0]


#: A reply: entry ``number`` of row ``rid`` repeats wholly (0), is shared (1) or hot (2).
REPLY = "rid long, number int, kind byte"


def _entries(parts: int, bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            rid, ids, text = (batch.column(batch.schema.get_field_index(n)) for n in ("rid", "doc_id", "text"))
            doc, number, _, _, key, z = runs(*kernel.raw(text))
            rid, ids = rid.to_numpy()[doc], ids.to_numpy()[doc]
            key, z = (key >> U(16)).astype(np.int64), (z >> U(24)).astype(np.int64)
            # Settle copies inside the chunk: only the smallest document of a run goes on.
            order = np.lexsort((ids, z, key))
            rid, ids, number, key, z = rid[order], ids[order], number[order], key[order], z[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (z[1:] != z[:-1])
            low = ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else ids
            copy = ~new & (ids > low)
            kept = new
            again = ~new & ~copy  # another row or place of the same document
            kept = kept | again
            kind = np.where(copy, 0, -1).astype(np.int8)
            # A key with very many surroundings is settled as hot here, with one mark sent on.
            keys, start, count = np.unique(key[kept], return_index=True, return_counts=True)
            several = np.zeros(len(keys), bool)
            if len(keys):
                own = ids[kept]
                several = np.maximum.reduceat(own, start) > np.minimum.reduceat(own, start)
            hot = keys[(count > HOT_IN_CHUNK) & several]
            at = np.searchsorted(hot, key)
            at[at == len(hot)] = 0
            is_hot = kept & (hot[at] == key) if len(hot) else np.zeros(len(key), bool)
            kind[is_hot] = 2
            send = np.flatnonzero(kind < 0)
            done = np.flatnonzero(kind >= 0)
            batch_no = np.searchsorted(edges, ids[send], side="right")
            cell = key[send] % parts * (BATCHES + 1) + batch_no
            by = np.argsort(cell, kind="stable")
            send, cell = send[by], cell[by]
            heads = np.flatnonzero(np.diff(cell, prepend=-1))
            part, no, blob = [], [], []
            for a, b in zip(heads, [*heads[1:], len(cell)], strict=True):
                s = send[a:b]
                part.append(int(cell[a]) // (BATCHES + 1))
                no.append(int(cell[a]) % (BATCHES + 1))
                same = bool((rid[s] == ids[s]).all())
                blob.append(_packed([
                    (key[s] & 0xFFFFFFFF).astype(np.uint32), (key[s] >> 32).astype(np.uint16),
                    (z[s] & 0xFFFFFFFF).astype(np.uint32), (z[s] >> 32).astype(np.uint8),
                    *_slim(ids[s]), *_slim(number[s]), *([] if same else [rid[s]]),
                ]))
            for k in hot.tolist():
                part.append(k % parts)
                no.append(BATCHES + 1)
                blob.append(_packed([np.array([k], np.int64)]))
            for a in range(0, len(done), 50_000):
                s = done[a : a + 50_000]
                part.append(int(rid[s[0]] % parts))
                no.append(BATCHES + 2)
                blob.append(_packed([rid[s], number[s].astype(np.int32), kind[s]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(no, pa.int32()), pa.array(blob, pa.binary())],
                names=["part", "batch", "blob"],
            )

    return run


class Family:
    """Levels of sorted run codes; the sizes of neighbouring levels differ by a factor."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def scan(self, codes: np.ndarray) -> np.ndarray:
        """Which codes some level holds."""
        found = np.zeros(len(codes), bool)
        for level in self.levels:
            at = np.searchsorted(level, codes)
            at[at == len(level)] = 0
            found |= level[at] == codes
        return found

    def add(self, codes: np.ndarray) -> None:
        """A new level of sorted codes; the last two merge while they are of like size."""
        self.levels.append(codes)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = np.sort(np.concatenate([self.levels[-1], last]), kind="stable")


def _settle(batches: dict[int, list[bytes]], hot: set[int]) -> tuple[np.ndarray, ...]:
    """Replies about the entries of one part."""
    family = Family()
    out = []
    for no in sorted(batches):
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for blob in batches[no]:
            a, b, c, d, ids0, ids1, n0, n1, *rid = _unpacked(blob)
            ids = _wide(ids0, ids1)
            for column, x in zip(columns, (
                a.astype(np.int64) | (b.astype(np.int64) << 32),
                c.astype(np.int64) | (d.astype(np.int64) << 32),
                ids, _wide(n0, n1), rid[0] if rid else ids,
            ), strict=True):
                column.append(x)
        key, z, ids, number, rid = (np.concatenate(x) for x in columns)
        code = kernel.mix(key.view(U) * kernel.WEIGHTS[50] + z.view(U) * kernel.WEIGHTS[51])
        order = np.lexsort((ids, code))
        key, ids, number, rid, code = key[order], ids[order], number[order], rid[order], code[order]
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        low = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        copy = family.scan(code) | (ids > low)
        family.add(code[new])
        out.append((key, ids, number, rid, code, copy))
    key, ids, number, rid, code, copy = (np.concatenate(x) for x in zip(*out, strict=True))
    kind = np.full(len(key), -1, np.int8)
    kind[copy] = 0
    # Suffixes with different surroundings in several documents.
    rest = np.flatnonzero(~copy)
    rest = rest[np.argsort(key[rest], kind="stable")]
    keys, start, count = np.unique(key[rest], return_index=True, return_counts=True)
    if len(keys):
        own, codes = ids[rest], code[rest]
        several = np.maximum.reduceat(own, start) > np.minimum.reduceat(own, start)
        differ = np.maximum.reduceat(codes, start) > np.minimum.reduceat(codes, start)
        marked = np.isin(keys, np.array(sorted(hot), np.int64)) if hot else np.zeros(len(keys), bool)
        label = np.where(marked | (several & differ & (count > HOT)), 2, np.where(several & differ, 1, -1))
        kind[rest] = np.repeat(label, count)
    told = kind >= 0
    return rid[told], number[told], kind[told]


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by part: replies for every part in turn."""
    now, by_batch, hot = None, {}, set()

    def reply(rid, number, kind):
        return pa.RecordBatch.from_arrays(
            [pa.array(rid), pa.array(number.astype(np.int32)), pa.array(kind)], names=["rid", "number", "kind"]
        )

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for part, no, blob in rows():
        if part != now:
            if by_batch:
                yield reply(*_settle(by_batch, hot))
            now, by_batch, hot = part, {}, set()
        if no == BATCHES + 2:
            yield reply(*_unpacked(blob))
        elif no == BATCHES + 1:
            hot.update(_unpacked(blob)[0].tolist())
        else:
            by_batch.setdefault(no, []).append(blob)
    if by_batch:
        yield reply(*_settle(by_batch, hot))


# --- surroundings of shared suffixes ---------------------------------------------------


def _surroundings(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            rid, ids, text, asked = (
                batch.column(batch.schema.get_field_index(n)) for n in ("rid", "doc_id", "text", "asked")
            )
            data, offsets = kernel.raw(text)
            doc, number, first, count, key, _ = runs(data, offsets, length)
            heads = np.searchsorted(doc, np.arange(batch.num_rows))
            sizes = np.diff(asked.offsets.to_numpy())
            want = asked.flatten().to_numpy()
            at = heads[np.repeat(np.arange(batch.num_rows), sizes)] + (want >> 1)
            hot = (want & 1).astype(bool)
            # Hot runs go window by window, each by the hash of its own bytes.
            cold, wide = at[~hot], at[hot]
            each = np.repeat(wide, count[wide])
            step = np.arange(len(each)) - np.repeat(np.cumsum(count[wide]) - count[wide], count[wide])
            entry = np.concatenate([cold, each])
            shift = np.concatenate([np.zeros(len(cold), np.int64), step])
            n = np.concatenate([count[cold], np.ones(len(each), np.int64)])
            start = first[entry] + shift
            if not len(entry):
                continue
            hashed = kernel.range_hash(kernel.prefix_sums(data), start, start + length)
            to = np.where(np.arange(len(entry)) < len(cold), key[entry], hashed)
            part = (to % U(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            rid, ids = rid.to_numpy(), ids.to_numpy()
            edges = np.flatnonzero(np.diff(part[by], prepend=-1))
            out = []
            for a, b in zip(edges, [*edges[1:], len(by)], strict=True):
                s = by[a:b]
                d, size = doc[entry[s]], n[s] + length - 1
                where = np.repeat(start[s] - np.cumsum(size) + size, size) + np.arange(size.sum())
                out.append((int(part[s[0]]), _packed([
                    *_slim(ids[d]), *_slim(number[entry[s]]), shift[s].astype(np.uint8), n[s].astype(np.uint8),
                    data[where], *([] if (rid[d] == ids[d]).all() else [rid[d]]),
                ])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())],
                names=["part", "blob"],
            )

    return run


def _judge(blobs: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Masks of the windows of shared runs that a smaller document has too."""
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    hashes = []
    for blob in blobs:
        ids0, ids1, n0, n1, shift, n, data, *rid = _unpacked(blob)
        ids, n = _wide(ids0, ids1), n.astype(np.int64)
        size = n + length - 1
        sums = kernel.prefix_sums(data)
        start = np.repeat(np.cumsum(size) - size - np.cumsum(n) + n, n) + np.arange(n.sum())
        hashes.append(kernel.range_hash(sums, start, start + length))
        for column, x in zip(
            columns, (ids, _wide(n0, n1), shift.astype(np.int64), n, rid[0] if rid else ids), strict=False
        ):
            column.append(x)
    ids, number, shift, n, rid = (np.concatenate(x) for x in columns[:5])
    h = np.concatenate(hashes)
    entry = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((ids[entry], h))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    own = ids[entry[order]]
    low = own[np.flatnonzero(new)][np.cumsum(new) - 1]
    twin = np.zeros(len(h), bool)
    twin[order] = own > low
    bit = shift[entry] + np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    mask = np.bincount(entry, np.where(twin, 2.0**bit, 0.0), minlength=len(n)).astype(np.int64)
    some = np.flatnonzero(mask)
    return rid[some], number[some], mask[some]


def _judged(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []

        def reply():
            rid, number, mask = _judge(blobs, length)
            return pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(number.astype(np.int32)), pa.array(mask)], names=["rid", "number", "mask"]
            )

        for batch in batches:
            for part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and blobs:
                    yield reply()
                    blobs = []
                now = part
                blobs.append(blob)
        if blobs:
            yield reply()

    return run


# --- removal ---------------------------------------------------------------------------

FOUND = "doc_id long, n_bytes long, spans array<struct<start: int, stop: int>>, kept binary, kept_sha256 string"


def _removal(length: int, with_bytes: bool):
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            ids, text, numbers, masks = (
                batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "text", "numbers", "masks")
            )
            data, offsets = kernel.raw(text)
            doc, _, first, count, _, _ = runs(data, offsets, length)
            heads = np.searchsorted(doc, np.arange(batch.num_rows))
            rows, numbers, masks = numbers.to_pylist(), None, masks.to_pylist()
            spans, kept, digests = [], [], []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                parts: list[tuple[int, int]] = []
                if rows[i]:
                    at = heads[i] + np.array(rows[i])
                    mask = np.array(masks[i], np.int64)
                    n = count[at]
                    bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yes = ((np.repeat(mask, n) >> bit) & 1).astype(bool)
                    start = (np.repeat(first[at], n) + bit)[yes] - offsets[i]
                    parts = kernel.spans_in_order(len(own), start, start + length)
                keep, last = [], 0
                for a, b in parts:
                    keep.append(own[last:a].tobytes())
                    last = b
                keep.append(own[last:].tobytes())
                left = b"".join(keep)
                spans.append([{"start": a, "stop": b} for a, b in parts])
                kept.append(left if with_bytes else None)
                digests.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.diff(offsets)), pa.array(spans, span), pa.array(kept, pa.binary()),
                pa.array(digests, pa.string()),
            ], names=["doc_id", "n_bytes", "spans", "kept", "kept_sha256"])

    return run


def repeated(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans, kept and kept_sha256 of every row of ``docs`` (doc_id, text).

    ``spans`` are the byte ranges covered by ``length``-byte strings that start in a document
    with a smaller doc_id too; ``kept`` are the other bytes (null unless asked for).
    """
    spark = docs.sparkSession
    known = docs.where("doc_id IS NOT NULL")
    n, distinct, bounds = known.agg(
        F.count("*"), F.approx_count_distinct("doc_id"),
        F.percentile_approx("doc_id", [i / BATCHES for i in range(1, BATCHES)], 10_000),
    ).first()
    twice = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
    # Rows are told apart by doc_id, or where ids repeat by a hash over id and text.
    rid = F.xxhash64("doc_id", "text") if twice else F.coalesce("doc_id", F.lit(-1).cast("long"))
    rows = docs.select(rid.alias("rid"), "doc_id", "text")
    parts = 4 * slots(spark)
    usable = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    replies = store(
        usable.mapInArrow(_entries(parts, sorted(set(bounds or []))), "part int, batch int, blob binary")
        .repartition(parts, "part").sortWithinPartitions("part", "batch")
        .mapInArrow(_replies, REPLY),
        "suffix-replies",
    )
    release(spark)
    asked = replies.where("kind > 0").groupBy("rid").agg(
        F.sort_array(F.collect_set(F.col("number") * 2 + (F.col("kind") - 1).cast("int"))).alias("asked")
    )
    judged = store(
        usable.join(asked, "rid").select("rid", "doc_id", "text", "asked")
        .mapInArrow(_surroundings(parts, length), "part int, blob binary")
        .repartition(parts, "part").sortWithinPartitions("part")
        .mapInArrow(_judged(length), "rid long, number int, mask long"),
        "suffix-masks",
    )
    release(spark)
    whole = replies.where("kind = 0").select("rid", "number", F.lit(-1).cast("long").alias("mask"))
    marks = whole.union(judged).groupBy("rid").agg(
        F.collect_set(F.struct("number", "mask")).alias("m")
    ).select("rid", F.col("m.number").alias("numbers"), F.col("m.mask").alias("masks"))
    return rows.join(marks, "rid", "left").select("doc_id", "text", "numbers", "masks").mapInArrow(
        _removal(length, with_bytes), FOUND
    )

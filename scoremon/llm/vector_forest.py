"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Equal vectors of a label become one node first.  Each label gets ``TREES`` trees: a node of
a tree projects its vectors on a random direction and cuts them in two, and vectors within
half the reach of the cut go to both sides.  The reach is a distance: ``REACH`` times the
root mean square of the projected gap of a pair at the threshold.  The cut is where the two
sides have the fewest pairs to compare; where no direction of ``TRIES`` leaves at most
``WORTH`` of them, as inside a dense cluster, the node stays a leaf of any size.  The trees
are fitted in one task on a bounded sample (``SAMPLE`` nodes), but deep enough for the whole
table: a leaf is also done when it stands for at most ``LEAF`` nodes of it.

All nodes are then routed into leaves, compared inside them in double precision, and links
at or above the threshold are counted.  Leaves of more than ``PIECE`` nodes are dealt into
pieces by a hash, and every pair of pieces is a task of its own, so no leaf is too large.  A
label that some tree does not cut is compared as a whole, without the other trees.

Every link is counted once: where two nodes share a leaf of an earlier tree, or an earlier
leaf of the same tree, that leaf counts it.  So leaves give sums per node and one edge per
node and component, never their pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers, and
vectors without a label, link with nothing; vectors of different length do not link; every
row is a vector, also repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremon.llm.common import components, cut, store

TREES = 8
LEAF = 512
#: Width of the overlap around a cut, in root mean squares of the gap of a pair at the threshold.
REACH = 1.0
#: Directions that are tried for a cut, and the most that a cut may leave of the pairs to compare.
TRIES = 4
WORTH = 0.85
#: Bound of the sample of nodes that the trees are fitted on.
SAMPLE = 16_384
#: Nodes of a leaf that one task compares; larger leaves are dealt out in pieces.
PIECE = 1024
#: Bound of the pieces of very large leaves.
MOST_PIECE = 8192
#: Rows that one step of a comparison looks at together.
BLOCK = 1024


def _pack(dtype: str):
    """Embedding as bytes, null where it can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, label = (
                batch.column(batch.schema.get_field_index(n)) for n in ("vec_id", "embedding", "label")
            )
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            flat = column.flatten()
            bad = flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)
            wide = values.astype(float)
            bad |= ~np.isfinite(wide)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            bads = np.concatenate([[0], np.cumsum(bad)])
            squares = np.concatenate([[0.0], np.cumsum(np.where(bad, 0.0, wide != 0))])
            usable = (
                (bads[ends[1:]] == bads[ends[:-1]]) & (squares[ends[1:]] > squares[ends[:-1]])
                & ~label.is_null().to_numpy(zero_copy_only=False)
            )
            data = values.tobytes()
            width = values.itemsize
            packed = [
                data[a * width : b * width] if u else None
                for a, b, u in zip(ends[:-1].tolist(), ends[1:].tolist(), usable.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [ids, label, pa.array(packed, pa.binary())], names=["vec_id", "label", "v"]
            )

    return run


def direction(label: int, tree: int, place: int, width: int, attempt: int) -> np.ndarray:
    """Random unit direction of one tree node, the same wherever it is asked for."""
    out = np.random.default_rng([label & 0xFFFFFFFF, tree, place, width, attempt]).normal(size=width)
    return out / np.sqrt(out @ out)


def _cut(p: np.ndarray, reach: float) -> tuple[float, float, float]:
    """(share of pairs left, lower, upper) of the overlap with the fewest pairs on its sides."""
    p = np.sort(p)
    at = np.quantile(p, np.linspace(0.2, 0.8, 61))
    lower, upper = at - reach / 2, at + reach / 2
    left = np.searchsorted(p, upper, side="right") / len(p)
    right = 1 - np.searchsorted(p, lower, side="left") / len(p)
    pairs = left * left + right * right
    k = int(pairs.argmin())
    return float(pairs[k]), float(lower[k]), float(upper[k])


class Tree:
    """Splits of one tree: place -> (attempt, lower, upper): direction and bounds of the overlap.

    The children of place p are 2p+1 and 2p+2.
    """

    def __init__(self, label: int, tree: int, width: int, splits: dict[int, tuple[int, float, float]]):
        self.label, self.tree, self.width, self.splits = label, tree, width, splits

    @staticmethod
    def fit(label: int, tree: int, x: np.ndarray, weight: float, threshold: float) -> Tree:
        width = x.shape[1]
        out = Tree(label, tree, width, {})
        # Unit vectors at the threshold are sqrt(2 - 2 * threshold) apart.
        reach = np.sqrt(max(2 - 2 * threshold, 0)) * min(1.0, REACH / np.sqrt(width))
        todo = [(0, np.arange(len(x)))]
        while todo:
            place, rows = todo.pop()
            if len(rows) * weight <= LEAF or len(rows) < 8 or place > 1 << 40:
                continue
            for attempt in range(TRIES):
                p = x[rows] @ direction(label, tree, place, width, attempt)
                pairs, lower, upper = _cut(p, reach)
                if pairs <= WORTH:
                    out.splits[place] = (attempt, lower, upper)
                    todo += [(2 * place + 1, rows[p <= upper]), (2 * place + 2, rows[p >= lower])]
                    break
        return out

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row belongs to."""
        rows_out, leaf_out, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            place, rows = todo.pop()
            if place not in self.splits or not len(rows):
                rows_out.append(rows)
                leaf_out.append(np.full(len(rows), place, np.int64))
                continue
            attempt, lower, upper = self.splits[place]
            p = x[rows] @ direction(self.label, self.tree, place, self.width, attempt)
            todo += [(2 * place + 1, rows[p <= upper]), (2 * place + 2, rows[p >= lower])]
        return np.concatenate(rows_out), np.concatenate(leaf_out)


def _unit(packed: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), dtype).reshape(len(packed), -1).astype(float)
    # Scaled first, so that no square over- or underflows.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_shape(labels: list[int], packed: list[bytes]) -> dict[tuple[int, int], list[int]]:
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (label, v) in enumerate(zip(labels, packed, strict=True)):
        groups.setdefault((label, len(v)), []).append(i)
    return groups


def _fit_task(dtype: str, weight: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            (r["label"], r["node"], r["v"]) for batch in batches for r in batch.to_pylist()
        )
        labels, packed = [r[0] for r in rows], [r[2] for r in rows]
        out = []
        for (label, size), own in _by_shape(labels, packed).items():
            x = _unit([packed[i] for i in own], dtype)
            for t in range(TREES):
                for place, split in Tree.fit(label, t, x, weight, threshold).splits.items():
                    out.append((label, size, t, place, *split))
        names = ["label", "size", "tree", "place", "attempt", "lower", "upper"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names
        )

    return run


Trees = dict[tuple[int, int], list[Tree]]


def fit(nodes: DataFrame, dtype: str, threshold: float) -> Trees:
    """Trees per (label, vector bytes); at most a few splits per sampled node come back.

    Left out are labels that a tree does not cut: one leaf holds all their pairs.
    """
    n = nodes.count()
    share = min(1.0, SAMPLE / max(n, 1))
    h = F.shiftrightunsigned(F.xxhash64("node"), 33)
    rows = (
        nodes.where(h < F.lit(int(share * 2**31))).select("label", "node", "v")
        .orderBy(F.xxhash64("node"), "node").limit(SAMPLE).repartition(1)
        .mapInArrow(
            _fit_task(dtype, 1 / share, threshold),
            "label long, size int, tree int, place long, attempt int, lower double, upper double",
        ).collect()
    )
    width = np.dtype(dtype).itemsize
    splits: dict[tuple[int, int], list[dict]] = {}
    for label, size, t, place, *split in rows:
        splits.setdefault((label, size), [{} for _ in range(TREES)])[t][place] = tuple(split)
    return {
        (label, size): [Tree(label, t, size // width, s) for t, s in enumerate(by)]
        for (label, size), by in splits.items() if all(by)
    }


def _trees_of(trees: Trees, label: int, size: int, dtype: str) -> list[Tree]:
    return trees.get((label, size)) or [Tree(label, 0, size // np.dtype(dtype).itemsize, {})]


def _count_leaves(shared, dtype: str):
    """Nodes of each leaf within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, packed = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("label", "v"))
            for (label, size), own in _by_shape(labels, packed).items():
                x = _unit([packed[i] for i in own], dtype)
                for t, tree in enumerate(_trees_of(shared.value, label, size, dtype)):
                    leaf, n = np.unique(tree.leaves(x)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([label] * len(leaf), pa.int64()), pa.array([size] * len(leaf), pa.int32()),
                        pa.array([t] * len(leaf), pa.int32()), pa.array(leaf), pa.array(n.astype(np.int64)),
                    ], names=["label", "size", "tree", "leaf", "n"])

    return run


def large_leaves(nodes: DataFrame, shared, dtype: str) -> dict[tuple[int, int, int, int], int]:
    """Number of pieces of every leaf of more than ``PIECE`` nodes; no more than the trees have leaves."""
    rows = (
        nodes.select("label", "v")
        .mapInArrow(_count_leaves(shared, dtype), "label long, size int, tree int, leaf long, n long")
        .groupBy("label", "size", "tree", "leaf").agg(F.sum("n").alias("n")).where(F.col("n") > PIECE).collect()
    )
    return {tuple(r[:4]): -(-r.n // min(max(PIECE, r.n // 32), max(PIECE, MOST_PIECE))) for r in rows}


ROUTED = (
    "label long, size int, tree int, leaf long, piece int, other int, first boolean, "
    "node long, copies long, v binary, others binary"
)
#: Rows of one batch of routed nodes.
ROUTED_ROWS = 8192


def _route(shared, large, dtype: str):
    """One row per node, leaf and pair of pieces, with the leaves of all trees (padded) beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label_, v_, node_, copies_ = (
                batch.column(batch.schema.get_field_index(n)) for n in ("label", "v", "node", "copies")
            )
            packed, mixed = v_.to_pylist(), node_.to_numpy().astype(np.uint64)
            mixed = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for (label, size), own in _by_shape(label_.to_pylist(), packed).items():
                x, own = _unit([packed[i] for i in own], dtype), np.array(own)
                trees = _trees_of(shared.value, label, size, dtype)
                found = [t.leaves(x) for t in trees]
                most = max(int(np.bincount(r).max()) for r, _ in found)
                table = np.full((len(own), len(trees), most), -1, np.int64)
                for t, (row, leaf) in enumerate(found):
                    order = np.argsort(row, kind="stable")
                    row, leaf = row[order], leaf[order]
                    first = np.searchsorted(row, np.arange(len(own)))
                    table[row, t, np.arange(len(row)) - first[row]] = leaf
                head = np.array([len(trees), most], np.int64).tobytes()
                others = pa.array([head + table[i].tobytes() for i in range(len(own))], pa.binary())
                for t, (row, leaf) in enumerate(found):
                    ids, at = np.unique(leaf, return_inverse=True)
                    pieces = np.array([large.value.get((label, size, t, k), 1) for k in ids.tolist()])[at]
                    mine = (mixed[own[row]] % pieces.astype(np.uint64)).astype(np.int64)
                    ends = np.cumsum(pieces)
                    for c in range(0, int(ends[-1]), ROUTED_ROWS):
                        out = np.arange(c, min(c + ROUTED_ROWS, int(ends[-1])))
                        k = np.searchsorted(ends, out, side="right")
                        other = out - (ends[k] - pieces[k])
                        pick, n = own[row[k]], len(out)
                        yield pa.RecordBatch.from_arrays([
                            pa.array([label] * n, pa.int64()), pa.array([size] * n, pa.int32()),
                            pa.array([t] * n, pa.int32()), pa.array(leaf[k]),
                            pa.array(np.minimum(mine[k], other).astype(np.int32)),
                            pa.array(np.maximum(mine[k], other).astype(np.int32)),
                            pa.array(mine[k] <= other), node_.take(pa.array(pick)), copies_.take(pa.array(pick)),
                            v_.take(pa.array(pick)), others.take(pa.array(row[k])),
                        ], names=[f.split()[0] for f in ROUTED.split(", ")])

    return run


def _first_meeting(table: np.ndarray, a: np.ndarray, b: np.ndarray, tree: int, leaf: int) -> np.ndarray:
    """Whether (tree, leaf) is the first leaf that rows a and b share."""
    out = np.ones(len(a), bool)
    for t in range(tree + 1):
        x, y = table[a, t], table[b, t]
        common = (x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)
        if t < tree:
            out &= ~common.any(axis=(1, 2))
        else:
            least = np.where(common.any(axis=2), x, np.iinfo(np.int64).max).min(axis=1)
            out &= least == leaf
    return out


def _met_before(table: np.ndarray, a: slice, b: slice, tree: int, leaf: int) -> np.ndarray:
    """Opposite of ``_first_meeting`` for all pairs of two blocks of rows."""
    out = np.zeros((len(table[a]), len(table[b])), np.float32)
    for t in range(tree + 1):
        x, y = table[a, t], table[b, t]
        both = np.intersect1d(x[x >= 0], y[y >= 0])
        if t == tree:
            both = both[both < leaf]
        if len(both):
            has = [(np.zeros((len(z), len(both)), np.float32), z) for z in (x, y)]
            for marks, z in has:
                place = np.minimum(np.searchsorted(both, z), len(both) - 1)
                row, slot = np.nonzero(both[place] == z)
                marks[row, place[row, slot]] = 1
            out += has[0][0] @ has[1][0].T
    return out > 0


def _unite(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``low`` after the edges (i, j): both ends of each have the same value."""
    while len(i):
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, low[i], least)
        np.minimum.at(low, low[j], least)
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        apart = low[i] != low[j]
        i, j = i[apart], j[apart]
    return low


FOUND = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("low", pa.int64())])


def _compare(dtype: str, threshold: float):
    def run(key, rows):
        tree, leaf, same = key[2].as_py(), key[3].as_py(), key[4].as_py() == key[5].as_py()
        node, first = rows["node"].to_numpy(), rows["first"].to_numpy()
        order = np.lexsort([node, ~first])
        node, copies = node[order], rows["copies"].to_numpy()[order]
        half = int(first.sum())
        packed, blobs = rows["v"].to_pylist(), rows["others"].to_pylist()
        heads = [np.frombuffer(b, np.int64, 2) for b in blobs]
        most = max(int(h[1]) for h in heads)
        table = np.full((len(node), int(heads[0][0]), most), -1, np.int64)
        for k, i in enumerate(order):
            h = heads[i]
            table[k, :, : h[1]] = np.frombuffer(blobs[i], np.int64, offset=16).reshape(h)
        for t in range(tree):
            if any((table[:, t] == k).any(axis=1).all() for k in table[0, t] if k >= 0):
                return FOUND.empty_table()
        x = _unit([packed[i] for i in order], dtype)
        links = np.zeros(len(node), np.int64)
        low = np.arange(len(node))
        for s in range(0, half, BLOCK):
            a_ = slice(s, min(s + BLOCK, half))
            for o in range(s, half, BLOCK) if same else range(half, len(node), BLOCK):
                b_ = slice(o, min(o + BLOCK, half if same else len(node)))
                near = x[a_] @ x[b_].T >= threshold
                if s == o:
                    near = np.triu(near, 1)
                if 16 * np.count_nonzero(near) > near.size:
                    # Dense: the block as a whole, without a list of its pairs.
                    near &= ~_met_before(table, a_, b_, tree, leaf)
                    links[a_] += near @ copies[b_]
                    links[b_] += copies[a_] @ near
                    while True:
                        apart = near & (low[a_][:, None] != low[b_][None, :])
                        i, j = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
                        if not len(i):
                            break
                        low = _unite(
                            low, np.concatenate([i, apart[:, j].argmax(axis=0)]) + s,
                            np.concatenate([apart[i].argmax(axis=1), j]) + o,
                        )
                    continue
                a, b = np.nonzero(near)
                a, b = a + s, b + o
                for c in range(0, len(a), 100_000):
                    i, j = a[c : c + 100_000], b[c : c + 100_000]
                    mine = _first_meeting(table, i, j, tree, leaf)
                    i, j = i[mine], j[mine]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    low = _unite(low, i, j)
        while (low[low] != low).any():
            low = low[low]
        some = np.flatnonzero(links)
        return pa.table([pa.array(node[some]), pa.array(links[some]), pa.array(node[low[some]])], schema=FOUND)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row (vec_id, embedding, label)."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = "float32" if element == "float" else "float64"
    spark = vectors.sparkSession
    packed = store(
        vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
        .mapInArrow(_pack(dtype), "vec_id long, label long, v binary")
        .withColumn("key", F.md5("v")),
        "vectors",
    )
    nodes = store(
        packed.where("v IS NOT NULL").groupBy("label", "key").agg(
            F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.min("v").alias("v")
        ),
        "vector-nodes",
    )
    shared = spark.sparkContext.broadcast(fit(nodes, dtype, threshold))
    large = spark.sparkContext.broadcast(large_leaves(nodes, shared, dtype))
    found = cut(
        nodes.select("label", "node", "copies", "v").mapInArrow(_route(shared, large, dtype), ROUTED)
        .groupBy("label", "size", "tree", "leaf", "piece", "other")
        .applyInArrow(_compare(dtype, threshold), "node long, n long, low long")
    )
    part = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    per_node = nodes.select("label", "key", "node", "copies").join(sums, "node", "left").join(
        part, "node", "left"
    ).select(
        "label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    return packed.select("vec_id", "label", "key").join(per_node, ["label", "key"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )

"""Merkle manifest of a table by time-forward processing.

Every row is a leaf: a SHA-256 over its fields, length-prefixed.  Leaves stand per source in
the order of doc_id under a tree of fan-out 16; the source roots stand under another one.

A node is labelled (tree, level, index), and nodes are worked on in the order of labels.  A
digest is sent to its parent as a message with the parent's label, and a priority queue
ordered by label hands each node all messages of its children at once.  The queue is
external: within a task it is a heap over one chunk of ``FANOUT ** LEVELS`` neighbouring
nodes, and what leaves a chunk is written and sorted by label by Spark before the next
``LEVELS`` levels.  So passes grow with the logarithm of the largest tree, and no task sees
more than whole chunks, however large one source is.

The reversed sweep goes from the root down: a node hands each child its proof suffix, that
is the child's siblings followed by the node's own suffix.  The message for a chunk is sorted
before the nodes of the chunk, so one pass over the sorted rows settles them.  A leaf then
knows its proof and folds its own digest (or that of a tampered row) up to the root again.

Defined cases: an empty table gives no rows; a null source is a source of its own, before all
others; a null doc_id comes first in its source and is never tampered with; rows with equal
doc_id stand in the order of their leaf digests, equal rows are leaves of their own.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoremon.llm.common import store

FANOUT = 16
#: Levels that one pass goes up or down; a chunk holds FANOUT ** LEVELS nodes.
LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Path = list[tuple[str, str]]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row over ``FIELDS``, some of them given as other columns."""
    return F.sha2(F.concat(*[encoded(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def lowered(text: Column) -> Column:
    """ASCII letters in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered() -> Column:
    """Rows whose text is tampered with: 5 divides the crc32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Stored ``rows`` with their position in the order of ``keys`` (which tell rows apart).

    Ranges of rows are numbered on their own and start at the sum of the ranges before them.
    """
    ranged = store(
        rows.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_range", F.spark_partition_id()),
        f"ranged-{name}",
    )
    # One row per range, so this one window is small.
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_range").count().select(
        "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return store(
        ranged.withColumn("_inside", inside).join(bases, "_range")
        .withColumn(name, F.col("_base") + F.col("_inside") - 1).drop("_range", "_inside", "_base"),
        f"numbered-{name}",
    )


def height(nodes: int) -> int:
    """Levels above ``nodes`` neighbouring nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


def sweep_up(digests: list[str], levels: int) -> list[list[str]]:
    """All levels above the nodes of one chunk, lowest first, through a queue ordered by label."""
    tiers = [digests] + [[] for _ in range(levels)]
    queue = [((1, k // FANOUT), k, d) for k, d in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    while queue:
        label = queue[0][0]
        messages = []
        while queue and queue[0][0] == label:
            messages.append(heapq.heappop(queue)[2])
        level, index = label
        made = digest("".join(messages))
        tiers[level].append(made)
        if level < levels:
            heapq.heappush(queue, ((level + 1, index // FANOUT), index, made))
    return tiers


def sweep_down(tiers: list[list[str]], top: Path) -> list[Path]:
    """Proof suffix of every node of the lowest tier, given that of the chunk's top node.

    A suffix holds per level the siblings to the left and to the right of the path.
    """
    suffixes = [top]
    for nodes in reversed(tiers[:-1]):
        below = []
        for first in range(0, len(nodes), FANOUT):
            run, above = nodes[first : first + FANOUT], suffixes[first // FANOUT]
            below += [
                [("".join(run[:k]), "".join(run[k + 1 :])), *above] for k in range(len(run))
            ]
        suffixes = below
    return suffixes


def fold(leaf: str, path: Path) -> str:
    """Root that a leaf and its proof lead to."""
    for left, right in path:
        leaf = digest(f"{left}{leaf}{right}")
    return leaf


def siblings(path: Path) -> list[str]:
    """The digests of a proof, level by level, left to right."""
    return [d for left, right in path for s in (left, right) for d in (s[i : i + 64] for i in range(0, len(s), 64))]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one chunk each, from rows sorted by tree, chunk and position."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            at = (row["tree"], row["chunk"])
            if at != key and held:
                yield held
                held = []
            key = at
            held.append(row)
    if held:
        yield held


def _in_chunks(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, at, ...) side by side with the others of their chunk, in order."""
    return nodes.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "at")


def chunk() -> Column:
    return F.floor(F.col("at") / FANOUT**LEVELS).cast("long")


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One message per chunk: the digest of its top node."""
    for rows in _chunks(batches):
        levels = min(LEVELS, height(rows[0]["width"]))
        top = sweep_up([r["digest"] for r in rows], levels)[-1]
        yield pa.RecordBatch.from_pydict({
            "tree": [rows[0]["tree"]], "at": [rows[0]["chunk"]], "digest": top,
            "width": [-(-rows[0]["width"] // FANOUT**LEVELS)],
        })


NODE = "tree long, at long, digest string, width long"
STEP = "array<struct<left:string,right:string>>"


def climb(nodes: DataFrame, widest: int) -> tuple[list[DataFrame], DataFrame]:
    """Node tables of every pass and the top nodes (tree, digest) of all trees.

    ``nodes`` is (tree, at, digest, width): width is the number of nodes of the tree at that
    level, at the place among them, and ``widest`` the largest width.
    """
    passes, tops = [], nodes.where("width = 1").select("tree", "digest")
    while widest > 1:
        nodes = nodes.where("width > 1").withColumn("chunk", chunk())
        passes.append(nodes)
        made = _in_chunks(nodes.select("tree", "chunk", "at", "digest", "width")).mapInArrow(_up, NODE)
        nodes = store(made, "merkle-nodes")
        tops = tops.union(nodes.where("width = 1").select("tree", "digest"))
        widest = -(-widest // FANOUT**LEVELS)
    return passes, tops


def _down(
    emit: Callable[[dict, Path, dict], dict], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hand the suffix of each chunk's top node (the row in front) down to its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for message, *rows in _chunks(batches):
            top = [(s["left"], s["right"]) for s in message["path"]]
            tiers = sweep_up([r["digest"] for r in rows], min(LEVELS, height(rows[0]["width"])))
            out += [emit(r, path, message) for r, path in zip(rows, sweep_down(tiers, top), strict=True)]
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_MESSAGE = pa.schema([
    ("tree", pa.int64()), ("chunk", pa.int64()), ("path", _PATH), ("subroot", pa.string()), ("root", pa.string()),
])
MESSAGE = f"tree long, chunk long, path {STEP}, subroot string, root string"


def _message(row: dict, path: Path, above: dict) -> dict:
    return {
        "tree": row["tree"], "chunk": row["at"], "subroot": above["subroot"], "root": above["root"],
        "path": [{"left": a, "right": b} for a, b in path],
    }


def descend(passes: list[DataFrame], messages: DataFrame, run, schema: str) -> DataFrame:
    """Reversed sweep from the top nodes of all trees to the nodes of the lowest pass.

    ``messages`` hold one row per tree with its width, which tells the pass that holds the
    top of the tree; they wait until the sweep comes to it.  ``run`` works on the lowest
    pass, the passes above it hand on messages.
    """
    first = sum(
        ((F.col("width") > FANOUT ** (LEVELS * k)).cast("int") for k in range(1, len(passes))), F.lit(0)
    )
    waiting = messages.select(*_MESSAGE.names, first.alias("_first"))
    arrived = None
    for k in range(len(passes) - 1, -1, -1):
        now = waiting.where(F.col("_first") == k).drop("_first")
        now = now if arrived is None else arrived.unionByName(now)
        rows = _in_chunks(passes[k].unionByName(
            now.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True
        ))
        if k:
            arrived = store(rows.mapInArrow(_down(_message, _MESSAGE), MESSAGE), "merkle-messages")
    return rows.mapInArrow(run, schema)


def manifest(docs: DataFrame, changed: Column | None = None, proofs: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    ``changed`` is the leaf digest of the row as it is found now, null where it has not
    changed; the proof is checked against it.  With ``proofs`` the sibling digests come too,
    as column ``proof``.
    """
    leaves = store(docs.select(
        "doc_id", "source", leaf_digest().alias("leaf"),
        (F.lit(None).cast("string") if changed is None else changed).alias("found"),
        F.monotonically_increasing_id().alias("_row"),
    ), "merkle-leaves")
    places = numbered(leaves, ["source", "doc_id", "leaf", "_row"], "place")
    trees = places.groupBy("source").agg(F.min("place").alias("tree"), F.count("*").alias("width"))
    trees = store(trees, "merkle-trees")
    widest, sources = trees.agg(F.max("width"), F.count("*")).first()

    columns = {"doc_id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "root": pa.string(),
               "proof_sha256": pa.string(), "folded_root": pa.string(), "verified": pa.bool_()}
    schema = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
              "folded_root string, verified boolean")
    if proofs:
        columns["proof"], schema = pa.list_(pa.string()), f"{schema}, proof array<string>"

    def settle(row: dict, path: Path, above: dict) -> dict:
        folded = fold(row["found"] or row["digest"], path)
        out = {
            "doc_id": row["doc_id"], "leaf": row["digest"], "subroot": above["subroot"], "root": above["root"],
            "proof_sha256": digest("".join(a + b for a, b in path)), "folded_root": folded,
            "verified": folded == above["root"],
        }
        return out | {"proof": siblings(path)} if proofs else out

    if not sources:
        return docs.sparkSession.createDataFrame([], schema)
    by_source = places.join(
        trees.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    )
    leaf_nodes = by_source.select(
        "tree", (F.col("place") - F.col("tree")).alias("at"), F.col("leaf").alias("digest"), "width",
        "doc_id", "found",
    )
    passes, subroots = climb(leaf_nodes, widest)
    upper = numbered(subroots.select(F.col("tree").alias("at_tree"), "digest"), ["at_tree"], "at")
    upper = upper.select(
        F.lit(0).cast("long").alias("tree"), "at", "digest", F.lit(sources).cast("long").alias("width"), "at_tree"
    )
    upper_passes, top = climb(upper, sources)
    root = top.first()["digest"]

    def to_tree(row: dict, path: Path, above: dict) -> dict:
        return _message(row, path, above) | {"tree": row["at_tree"], "chunk": 0, "subroot": row["digest"]}

    start = docs.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("chunk"),
        F.array().cast(STEP).alias("path"), F.lit(None).cast("string").alias("subroot"),
        F.lit(root).alias("root"), F.lit(sources).cast("long").alias("width"),
    )
    # The lowest pass also takes the trees of a single node, which no pass upwards holds.
    messages = descend(
        [upper.withColumn("chunk", chunk()), *upper_passes[1:]], start, _down(to_tree, _MESSAGE), MESSAGE
    )
    messages = store(messages, "merkle-messages").join(trees.select("tree", "width"), "tree")
    return descend(
        [leaf_nodes.withColumn("chunk", chunk()), *passes[1:]], messages,
        _down(settle, pa.schema(list(columns.items()))), schema,
    )

"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual`` points of a 64-bit ring.  A key belongs to the arc it hashes
to, and prefers the shards in the order in which they follow clockwise.  No shard takes
more than (1 + ``slack``) times the mean load; keys that a full shard cannot take continue
clockwise to the next shard with room.  Loads are bytes.

The ring is filled from totals, not row by row: one grouped sum gives the bytes of each
cell (arc, size class), at most ``shards * virtual * 64`` rows however large the table.
Cells are placed large size classes first, so what a full shard hands on are small
documents; the few cells that are split are cut by running bytes in hash order, taken over
buckets of bounded row counts.  Slot numbers come from bucket counts in the same way, so
neither needs more than a bucket in one task.

Defined cases: a null text has no bytes and size 1; equal doc_ids hash alike, told apart by
a hash of the text, and fully repeated rows by an arbitrary, stable number; a null doc_id
is a key of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremon.llm.common import place_in, running, store, twins

RING_BITS = 62


def ring(shards: int, virtual: int) -> tuple[list[int], list[int]]:
    """Sorted points and their owners; a shard's points depend on nothing but its number."""
    points = sorted(
        (int(np.random.default_rng([s, v]).integers(1 << RING_BITS)), s)
        for s in range(shards) for v in range(virtual)
    )
    return [p for p, _ in points], [s for _, s in points]


def preferences(owners: Sequence[int], arc: int, shards: int) -> list[int]:
    """All shards in clockwise order from an arc."""
    seen: dict[int, None] = {}
    for k in range(len(owners)):
        seen.setdefault(owners[(arc + k) % len(owners)])
        if len(seen) == shards:
            break
    return list(seen)


def fill(
    cells: Sequence[tuple[int, int, int]], owners: Sequence[int], shards: int, slack: float
) -> list[tuple[int, int, int, int]]:
    """Pieces (arc, size class, first byte, shard) for cells (arc, size class, bytes).

    A piece runs up to the first byte of the next piece of its cell.
    """
    total = sum(b for _, _, b in cells)
    limit = math.ceil(total / shards * (1 + slack))
    room = [limit] * shards
    pieces = []
    for arc, size_class, left in sorted(cells, key=lambda c: (-c[1], c[0])):
        at = 0
        for shard in preferences(owners, arc, shards):
            take = min(left, room[shard])
            if take > 0:
                pieces.append((arc, size_class, at, shard))
                room[shard] -= take
                at, left = at + take, left - take
            if not left:
                break
    return pieces


def assign(
    rows: DataFrame, shards: int, virtual: int = 64, slack: float = 0.001, key: str = "doc_id",
    size: str = "size", tie: str = "tie", content: str = "text_hash",
) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, gapless from 0 in each shard.

    ``rows`` is read several times and has to be a stored frame.  Rows are placed by ``key``
    and ``content``; ``tie`` tells rows apart that agree in both, and only they change places
    with another file layout.
    """
    spark = rows.sparkSession
    names = rows.columns
    rows = twins(rows, [key, content], tie)
    points, owners = ring(shards, virtual)
    at = F.shiftrightunsigned(F.xxhash64(key), 64 - RING_BITS)
    cell = rows.withColumns({
        "_arc": (place_in(points, at) % len(points)).cast("int"),
        "_class": F.floor(F.log2(F.greatest(F.col(size), F.lit(1)))).cast("int"),
    }).withColumn("_cell", F.col("_arc") * 64 + F.col("_class"))
    totals = cell.groupBy("_arc", "_class").agg(F.sum(size)).collect()
    pieces = fill([tuple(r) for r in totals], owners, shards, slack)
    by_cell: dict[int, list] = {}
    for arc, size_class, first, shard in pieces:
        by_cell.setdefault(arc * 64 + size_class, []).append((first, shard))
    plan = spark.createDataFrame(
        list(by_cell.items()), "_cell int, _pieces array<struct<first: bigint, shard: int>>"
    )
    # Bounded by arcs times size classes, whatever the table.
    cell = cell.drop("_arc", "_class").join(F.broadcast(plan), "_cell")
    whole = cell.where(F.size("_pieces") == 1).withColumn("shard", F.col("_pieces")[0]["shard"])
    if any(len(p) > 1 for p in by_cell.values()):
        parts = running(
            store(cell.where(F.size("_pieces") > 1), "split-cells"), "_cell", [key, content, "twin"],
            F.col(size), "_byte",
        ).withColumn(
            "shard",
            F.element_at(F.filter("_pieces", lambda p: p["first"] <= F.col("_byte")), -1)["shard"],
        )
        whole = whole.unionByName(parts.select(*whole.columns))
    placed = store(whole.drop("_pieces", "_cell"), "shards")
    return running(placed, "shard", [key, content, "twin"], F.lit(1).cast("long"), "slot").select(
        *names, "shard", "slot"
    )


def shard_rows(docs: DataFrame, tie: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, hash of the text and a tie breaker of every row of ``docs``.

    ``tie`` tells rows apart; the position of the row in its file by default.
    """
    text = F.coalesce("text", F.lit(""))
    return store(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_hash"),
        (F.monotonically_increasing_id() if tie is None else tie).alias("tie"),
    ), "shard-rows")

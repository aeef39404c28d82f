"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A vector is quantised to whole numbers, ``floor(scale * x)`` of every component, and read as
a sparse row: term = position of a component, weight = its number where that is not zero.
Candidates are dealt into blocks, and so are the queries.  A task holds the postings of one
candidate block (per term the rows and their weights) and one block of queries.  It goes
through the terms, scatters query weight times posting weight into dense arrays of scores
(one per query, as long as the candidate block), and takes the best k of each array by
partition selection.  The lists of the candidate blocks are merged per query.

Nothing is pruned, so results are exact.  Block sizes bound the memory of a task; there are
as many blocks as the table needs, and every pair of a query and a candidate block is a task
group of its own.  Only queries that the caller names are compared with all rows.

Defined cases: vectors that are null or hold null or non-finite components take no part;
empty vectors and vectors of different width do (a missing component weighs 0); every row is
a vector of its own, so a repeated row is a candidate for its twin; equal scores go by the
smaller vec_id, null ids last, then by row; scores beyond a long stand at its end and numbers
beyond it too.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoremon.llm.common import slots, store

SCALE = 256.0
#: Components (not rows) of one candidate block and of one query block.
BLOCK = 4_000_000
#: Rows of a block, which bound a score array and the rows that a table with narrow vectors gives.
ROWS = 65_536
#: Scores that are accumulated together: queries times candidates.
SCORES = 1 << 19
#: From this share of a block's rows on, a posting list is kept as one weight per row.
FULL = 0.3
END = np.iinfo(np.int64).max


def quantised(rows: DataFrame, id_column: str, vector: str, query: Column, scale: float) -> DataFrame:
    """(_id, _query, w array<long>) of the usable vectors."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = F.col(vector).isNotNull() & ~F.exists(
        wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return rows.select(
        F.col(id_column).cast("long").alias("_id"), F.coalesce(query, F.lit(False)).alias("_query"),
        F.when(usable, F.transform(wide, lambda x: F.floor(x * scale))).alias("w"),
    ).where("w IS NOT NULL")


def _sparse(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all weights that are not zero, by term and row."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    weight = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = weight != 0
    row, term, weight = row[keep], term[keep], weight[keep]
    order = np.argsort(term, kind="stable")
    return row[order], term[order], weight[order]


def _cut(sorted_terms: np.ndarray, rows: np.ndarray, weights: np.ndarray):
    """term -> (rows, weights) of arrays sorted by term."""
    terms, starts = np.unique(sorted_terms, return_index=True)
    ends = np.append(starts[1:], len(sorted_terms))
    return {t: (rows[a:b], weights[a:b]) for t, a, b in zip(terms.tolist(), starts.tolist(), ends.tolist())}


def _fits(queries: np.ndarray, weights: np.ndarray, terms: int) -> bool:
    """Whether no sum of products can leave the range of a long."""
    top = [max(abs(int(w.max())), abs(int(w.min()))) if len(w) else 0 for w in (queries, weights)]
    return top[0] * top[1] * max(terms, 1) <= END


def best_of_block(queries: pa.ChunkedArray, block: pa.ChunkedArray, own: np.ndarray, ids: np.ndarray,
                  missing: np.ndarray, rids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate row, score) of the best k rows of a block for each query.

    ``own`` is the row number of each query; that row is no candidate of it.  Rows stand in
    the order of ties, so of equal scores the first rows are the better ones.
    """
    order = np.lexsort((rids, ids, missing))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    row, term, weight = _sparse(block)
    q_row, q_term, q_weight = _sparse(queries)
    n, total = len(order), len(own)
    exact = _fits(q_weight, weight, int(max(term.max(initial=-1), q_term.max(initial=-1))) + 1)
    dtype = np.int64 if exact else object
    postings = {}
    for t, (rows, weights) in _cut(term, rank[row], weight).items():
        if len(rows) >= FULL * n:
            full = np.zeros(n, np.int64)
            full[rows] = weights
            postings[t] = (None, full.astype(dtype))
        else:
            postings[t] = (rows, weights.astype(dtype))
    place = {int(r): p for p, r in enumerate(rids[order].tolist())}
    asked, found, scores = [], [], []
    step = max(1, SCORES // max(n, 1))
    by_query = np.argsort(q_row, kind="stable")
    q_row, q_term, q_weight = q_row[by_query], q_term[by_query], q_weight[by_query]
    for start in range(0, total, step):
        stop = min(start + step, total)
        a, b = np.searchsorted(q_row, [start, stop])
        by_term = np.argsort(q_term[a:b], kind="stable") + a
        acc = np.zeros((stop - start, n), dtype)
        for t, (qs, ws) in _cut(q_term[by_term], q_row[by_term] - start, q_weight[by_term]).items():
            if t not in postings:
                continue
            rows, weights = postings[t]
            if rows is None:
                if len(qs) == stop - start:
                    acc += ws.astype(dtype)[:, None] * weights
                else:
                    acc[qs] += ws.astype(dtype)[:, None] * weights
            else:
                acc[np.ix_(qs, rows)] += ws.astype(dtype)[:, None] * weights
        if not exact:
            acc = np.clip(acc, -END, END).astype(np.int64)
        for q in range(stop - start):
            line = acc[q]
            mine = place.get(int(own[start + q]))
            take = min(k + (mine is not None), n)
            cut = np.partition(line, n - take)[n - take]
            top = np.flatnonzero(line > cut)
            top = np.concatenate([top, np.flatnonzero(line == cut)[: take - len(top)]])
            # An own row that ranks among them leaves; else the one row too many does.
            top = top[top != mine] if mine is not None else top
            top = top[np.lexsort((top, -line[top]))][:k]
            asked.append(np.full(len(top), start + q))
            found.append(order[top])
            scores.append(line[top])
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (asked, found, scores))


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and a mark for nulls."""
    return np.asarray(pc.fill_null(column, 0)).astype(np.int64), np.asarray(column.is_null()).astype(bool)


OUT = pa.schema([(c, pa.int64()) for c in ("_own", "query_id", "vec_id", "score", "_rid")])


def _compare(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return OUT.empty_table()
        asked_id, asked_null = _numbers(queries["_id"])
        own, _ = _numbers(queries["_rid"])
        ids, missing = _numbers(block["_id"])
        rids, _ = _numbers(block["_rid"])
        q, c, score = best_of_block(queries["w"], block["w"], own, ids, missing, rids, k)
        return pa.table([
            pa.array(own[q]), pa.array(asked_id[q], mask=asked_null[q]),
            pa.array(ids[c], mask=missing[c]), pa.array(score), pa.array(rids[c]),
        ], schema=OUT)

    return run


def top_k(
    rows: DataFrame, query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding",
    scale: float = SCALE,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k best other rows of each row marked by ``query``."""
    spark = rows.sparkSession
    kept = store(
        quantised(rows, id_column, vector, query, scale).withColumn("_rid", F.monotonically_increasing_id()),
        "quantised-vectors",
    )
    total, asked, parts, asked_parts = kept.agg(
        F.count("*"), F.count_if("_query"), F.coalesce(F.sum(F.size("w")), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("_query"), F.size("w"))), F.lit(0)),
    ).first()
    # Enough blocks for memory, and on small tables enough for all slots.
    blocks = max(-(-parts // BLOCK), -(-total // ROWS), min(slots(spark) * 2, -(-total // 1024)), 1)
    query_blocks = max(-(-asked_parts // BLOCK), -(-asked // ROWS), 1)

    def dealt(frame: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        return frame.select(
            *[F.col(c).alias(c) for c in ("_id", "_rid", "w")], F.pmod(F.xxhash64("_rid"), F.lit(count)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
        )

    queries = dealt(kept.where("_query"), "_q", query_blocks, "_c", blocks)
    candidates = dealt(kept, "_c", blocks, "_q", query_blocks)
    lists = queries.groupBy("_q", "_c").cogroup(candidates.groupBy("_q", "_c")).applyInArrow(
        _compare(k), "_own long, query_id long, vec_id long, score long, _rid long"
    )
    best = Window.partitionBy("_own").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("_rid")
    )
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )

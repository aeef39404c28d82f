"""Mixing sources to target weights by a low-discrepancy schedule of token blocks.

The documents of a source, shuffled by a hash of id and text, form one stream of words that is cut into
blocks of ``block`` words (the last may be shorter).  Slot i of the schedule looks at the
point frac(i * golden ratio), mapped through the cumulative weights of the sources, so every
stretch of the schedule holds every source close to its share.  Slots are ranked inside
their source, and rank r takes block r modulo the number of blocks: a source is read again
from its start when it is used up, three times at most.  Schedule and streams meet in a
hash join on (source, block), where no source is hot.

Ranks and stream positions come from sums of bounded ranges (``common.running``), so a
source may hold any share of the rows.  Only one row per source reaches the driver.

Defined cases: a null text has size 0; the null source is a source, last in order; a
document without words is never taken; repeated rows are rows of their own, and the words
taken of equal rows are the same as a set, whatever the file layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoremon.llm.common import place_in, running, store, twins

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
BLOCK = 64
SLOT_RANGE = 8192
#: 2**32 divided by the golden ratio.
GOLDEN = 2_654_435_769


def targets(sizes: Sequence[int], weights: Sequence[float], epochs: int = EPOCHS) -> list[float]:
    """Shares of the whole by weight; what a source cannot give is shared by the others."""
    open_ = {i for i, s in enumerate(sizes) if s > 0}
    out = [0.0] * len(sizes)
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > epochs * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(epochs * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def mix_rows(docs: DataFrame, tie: Column | None = None) -> DataFrame:
    """doc_id, source, number of words, hash of the text and a tie breaker of every row.

    ``tie`` tells rows apart; the position of the row in its file by default.
    """
    return store(docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
        .cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"),
        (F.monotonically_increasing_id() if tie is None else tie).alias("tie"),
    ), "mix-rows")


def schedule(sources: DataFrame, plan: Sequence[tuple], block: int) -> DataFrame:
    """slot, source_no, rank and block of the whole schedule.

    ``plan`` has (number, size, target) of each source, in order.
    """
    spark = sources.sparkSession
    blocks = [-(-size // block) for _, size, _ in plan]
    shares = [t * b / s if s else 0.0 for (_, s, t), b in zip(plan, blocks, strict=True)]
    total, bounds, up = sum(shares), [], 0.0
    for x in shares[:-1]:
        up += x
        bounds.append(up / total if total else 1.0)
    n = round(total)
    point = F.pmod((F.col("id") % (1 << 31)) * F.lit(GOLDEN), F.lit(1 << 32)) / float(1 << 32)
    slots = spark.range(n).select(
        F.col("id").alias("slot"), place_in(bounds, point).alias("source_no"),
        (F.col("id") / SLOT_RANGE).cast("long").alias("_range"),
    )
    counts = slots.groupBy("source_no", "_range").agg(F.count("*").alias("_n"))
    over = Window.partitionBy("source_no").orderBy("_range")
    base = counts.select(
        "source_no", "_range", (F.sum("_n").over(over) - F.col("_n")).alias("_base")
    )
    inside = Window.partitionBy("source_no", "_range").orderBy("slot")
    ranked = slots.join(base, ["source_no", "_range"]).select(
        "slot", "source_no", (F.col("_base") + F.row_number().over(inside) - 1).alias("rank")
    )
    count = spark.createDataFrame(
        [(i, b) for i, b in enumerate(blocks)], "source_no int, blocks bigint"
    )
    return ranked.join(count, "source_no").where(F.col("rank") < F.col("blocks") * EPOCHS).select(
        "slot", "source_no", "rank", (F.col("rank") % F.col("blocks")).alias("block")
    )


def mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """``rows`` (see ``mix_rows``) with source_size, target, taken and starts.

    ``taken`` counts the words that the schedule takes from the row, repeats included;
    ``starts`` how often it takes the block in which the row begins.
    """
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
    plan = spark.createDataFrame(
        [(r[0], i, r[1], t) for i, (r, t) in enumerate(zip(found, goal, strict=True))],
        "_source string, source_no int, source_size bigint, target double",
    )
    ordered = twins(rows, ["source", "doc_id", "text_hash"], "tie")
    placed = running(ordered, "source", ["doc_id", "text_hash", "twin"], F.col("size"), "_from").drop("twin")
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    used = schedule(rows, [(i, s, t) for i, (s, t) in enumerate(zip(sizes, goal, strict=True))], block)
    used = used.groupBy("source_no", "block").agg(F.count("*").alias("_times"))
    upto = F.col("_from") + F.col("size")
    number = lambda at: F.floor(at / block).cast("long")
    cut = placed.withColumn(
        "block", F.explode(F.when(
            F.col("size") > 0, F.sequence(number(F.col("_from")), number(upto - 1))
        ).otherwise(F.array(F.lit(None).cast("long"))))
    ).withColumn(
        "_part", F.least(upto, (F.col("block") + 1) * block)
        - F.greatest(F.col("_from"), F.col("block") * block)
    )
    first = F.col("block") == number(F.col("_from"))
    return cut.join(used, ["source_no", "block"], "left").groupBy(
        *rows.columns, "source_size", "target"
    ).agg(
        F.coalesce(F.sum(F.col("_times") * F.col("_part")), F.lit(0)).alias("taken"),
        F.coalesce(F.max(F.when(first, F.col("_times"))), F.lit(0)).alias("starts"),
    )


def repeated(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, block: int = BLOCK, row: str | None = None
) -> DataFrame:
    """Rows of ``docs`` as often as the schedule takes the block in which they begin.

    Rows without words stay as they are: the mix weighs words and has no view on them.
    ``row`` names a column of a stored frame that tells its rows apart; without it the rows
    are stored with such a column first.
    """
    names = [c for c in docs.columns if c != row]
    rows = store(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-documents") if row is None else docs
    row = row or "_row"
    times = mix(mix_rows(rows, F.col(row)), weights, block).select(
        F.col("tie").alias(row), F.when(F.col("size") == 0, 1).otherwise(F.col("starts")).cast("int").alias("_times")
    )
    return rows.join(times.where("_times > 0"), row).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))
    ).select(*names)

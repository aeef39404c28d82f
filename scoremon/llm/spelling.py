"""Spelling variants by a dictionary of pairs of trie nodes.

Words stand in a forward trie and, reversed, in a second one.  The nodes of both are numbered,
so that a prefix and a suffix are one whole number each.  A word of length L has a *skip* pair
(prefix node before i, suffix node after i) for each of its L positions, and a *split* pair
(prefix node before i, suffix node from i) for each of its L + 1 gaps.  Exactly then

* two words differ by one replaced code point when they share a skip pair, and
* the longer of two differs by one inserted code point when its skip pair is a split pair of
  the shorter.  Skipping either of two equal neighbours leaves the same word, so only the
  first position of such a run counts here.

A pair names one text with at most one free place, so a group holds at most one split row and
one skip row per letter of the alphabet.  Groups give each member its number of neighbours and
the best of them; pairs of words are never written.

The tries are never held in one place.  A range partition of the sorted words numbers its own
nodes from the words in order: a word opens the nodes below its common prefix with the word
before.  Only prefixes of the first word of a partition can belong to nodes opened before it;
two words per partition tell which, and their numbers are put in place of the new ones.  A
prefix (or suffix) that no other word has cannot be in a shared pair and is not written.

Work is linear in the code points of all words, whatever their length.

Defined cases: null and empty texts hold no words; a null doc_id reads as no digits in front
of the colon; repeated rows count as often as they stand; words below the number of
occurrences or the length that is asked for are no neighbours of any word.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremon.llm.common import store
from scoremon.llm.merkle import lowered

#: Letters of a word, for Java's expressions.
LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST = 7
LEAST = 2
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: One in so many runs of the query loses a letter.
SPOILT = 31
#: Numbers of one partition: partition << SHIFT | number.
SHIFT = 40
ROWS = 20_000


def spoilt_words(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(word, n) of all runs of letters with ``shortest`` code points or more.

    Where ``SPOILT`` divides the crc32 of ``doc_id:run``, the run lost the code point at
    crc32 modulo its length.
    """
    # A shorter run cannot become a word, and a longest match that starts a run takes all of it.
    runs = docs.select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run")
    ).withColumn("run", lowered(F.col("run")))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    runs = runs.withColumn("_h", F.crc32(name.cast("binary")))
    at = (F.col("_h") % F.length("run")).cast("int")
    word = F.when(
        F.col("_h") % SPOILT == 0,
        F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))),
    ).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(
        F.count("*").alias("n")
    )


def common_prefix(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _number(text: str, side: str):
    """Number the trie nodes of sorted words within a partition.

    Adds ``<side>_part``, ``<side>_row`` (place in the partition), ``<side>_nodes`` (number of
    every prefix), ``<side>_shared`` (longest prefix that a neighbour has too) and
    ``<side>_edge`` (first or last word of the partition).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path: list[int] = []
        last, opened, count, before = None, 0, 0, 0
        held = None

        def out(rows: pa.Table, nodes: array, sizes: list[int], shared: list[int], first: int, final: bool):
            n = rows.num_rows
            offsets = np.concatenate([[0], np.cumsum(sizes[:n], dtype=np.int64)]).astype(np.int32)
            edge = np.zeros(n, bool)
            if n and first == 0:
                edge[0] = True
            if n and final:
                edge[-1] = True
            values = np.frombuffer(nodes, np.int64)[: int(offsets[-1])] if n else np.zeros(0, np.int64)
            columns = [
                pa.array(np.full(n, part, np.int64)), pa.array(np.arange(first, first + n)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                pa.array(np.array(shared[:n], np.int32)), pa.array(edge),
            ]
            for name, column in zip(("part", "row", "nodes", "shared", "edge"), columns):
                rows = rows.append_column(f"{side}_{name}", column)
            return rows.combine_chunks().to_batches()

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = pa.Table.from_batches([batch.slice(start, ROWS)])
                nodes, sizes, shared = array("q"), [], []
                if held is not None:
                    piece = pa.concat_tables([held, piece])
                    nodes.extend(path)
                    sizes.append(len(path))
                for word in piece.column(text).to_pylist()[len(sizes) :]:
                    common = -1 if last is None else common_prefix(last, word)
                    if sizes:
                        shared.append(max(before, common))
                    fresh = len(word) - common
                    path[common + 1 :] = range(opened, opened + fresh)
                    opened += fresh
                    nodes.extend(path)
                    sizes.append(len(path))
                    last, before = word, common
                # The last word waits for its successor.
                done = piece.slice(0, piece.num_rows - 1)
                held = piece.slice(piece.num_rows - 1)
                yield from out(done, nodes, sizes, shared, count, False)
                count += done.num_rows
        if held is not None:
            yield from out(held, array("q", path), [len(path)], [before], count, True)

    return run


def bridges(edges: list[tuple[int, int, str, list[int]]]) -> dict[int, tuple[list[int], int]]:
    """partition -> (numbers of its first nodes that earlier partitions opened, prefix shared with the next one).

    ``edges`` holds (partition, row, word, nodes) of the first and the last word of every
    partition.  The first word of a partition has the local numbers 0, 1, ... down its path.
    """
    found: dict[int, tuple[list[int], int]] = {}
    before = None
    for part in sorted({e[0] for e in edges}):
        rows = sorted(e for e in edges if e[0] == part)
        known: list[int] = []
        if before is not None:
            common = common_prefix(before[2], rows[0][2])
            mine, _ = found[before[0]]
            known = [mine[k] if k < len(mine) else before[0] << SHIFT | k for k in before[3][: common + 1]]
            found[before[0]] = (mine, common)
        found[part] = (known, -1)
        before = rows[-1]
    return found


class Numbers:
    """Numbers of nodes across partitions, from the local ones."""

    def __init__(self, found: dict[int, tuple[list[int], int]]):
        self.known = {p: np.array(k, np.int64) for p, (k, _) in found.items()}
        self.after = {p: shared for p, (_, shared) in found.items()}

    def settled(self, part: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """``nodes`` (all words, one after the other) with the numbers that hold everywhere."""
        of = np.repeat(part, sizes)
        out = (of << SHIFT) | nodes
        for p in np.unique(part).tolist():
            known = self.known[p]
            at = np.flatnonzero((of == p) & (nodes < len(known)))
            out[at] = known[nodes[at]]
        return out

    def shared(self, part: np.ndarray, row: np.ndarray, edge: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Longest shared prefix of every word, also with neighbours in other partitions."""
        out = inside.astype(np.int64)
        for k in np.flatnonzero(edge).tolist():
            p = int(part[k])
            if row[k] == 0:
                out[k] = max(out[k], len(self.known[p]) - 1)
            # Only the last word is next to the partition after; for a first word that is not
            # the last one this only writes a pair more.
            out[k] = max(out[k], self.after[p])
        return out


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, position) for every position from first to last of every word."""
    count = np.maximum(last - first + 1, 0)
    word = np.repeat(np.arange(len(count)), count)
    return word, np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + first[word]


PAIR = "p long, s long, n long, wid long, skip boolean, head boolean"


def _pairs(forward: Numbers, backward: Numbers):
    """Skip and split pairs of every word that another word may share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
                flat = {n: col[n].to_numpy(zero_copy_only=False) for n in col if n not in ("word", "f_nodes", "r_nodes")}
                sizes = col["f_nodes"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.cumsum(sizes) - sizes
                length = sizes - 1
                prefix = forward.settled(flat["f_part"], sizes, col["f_nodes"].flatten().to_numpy())
                suffix = backward.settled(flat["r_part"], sizes, col["r_nodes"].flatten().to_numpy())
                to = forward.shared(flat["f_part"], flat["f_row"], flat["f_edge"], flat["f_shared"])
                back = backward.shared(flat["r_part"], flat["r_row"], flat["r_edge"], flat["r_shared"])
                codes = np.frombuffer("".join(col["word"].to_pylist()).encode("utf-32-le"), np.uint32)
                begin = np.cumsum(length) - length
                # The suffix from i is number L - i of the reversed word.
                word, i = _ranges(np.maximum(0, length - 1 - back), np.minimum(length - 1, to))
                at = begin[word] + i
                head = (i == 0) | (codes[at] != codes[at - 1])
                split, j = _ranges(np.maximum(0, length - back), np.minimum(length, to))
                both = np.concatenate([word, split])
                yield pa.RecordBatch.from_pydict({
                    "p": np.concatenate([prefix[first[word] + i], prefix[first[split] + j]]),
                    "s": np.concatenate([
                        suffix[first[word] + length[word] - i - 1], suffix[first[split] + length[split] - j]
                    ]),
                    "n": flat["n"][both],
                    "wid": (flat["f_part"][both] << SHIFT) | flat["f_row"][both],
                    "skip": np.arange(len(both)) < len(word),
                    "head": np.concatenate([head, np.zeros(len(split), bool)]),
                })

    return run


LINK = "wid long, n long, near long, best_n long, best long"


def _first_of(group: np.ndarray, rows: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, first) of the given sorted rows in every group; first is -1 where there is none."""
    count = np.bincount(group[rows], minlength=groups)
    first = np.full(groups, -1)
    first[group[rows[::-1]]] = rows[::-1]
    return count, first


def neighbours(p: np.ndarray, s: np.ndarray, n: np.ndarray, wid: np.ndarray, skip: np.ndarray, head: np.ndarray):
    """(row, near, best row) of whole groups, sorted by pair, n falling and wid."""
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    groups = int(group[-1]) + 1 if len(group) else 0
    skips = np.flatnonzero(skip)
    skip_count, skip_first = _first_of(group, skips, groups)
    head_count, head_first = _first_of(group, np.flatnonzero(head), groups)
    _, split = _first_of(group, np.flatnonzero(~skip), groups)
    near = np.zeros(len(p), np.int64)
    best = np.full(len(p), -1)

    # Replaced: the other skip rows; the best is the first of them, or the second for the first.
    near[skips] = skip_count[group[skips]] - 1
    best[skips] = skip_first[group[skips]]
    lead = np.flatnonzero(best[skips] == skips)
    after = np.append(skips, -1)[lead + 1]
    alone = near[skips[lead]] == 0
    best[skips[lead]] = np.where(alone, -1, after)

    # Inserted: the split row has all heads as neighbours, a head has the split row.
    some = split[(split >= 0) & (head_count > 0)]
    near[some] = head_count[group[some]]
    best[some] = head_first[group[some]]
    heads = np.flatnonzero(head)
    heads = heads[split[group[heads]] >= 0]
    near[heads] += 1
    other, own = split[group[heads]], best[heads]
    take = (own < 0) | (n[other] > n[own]) | ((n[other] == n[own]) & (wid[other] < wid[own]))
    best[heads] = np.where(take, other, own)
    rows = np.flatnonzero(near > 0)
    return rows, near[rows], best[rows]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours within every pair; rows come sorted by pair, n falling and wid."""
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table) -> pa.RecordBatch:
        col = [table.column(k).to_numpy() for k in range(6)]
        rows, near, best = neighbours(*col)
        n, wid = col[2], col[3]
        return pa.RecordBatch.from_pydict({
            "wid": wid[rows], "n": n[rows], "near": near, "best_n": n[best], "best": wid[best],
        })

    for batch in batches:
        if not batch.num_rows:
            continue
        p, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        inside = np.flatnonzero((p != p[-1]) | (s != s[-1]))
        # The last pair may go on in the next batch.
        cut = int(inside[-1]) + 1 if len(inside) else 0
        if cut:
            yield out(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif held and (held[-1].column(0)[-1], held[-1].column(1)[-1]) != (batch.column(0)[0], batch.column(1)[0]):
            yield out(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield out(pa.Table.from_batches(held))


def _schema(df: DataFrame, side: str) -> str:
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{kept}, {side}_part long, {side}_row long, {side}_nodes array<long>, {side}_shared int, {side}_edge boolean"


def _trie(words: DataFrame, text: str, side: str) -> tuple[DataFrame, Numbers]:
    """Stored ``words`` with the numbers of their prefixes, and how partitions fit together."""
    ordered = words.repartitionByRange(text).sortWithinPartitions(text)
    nodes = store(ordered.mapInArrow(_number(text, side), _schema(words, side)), f"trie-{side}")
    # Two words per partition.
    edges = nodes.where(f"{side}_edge").select(f"{side}_part", f"{side}_row", text, f"{side}_nodes").collect()
    return nodes, Numbers(bridges([tuple(r) for r in edges]))


def variants(counted: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of (word, n) with ``least`` occurrences.

    Words are distinct and not null.  A form is the most frequent neighbour (of equal ones the
    first in code-point order), if it occurs at least ``ratio`` times as often.
    """
    words = store(counted.where(F.col("n") >= least).select("word", F.col("n").cast("long").alias("n")), "words")
    forward, to = _trie(words, "word", "f")
    backward, back = _trie(forward.withColumn("rev", F.reverse("word")), "rev", "r")
    pairs = backward.drop("rev").mapInArrow(_pairs(to, back), PAIR)
    links = pairs.repartition("p", "s").sortWithinPartitions(
        F.col("p"), F.col("s"), F.col("n").desc(), F.col("wid")
    ).mapInArrow(_settle, LINK)
    best = links.groupBy("wid").agg(
        F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("best"))).alias("top"),
        F.max("n").alias("_n"),
    )
    is_form = F.col("top.best_n") >= F.col("_n") * ratio
    best = store(best.select(
        "wid", "n_near", F.when(is_form, -F.col("top.best")).alias("form_wid"),
        F.when(is_form, F.col("top.best_n")).alias("form_n"),
    ), "neighbours")
    hops = best.where("form_wid IS NOT NULL").select("wid", F.col("form_wid").alias("to"))
    most = words.agg(F.max("n")).first()[0] or 0
    # Every step multiplies n by the ratio, so chains are short; each round doubles the reach.
    deepest, n = 0, max(least, 1)
    while ratio > 1 and n * ratio <= most:
        deepest, n = deepest + 1, n * ratio
    reach = 1
    while reach < deepest:
        on = hops.select(F.col("wid").alias("to"), F.col("to").alias("_next"))
        hops = store(hops.join(on, "to", "left").select("wid", F.coalesce("_next", "to").alias("to")), "hops")
        reach *= 2
    ids = forward.select(
        F.shiftleft("f_part", SHIFT).bitwiseOR(F.col("f_row")).alias("wid"), "word", "n"
    )
    forms = best.where("form_wid IS NOT NULL").select("wid", "form_wid").join(
        ids.select(F.col("wid").alias("form_wid"), F.col("word").alias("form")), "form_wid"
    ).join(hops, "wid").join(
        ids.select(F.col("wid").alias("to"), F.col("word").alias("_root")), "to"
    ).select("wid", "form", "_root")
    return ids.join(best.select("wid", "n_near", "form_n"), "wid", "left").join(forms, "wid", "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )

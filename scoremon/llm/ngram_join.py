"""Jaccard self-join on word shingles with token-combination prefixes.

Texts become sets of 64-bit shingle hashes; equal sets are one node, named by a 64-bit
signature of the set.  A fixed-size table of ``SKETCH`` counters over all shingles tells
which are frequent: the counter is never below the true count, so a shingle called rare is
proven to be in few documents.

Each set is ordered rare first.  Its prefix is extended until every set that is similar
enough must share one of its signatures: a rare shingle alone, or a pair of frequent
shingles of one hash class (a class of c frequent shingles in the prefix counts c - 1,
because a partner that keeps two of them shares their pair).  The number of hash classes
follows the size band, so a set makes only a few pairs per class; a set near the upper end
of its band also signs for the next band, where its larger partners are.

Signature groups are not expanded into pairs.  Every member is first compared with the
group's hub, the member whose signature stands nearest to the front of its set; after the
components of these links are known, only pairs across components are compared, and only
where size and position bounds leave the threshold within reach.  All links between
components are thus found, pairs inside one component need no look.  Candidates are
verified on the whole sets.

Defined cases: null, empty and blank texts have no set and stay alone; with fewer than
``k`` words the whole sequence is the one shingle; repeated rows fall into one node; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoremon.llm import kernel
from scoremon.llm.common import components, cut, discard, release, slices, slots, store, stored

CHUNK_BYTES = 1 << 19
#: Names of sets that a task remembers, so that copies beside each other are sent once.
SEEN = 100_000
SKETCH = 1 << 20
SKETCH_BLOCKS = 16
BLOOM_BITS = 1 << 23
#: A shingle is frequent if its counter passes the mean by this and by six deviations.
FREQUENT = 64
U = np.uint64


def _signature(doc: np.ndarray, g: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit name per set, whatever the order of its members."""
    ends = np.cumsum(sizes)
    sums = np.zeros(len(g) + 1, U)
    np.cumsum(kernel.mix(g ^ U(0x5851F42D4C957F2D)), out=sums[1:])
    return kernel.mix(sums[ends] - sums[ends - sizes] + sizes.astype(U))


def _fingerprints(doc: np.ndarray, g: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """Histogram of the hashes of each set, a byte per bucket and about a bucket per shingle.

    The sum of bucket minima bounds the overlap of two sets from above.  A set with a fuller
    bucket than a byte holds has no fingerprint.
    """
    buckets = np.ones(len(sizes), np.int64)
    some = sizes > 0
    buckets[some] = 1 << np.ceil(np.log2(sizes[some])).astype(np.int64)
    heads = np.cumsum(buckets) - buckets
    at = heads[doc] + ((g >> U(16)) & (buckets[doc] - 1).astype(U)).astype(np.int64)
    counts = np.bincount(at, minlength=int(buckets.sum()))
    data = counts.astype(np.uint8).tobytes()
    full = np.zeros(len(sizes), bool)
    full[np.searchsorted(heads, np.flatnonzero(counts > 255), side="right") - 1] = True
    return [
        None if f else data[h : h + b]
        for h, b, f in zip(heads.tolist(), buckets.tolist(), (full | ~some).tolist(), strict=True)
    ]


def _possible(percent: int):
    """Pairs whose fingerprints leave the threshold within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                if x[i] is not None and y[i] is not None:
                    p, q = np.frombuffer(x[i], np.uint8), np.frombuffer(y[i], np.uint8)
                    total = int(p.sum()) + int(q.sum())
                    p, q = p.astype(np.int64), q.astype(np.int64)
                    while len(p) != len(q):
                        if len(p) > len(q):
                            p = p.reshape(2, -1).sum(axis=0)
                        else:
                            q = q.reshape(2, -1).sum(axis=0)
                    most = int(np.minimum(p, q).sum())
                    if 100 * most < percent * (total - most):
                        continue
                keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())],
                names=["a", "b"],
            )

    return run


PROFILE = "doc_id long, n_shingles long, node long, fingerprint binary, block int, counts binary"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "node", "fingerprint", "block", "counts"]
    sketch, any_ = np.zeros(SKETCH, np.int64), False
    for batch in slices(batches, "text", CHUNK_BYTES):
        doc, g, sizes = kernel.shingle_sets(batch.column(batch.schema.get_field_index("text")))
        np.add.at(sketch, (g >> U(44)).astype(np.int64), 1)
        any_ = True
        node = _signature(doc, g, sizes).view(np.int64)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([
            batch.column(batch.schema.get_field_index("doc_id")),
            pa.array(sizes, pa.int64()), pa.array(node, mask=sizes == 0),
            pa.array(_fingerprints(doc, g, sizes), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
        ], names=names)
    if any_:
        parts = [p.tobytes() for p in np.split(sketch, SKETCH_BLOCKS)]
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()),
            pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.binary()),
            pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()),
        ], names=names)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = np.frombuffer(counts, np.int64)
            total[block] = total[block] + new if block in total else new
    if total:
        yield pa.RecordBatch.from_arrays([
            pa.array(list(total), pa.int32()),
            pa.array([c.tobytes() for c in total.values()], pa.binary()),
        ], names=["block", "counts"])


def frequent_table(profile: DataFrame) -> np.ndarray:
    """Which of the ``SKETCH`` counters are frequent: a bitmap of fixed size."""
    rows = (
        profile.where("block IS NOT NULL").select("block", "counts")
        .mapInArrow(_add_counts, "block int, counts binary")
        .repartition(SKETCH_BLOCKS, "block")
        .mapInArrow(_add_counts, "block int, counts binary").collect()
    )
    counts = np.zeros(SKETCH, np.int64)
    width = SKETCH // SKETCH_BLOCKS
    for block, part in rows:
        counts[block * width : (block + 1) * width] = np.frombuffer(part, np.int64)
    mean = counts.mean()
    return counts >= FREQUENT + mean + 6 * np.sqrt(mean)


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles a partner must share at least: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


def _band_signatures(doc, g, common, sizes, band, percent):
    """Signatures of whole sets that all sign for one band (arrays ordered by document).

    Returns key, document, position, the number of frequent shingles before it, and whether
    it is a pair.
    """
    heads = np.cumsum(sizes) - sizes
    classes = max(1, round(2.0**band / 12))
    paired = common if band > 3 else np.zeros(len(g), bool)
    # Rare first, then frequent; both by hash.
    order = np.argsort((doc * 2 + paired).astype(np.int64), kind="stable")
    d, h, paired = doc[order], g[order], paired[order]
    place = np.arange(len(h)) - heads[d]
    own = np.where(paired, (h >> U(8)) % U(classes), U(0)).astype(np.int64)
    worth = np.ones(len(h), np.int64)
    at = np.flatnonzero(paired)
    if len(at):
        slot = d[at] * classes + own[at]
        by = np.argsort(slot, kind="stable")
        first = np.ones(len(at), bool)
        first[1:] = slot[by][1:] != slot[by][:-1]
        worth[at[by[first]]] = 0
    # Worth before each shingle, inside its set; the prefix ends where the need is met.
    run = np.cumsum(worth) - worth
    run -= run[heads[d]]
    inside = run < (sizes - needed(sizes, percent) + 1)[d]
    before = place - (np.cumsum(~paired) - ~paired - (np.cumsum(~paired) - ~paired)[heads[d]])
    single = np.flatnonzero(inside & ~paired)
    keys, docs = [h[single]], [d[single]]
    places, slack = [place[single]], [np.zeros(len(single), np.int64)]
    pairs = [np.zeros(len(single), bool)]
    at = np.flatnonzero(inside & paired)
    if len(at):
        slot = d[at] * classes + own[at]
        at = at[np.argsort(slot, kind="stable")]
        slot = d[at] * classes + own[at]
        gap = 1
        while True:
            ok = np.flatnonzero(slot[gap:] == slot[:-gap]) if gap < len(at) else []
            if not len(ok):
                break
            a, b = at[ok], at[ok + gap]
            keys.append(kernel.mix(h[a] * kernel.WEIGHTS[20] + h[b] * kernel.WEIGHTS[21] + U(band)))
            docs.append(d[a])
            places.append(place[a])
            slack.append(before[a])
            pairs.append(np.ones(len(a), bool))
            gap += 1
    return [np.concatenate(x) for x in (keys, docs, places, slack, pairs)]


def signatures(doc, g, sizes, frequent: np.ndarray, percent: int):
    """key, document, position, slack and pair flag of every signature of every set."""
    common = frequent[(g >> U(44)).astype(np.int64)]
    band = np.zeros(len(sizes), np.int64)
    some = sizes > 0
    band[some] = np.floor(np.log2(sizes[some])).astype(np.int64)
    # The largest possible partner has 100 / percent times the size.
    upper = np.zeros(len(sizes), np.int64)
    upper[some] = np.floor(np.log2(np.maximum(sizes[some] * 100 // percent, 1))).astype(np.int64)
    has_common = np.bincount(doc[common], minlength=len(sizes)) > 0
    parts = []
    for b in sorted(set(band[some].tolist()) | set(upper[some].tolist())):
        # The second band matters only where frequent shingles can be in the prefix.
        use = some & ((band == b) | ((upper == b) & has_common))
        chosen = np.flatnonzero(use)
        if not len(chosen):
            continue
        new = np.full(len(sizes), -1, np.int64)
        new[chosen] = np.arange(len(chosen))
        mask = use[doc]
        key, d, place, slack, paired = _band_signatures(
            new[doc[mask]], g[mask], common[mask], sizes[chosen], b, percent
        )
        parts.append((key, chosen[d], place, slack, paired))
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(U), z, z, z, z.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


POSTING = "key long, node long, size int, place int, slack int, paired boolean"


def _postings(frequent: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text", CHUNK_BYTES):
            doc, g, sizes = kernel.shingle_sets(batch.column(0))
            node = _signature(doc, g, sizes).view(np.int64)
            fresh = _unseen(node, sizes, seen)
            mask = fresh[doc]
            doc, g, sizes = doc[mask], g[mask], np.where(fresh, sizes, 0)
            key, d, place, slack, paired = signatures(doc, g, sizes, frequent, percent)
            yield pa.RecordBatch.from_arrays([
                pa.array(key.view(np.int64)), pa.array(node[d]), pa.array(sizes[d], pa.int32()),
                pa.array(place, pa.int32()), pa.array(slack, pa.int32()), pa.array(paired),
            ], names=["key", "node", "size", "place", "slack", "paired"])

    return run


def _unseen(node: np.ndarray, sizes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Sets not met before in this task; forgets all when it has kept ``SEEN`` names."""
    fresh = np.zeros(len(node), bool)
    if len(seen) > SEEN:
        seen.clear()
    for i, (x, n) in enumerate(zip(node.tolist(), sizes.tolist(), strict=True)):
        if n and x not in seen:
            seen.add(x)
            fresh[i] = True
    return fresh


def reach_sql(a: str, b: str, percent: int) -> str:
    return (
        f"(least({a}slack, {b}slack) + least({a}size - {a}place, {b}size - {b}place))"
        f" * {100 + percent}L >= {percent}L * ({a}size + {b}size)"
    )


SHARED = POSTING + ", hub long, hub_size int, hub_place int, hub_slack int"


def _has_partner(part: dict, group: np.ndarray, percent: int) -> np.ndarray:
    """Rows with another node in their group for which the bounds leave hope.

    Groups of single shingles are small (the counters prove it), so this looks at all gaps.
    """
    found = np.zeros(len(group), bool)
    size = part["size"].astype(np.int64)
    rest, node = size - part["place"], part["node"]
    gap, at = 1, np.arange(len(group))
    while True:
        at = at[at + gap < len(group)]
        at = at[group[at] == group[at + gap]]
        if not len(at):
            return found
        b = at + gap
        near = np.minimum(rest[at], rest[b]) * (100 + percent) >= percent * (size[at] + size[b])
        near &= node[at] != node[b]
        found[at[near]] = True
        found[b[near]] = True
        gap += 1


def _grouping(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by key and place, pairs last: those of single keys that have a
        possible partner, with their hub; pairs pass as they are."""
        names = ["key", "node", "size", "place", "slack"]
        columns = [*names, "paired", "hub", "hub_size", "hub_place", "hub_slack"]
        rest: pa.Table | None = None

        def emit(part: dict):
            key = part["key"]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            other = part["node"] != part["node"][heads][group]
            several = np.zeros(len(heads), bool)
            several[group[other]] = True
            rows = np.flatnonzero(several[group])
            part, group = {n: x[rows] for n, x in part.items()}, group[rows]
            keep = _has_partner(part, group, percent)
            if not keep.any():
                return None
            part, group = {n: x[keep] for n, x in part.items()}, group[keep]
            new = np.ones(len(group), bool)
            new[1:] = group[1:] != group[:-1]
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            return pa.RecordBatch.from_arrays(
                [pa.array(part[n]) for n in names]
                + [pa.array(np.zeros(len(head), bool))]
                + [pa.array(part[n][head]) for n in names[1:]],
                names=columns,
            )

        for batch in batches:
            paired = batch.column(batch.schema.get_field_index("paired")).to_numpy(zero_copy_only=False)
            single = int((~paired).sum())
            if single < len(paired):
                tail = batch.slice(single)
                n = tail.num_rows
                yield pa.RecordBatch.from_arrays(
                    [tail.column(tail.schema.get_field_index(c)) for c in [*names, "paired"]]
                    + [pa.nulls(n, pa.int64())] + [pa.nulls(n, pa.int32())] * 3,
                    names=columns,
                )
            batch = batch.slice(0, single)
            t = pa.Table.from_batches([batch.select(names)])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.num_rows < 20_000:
                continue
            part = {n: rest[n].to_numpy() for n in names}
            stop = int(np.searchsorted(part["key"], part["key"][-1]))
            if stop:
                if (out := emit({n: x[:stop] for n, x in part.items()})) is not None:
                    yield out
                rest = rest.slice(stop)
        if rest is not None and rest.num_rows:
            if (out := emit({n: rest[n].to_numpy() for n in names})) is not None:
                yield out

    return run


def shared_groups(postings: DataFrame, percent: int) -> DataFrame:
    """Rows of signatures that several nodes have, each with the hub of its group.

    A rare shingle is in few documents, so its rows may meet in one task.  A pair of
    frequent shingles may be in very many: its rows are spread by key and node, hubs come
    from a grouped minimum and are joined back, where a hot key can be split.
    """
    spread = F.when(F.col("paired"), F.pmod("node", F.lit(64))).otherwise(F.lit(0))
    rows = store(
        postings.repartition(slots(postings.sparkSession), F.col("key"), spread)
        .sortWithinPartitions("paired", "key", "place", "node").mapInArrow(_grouping(percent), SHARED),
        "ngram-groups",
    )
    paired = rows.where("paired").drop("hub", "hub_size", "hub_place", "hub_slack")
    hubs = paired.groupBy("key").agg(
        F.min(F.struct("place", "node", "size", "slack")).alias("h"),
        F.min("node").alias("low"), F.max("node").alias("high"),
    ).where("low < high").select(
        "key", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size"),
        F.col("h.place").alias("hub_place"), F.col("h.slack").alias("hub_slack"),
    )
    return rows.where("NOT paired").unionByName(paired.join(hubs, "key")).drop("paired")


def _sets(bloom: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            place = (ids.fill_null(0).to_numpy().view(U) % U(BLOOM_BITS)).astype(np.int64)
            wanted = ((bloom[place >> 3] >> (place & 7)) & 1).astype(bool)
            wanted |= ids.is_null().to_numpy(zero_copy_only=False)
            chosen = batch.filter(pa.array(wanted))
            for part in slices(iter([chosen]), "text", CHUNK_BYTES):
                column = part.column(part.schema.get_field_index("text"))
                doc, g, sizes = kernel.shingle_sets(column)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(_signature(doc, g, sizes).view(np.int64)),
                    pa.array([g[e - n : e].tobytes() for n, e in zip(sizes, ends, strict=True)], pa.binary()),
                ], names=["node", "members"])

    return run


def _bloom(ids: DataFrame) -> np.ndarray:
    """Fixed-size bitmap of document ids, built by Spark in pieces."""
    place = F.pmod("doc_id", F.lit(BLOOM_BITS))
    rows = (
        ids.select((place / 32_768).cast("int").alias("block"), (place % 32_768).alias("bit"))
        .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    )
    out = np.zeros(BLOOM_BITS >> 3, np.uint8)
    for block, bits in rows:
        out[block * 4096 : (block + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "y", CHUNK_BYTES):
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            last, first_set = None, None
            for i in range(len(a)):
                if a[i] != last:
                    last, first_set = a[i], np.frombuffer(x[i], U)
                other = np.frombuffer(y[i], U)
                if len(other) > len(first_set):
                    at = np.searchsorted(other, first_set)
                    at[at == len(other)] = 0
                    same = int((other[at] == first_set).sum())
                else:
                    at = np.searchsorted(first_set, other)
                    at[at == len(first_set)] = 0
                    same = int((first_set[at] == other).sum())
                if 100 * same >= percent * (len(first_set) + len(other) - same):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())],
                names=["a", "b"],
            )

    return run


def verified(docs: DataFrame, profile: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the threshold.

    Fingerprints, an eighth of the size of the sets, refuse most pairs first.  One document
    of each remaining node, its smallest, brings the set.  A fixed-size bitmap of these
    documents spares the others; a document that passes by chance only repeats a row.
    """
    named = profile.where("node IS NOT NULL")
    carriers = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def carrying(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return carriers.join(nodes, "node", "left_semi")

    def joined(pairs: DataFrame, right: DataFrame) -> DataFrame:
        return (
            pairs.join(right.toDF("a", "x"), "a").join(right.toDF("b", "y"), "b")
            .select("a", "b", "x", "y")
        )

    prints, prints_path = stored(
        named.join(
            carrying(pairs).select("node", F.col("doc_id").alias("_d")), "node"
        ).where(F.col("doc_id").eqNullSafe(F.col("_d"))).select("node", "fingerprint"),
        "ngram-fingerprints",
    )
    pairs = cut(joined(pairs, prints).mapInArrow(_possible(percent), "a long, b long").distinct())
    discard(docs.sparkSession, prints_path)
    release(docs.sparkSession)
    bloom = _bloom(carrying(pairs).where("doc_id IS NOT NULL"))
    sets, sets_path = stored(
        docs.select("doc_id", "text").mapInArrow(_sets(bloom), "node long, members binary"),
        "ngram-sets",
    )
    links = cut(joined(pairs, sets).mapInArrow(_linked(percent), "a long, b long"))
    discard(docs.sparkSession, sets_path)
    return links


def similar_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links of at least ``percent``.
    """
    spark = docs.sparkSession
    profile = store(docs.select("doc_id", "text").mapInArrow(_profile, PROFILE), "ngram-profile")
    frequent = frequent_table(profile)
    shared = shared_groups(
        docs.select("text").mapInArrow(_postings(frequent, percent), POSTING), percent
    )
    release(spark)
    first = cut(shared.where("node <> hub").where(reach_sql("", "hub_", percent)).select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    ).distinct())
    links = verified(docs, profile, first, percent)
    release(spark)
    part = cut(components(links))
    # What is left: pairs of a group that are still in different components.
    rows = shared.join(part, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    ).join(
        part.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")),
        "hub", "left",
    ).withColumn("hub_component", F.coalesce("hub_component", "hub"))
    rows = rows.select(
        "key", "node", "size", "place", "slack", "component",
        (F.col("component") == F.col("hub_component")).alias("with_hub"), "hub",
    )
    out = rows.where("NOT with_hub").select(
        "key", *(F.col(c).alias(f"o_{c}") for c in ("node", "size", "place", "slack", "component", "hub"))
    )
    rest = out.join(rows, "key").where(
        "component <> o_component AND (with_hub OR o_node < node) AND node <> o_hub"
    ).where(reach_sql("", "o_", percent)).select(
        F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")
    ).distinct().join(first, ["a", "b"], "left_anti")
    rest = cut(rest)
    if not rest.isEmpty():
        part = cut(components(links.union(verified(docs, profile, rest, percent))))
    ids = profile.where("block IS NULL")
    named = ids.join(part, "node", "left").withColumn(
        "group", F.coalesce("component", "node")
    )
    # Cut off, so that the join below has shuffles of its own, which Spark can split at a hot group.
    low = cut(named.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("low")))
    return named.join(low, "group", "left").select(
        "doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id")
    )

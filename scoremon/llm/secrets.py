"""Secret scan: fixed patterns, and character Markov models for what patterns miss.

Built of SQL functions only.  Matches come from ``regexp_extract_all``; their places from
the lengths of what ``split`` leaves between them, so no text leaves the JVM.  Sums over the
matches of one text run in blocks, and matches meet the spans of patterns in one sorted
order, so time grows with the text (times the logarithm of its matches) and not its square.

Two first-order Markov chains over characters are counted from labelled strings, one of
random strings and one of ordinary identifiers.  A run of identifier characters of at least
``MIN_RUN`` that no pattern covers is a secret if its mean log-likelihood ratio per
transition passes a threshold: the larger of ``MARGIN`` and the score that ``QUANTILE`` of
the ordinary samples stay below.

Defined cases: null reads as empty text; without random samples only the patterns apply;
repeated rows are reported each; other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds and their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8

KINDS = ("assign", "access", "hex", "markov")
MIN_RUN = 20
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SMOOTHING = 0.5
MARGIN = 0.25
QUANTILE = 0.999
#: Expected number of documents that ordinary strings come from; random ones come from all.
ORDINARY_DOCS = 1_000
#: Beyond the end of every text.
FAR = 2**31 - 1
SPAN = "array<struct<start:int,kind:int,stop:int>>"


#: Elements that one fold appends to; longer arrays are folded in blocks of this length.
FOLD = 128


def _running(values: Column, first: Column, combine: Callable[[Column, Column], Column], kind: str) -> Column:
    """``first`` combined with all values before each value: a fold that appends to an array."""
    start = F.struct(first.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(
        values, start,
        lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often and deep it is used in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, zero: Column, combine: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """``zero`` combined with all values before each value (``combine`` associative).

    Appending copies the array, so one fold over a long array would be quadratic.  It is cut
    into blocks: totals of blocks give every block its start, and folds run inside blocks.
    """
    def cut(v: Column) -> Column:
        return F.when(F.size(v) > 0, F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLD).cast("int")),
            lambda k: F.slice(v, k * FOLD + 1, FOLD),
        )).otherwise(F.array().cast(f"array<array<{kind}>>"))

    def summed(blocks: Column) -> Column:
        starts = _running(F.transform(blocks, lambda b: F.aggregate(b, zero, combine)), zero, combine, kind)
        return F.flatten(F.zip_with(blocks, starts, lambda b, first: _running(b, first, combine, kind)))

    return _let(values, lambda v: _let(cut(v), summed))


def _matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """(start, kind, stop, hit, value) of all matches, in order, in time linear in the text."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    lengths = F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h))
    # Where the gap before a match starts: the sum of all gaps and matches before it.
    joined = F.arrays_zip(
        before(lengths, F.lit(0), lambda a, b: a + b).alias("from"), gaps.alias("gap"), hits.alias("hit"),
        values.alias("value"),
    )
    return F.transform(joined, lambda x: F.struct(
        (x["from"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"),
        (x["from"] + F.length(x["gap"]) + F.length(x["hit"])).alias("stop"), x["hit"].alias("hit"),
        x["value"].alias("value"),
    ))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["stop"]))


def _found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of all matches whose ``group`` has ``least`` characters, in order."""
    found = _matches(text, pattern, kind, group)
    if least:
        found = F.filter(found, lambda x: F.length(x["value"]) >= least)
    return F.when(text.rlike(pattern), _bare(found).cast(SPAN)).otherwise(F.array().cast(SPAN))


def apart(runs: Column, spans: Column) -> Column:
    """The runs that overlap no span, from both in one sorted order.

    Runs do not overlap each other.  A span that reaches into a run starts before the run and
    ends after its start, or starts inside it: the furthest end so far and the next start tell.
    """
    both = F.array_sort(F.concat(
        F.transform(spans, lambda s: F.struct(
            s["start"].alias("at"), F.lit(0).alias("run"), s["stop"].alias("stop"), F.lit("").alias("hit"))),
        F.transform(runs, lambda r: F.struct(
            r["start"].alias("at"), F.lit(1).alias("run"), r["stop"].alias("stop"), r["hit"].alias("hit"))),
    ))

    def kept(line: Column) -> Column:
        ends = F.transform(line, lambda x: F.when(x["run"] == 0, x["stop"]).otherwise(0))
        starts = F.transform(line, lambda x: F.when(x["run"] == 0, x["at"]).otherwise(FAR))
        marked = F.arrays_zip(
            line.alias("x"), before(ends, F.lit(0), lambda a, b: F.greatest(a, b)).alias("reach"),
            # The first start of a span after each entry: the same from the other end.
            F.reverse(before(F.reverse(starts), F.lit(FAR), lambda a, b: F.least(a, b))).alias("ahead"),
        )
        return F.filter(
            marked, lambda m: (m["x"]["run"] == 1) & (m["reach"] <= m["x"]["at"]) & (m["ahead"] >= m["x"]["stop"])
        )

    return F.transform(_let(both, kept), lambda m: F.struct(
        m["x"]["at"].alias("start"), F.lit(3).alias("kind"), m["x"]["stop"].alias("stop"), m["x"]["hit"].alias("hit")
    ))


def base_spans(text: Column) -> Column:
    """Spans of the three pattern kinds, by start and kind."""
    return F.array_sort(F.concat(
        _found(text, ASSIGN, 0, 1, ASSIGN_VALUE), _found(text, ACCESS, 1), _found(text, HEX, 2)
    ))


@dataclass
class Model:
    """Log-likelihood ratio per character pair, and the threshold on its mean."""

    ratio: list[float]
    threshold: float


def score(string: Column, ratio: list[float]) -> Column:
    """Mean log-likelihood ratio over the transitions of a string of ``ALPHABET``."""
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")
    at = F.transform(
        F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1
    )
    total = F.aggregate(
        at, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(
            (acc["last"] >= 0) & (c >= 0), F.get(table, acc["last"] * len(ALPHABET) + c)
        ).otherwise(0.0)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return total / F.greatest(F.length(string) - 1, F.lit(1))


def train(samples: DataFrame) -> Model | None:
    """Model of labelled strings: ``sample`` and ``label``, 1 random and 0 ordinary."""
    at = F.filter(
        F.transform(F.split("sample", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1),
        lambda c: c >= 0,
    )
    pairs = samples.where("label IN (0, 1)").select("label", at.alias("at")).where("size(at) > 1").select(
        "label", F.explode(F.zip_with(
            F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at") - 1),
            lambda a, b: a * len(ALPHABET) + b,
        )).alias("pair"),
    )
    n = len(ALPHABET)
    # One row per label and character pair: bounded by the alphabet.
    counts = {(r[0], r[1]): r[2] for r in pairs.groupBy("label", "pair").count().collect()}
    if not any(label == 1 for label, _ in counts):
        return None
    ratio = []
    for a in range(n):
        totals = [sum(counts.get((k, a * n + b), 0) for b in range(n)) for k in (0, 1)]
        for b in range(n):
            p, q = ((counts.get((k, a * n + b), 0) + SMOOTHING) / (totals[k] + SMOOTHING * n) for k in (1, 0))
            ratio.append(math.log(p / q))
    ordinary = samples.where("label = 0 AND length(sample) > 1").select(
        F.percentile_approx(score(F.col("sample"), ratio), F.lit(QUANTILE), F.lit(10_000))
    ).first()[0]
    return Model(ratio, max(MARGIN, ordinary if ordinary is not None else MARGIN))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """Random strings: the values that patterns find; ordinary ones: words beside them.

    Random strings are rare, so all documents give theirs; ordinary ones come from a sample
    of documents of bounded expected size, taken by id hashes.
    """
    share = min(1.0, ORDINARY_DOCS / max(docs.count(), 1))
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)
    text = F.coalesce("text", F.lit(""))
    all_ = docs.select("doc_id", text.alias("text"))
    text = F.col("text")
    values = F.concat(
        F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= ASSIGN_VALUE),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
    )
    random = all_.where(
        text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX)
    ).select(F.explode(values).alias("sample"), F.lit(1).alias("label"))
    rest = text
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = all_.where(h < F.lit(int(share * 2**31))).select(
        F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))).alias("sample"),
        F.lit(0).alias("label"),
    ).distinct()
    return random.unionByName(ordinary)


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: (start, kind number, stop) in code points."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("base_spans", base_spans(text))
    if model is None:
        return out.withColumn("all_spans", F.col("base_spans"))
    out = out.withColumn("_runs", F.when(text.rlike(RUN), apart(_matches(text, RUN, 3), F.col("base_spans"))))
    added = F.filter("_runs", lambda r: score(r["hit"], model.ratio) > model.threshold)
    spans = F.array_sort(F.concat("base_spans", F.coalesce(_bare(added).cast(SPAN), F.array().cast(SPAN))))
    return out.withColumn("all_spans", spans).drop("_runs")


def listed(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")
    )), ",")


def counted(kind: str, spans: str = "base_spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(found: DataFrame) -> DataFrame:
    """Result of ``scan`` with every found span replaced by its kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = F.coalesce("text", F.lit(""))
    done = F.aggregate(
        "all_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["stop"] <= acc["at"], acc).otherwise(F.struct(
            s["stop"].alias("at"),
            F.concat(
                acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                F.when(s["start"] >= acc["at"], F.get(names, s["kind"])).otherwise(""),
            ).alias("out"),
        )),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return found.withColumn("text", F.when(F.col("text").isNotNull(), done)).drop("base_spans", "all_spans")

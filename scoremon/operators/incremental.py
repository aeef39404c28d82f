"""Monthly summaries that are kept from run to run: only new or changed months are read again.

The base is a Parquet folder partitioned by month.  Everything that the reports of a run need
is a sum or a sketch per month, and those merge: cohort sums per segment, driver cells, score
counts behind Gini and KS, and quantile sketches of numeric columns.  A store keeps them in
parts, one per refresh, and a small manifest that names for every month the part that holds it
and a fingerprint of the month's files.  A refresh reads the months whose files are new or
changed, writes their part and then replaces the manifest; a run that dies before that leaves
the old summaries as they were.  One refresh at a time.

Other settings make every month new.  A month that has left the base leaves the summaries.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremon.config import MonitorConfig
from scoremon.operators import calibration, discrimination
from scoremon.operators import settings as by_settings
from scoremon.sources.tables import _files, read_folder, write_folder

TABLES = ("sums", "cells", "scores", "sketches")
#: Parts after which a refresh writes all months into one.
PARTS = 24
#: Size parameter of a quantile sketch; its rank error is about 1.3 % / (k / 200).
SKETCH_K = 800


@dataclass(frozen=True)
class SummarySpec:
    """What is summed: drivers, numeric scores, horizons beside those of the reports, predicate."""

    drivers: Sequence[str]
    numeric: Sequence[str]
    horizons: Sequence[int] = (24, 21, 18, 12)
    use: str = ""

    def all_horizons(self, cfg: MonitorConfig) -> list[int]:
        return calibration.report_horizons(cfg, [*self.horizons, cfg.target - 6, *by_settings.horizons(cfg)])


def month_summaries(df: DataFrame, cfg: MonitorConfig, spec: SummarySpec) -> dict[str, DataFrame]:
    """The mergeable tables of some months of the base, all by month."""
    base, horizons = cfg.select_universe(df), spec.all_horizons(cfg)
    names = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in spec.numeric)
    values = base.select(cfg.month, F.expr(f"stack({len(spec.numeric)}, {names}) AS (variable, value)"))
    known = F.when(~F.isnan("value"), F.col("value"))
    return {
        "sums": calibration.cohort_sums(
            cfg.select_universe(df, spec.use), cfg, horizons, (cfg.segment,), early=True
        ),
        "cells": calibration.driver_cells(base, cfg, spec.drivers, horizons, by=(cfg.segment,)),
        "scores": discrimination.driver_counts(base, cfg, {c: c for c in spec.numeric}, spec.horizons),
        "sketches": values.groupBy("variable", cfg.month).agg(
            F.count(known).alias("n"), F.kll_sketch_agg_double(known, F.lit(SKETCH_K)).alias("sketch")
        ).filter("n > 0"),
    }


@dataclass(frozen=True)
class Refresh:
    """Months that a refresh has read, and those that it has dropped."""

    read: tuple[int, ...]
    dropped: tuple[int, ...]


class SummaryStore:
    """Summaries below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, cfg: MonitorConfig, spec: SummarySpec):
        self.spark, self.path, self.cfg, self.spec = spark, path.rstrip("/"), cfg, spec
        self.settings = hashlib.sha256(repr((cfg, spec, SKETCH_K)).encode()).hexdigest()

    def months_of(self, base: str) -> dict[int, str]:
        """Fingerprint of the files of every month folder: names, sizes and times."""
        fs, make = _files(self.spark, base)
        found = {}
        for entry in fs.listStatus(make(base)):
            name, _, value = entry.getPath().getName().partition("=")
            if entry.isDirectory() and name == self.cfg.month and value.isdigit():
                files, seen = fs.listFiles(entry.getPath(), True), []
                while files.hasNext():
                    f = files.next()
                    seen.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
                found[int(value)] = hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()
        return found

    def manifest(self) -> dict[int, tuple[str, str]]:
        """month -> (fingerprint, part) under the settings of this store."""
        fs, make = _files(self.spark, self.path)
        if not any(fs.exists(make(f"{self.path}/{name}")) for name in ("manifest", ".manifest.previous")):
            return {}
        # A row per month.
        rows = read_folder(self.spark, f"{self.path}/manifest").filter(F.col("settings") == self.settings).collect()
        return {r.month: (r.fingerprint, r.part) for r in rows}

    def changed(self, base: str) -> tuple[list[int], list[int], dict[int, str]]:
        """Months to read, months to drop, and the fingerprints as they are now."""
        now, known = self.months_of(base), self.manifest()
        read = sorted(m for m, mark in now.items() if m not in known or known[m][0] != mark)
        return read, sorted(set(known) - set(now)), now

    def months(self, base: str, months: Sequence[int]) -> DataFrame:
        """The base, with only the folders of some months."""
        root = base.rstrip("/")
        return self.spark.read.option("basePath", root).parquet(*[f"{root}/{self.cfg.month}={m}" for m in months])

    def refresh(self, base: str) -> Refresh:
        """Bring the summaries up to the base."""
        read, dropped, now = self.changed(base)
        known = {m: x for m, x in self.manifest().items() if m in now}
        if read:
            part = uuid.uuid4().hex
            self._write(part, month_summaries(self.months(base, read), self.cfg, self.spec))
            known |= {m: (now[m], part) for m in read}
        if read or dropped:
            if len({part for _, part in known.values()}) > PARTS:
                known = self._compacted(known)
            self._publish(known)
        return Refresh(tuple(read), tuple(dropped))

    def table(self, name: str) -> DataFrame:
        """One of the summaries over all months, each month from the part that holds it now."""
        return self._table(name, self.manifest())

    def tables(self) -> dict[str, DataFrame]:
        known = self.manifest()
        return {name: self._table(name, known) for name in TABLES}

    def _table(self, name: str, known: dict[int, tuple[str, str]]) -> DataFrame:
        if not known:
            raise ValueError("no summaries under these settings: refresh first")
        by_part: dict[str, list[int]] = {}
        for month, (_, part) in known.items():
            by_part.setdefault(part, []).append(month)
        out = None
        for part, months in sorted(by_part.items()):
            rows = self.spark.read.parquet(f"{self.path}/parts/{part}/{name}").filter(F.col(self.cfg.month).isin(months))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _write(self, part: str, frames: dict[str, DataFrame]) -> None:
        for name, frame in frames.items():
            frame.write.parquet(f"{self.path}/parts/{part}/{name}")

    def _compacted(self, known: dict[int, tuple[str, str]]) -> dict[int, tuple[str, str]]:
        part = uuid.uuid4().hex
        self._write(part, {name: self._table(name, known) for name in TABLES})
        return {m: (mark, part) for m, (mark, _) in known.items()}

    def _publish(self, known: dict[int, tuple[str, str]]) -> None:
        rows = [(m, mark, part, self.settings) for m, (mark, part) in known.items()]
        write_folder(self.spark.createDataFrame(
            rows, "month INT, fingerprint STRING, part STRING, settings STRING"
        ).coalesce(1), f"{self.path}/manifest")
        fs, make = _files(self.spark, self.path)
        used = {part for _, part in known.values()}
        for entry in fs.listStatus(make(f"{self.path}/parts")):
            if entry.getPath().getName() not in used:
                fs.delete(entry.getPath(), True)


def window_quantiles(
    sketches: DataFrame, probs: Sequence[float], start: int, end: int, month: str = "codmes"
) -> DataFrame:
    """(variable, n, cuts) of a window of months, from its merged sketches.

    Every cut is off by the rank error of a sketch (see ``SKETCH_K``) at most.
    """
    return sketches.filter(F.col(month).between(start, end)).groupBy("variable").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_merged")
    ).select(
        "variable", "n",
        F.kll_sketch_get_quantile_double("_merged", F.array(*[F.lit(float(p)) for p in probs])).alias("cuts"),
    )

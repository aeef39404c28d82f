"""Parameters shared by the monitoring operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremon.functions.months import index_of, shift_yyyymm

# Months after the newest closed cohort -> newest usable target
# horizon of that cohort (months of observed history read as the target).
USABLE_HORIZON = MappingProxyType(
    {1: 23, 2: 22, 3: 22, 4: 21, 5: 20, 6: 19, 7: 18, 8: 17, 9: 16}
)


@dataclass(frozen=True)
class MonitorConfig:
    """What to monitor and how; immutable, so one config serves many operators.

    ``closed_month`` is the newest cohort whose ``target`` window is complete.
    ``pds`` are the predicted default probabilities, the first one being the
    score in use.  ``distance`` holds the months from origination to default
    (null = no default), from which every "defaulted within k months" target
    is derived; with ``target_prefix`` the stored 0/1 columns
    ``<prefix><k>`` are read instead.  ``early`` names a stored 0/1 flag of
    early delinquency, otherwise "defaulted within ``early_target`` months"
    stands for it.  ``early_usable`` maps months after its newest closed cohort to the horizon
    it is projected from; by default the defaults until then, where ``distance`` tells them.
    """

    closed_month: int
    pds: tuple[str, ...] = ("pd",)
    month: str = "codmes"
    amount: str = "amount"
    distance: str = "dist_def"
    segment: str = "segment"
    universe: str = ""
    target_prefix: str = ""
    early: str = ""
    target: int = 24
    early_target: int = 3
    early_usable: dict[int, int] | None = None
    history: int = 14
    open_months: int = 6
    percentile: float = 0.75
    usable: dict[int, int] = field(default_factory=lambda: dict(USABLE_HORIZON))

    @classmethod
    def for_run_month(cls, run_month: int, target: int = 24, **kw) -> "MonitorConfig":
        """Config whose closed cohort is ``target`` months before ``run_month``."""
        return cls(closed_month=shift_yyyymm(run_month, -target), target=target, **kw)

    def with_(self, **kw) -> "MonitorConfig":
        return replace(self, **kw)

    @property
    def closed_index(self) -> int:
        return index_of(self.closed_month)

    def cutoff(self, k: int) -> int:
        """Cohort ``a_k``: ``12 - k`` months after the newest closed cohort."""
        return shift_yyyymm(self.closed_month, 12 - k)

    def defaulted(self, k: int) -> Column:
        """0/1: defaulted within ``k`` months of origination (null distance -> 0)."""
        if self.target_prefix:
            return F.col(f"{self.target_prefix}{k}")
        return F.when(F.col(self.distance) <= k, 1).otherwise(0)

    def early_flag(self) -> Column:
        return F.col(self.early) if self.early else self.defaulted(self.early_target)

    def target_inputs(self, horizons) -> list[str]:
        """Columns the targets of these horizons are derived from."""
        stored = [f"{self.target_prefix}{k}" for k in sorted(set(horizons))]
        return stored if self.target_prefix else [self.distance]

    def select_universe(self, df: DataFrame, extra: str = "") -> DataFrame:
        """Apply the monitored universe and a free-form predicate ('' = none)."""
        return where(where(df, self.universe), extra)


def where(df: DataFrame, predicate: str | None) -> DataFrame:
    """Filter by a SQL predicate string; blank means keep everything."""
    if predicate is None or not predicate.strip():
        return df
    return df.filter(F.expr(predicate))


def product_universe(
    df: DataFrame,
    equals: dict[str, object] | None = None,
    excluded: dict[str, list] | None = None,
    allowed: dict[str, list] | None = None,
) -> DataFrame:
    """Rows with the given values, without excluded ones, within allowed lists.

    A null in an excluded column drops the row, as ``NOT IN`` does.
    """
    for c, v in (equals or {}).items():
        df = df.filter(F.col(c) == v)
    for c, values in (excluded or {}).items():
        df = df.filter(~F.col(c).isin(*values))
    for c, values in (allowed or {}).items():
        df = df.filter(F.col(c).isin(*values))
    return df

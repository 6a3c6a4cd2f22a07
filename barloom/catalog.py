"""A registry of features: what makes each column, over which parameters, and what is known of it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.series import Series

CATEGORIES = ("Trend", "Mean Reversion", "Microstructure", "Diagnostic")
OUTCOMES = ("Pending", "Predictive", "Not Predictive", "Inconclusive")
_LAMBDAS = (1e6, 1e7, 1e8, 1e9, 3.9e9, 1e11)


@dataclass(frozen=True)
class FeatureSpec:
    """make(series, out, **parameters) adds the column; columns of trends are named `trend`, ATR `atr`."""

    name: str
    category: str
    make: Callable[..., Series]
    parameters: Mapping[str, Sequence[float]]
    expected_stationary: bool | None = None
    outcome: str = "Pending"
    notes: str = ""

    def __post_init__(self) -> None:
        if self.category not in CATEGORIES or self.outcome not in OUTCOMES:
            raise ValueError(f"unknown category or outcome of {self.name}")


class Catalog:
    def __init__(self, specs: Sequence[FeatureSpec] = ()) -> None:
        self._specs: dict[str, FeatureSpec] = {}
        for s in specs:
            self.register(s)

    def __len__(self) -> int:
        return len(self._specs)

    def register(self, spec: FeatureSpec) -> None:
        """ValueError for a name that is taken."""
        if spec.name in self._specs:
            raise ValueError(f"{spec.name} is registered")
        self._specs[spec.name] = spec

    def get(self, name: str) -> FeatureSpec:
        """KeyError for a name that isn't there."""
        return self._specs[name]

    def update_outcome(self, name: str, outcome: str, notes: str = "") -> None:
        self._specs[name] = replace(self.get(name), outcome=outcome, notes=notes or self.get(name).notes)

    def all(self) -> list[FeatureSpec]:
        return list(self._specs.values())

    def by_category(self, category: str) -> list[FeatureSpec]:
        return [s for s in self.all() if s.category == category]

    def pending(self) -> list[FeatureSpec]:
        return [s for s in self.all() if s.outcome == "Pending"]

    def summary(self, spark: SparkSession) -> DataFrame:
        """(name, category, expected_stationary, parameters, outcome, notes)."""
        rows = [(s.name, s.category, s.expected_stationary, {k: [float(v) for v in vs] for k, vs in s.parameters.items()}, s.outcome, s.notes) for s in self.all()]
        return spark.createDataFrame(rows, "name string, category string, expected_stationary boolean, parameters map<string, array<double>>, outcome string, notes string")


def standard() -> Catalog:
    """The eleven features of the research. Trends of a lambda and window are made by `trend.causal_trends` first."""
    return Catalog([
        FeatureSpec("hp_trend_level", "Trend", lambda s, out: s.put(**{out: s.df["trend"]}), {"lambda": _LAMBDAS, "window": (500,)}, False),
        FeatureSpec("hp_trend_slope", "Trend", lambda s, out: s.slope(out, "trend"), {"lambda": _LAMBDAS}, True),
        FeatureSpec("hp_trend_curvature", "Trend", lambda s, out: s.curvature(out, "trend"), {"lambda": _LAMBDAS}, True),
        FeatureSpec("ma_spread_on_trend", "Trend", lambda s, out, t1, t2, atr=None: s.ma_spread(out, "trend", t1, t2, atr), {"lambda": _LAMBDAS, "t1": (24, 48, 72), "t2": (120, 168, 240, 480)}),
        FeatureSpec("ma_crossover_signal", "Trend", lambda s, out, t1, t2: s.crossover(out, "trend", t1, t2), {"lambda": _LAMBDAS, "t1": (24, 48, 72), "t2": (120, 168, 240, 480)}),
        FeatureSpec("ma_crossover_age", "Trend", lambda s, out, t1, t2: s.crossover_age(out, "trend", t1, t2), {"t1": (24, 48, 72), "t2": (120, 168, 240, 480)}, False),
        FeatureSpec("trend_deviation_from_ma", "Mean Reversion", lambda s, out, t2: s.deviation_from_ma(out, "trend", t2, "atr"), {"t2": (120, 168, 240, 480), "atr_window": (20,)}),
        FeatureSpec("distance_from_ma_20_raw", "Mean Reversion", lambda s, out: s.distance_from_ma(out, "close", 20), {"window": (20,)}, True),
        FeatureSpec("ma_spread_raw_5020", "Trend", lambda s, out: s.ma_spread(out, "close", 20, 50), {"t1": (20,), "t2": (50,)}),
        FeatureSpec("lambda_sensitivity_score", "Diagnostic", lambda s, out, trends, atr=None: s.disagreement(out, trends, atr), {"lambda": _LAMBDAS, "atr_window": (20,)}, True),
        FeatureSpec("vol_regime", "Diagnostic", lambda s, out, returns="lr": s.vol_regime(out, returns), {"vol_window": (20,), "classification_window": (252,)}, True),
    ])

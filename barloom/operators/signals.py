"""Combining features to a signal, and a signal to a position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("binary_threshold", "proportional", "ensemble_vote")


@dataclass(frozen=True)
class SignalConfig:
    mode: str = "binary_threshold"
    threshold: float = 0.3
    weights: Mapping[str, float] | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")


def _sum(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def linear(features: Sequence[str], weights: Mapping[str, float] | None = None) -> Column:
    """Weighted mean of the features that aren't null. Weights are over the sum of their sizes; features without one
    weigh 0; a row whose weights cancel is null."""
    w = {f: 1.0 / len(features) for f in features}
    if weights is not None:
        total = sum(abs(float(weights.get(f, 0.0))) for f in features)
        if total == 0:
            raise ValueError("the weights sum to 0")
        w = {f: float(weights.get(f, 0.0)) / total for f in features}
    top = _sum([F.coalesce(F.col(f), F.lit(0.0)) * w[f] for f in features])
    return F.try_divide(top, _sum([F.when(F.col(f).isNotNull(), F.lit(w[f])).otherwise(F.lit(0.0)) for f in features]))


def vote(features: Sequence[str]) -> Column:
    """Sign of the sum of signs; nulls abstain."""
    return F.signum(_sum([F.coalesce(F.signum(f), F.lit(0.0)) for f in features]))


def combined(features: Sequence[str], config: SignalConfig = SignalConfig()) -> Column:
    if not features:
        return F.lit(None).cast("double")
    return vote(features) if config.mode == "ensemble_vote" else linear(features, config.weights)


def position(signal: Column, mode: str = "binary_threshold", threshold: float = 0.3) -> Column:
    """-1.0, 0.0 or 1.0 beyond the thresholds (strictly), the signal within [-1, 1], or its sign; null is 0.0."""
    if mode == "binary_threshold":
        return F.when(signal > threshold, 1.0).when(signal < -threshold, -1.0).otherwise(0.0)
    if mode == "proportional":
        return F.when(signal.isNotNull(), F.greatest(F.least(signal, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
    if mode == "ensemble_vote":
        return F.coalesce(F.signum(signal), F.lit(0.0))
    raise ValueError(f"mode must be one of {MODES}, not {mode!r}")

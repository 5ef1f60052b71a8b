"""Ordered levels as small integers, and arithmetic on them that stays within bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Orders are positions. Fixed values.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
CONFIDENCES = ["low", "medium", "high"]
VERDICTS = ["pass", "warn", "block"]


def severity(name: str) -> int:
    return SEVERITIES.index(name)


def confidence(name: str) -> int:
    return CONFIDENCES.index(name)


def name_of(rank: Column, names: list[str]) -> Column:
    """The name of a rank; null for null and for ranks outside the list."""
    return F.get(F.array(*[F.lit(n) for n in names]), rank.cast("int"))


def demote(sev: Column, steps: Column | int = 1) -> Column:
    return F.greatest(sev - steps, F.lit(0))


def promote(sev: Column, steps: Column | int = 1) -> Column:
    return F.least(sev + steps, F.lit(len(SEVERITIES) - 1))


def lower_confidence(conf: Column, steps: Column | int = 1) -> Column:
    return F.greatest(conf - steps, F.lit(0))


def effective_severity(sev: Column, conf: Column) -> Column:
    """One step down where confidence is low."""
    return F.when(conf == 0, demote(sev)).otherwise(sev)


def verdict(worst: Column, block_at: int = 3, warn_at: int = 2) -> Column:
    """Verdict rank for the greatest effective severity; pass for none."""
    return F.when(worst >= block_at, 2).when(worst >= warn_at, 1).otherwise(0)

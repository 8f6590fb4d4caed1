"""Summaries of timed runs, and how two of them differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(runs: DataFrame, name: str, measures: list[str], total: str) -> DataFrame:
    """A row for each name: average of every measure to two places, and least and most of the total."""
    averages = [F.round(F.avg(m), 2).alias(f"average_{m}") for m in measures]
    return runs.groupBy(name).agg(*averages, F.min(total).alias(f"min_{total}"), F.max(total).alias(f"max_{total}"))


def delta(before: DataFrame, after: DataFrame, name: str, measures: list[str]) -> DataFrame:
    """after less before for names that both have."""
    a = after.select(name, *[F.col(m).alias(f"__{m}") for m in measures])
    return before.join(a, name).select(name, *[(F.col(f"__{m}") - F.col(m)).alias(f"delta_{m}") for m in measures])

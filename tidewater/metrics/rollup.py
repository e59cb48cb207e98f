"""Rollups of mergeable states (MET-1, MET-4).

A rollup holds, per day and dimension values, the states that a semantic
model's measures need: sums and counts, least and greatest values.  States of
finer groups merge into those of coarser ones, so weeks, months and averages over
fewer dimensions are answered from the stored rollup and the fact is
read once, when the rollup is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.metrics.views import SemanticModel
from tidewater.sources.publish import publish, published

DAY = "date_day"
#: States of each aggregate; an average is a sum over a count.
STATES = {"average": ("sum", "count"), "sum": ("sum",), "count": ("count",), "min": ("min",), "max": ("max",)}
FOLD = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
#: How a state of groups is merged.
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
GRAINS = ("day", "week", "month", "quarter", "year")


def _state(kind: str, column: str) -> str:
    return f"{kind}__{column}"


@dataclass
class Rollup:
    states: DataFrame
    dimensions: list[str]
    measures: dict[str, tuple[str, str]]

    def metric(self, name: str, by: Sequence[str] = (), grain: str = "day", digits: int | None = None) -> DataFrame:
        """One measure by ``grain`` (column ``period``) and ``by``, from the states alone.

        ``digits`` rounds an average, a little off the half-way points: sums of
        doubles differ in the last bit with the order of addition.
        """
        if name not in self.measures:
            raise KeyError(f"unknown measure {name!r}")
        if grain not in GRAINS:
            raise ValueError(f"grain must be one of {GRAINS}")
        for d in by:
            if d not in self.dimensions:
                raise KeyError(f"unknown dimension {d!r}")
        agg, column = self.measures[name]
        merged = {k: MERGE[k](F.col(f"`{_state(k, column)}`")) for k in STATES[agg]}
        value: Column = merged["sum"] / F.nullif(merged["count"], F.lit(0)) if agg == "average" else merged[STATES[agg][0]]
        if digits is not None:
            value = F.round(value * F.lit(10.0**digits) + F.lit(1e-4)) / F.lit(10.0**digits)
        period = F.date_trunc(grain.upper(), F.col(DAY)).cast("date").alias("period")
        return self.states.groupBy(period, *by).agg(value.alias(name))


def build_rollup(model: SemanticModel, dimensions: Sequence[str], root: str, name: str) -> Rollup:
    """Compute the states of every measure by day and ``dimensions`` and publish them as ``<root>/rollups/<name>``."""
    needed = dict.fromkeys((kind, column) for agg, column in model.measures.values() for kind in STATES[agg])
    day = F.to_date(F.col(model.time_dimension)).alias(DAY)
    whole = {f.name for f in model.model.schema.fields if isinstance(f.dataType, T.IntegralType)}
    states = [
        (FOLD[k](F.col(f"`{c}`")).cast("long") if k == "sum" and c in whole else FOLD[k](F.col(f"`{c}`"))).alias(_state(k, c))
        for k, c in needed
    ]
    table = model.model.groupBy(day, *dimensions).agg(*states)
    return Rollup(publish(table, root, "rollups", name), list(dimensions), dict(model.measures))


def open_rollup(spark: SparkSession, root: str, name: str, dimensions: Sequence[str], measures: dict[str, tuple[str, str]]) -> Rollup:
    """A rollup published by this or another session."""
    return Rollup(published(spark, root, "rollups", name), list(dimensions), dict(measures))

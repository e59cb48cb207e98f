"""Declared data-quality checks (DQ-1..4) as aggregated Spark jobs.

Per model, all ``not_null`` and ``accepted_values`` checks are answered by
ONE aggregation pass (``count_if`` / filtered ``count_distinct`` per
column); each ``unique`` check is one ``groupBy(col)`` whose partial
aggregation runs map-side.  Results are small frames unioned into one
report: model, column_name, check_name, failing_rows, status.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_COLUMNS = ["model", "column_name", "check_name", "failing_rows", "status"]


@dataclass
class ModelChecks:
    model: str
    not_null: list[str] = field(default_factory=list)
    unique: list[str] = field(default_factory=list)
    accepted: dict[str, list[str]] = field(default_factory=dict)


def _row(model: str, column: str, check: str, failing):
    return F.struct(
        F.lit(model).alias("model"),
        F.lit(column).alias("column_name"),
        F.lit(check).alias("check_name"),
        failing.cast("long").alias("failing_rows"),
    )


def check_model(df: DataFrame, spec: ModelChecks) -> DataFrame:
    """All checks of one model -> report rows."""
    parts: list[DataFrame] = []
    single = []
    for c in spec.not_null:
        single.append(_row(spec.model, c, "not_null", F.count_if(F.col(c).isNull())))
    for c, values in spec.accepted.items():
        bad = F.when(~F.col(c).isin(*values), F.col(c))  # NULL is not a failure
        single.append(_row(spec.model, c, "accepted_values", F.count_distinct(bad)))
    if single:
        one_pass = df.agg(F.array(*single).alias("r")).select(F.explode("r").alias("r")).select("r.*")
        parts.append(one_pass)
    for c in spec.unique:
        dup_values = df.where(F.col(c).isNotNull()).groupBy(c).count().where(F.col("count") > 1)
        parts.append(dup_values.agg(F.count(F.lit(1)).alias("n")).select(
            _row(spec.model, c, "unique", F.col("n")).alias("r")).select("r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_checks(resolve, specs: list[ModelChecks]) -> DataFrame:
    """``resolve(model_name) -> DataFrame``; returns the unioned report (DQ-4)."""
    out = None
    for spec in specs:
        part = check_model(resolve(spec.model), spec)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("status", F.when(F.col("failing_rows") == 0, F.lit("pass")).otherwise(F.lit("fail")))


def check_not_null(df: DataFrame, model: str, *cols: str) -> DataFrame:
    return run_checks(lambda _: df, [ModelChecks(model, not_null=list(cols))])


def check_unique(df: DataFrame, model: str, *cols: str) -> DataFrame:
    return run_checks(lambda _: df, [ModelChecks(model, unique=list(cols))])


def check_accepted(df: DataFrame, model: str, col: str, values: list[str]) -> DataFrame:
    return run_checks(lambda _: df, [ModelChecks(model, accepted={col: values})])


def oracle_sql(specs: list[ModelChecks]) -> str:
    """The same report as plain SQL over views named after the models."""
    parts = []
    for s in specs:
        for c in s.not_null:
            parts.append(
                f"select '{s.model}' as model, '{c}' as column_name, 'not_null' as check_name, "
                f"cast(count(*) filter (where {c} is null) as bigint) as failing_rows from {s.model}"
            )
        for c, values in s.accepted.items():
            vals = ", ".join(f"'{v}'" for v in values)
            parts.append(
                f"select '{s.model}', '{c}', 'accepted_values', "
                f"cast(count(distinct case when {c} not in ({vals}) then {c} end) as bigint) from {s.model}"
            )
        for c in s.unique:
            parts.append(
                f"select '{s.model}', '{c}', 'unique', cast(count(*) as bigint) from "
                f"(select {c} from {s.model} where {c} is not null group by {c} having count(*) > 1)"
            )
    body = "\nunion all\n".join(parts)
    return (
        "select *, case when failing_rows = 0 then 'pass' else 'fail' end as status from (\n"
        + body + "\n)"
    )

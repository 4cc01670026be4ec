"""Before/after text metrics: flat columns, means, run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycoder.functions import fixed
from staycoder.functions.text import round_half_even

PHASES = ("before", "after")


def flat_metrics(phases: dict[str, str]) -> list[Column]:
    """`<metric>_<phase>` columns from metric structs; `phases` maps a phase to its struct column."""
    return [
        F.col(column)[metric].alias(f"{metric}_{phase}")
        for metric in fixed.METRICS
        for phase, column in phases.items()
    ]


def _recap_names() -> list[str]:
    return [f"{metric}_{phase}" for metric in fixed.METRICS for phase in PHASES]


def recap_sums() -> list[Column]:
    """Aggregates of the flat metric columns: n_rows and one sum per column, nulls as 0."""
    sums = [F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in _recap_names()]
    return [F.count(F.lit(1)).alias("n_rows"), *sums]


def recap_from_sums(sums: DataFrame) -> DataFrame:
    """Means over all rows, rounded to 3 digits; an empty table counts as one row."""
    rows = F.greatest(F.col("n_rows"), F.lit(1)).cast("double")
    means = sums.select("n_rows", *[(F.col(c) / rows).alias(c) for c in _recap_names()])
    return means.select("n_rows", *[round_half_even(F.col(c)).alias(c) for c in _recap_names()])


def recap_means(df: DataFrame) -> DataFrame:
    """One row: n_rows and the mean of each metric before and after."""
    return recap_from_sums(df.agg(*recap_sums()))


def summary_columns(code: Column, means: bool = False) -> list[Column]:
    """Aggregates: documents, non-empty predictions and, on request, metric means (nulls skipped)."""
    columns = [
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if(F.coalesce(code, F.lit("")) != "").alias("n_predicted"),
    ]
    return columns + ([F.avg(c).alias(f"mean_{c}") for c in _recap_names()] if means else [])


def run_summary(df: DataFrame, pred: str = "pred", means: bool = False) -> DataFrame:
    """One row of `summary_columns`."""
    return df.agg(*summary_columns(F.col(pred)["code"], means))

"""Score a prediction table against a gold table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staycoder.functions import fixed
from staycoder.operators.checks import require_rows
from staycoder.operators.evaluation import classification_report, confusion_counts, eval_scores
from staycoder.sources.documents import read_table
from staycoder.sources.shared import write_once


def evaluate(
    gold: DataFrame,
    pred: DataFrame,
    gold_id: str = fixed.COL_STAY,
    pred_id: str = fixed.COL_STAY,
    gold_col: str = fixed.COL_GOLD,
    pred_col: str = fixed.COL_PREDICTION,
    average: str = "macro",
    upper: bool = False,
    strip_dot: bool = False,
    null_ids_match: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(scores, report). The label-sized counts are stored once and feed both."""
    counts = confusion_counts(
        gold, pred, gold_id, pred_id, gold_col, pred_col, upper, strip_dot, null_ids_match
    )
    counts = write_once(counts, "confusion-counts")
    if counts.isEmpty():  # which of the two it is matters only now
        ids = [df.select(F.col(c).cast("string").alias(n)) for df, c, n in ((gold, gold_id, "g"), (pred, pred_id, "p"))]
        same = F.col("g").eqNullSafe(F.col("p")) if null_ids_match else F.col("g") == F.col("p")
        require_rows(ids[0].join(ids[1], same, "left_semi"), f"no matched pair: no {gold_id} of the gold table is a {pred_id} of the predictions")
        raise ValueError("no matched pair has both a gold and a predicted code")
    return eval_scores(counts, (average,)), classification_report(counts)


def run_evaluate(
    spark: SparkSession, gold_path: str, pred_path: str, fmt: str = "csv", **options: object
) -> tuple[DataFrame, DataFrame]:
    return evaluate(read_table(spark, gold_path, fmt), read_table(spark, pred_path, fmt), **options)

"""Rewrite a dataset and measure its texts before and after."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from staycoder.functions import fixed
from staycoder.functions.text import add_text_metrics
from staycoder.operators.checks import require_columns
from staycoder.operators.metrics import flat_metrics, recap_from_sums, recap_sums
from staycoder.operators.rewriting import RewriteConfig, rewrite
from staycoder.sources.documents import read_table
from staycoder.sources.shared import spread, write_once
from staycoder.sources.sinks import recap_json, write_json_row, write_table


def rewrite_dataset(
    table: DataFrame,
    text: str = fixed.COL_TEXT,
    out_text: str = "text_rw",
    rewriter: Callable[[DataFrame], DataFrame] = rewrite,
    sampled: bool = False,
) -> DataFrame:
    """Source columns plus the rewritten text and its twelve metric columns.

    `rewriter` is a step that reads `text` and adds `text_rw`. With `sampled`, its output is stored
    before it is measured, because computing it again would give other texts.
    """
    require_columns(table, [text], "input table")
    source = [c for c in table.columns if c != out_text]
    note = F.coalesce(F.col("_source")[text].cast("string"), F.lit("")).alias("text")
    rows = table.select(F.struct(*source).alias("_source"))
    rewritten = rows.select("_source", note).transform(rewriter).select("_source", "text_rw")
    if sampled:
        rewritten = write_once(rewritten, "rewritten")
    rewritten = rewritten.select("_source", note, "text_rw")
    measured = add_text_metrics(rewritten, "text", "_before")
    measured = add_text_metrics(measured, "text_rw", "_after")
    return measured.select(
        "_source.*",
        F.col("text_rw").alias(out_text),
        *flat_metrics({"before": "_before", "after": "_after"}),
    )


def recap_name(output_path: str) -> str:
    """The recap's place beside the output: out.csv and out/ both give out.metrics.json."""
    base = output_path.rstrip("/")
    folder, _, name = base.rpartition("/")
    stem = name.rpartition(".")[0] or name
    return f"{folder}/{stem}.metrics.json" if folder or base.startswith("/") else f"{stem}.metrics.json"


def run_rewrite(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    config: RewriteConfig,
    model_factory: Callable[..., Callable] | None = None,
    text: str = fixed.COL_TEXT,
    out_text: str = "text_rw",
    recap_path: str | None = None,
    fmt: str = "csv",
) -> DataFrame:
    """Read, rewrite, write the dataset and its recap; returns the one-row recap."""
    table = spread(read_table(spark, input_path, fmt))
    step = lambda df: rewrite(df, config, model_factory)
    result = rewrite_dataset(table, text, out_text, step, sampled=model_factory is not None)
    observed = Observation("recap")
    write_table(result.observe(observed, *recap_sums()), output_path, fmt)
    settings = {
        "llm_model": config.model_name,
        "target_words": config.target_words,
        "max_new_tokens": config.max_new_tokens,
        "temperature": config.temperature,
        "top_p": config.top_p,
    }
    sums = spark.createDataFrame([Row(**observed.get)])
    recap = recap_json(recap_from_sums(sums), input_path, output_path, settings)
    write_json_row(recap, recap_path or recap_name(output_path))
    return recap

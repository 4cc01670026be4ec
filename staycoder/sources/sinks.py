"""Writers, to any file system Spark can reach: tables are folders of part files, JSON artefacts single files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycoder.functions import fixed
from staycoder.operators.metrics import flat_metrics


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write CSV (header, quotes doubled, blanks kept, missing as empty field) or another format."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(
            header=True,
            quote='"',
            escape='"',
            emptyValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    writer.format(fmt).save(path)


def write_object(text: DataFrame, path: str) -> None:
    """Write a one-row table of one text as the file `path`, replacing what is there.

    A task writes it beside its place, and a rename puts it there whole: readers see the old file or the new one.
    """
    spark = text.sparkSession
    if len(text.columns) != 1:
        raise ValueError(f"an artefact is one text, not the columns {text.columns}")
    folder = f"{path}.{uuid.uuid4().hex}.tmp"
    text.coalesce(1).write.text(folder)
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target, scratch = hadoop.Path(path), hadoop.Path(folder)
    files = scratch.getFileSystem(conf)
    try:
        parts = [s.getPath() for s in files.globStatus(hadoop.Path(scratch, "part-*")) if s.getLen() > 0]
        if len(parts) != 1:
            raise ValueError(f"an artefact is one row, {path} would have {len(parts)} parts")
        if files.exists(target) and files.getFileStatus(target).isDirectory():
            files.delete(target, True)  # a folder of that name cannot be replaced by a rename
        replace = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        replace[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        context = hadoop.FileContext.getFileContext(files.getUri(), conf)
        context.rename(files.makeQualified(parts[0]), files.makeQualified(target), replace)
    finally:
        files.delete(scratch, True)


def write_json_row(df: DataFrame, path: str) -> None:
    """Write a one-row table as the file `path`, one JSON object."""
    write_object(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")), path)


def prediction_columns(
    pred: str = "pred", out_stay: str = fixed.COL_STAY, out_pred: str = fixed.COL_PREDICTION
) -> list[Column]:
    """Stay id and predicted code, each "" if missing."""
    return [
        F.coalesce(F.col("id_sejour"), F.lit("")).alias(out_stay),
        F.coalesce(F.col(pred)["code"], F.lit("")).alias(out_pred),
    ]


def prediction_output(
    df: DataFrame,
    pred: str = "pred",
    out_stay: str = fixed.COL_STAY,
    out_pred: str = fixed.COL_PREDICTION,
    metrics: dict[str, str] | None = None,
) -> DataFrame:
    """The output table; with `metrics` ({'before': column, 'after': column}) plus 12 metric columns."""
    return df.select(*prediction_columns(pred, out_stay, out_pred), *flat_metrics(metrics or {}))


def recap_json(
    means: DataFrame, input_path: str, output_path: str, settings: dict[str, object]
) -> DataFrame:
    """One row with the nested recap: paths, n_rows, rewrite settings, metric means per phase."""
    phase = lambda p: F.struct(*[F.col(f"{m}_{p}").alias(m) for m in fixed.METRICS])
    return means.select(
        F.lit(input_path).alias("input_csv"),
        F.lit(output_path).alias("output_csv"),
        "n_rows",
        F.struct(*[F.lit(v).alias(k) for k, v in settings.items()]).alias("rewrite"),
        F.struct(phase("before").alias("before"), phase("after").alias("after")).alias("metrics_means"),
    )


def label_map_json(labels: DataFrame) -> DataFrame:
    """One row, one JSON text: {label: id}, in id order. Label-sized."""
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("label_id", "label"))),
        lambda e: F.struct(e["label"].alias("key"), e["label_id"].alias("value")),
    )
    return labels.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def split_stats_json(stats: DataFrame) -> DataFrame:
    """One row, one JSON text: train_counts, val_counts, labels. Label-sized."""

    def counts(split: str) -> Column:
        pairs = F.collect_list(F.when(F.col("split") == split, F.struct("label", "n_rows")))
        return F.map_from_entries(F.array_sort(pairs))

    body = F.struct(
        counts("train").alias("train_counts"),
        counts("val").alias("val_counts"),
        F.array_sort(F.collect_set("label")).alias("labels"),
    )
    return stats.agg(F.to_json(body).alias("value"))

"""Label ids, per-class train/validation split, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staycoder.sources.shared import write_once


def label_map(df: DataFrame, label: str) -> DataFrame:
    """(label, label_id): distinct labels in code-point order, numbered from 0.

    The numbering window runs over distinct labels only, i.e. over a model's classes.
    """
    labels = df.select(F.col(label).cast("string").alias("label")).where("label is not null").distinct()
    return labels.withColumn("label_id", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


def validation_size(n: Column, val_frac: float) -> Column:
    """0 for a single row; else the rounded share (half to even), at least 1, at most n - 1."""
    share = F.rint(n * F.lit(float(val_frac))).cast("bigint")
    return F.when(n == 1, F.lit(0)).otherwise(F.least(F.greatest(share, F.lit(1)), n - 1)).cast("bigint")


def per_class_split(
    df: DataFrame,
    label: str,
    key: str,
    val_frac: float = 0.1,
    seed: int = 42,
    out: str = "split",
    bucket_digits: int = 3,
) -> DataFrame:
    """Add `out` = 'train' | 'val', per label. Rows without label are left out.

    Rows are ordered by a seeded hash of the unique column `key`; the first ones of a label are its
    validation rows. No label is ever sorted as a whole: counts per hash prefix tell in which prefix
    bucket the label's cut lies, only that bucket (1/4096 of the label by default) is ranked, and
    each row is then compared with its label's cut. Two label-sized tables are stored on the way.
    """
    rows = df.where(F.col(label).isNotNull())
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    keyed = rows.select(
        F.col(label).cast("string").alias("_label"), order.alias("_hash"), F.col(key).alias("_key")
    ).withColumn("_bucket", F.substring("_hash", 1, bucket_digits))

    per_label = Window.partitionBy("_label")
    buckets = keyed.groupBy("_label", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    buckets = buckets.withColumn("_upto", F.sum("_n").over(per_label.orderBy("_bucket")))
    buckets = buckets.withColumn("_val", validation_size(F.sum("_n").over(per_label), val_frac))
    before = F.col("_upto") - F.col("_n")
    holds_cut = (before < F.col("_val")) & (F.col("_val") <= F.col("_upto"))
    cut_buckets = buckets.where(holds_cut).select("_label", "_bucket", (F.col("_val") - before).alias("_want"))
    cut_buckets = write_once(cut_buckets, "split-buckets")

    in_order = per_label.orderBy("_hash", "_key")
    ranked = (
        keyed.join(cut_buckets, ["_label", "_bucket"])
        .withColumn("_rank", F.row_number().over(in_order))
        .withColumn("_next_key", F.lead("_key").over(in_order))
    )
    repeated = F.raise_error(F.lit(f"per_class_split: the key column {key} is not unique"))
    cuts = ranked.where(F.col("_rank") == F.col("_want")).select(
        "_label",
        F.col("_hash").alias("_cut_hash"),
        F.when(F.col("_next_key") == F.col("_key"), repeated).otherwise(F.col("_key")).alias("_cut_key"),
    )
    cuts = write_once(cuts, "split-cuts")

    placed = rows.withColumn("_label", F.col(label).cast("string")).join(cuts, "_label", "left")
    in_val = (order < F.col("_cut_hash")) | (
        (order == F.col("_cut_hash")) & (F.col(key) <= F.col("_cut_key"))
    )
    split = F.when(in_val, F.lit("val")).otherwise(F.lit("train"))
    return placed.withColumn(out, split).drop("_label", "_cut_hash", "_cut_key")


def split_stats(split: DataFrame, label: str, out: str = "split") -> DataFrame:
    """Rows per (split, label)."""
    return split.groupBy(out, F.col(label).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def class_weights(train: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    """(label, label_id, weight): inverse training frequency over all labels, divided by its mean.

    Everything after the counting is label-sized, the mean's window included.
    """
    counts = train.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    inverse = 1.0 / F.greatest(F.coalesce(F.col("_n"), F.lit(0)), F.lit(1))
    weighted = labels.join(counts, "label", "left").withColumn("_inverse", inverse)
    weight = F.col("_inverse") / F.avg("_inverse").over(Window.partitionBy())
    return weighted.select("label", "label_id", weight.cast("float").alias("weight"))

"""Left join with a table of unique keys, some of which may hold a large share of the left rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def lookup(left: DataFrame, right: DataFrame, keys: list[str], rows: str, spread_by: list[str]) -> DataFrame:
    """Every row of `left` with the columns of the row of `right` that has its keys, or nulls.

    `right` has a key at most once; its column `rows` (dropped) counts the left rows with the key. A key with more
    than 1/1000 of the counted rows is heavy; there are fewer than 1000, so heavy rows are broadcast. The other
    keys are joined by a shuffle, in which rows that found a heavy key are spread by the columns `spread_by`.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    values = [c for c in right.columns if c not in (*keys, rows)]
    heavy = F.col(rows) * SHARE > F.lit(total)
    few = right.where(heavy).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(v).alias(f"_h_{v}") for v in values), F.lit(True).alias("_heavy"))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    found = left.join(F.broadcast(few), on, "left").drop(*(f"_k{i}" for i in range(len(keys))))
    found = found.withColumn("_salt", F.when(F.col("_heavy"), F.xxhash64(*spread_by)).otherwise(F.lit(0).cast("long")))
    # a row that found its key looks for a salt that no row of the right side has
    rest = right.where(~heavy).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(v).alias(f"_r_{v}") for v in values), F.lit(0).cast("long").alias("_s"))
    on += [F.col("_salt") == F.col("_s"), F.col("_heavy").isNull()]
    joined = found.join(rest, on, "left")
    merged = [F.when(F.col("_heavy"), F.col(f"_h_{v}")).otherwise(F.col(f"_r_{v}")).alias(v) for v in values]
    return joined.select(*left.columns, *merged)

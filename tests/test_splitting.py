import hashlib

import pytest
from pyspark.sql import functions as F

from staycoder.operators.splitting import class_weights, label_map, per_class_split, split_stats, validation_size


def test_validation_sizes(one_column):
    sizes = [1, 2, 5, 15, 25, 35, 45]
    assert one_column(lambda c: validation_size(c, 0.1), sizes, "bigint") == [0, 1, 1, 2, 2, 4, 4]


def brute_force_split(rows, frac, seed):
    """Sort each label by the seeded hash and cut."""
    split = {}
    for label in {label for _, label in rows}:
        keys = sorted((hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k) for k, lab in rows if lab == label)
        n_val = 0 if len(keys) == 1 else min(max(1, round(len(keys) * frac)), len(keys) - 1)
        split |= {k: "val" if i < n_val else "train" for i, (_, k) in enumerate(keys)}
    return split


@pytest.mark.parametrize("frac, seed, digits", [(0.1, 42, 3), (0.5, 7, 1), (0.0, 1, 2), (1.0, 1, 2)])
def test_split_matches_brute_force(spark, frac, seed, digits):
    """A third of the rows share one label; others are rare, one is single."""
    rows = [(i, "hot" if i % 3 == 0 else f"r{i % 40}") for i in range(1, 1500)] + [(5000, "single")]
    df = spark.createDataFrame(rows, "id int, code string")
    got = {r.id: r.split for r in per_class_split(df, "code", "id", frac, seed, bucket_digits=digits).collect()}
    assert got == brute_force_split(rows, frac, seed)


def test_split_drops_missing_labels_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "a", "z")], "id int, code string, text string")
    got = per_class_split(df, "code", "id")
    assert got.columns == ["id", "code", "text", "split"] and {r.id for r in got.collect()} == {1, 3}


def test_split_needs_a_unique_key(spark):
    df = spark.createDataFrame([(1, "a")] * 4, "id int, code string")
    with pytest.raises(Exception, match="not unique"):
        per_class_split(df, "code", "id").collect()


def test_rows_are_not_shuffled_by_the_split(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("code"))
    plan = per_class_split(df, "code", "id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and "BroadcastHashJoin" in plan


def test_label_map_and_weights(spark):
    df = spark.createDataFrame([("B", 1), ("A", 1), ("B", 1), ("B", 1), ("É", 0), (None, 1)], "code string, n int")
    labels = label_map(df, "code")
    assert [tuple(r) for r in labels.orderBy("label_id").collect()] == [("A", 0), ("B", 1), ("É", 2)]
    train = df.where("code in ('A', 'B')")
    pair = labels.where("label <> 'É'")
    assert {r.label: r.weight for r in class_weights(train, "code", pair).collect()} == {"A": 1.5, "B": 0.5}
    three = {r.label: r.weight for r in class_weights(train, "code", labels).collect()}
    assert three["É"] == three["A"] and sum(three.values()) / 3 == pytest.approx(1.0)


def test_split_stats(spark):
    df = spark.createDataFrame([("train", "a"), ("train", "a"), ("val", "a")], "split string, code string")
    assert {tuple(r) for r in split_stats(df, "code").collect()} == {("train", "a", 2), ("val", "a", 1)}

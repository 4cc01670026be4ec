import math
import statistics

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from staycoder.functions import vectors
from staycoder.operators.pooling import first_token_mean, masked_mean, pool_chunks, pool_logits
from staycoder.operators.scoring import label_predictions


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(0)
    rows = [(d, c, rng.normal(size=3).tolist()) for d in range(6) for c in range(d + 1)]
    return rows, spark.createDataFrame(rows, "doc int, chunk_no int, emb array<double>")


@pytest.mark.parametrize("strategy", ["mean", "max", "median", "first"])
def test_pooling_matches_brute_force(chunks, strategy):
    rows, df = chunks
    pool = {"mean": statistics.fmean, "max": max, "median": statistics.median, "first": lambda v: v[0]}[strategy]
    for table in (df, df.withColumn("emb", array_to_vector("emb"))):
        got = {r.doc: r.emb for r in pool_chunks(table, "doc", "emb", strategy).collect()}
        for doc in range(6):
            parts = [v for d, _, v in rows if d == doc]
            expected = [pool([p[i] for p in parts]) for i in range(3)]
            assert got[doc] == pytest.approx(expected, rel=1e-6)


def test_pooling_carries_and_completes(spark, chunks):
    _, df = chunks
    documents = spark.range(8).select(F.col("id").cast("int").alias("doc"))
    for strategy in ("mean", "median"):
        pooled = pool_chunks(df.withColumn("tag", F.concat(F.lit("t"), "doc")), "doc", "emb", strategy, carry=("tag",), documents=documents)
        got = {r.doc: (r.tag, r.emb is None) for r in pooled.collect()}
        assert got == {d: (f"t{d}", False) if d < 6 else (None, True) for d in range(8)}


def test_median_of_long_ragged_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(d, i, rng.normal(size=70 + (i % 3 if d == 1 else 0)).tolist()) for d in (0, 1) for i in range(41 + d)] + [(2, 0, None), (3, 0, [])]
    df = spark.createDataFrame(rows, "doc int, chunk_no int, emb array<double>").repartition(7)
    got = {r.doc: r.logits for r in pool_logits(df, "doc", "emb", "median").collect()}
    for doc in (0, 1):
        vectors = [v for d, _, v in rows if d == doc]
        assert got[doc] == pytest.approx([statistics.median(v[i] for v in vectors if i < len(v)) for i in range(max(map(len, vectors)))])
    assert set(got) == {0, 1, 3} and got[3] == []
    plan = pool_chunks(df, "doc", "emb", "median")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_unknown_strategies(chunks):
    _, df = chunks
    with pytest.raises(ValueError, match="pooling strategy"):
        pool_chunks(df, "doc", "emb", "cls")
    with pytest.warns(UserWarning, match="using the mean"):
        odd = pool_logits(df, "doc", "emb", "cls")
    assert sorted(map(str, odd.collect())) == sorted(map(str, pool_logits(df, "doc", "emb", "mean").collect()))


def test_a_hot_document_is_pooled_before_the_shuffle(spark):
    """A third of all chunks in one document: right values, and a partial aggregate under the exchange."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("doc"),
        F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("emb"),
    )
    pooled = pool_chunks(rows, "doc", "emb")
    got = {r.doc: r.emb for r in pooled.where("doc = -1").collect()}
    expected = statistics.fmean(i % 7 for i in range(0, 30_000, 3))
    assert got[-1] == pytest.approx([expected, 1.0])
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan.split("Exchange")[1]


def test_masked_and_first_token_means(spark):
    rows = [(0, 0, 1, [1.0, 2.0]), (0, 1, 1, [3.0, 4.0]), (0, 2, 0, [9.0, 9.0]), (1, 0, 0, [5.0, 5.0])]
    tokens = spark.createDataFrame(rows, "chunk int, t int, mask int, v array<double>")
    got = {r.chunk: r.emb for r in masked_mean(tokens, "chunk", "v", "mask").collect()}
    assert got == {0: [2.0, 3.0], 1: [0.0, 0.0]}
    layered = spark.createDataFrame([(0, t, layer, [float(layer)]) for t in (0, 1) for layer in range(1, 13)], "chunk int, t int, layer int, v array<double>")
    assert first_token_mean(layered, "chunk", "v", "t", "layer", n_layers=12).first().emb == [10.5]


def test_row_expressions(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([2.0, 2.0],)], "v array<double>")
    got = rows.select(vectors.l2_normalize(F.col("v")).alias("u"), vectors.argmax_id(F.col("v")).alias("a"), vectors.softmax_at_max(F.col("v")).alias("s")).collect()
    assert [r.u for r in got[:2]] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r.a for r in got] == [1, 0, 0]
    assert got[0].s == pytest.approx(1 / (1 + math.exp(-1)))


def test_label_predictions(spark):
    pooled = spark.createDataFrame([(0, [0.0, 2.0]), (1, [5.0, 2.0])], "doc int, logits array<double>")
    labels = spark.createDataFrame([(1, "I21.4")], "label_id int, label string")
    got = {r.doc: r.pred for r in label_predictions(pooled, labels=labels).collect()}
    assert got[0].code == "I21.4" and got[1].code == "0"
    assert got[1].score == pytest.approx(1 / (1 + math.exp(-3)))
    assert label_predictions(pooled, with_score=False).first().pred.score is None

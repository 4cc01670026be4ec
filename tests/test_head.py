from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from staycoder.operators.head import HeadConfig, fit_head, head_info, head_labels, load_head, predict_head, save_head


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        k = i % 3
        x = (rng.normal(size=4) + np.eye(4)[k] * 1.5).tolist()
        rows.append((i, x, f"C{k}", 0.5 + (i % 4)))
    return rows, spark.createDataFrame(rows, "id int, emb array<double>, gold_dp string, w double").cache()


def gradient(model, rows, C, weighted):
    """Largest gradient entry of C * sum(w * cross-entropy) + |W|^2 / 2 at the fitted coefficients."""
    lr = model.stages[0]
    W, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    if W.shape[0] == 1:  # the binomial model keeps one row
        X, y = np.array([r[1] for r in rows]), np.array([head_labels(model).index(r[2]) for r in rows])
        w = np.array([r[3] if weighted else 1.0 for r in rows])
        p = 1 / (1 + np.exp(-(X @ W[0] + b[0])))
        return np.abs(np.r_[C * ((p - y) * w) @ X + W[0], C * ((p - y) * w).sum()]).max()
    X, y = np.array([r[1] for r in rows]), np.array([head_labels(model).index(r[2]) for r in rows])
    w = np.array([r[3] if weighted else 1.0 for r in rows])
    z = X @ W.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= w[:, None]
    return max(np.abs(C * p.T @ X + W).max(), np.abs(C * p.sum(0)).max())


@pytest.mark.parametrize("C, weight", [(1.0, None), (0.1, None), (1.0, "w")])
def test_fit_solves_the_penalised_problem(points, C, weight):
    rows, df = points
    model = fit_head(df, config=HeadConfig(C=C, tolerance=1e-10), weight=weight)
    assert head_labels(model) == ["C0", "C1", "C2"]
    assert gradient(model, rows, C, weight is not None) < 5e-3


def test_two_classes(points):
    rows, df = points
    two = [r for r in rows if r[2] != "C2"]
    model = fit_head(df.where("gold_dp <> 'C2'"), config=HeadConfig(tolerance=1e-10))
    assert gradient(model, two, 1.0, False) < 5e-3


def test_predicts_every_row_but_learns_from_labelled_ones(points):
    _, df = points
    some = df.withColumn("gold_dp", F.when(F.col("id") < 100, F.col("gold_dp")).when(F.col("id") < 150, ""))
    model = fit_head(some)
    assert head_labels(model) == ["C0", "C1", "C2"]
    predicted = predict_head(some, model, with_score=True).collect()
    assert len(predicted) == 240 and all(r.pred.code in ("C0", "C1", "C2") and 1 / 3 <= r.pred.score <= 1 for r in predicted)
    assert predict_head(some, model).first().pred.score is None


def test_save_and_load(points, tmp_path):
    _, df = points
    model = fit_head(df)
    save_head(model, str(tmp_path / "head"))
    save_head(model, str(tmp_path / "head"))
    loaded = load_head(str(tmp_path / "head"))
    codes = lambda m: [r.pred.code for r in predict_head(df, m).orderBy("id").collect()]
    assert codes(loaded) == codes(model)
    assert head_info(loaded) == head_info(model) and head_info(loaded)["classes"] == ["C0", "C1", "C2"]
    assert datetime.strptime(head_info(loaded)["created_at"], "%Y-%m-%d %H:%M:%S").year >= 2024
    with pytest.raises(FileNotFoundError, match="train mode"):
        load_head(str(tmp_path / "none"))


def test_refuses_one_class_or_none(points):
    _, df = points
    with pytest.raises(ValueError, match="only one class"):
        fit_head(df.where("gold_dp = 'C1'"))
    with pytest.raises(ValueError, match="no usable"):
        fit_head(df.withColumn("gold_dp", F.lit(None).cast("string")))


def test_fits_after_an_observed_run(points):
    """A model whose training summary travelled to the tasks could not be applied in a session that observed a table."""
    from pyspark.sql import Observation

    _, df = points
    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 240
    assert predict_head(df, fit_head(df)).where("pred.code IS NOT NULL").count() == 240

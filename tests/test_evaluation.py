from collections import Counter

import pytest
from pyspark.sql import functions as F

from staycoder.operators.evaluation import AVERAGES, classification_report, confusion_counts, eval_scores, matched_pairs, per_class_scores
from staycoder.plans.evaluate import evaluate

ARGS = ("gid", "pid", "g", "p")


def tables(spark, gold, pred):
    return spark.createDataFrame(gold, "gid string, g string"), spark.createDataFrame(pred, "pid string, p string")


@pytest.fixture(scope="module")
def small(spark):
    gold, pred = tables(spark, list(zip("1234", "AABC")), list(zip("1234", "ABBD")))
    return confusion_counts(gold, pred, *ARGS)


def test_per_class(small):
    got = {r.label: (r.precision, r.recall, round(r.f1, 4), r.support) for r in per_class_scores(small).collect()}
    assert got == {"A": (1, 0.5, 0.6667, 2), "B": (0.5, 1, 0.6667, 1), "C": (0, 0, 0, 1), "D": (0, 0, 0, 0)}


def test_averages(small):
    got = {r.average: (r.accuracy, r.precision, r.recall, round(r.f1, 4)) for r in eval_scores(small, AVERAGES).collect()}
    assert got == {"micro": (0.5, 0.5, 0.5, 0.5), "macro": (0.5, 0.375, 0.375, 0.3333), "weighted": (0.5, 0.625, 0.5, 0.5)}
    with pytest.raises(ValueError, match="average"):
        eval_scores(small, ("samples",))


def test_report(small):
    rows = {(r.kind, r.label): r for r in classification_report(small).collect()}
    assert len(rows) == 7
    accuracy = rows["accuracy", "accuracy"]
    assert (accuracy.precision, accuracy.recall, accuracy.f1, accuracy.support) == (None, None, 0.5, 4)
    assert rows["average", "macro avg"].precision == 0.375 and rows["average", "weighted avg"].support == 4


def test_missing_and_repeated_ids(spark):
    gold, pred = tables(spark, [(None, "A"), ("a", "A")], [(None, "A"), ("a", "A"), ("a", "B")])
    pairs = matched_pairs(gold, pred, *ARGS)
    assert sum(r.n_pairs for r in pairs.collect()) == 3
    assert sum(r.n_pairs for r in matched_pairs(gold, pred, *ARGS, null_ids_match=False).collect()) == 2
    counts = {r.label: (r.support, r.predicted, r.true_positives) for r in confusion_counts(gold, pred, *ARGS).collect()}
    assert counts == {"A": (3, 2, 2), "B": (0, 1, 0)}
    strict = {r.label: r.support for r in confusion_counts(gold, pred, *ARGS, null_ids_match=False).collect()}
    assert strict == {"A": 2, "B": 0}


def test_hot_id_matches_brute_force(spark):
    """A third of both tables share one id; a tenth has no id; some codes are empty."""
    key = lambda i: "hot" if i % 3 == 0 else (None if i % 10 == 1 else f"k{i % 97}")
    gold = [(key(i), " c%d" % (i % 5) if i % 11 else "") for i in range(700)]
    pred = [(key(i + 1), "C%d." % (i % 6) if i % 13 else None) for i in range(900)]
    expected_s, expected_p, expected_t = Counter(), Counter(), Counter()
    norm = lambda c: (c or "").strip().upper().replace(".", "")
    for gid, g in gold:
        for pid, p in pred:
            if gid == pid and norm(g) and norm(p):
                expected_s[norm(g)] += 1
                expected_p[norm(p)] += 1
                expected_t[norm(g)] += norm(g) == norm(p)
    counts = confusion_counts(*tables(spark, gold, pred), *ARGS, upper=True, strip_dot=True)
    got = {r.label: (r.support, r.predicted, r.true_positives) for r in counts.collect()}
    assert got == {c: (expected_s[c], expected_p[c], expected_t[c]) for c in expected_s | expected_p}
    pairs = matched_pairs(*tables(spark, gold, pred), *ARGS, upper=True, strip_dot=True).collect()
    assert sum(r.n_pairs for r in pairs) == sum(expected_s.values())


def test_errors(spark):
    gold, pred = tables(spark, [("1", "A")], [("2", "A")])
    with pytest.raises(ValueError, match="nope"):
        confusion_counts(gold, pred, "gid", "pid", "nope", "p")
    with pytest.raises(ValueError, match="no matched pair"):
        evaluate(gold, pred, *ARGS)


def test_pairs_of_a_hot_id_are_spread(spark):
    gold = spark.range(6000).selectExpr("if(id < 5000, null, string(id)) AS gid", "concat('G', id) AS g")
    pred = spark.range(3000).selectExpr("if(id < 2000, null, string(id + 3000)) AS pid", "concat('P', id) AS p")
    pairs = matched_pairs(gold, pred, *ARGS).withColumn("task", F.spark_partition_id())
    found = pairs.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("n_pairs").alias("pairs")).collect()
    assert sum(r.n for r in found) == sum(r.pairs for r in found) == 5000 * 2000 + 1000
    assert len(found) >= 3 and max(r.n for r in found) < 8_000_000
    assert pairs.where("id IS NULL").select("gold_code", "pred_code").distinct().count() == 5000 * 2000

"""Scoring predicted codes against gold codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staycoder.functions.codes import normalize_code
from staycoder.operators.checks import require_choice, require_columns
from staycoder.sources.shared import write_once

CODES_AT_ONCE = 1000
AVERAGES = ("micro", "macro", "weighted")


def _side(
    df: DataFrame, what: str, id_col: str, code_col: str, upper: bool, strip_dot: bool, null_ids: bool
) -> DataFrame:
    """(id, code) of the rows with a usable code."""
    require_columns(df, [id_col, code_col], what)
    code = normalize_code(F.col(code_col), upper, strip_dot)
    side = df.select(F.col(id_col).cast("string").alias("id"), code.alias("code")).where("code <> ''")
    return side if null_ids else side.where("id is not null")


def matched_pairs(
    gold: DataFrame,
    pred: DataFrame,
    gold_id: str,
    pred_id: str,
    gold_col: str,
    pred_col: str,
    upper: bool = False,
    strip_dot: bool = False,
    null_ids_match: bool = True,
) -> DataFrame:
    """Inner join of gold and predicted codes on the id, as (id, gold_code, pred_code, n_pairs).

    Repeated ids multiply, and by default a missing id matches a missing id. The multiplicity is a
    count: equal rows of a side are merged before the join, so a very frequent id costs as many rows
    as it has distinct codes. The codes of an id with more than 1,000 gold ones are dealt by code to several tasks,
    and its predicted ones go to each of them.
    """
    sides = []
    for df, what, id_col, code_col, name in (
        (gold, "gold table", gold_id, gold_col, "gold"),
        (pred, "prediction table", pred_id, pred_col, "pred"),
    ):
        side = _side(df, what, id_col, code_col, upper, strip_dot, null_ids_match)
        counted = side.groupBy("id", "code").agg(F.count(F.lit(1)).alias(f"_{name}_n"))
        sides.append(counted.withColumnsRenamed({"id": f"_{name}_id", "code": f"{name}_code"}))
    gold_side, pred_side = sides
    wide = gold_side.groupBy(F.col("_gold_id").alias("_id")).agg(F.ceil(F.count(F.lit(1)) / CODES_AT_ONCE).cast("int").alias("_parts"))
    wide = write_once(wide.where("_parts > 1"), "wide-ids")
    parts = F.coalesce("_parts", F.lit(1))
    # the size of the result is not seen in the bytes of the sides, so the tasks are not left to their size
    tasks = int(gold.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda name, part: F.struct(F.col(name).isNull().alias("none"), F.coalesce(name, F.lit("")).alias("id"), part.cast("int").alias("part")).alias("_cell")
    dealt = gold_side.join(wide, F.col("_gold_id").eqNullSafe(F.col("_id")), "left").select(
        "_gold_id", "gold_code", "_gold_n", cell("_gold_id", F.pmod(F.xxhash64("gold_code"), parts))
    )
    copied = pred_side.join(wide, F.col("_pred_id").eqNullSafe(F.col("_id")), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    copied = copied.select("pred_code", "_pred_n", cell("_pred_id", F.col("_part")))
    pairs = dealt.repartition(tasks, "_cell").join(copied.repartition(tasks, "_cell"), "_cell")
    return pairs.select(
        F.col("_gold_id").alias("id"),
        "gold_code",
        "pred_code",
        (F.col("_gold_n") * F.col("_pred_n")).alias("n_pairs"),
    )


def confusion_counts(
    gold: DataFrame,
    pred: DataFrame,
    gold_id: str,
    pred_id: str,
    gold_col: str,
    pred_col: str,
    upper: bool = False,
    strip_dot: bool = False,
    null_ids_match: bool = True,
) -> DataFrame:
    """(label, support, predicted, true_positives) over all matched pairs, without forming them.

    Per id, a code with g gold rows takes part in g x (the id's prediction rows) pairs, and likewise
    for predictions; both sides go through one grouping, and an id holds at most one row per code
    when its totals are taken.
    """
    gold_side = _side(gold, "gold table", gold_id, gold_col, upper, strip_dot, null_ids_match)
    pred_side = _side(pred, "prediction table", pred_id, pred_col, upper, strip_dot, null_ids_match)
    both = gold_side.select("id", "code", F.lit(1).alias("_g"), F.lit(0).alias("_p")).unionByName(
        pred_side.select("id", "code", F.lit(0).alias("_g"), F.lit(1).alias("_p"))
    )
    per_code = both.groupBy("id", "code").agg(F.sum("_g").alias("_g"), F.sum("_p").alias("_p"))
    of_id = Window.partitionBy("id")
    totals = per_code.withColumn("_gold", F.sum("_g").over(of_id)).withColumn("_pred", F.sum("_p").over(of_id))
    matched = totals.where((F.col("_gold") > 0) & (F.col("_pred") > 0))
    return matched.groupBy(F.col("code").alias("label")).agg(
        F.sum(F.col("_g") * F.col("_pred")).alias("support"),
        F.sum(F.col("_p") * F.col("_gold")).alias("predicted"),
        F.sum(F.col("_g") * F.col("_p")).alias("true_positives"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def per_class_scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1 to confusion counts; undefined ones are 0."""
    tp, support, predicted = F.col("true_positives"), F.col("support"), F.col("predicted")
    return counts.select(
        "*",
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + predicted).alias("f1"),
    )


def eval_scores(counts: DataFrame, averages: tuple[str, ...] = ("macro",)) -> DataFrame:
    """One row per average: n_pairs, accuracy, precision, recall, f1, from confusion counts."""
    for average in averages:
        require_choice(average, AVERAGES, "average")
    names = ("precision", "recall", "f1")
    scored = per_class_scores(counts)
    n = F.sum("support")
    accuracy = _ratio(F.sum("true_positives"), n)
    sums = scored.agg(
        n.alias("n_pairs"),
        accuracy.alias("accuracy"),
        F.struct(*[accuracy.alias(m) for m in names]).alias("micro"),
        F.struct(*[F.avg(m).alias(m) for m in names]).alias("macro"),
        F.struct(*[_ratio(F.sum(F.col(m) * F.col("support")), n).alias(m) for m in names]).alias("weighted"),
    )
    rows = F.array(*[F.struct(F.lit(a).alias("average"), F.col(f"{a}.*")) for a in averages])
    return sums.select("n_pairs", "accuracy", F.inline(rows))


def classification_report(counts: DataFrame) -> DataFrame:
    """Rows (kind, label, precision, recall, f1, support): every class, accuracy, both averages.

    Each class contributes one row to itself and one to each summary, so a single grouping of a
    label-sized table gives the whole report.
    """
    nothing = F.lit(None).cast("double")

    def row(kind: str, label: Column, weight: Column, p: Column, r: Column, f: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            label.alias("label"),
            weight.cast("double").alias("w"),
            p.alias("p"),
            r.alias("r"),
            f.alias("f"),
            F.col("support").alias("s"),
        )

    scores = [F.col(m) for m in ("precision", "recall", "f1")]
    hits = F.when(F.col("support") > 0, F.col("recall")).otherwise(F.lit(0.0))
    one, support = F.lit(1), F.col("support")
    parts = F.array(
        row("class", F.col("label"), one, *scores),
        row("accuracy", F.lit("accuracy"), support, nothing, nothing, hits),
        row("average", F.lit("macro avg"), one, *scores),
        row("average", F.lit("weighted avg"), support, *scores),
    )
    rows = per_class_scores(counts).select(F.inline(parts))
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    return rows.groupBy("kind", "label").agg(
        mean("p").alias("precision"),
        mean("r").alias("recall"),
        mean("f").alias("f1"),
        F.sum("s").alias("support"),
    )

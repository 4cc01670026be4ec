"""Mixing sources to target weights: hierarchical token budgets and seeded token prefixes.

The leaves of a tree (by default domain, language, source) get token budgets: a total goes down the tree,
at every node in proportion to the children's weights. A child cannot take more than its subtree holds
times `max_epochs`; what it cannot take is shared by its siblings, again by weight, and only what all of
them together cannot take stays short at their parent, whose own siblings had room for it. Tokens are
whole: largest remainders decide, then names.

A leaf with budget b and t tokens gives b div t whole epochs and the first b mod t tokens of one more, in
the order of md5(seed:epoch:id). Only sums per (leaf, first three digits) and the rows of the one slice
that holds a leaf's cut (1/4096 of them) are put in order; no leaf is sorted as a whole.

Tokens are counted as blank-separated words of the whole text; null texts have none and are never
selected. Missing level values are a branch of their own. Ids may repeat or be null: rows that tie in
the order are alike in id and are taken in order of their tokens. The tree may have `max_leaves` leaves
(it is planned on the driver and broadcast); more raise ValueError. Levels may be expressions.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MixConfig:
    """`weights` maps a path of level values, such as ("web",) or ("web", "en"), to its weight among its
    siblings (default 1). `share` of all tokens is the total, unless `total` gives tokens."""

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: Mapping[tuple, float] = field(default_factory=dict)
    share: float = 0.5
    total: int | None = None
    max_epochs: int = 4
    seed: int = 42
    max_leaves: int = 50_000


def _divide(amount: int, wants: list[tuple[Fraction, int]]) -> list[int]:
    """Split `amount` by weight among (weight, capacity); what one cannot take goes to the others."""
    given = [0] * len(wants)
    open_ = [i for i, (w, c) in enumerate(wants) if w > 0 and c > 0]
    left = min(amount, sum(wants[i][1] for i in open_))
    while open_ and left:
        total = sum(wants[i][0] for i in open_)
        full = [i for i in open_ if wants[i][1] * total <= left * wants[i][0]]
        if full:
            for i in full:
                given[i] = wants[i][1]
                left -= given[i]
            open_ = [i for i in open_ if i not in full]
            continue
        exact = [left * wants[i][0] / total for i in open_]
        for i, x in zip(open_, exact, strict=True):
            given[i] = int(x)
        spare = left - sum(given[i] for i in open_)
        order = sorted(range(len(open_)), key=lambda k: (int(exact[k]) - exact[k], k))
        for k in [k for k in order if given[open_[k]] < wants[open_[k]][1]][:spare]:
            given[open_[k]] += 1
        break
    return given


def budgets(sizes: Mapping[tuple, int], config: MixConfig) -> dict[tuple, int]:
    """Tokens for every leaf, given the tokens that each leaf path holds."""
    capacity: dict[tuple, int] = {}
    children: dict[tuple, set] = {}
    for path, size in sizes.items():
        for depth in range(len(path) + 1):
            capacity[path[:depth]] = capacity.get(path[:depth], 0) + size * config.max_epochs
            if depth:
                children.setdefault(path[: depth - 1], set()).add(path[:depth])
    total = config.total if config.total is not None else int(Fraction(str(config.share)) * sum(sizes.values()))
    given = {(): min(total, capacity.get((), 0))}
    for depth in range(len(config.levels)):
        for node in [n for n in given if len(n) == depth]:
            below = sorted(children.get(node, ()), key=lambda p: (p[-1] is not None, str(p[-1])))
            wants = [(Fraction(str(config.weights.get(p, 1))), capacity[p]) for p in below]
            given.update(zip(below, _divide(given[node], wants), strict=True))
    return {path: given[path] for path in sizes}


def count_tokens(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    config: MixConfig = MixConfig(),
    level_columns: Mapping[str, Column] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The selected rows of `docs` with `mix_epoch` (from 0) and `mix_tokens` (tokens taken from its start).

    A row is returned once for every epoch that takes it; only the last row of a leaf may be cut short.
    """
    spark = docs.sparkSession
    levels = [f"_mix_{i}" for i in range(len(config.levels))]
    given = level_columns or {}
    rows = docs.withColumns({out: given.get(name, F.col(name) if name in docs.columns else F.lit(None)).cast("string") for out, name in zip(levels, config.levels, strict=True)})
    # a filter on the count itself would count twice in every pass
    rows = rows.where(F.col(text).rlike(r"[^\x20\x09-\x0D]")).withColumn("_mix_n", count_tokens(text))
    sizes = rows.groupBy(*levels).agg(F.sum("_mix_n").alias("n")).limit(config.max_leaves + 1).collect()
    if len(sizes) > config.max_leaves:
        raise ValueError(f"more than {config.max_leaves} leaves")
    held = {tuple(r[c] for c in levels): r["n"] for r in sizes}
    plan = [
        (i, *path, budget // held[path], budget % held[path])
        for i, (path, budget) in enumerate(sorted(budgets(held, config).items(), key=str))
        if budget
    ]
    kinds = ", ".join(f"{c} string" for c in levels)
    leaves = spark.createDataFrame(plan, f"_mix_leaf int, {kinds}, _mix_whole long, _mix_rest long")
    bounded = F.broadcast(leaves.toDF("_mix_leaf", *[f"{c}_" for c in levels], "_mix_whole", "_mix_rest"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in levels]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    rows = rows.join(bounded, condition).drop(*levels, *[f"{c}_" for c in levels])

    key = F.md5(F.concat_ws(":", F.lit(config.seed), F.col("_mix_whole"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    ordered = rows.where("_mix_rest > 0").withColumn("_mix_key", key).withColumn("_mix_slice", F.substring("_mix_key", 1, 3))
    slices = ordered.groupBy("_mix_leaf", "_mix_slice").agg(F.sum("_mix_n").alias("n"), F.max("_mix_rest").alias("rest"))
    before = Window.partitionBy("_mix_leaf").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cuts = slices.where("before < rest AND before + n >= rest").select(
        F.col("_mix_leaf").alias("leaf"), F.col("_mix_slice").alias("cut"), F.col("before")
    )
    # one row per leaf, so no larger than the plan
    keyed = rows.withColumn("_mix_key", F.when(F.col("_mix_rest") > 0, key)).withColumn("_mix_slice", F.substring("_mix_key", 1, 3))
    keyed = keyed.join(F.broadcast(cuts), keyed["_mix_leaf"] == F.col("leaf"), "left")
    # whole documents of all epochs in one pass; tokens are counted only for those that are taken
    times = F.col("_mix_whole") + F.when(F.col("_mix_slice") < F.col("cut"), 1).otherwise(0)
    taken = keyed.withColumn("_mix_given", times).where("_mix_given > 0").withColumn("mix_tokens", count_tokens(text))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_given") - 1))
    whole = taken.select(*docs.columns, epochs.alias("mix_epoch"), "mix_tokens")
    inside = Window.partitionBy("_mix_leaf").orderBy("_mix_key", "_mix_n").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = keyed.where("_mix_slice = cut").withColumn("_mix_n", count_tokens(text))
    at_cut = at_cut.withColumn("_mix_at", F.col("before") + F.coalesce(F.sum("_mix_n").over(inside), F.lit(0)))
    at_cut = at_cut.where("_mix_at < _mix_rest").withColumn("mix_tokens", F.least("_mix_n", F.col("_mix_rest") - F.col("_mix_at")))
    return whole.unionByName(at_cut.select(*docs.columns, F.col("_mix_whole").alias("mix_epoch"), "mix_tokens"))

"""Array arithmetic inside one row: norm, arg-max and softmax.

`transform(array(x), f)[0]` evaluates x once and binds it inside f; written directly into the
lambda, x would be computed again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once and bound wherever `use` names it, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def l2_normalize(vector: Column, floor: float = 1e-12) -> Column:
    """Divide by the Euclidean norm, which counts as `floor` at least."""
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    norm = F.greatest(F.sqrt(squares), F.lit(floor))
    return with_value(norm, lambda n: F.transform(vector, lambda x: x.cast("double") / n))


def argmax_id(scores: Column) -> Column:
    """Zero-based position of the top score; the lowest one on ties."""
    return F.array_position(scores, F.array_max(scores)) - 1


def softmax_at_max(scores: Column) -> Column:
    """Softmax probability of the top score."""

    def share(top: Column) -> Column:
        total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
        return 1.0 / total

    return with_value(F.array_max(scores).cast("double"), share)

"""From token to chunk vectors and from chunk to document vectors.

Mean, sum and max run through Spark ML's Summarizer: one buffer per group, combined before the
shuffle, so a document with very many chunks never meets in one task.
"""

from __future__ import annotations

import warnings

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycoder.functions.vectors import with_value
from staycoder.operators.checks import require_choice

MEDIAN_BLOCK = 32  # components that are sorted together
STRATEGIES = ("mean", "max", "median", "first")


def as_vector(df: DataFrame, name: str) -> Column:
    """The column as an ML vector, whether it is stored as one or as an array."""
    if isinstance(df.schema[name].dataType, VectorUDT):
        return F.col(name)
    return array_to_vector(F.col(name).cast("array<double>"))


def as_array(df: DataFrame, name: str) -> Column:
    """The column as array<double>, whether it is stored as an array or as an ML vector."""
    if isinstance(df.schema[name].dataType, VectorUDT):
        return vector_to_array(F.col(name))
    return F.col(name).cast("array<double>")


def masked_mean(tokens: DataFrame, chunk: str, value: str, mask: str, out: str = "emb") -> DataFrame:
    """Mean of the token vectors with mask 1; a chunk with no such token gives the zero vector."""
    masked = F.transform(as_array(tokens, value), lambda x: x * F.col(mask))
    per_token = tokens.select(chunk, F.col(mask).alias("_mask"), array_to_vector(masked).alias("_masked"))
    sums = per_token.groupBy(chunk).agg(
        Summarizer.sum(F.col("_masked")).alias("_sum"), F.sum("_mask").cast("double").alias("_n")
    )
    n = F.greatest(F.col("_n"), F.lit(1.0))
    return sums.select(chunk, F.transform(vector_to_array("_sum"), lambda x: x / n).alias(out))


def first_token_mean(
    tokens: DataFrame,
    chunk: str,
    value: str,
    token_no: str,
    layer: str,
    n_layers: int,
    last_layers: int = 4,
    out: str = "emb",
) -> DataFrame:
    """Mean of the first token's vectors over the last layers (layers count from 1 to n_layers)."""
    heads = tokens.where((F.col(token_no) == 0) & (F.col(layer) > n_layers - last_layers))
    vectors = heads.select(chunk, as_vector(heads, value).alias("_vector"))
    pooled = vectors.groupBy(chunk).agg(Summarizer.mean(F.col("_vector")).alias("_mean"))
    return pooled.select(chunk, vector_to_array("_mean").alias(out))


def _component_medians(chunks: DataFrame, doc: str, value: str, carry: list[str]) -> DataFrame:
    """Exact median per component: vectors are cut into blocks, and each note's blocks are transposed and sorted.

    A group is one block of one note's windows: its size is bounded by the note's own text, and the blocks of a long
    note go to different tasks."""
    numbers = lambda v: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / F.lit(float(MEDIAN_BLOCK))).cast("int") - 1, F.lit(0)))
    blocks = with_value(
        as_array(chunks, value),
        lambda v: F.transform(numbers(v), lambda b: F.slice(v, b * MEDIAN_BLOCK + 1, F.lit(MEDIAN_BLOCK))),
    )
    parts = chunks.select(doc, *carry, F.posexplode_outer(blocks).alias("_b", "_part")).where("_part is not null")
    gathered = parts.groupBy(doc, "_b").agg(F.collect_list("_part").alias("_parts"), *[F.first(c).alias(c) for c in carry])

    def median(i: Column) -> Column:
        values = F.filter(F.transform("_parts", lambda part: F.get(part, i)), lambda x: x.isNotNull())
        middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
        return with_value(F.sort_array(values), middle)

    width = F.array_max(F.transform("_parts", lambda part: F.size(part)))
    medians = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), median)).otherwise(F.array().cast("array<double>"))
    per_block = gathered.select(doc, *carry, F.struct("_b", medians.alias("_m")).alias("_block"))
    ordered = F.array_sort(F.collect_list("_block"))
    return per_block.groupBy(doc).agg(
        F.flatten(F.transform(ordered, lambda block: block["_m"])).alias("_pooled"), *[F.first(c).alias(c) for c in carry]
    )


def _pool(
    chunks: DataFrame, doc: str, value: str, strategy: str, chunk_no: str, carry: list[str]
) -> DataFrame:
    """Pooled array<double> `_pooled` per document, with the `carry` columns of its chunks."""
    if strategy == "median":
        return _component_medians(chunks, doc, value, carry)
    if strategy == "first":
        heads = chunks.where(F.col(chunk_no) == 0)
        return heads.select(doc, *carry, as_array(heads, value).alias("_pooled"))
    summary = Summarizer.max if strategy == "max" else Summarizer.mean
    vectors = chunks.select(doc, *carry, as_vector(chunks, value).alias("_vector"))
    pooled = vectors.groupBy(doc).agg(
        summary(F.col("_vector")).alias("_pooled"), *[F.first(c).alias(c) for c in carry]
    )
    return pooled.withColumn("_pooled", vector_to_array("_pooled"))


def pool_chunks(
    chunks: DataFrame,
    doc: str,
    value: str,
    strategy: str = "mean",
    out: str = "emb",
    chunk_no: str = "chunk_no",
    carry: tuple[str, ...] = (),
    documents: DataFrame | None = None,
) -> DataFrame:
    """One float vector per document; `first` takes chunk number 0. The result is not re-normalised.

    `carry` names columns that are constant within a document and ride along. With `documents`
    (a table holding the `doc` column), documents without chunks appear with a null vector.
    """
    require_choice(strategy, STRATEGIES, "pooling strategy")
    pooled = _pool(chunks, doc, value, strategy, chunk_no, list(carry))
    pooled = pooled.select(doc, *carry, F.col("_pooled").cast("array<float>").alias(out))
    return pooled if documents is None else documents.select(doc).join(pooled, doc, "left")


def pool_logits(
    chunks: DataFrame,
    doc: str,
    value: str,
    strategy: str = "mean",
    out: str = "logits",
    chunk_no: str = "chunk_no",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Class scores per document; an unknown strategy means the mean."""
    if strategy not in STRATEGIES:
        warnings.warn(f"unknown pooling strategy {strategy!r}: using the mean", stacklevel=2)
        strategy = "mean"
    pooled = _pool(chunks, doc, value, strategy, chunk_no, list(carry))
    return pooled.select(doc, *carry, F.col("_pooled").alias(out))

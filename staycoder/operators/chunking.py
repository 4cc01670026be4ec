"""Overlapping token windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycoder.functions import fixed


def whitespace_tokens(text: Column) -> Column:
    """Pieces between whitespace. Windows then count words, not subwords."""
    return F.regexp_extract_all(text, F.lit(rf"(?U)[^{fixed.WS}]++"), F.lit(0))


@dataclass(frozen=True)
class WindowConfig:
    """`chunk_size` counts the special tokens a model adds; they are not part of the window text.

    `tokenizer` turns a text column into an array<string> column (a Pandas UDF around a subword
    tokenizer fits too); `joiner` glues the tokens of a window together again.
    """

    chunk_size: int = 480
    overlap: int = 64
    special_tokens: int = 2
    tokenizer: Callable[[Column], Column] = whitespace_tokens
    joiner: str = " "

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.capacity:
            raise ValueError(f"overlap must lie in [0, {self.capacity}), not {self.overlap}")

    @property
    def capacity(self) -> int:
        return self.chunk_size - self.special_tokens

    @property
    def step(self) -> int:
        return self.capacity - self.overlap


def window_count(n_tokens: Column, config: WindowConfig) -> Column:
    """0 without tokens, else as many windows as reach the last token."""
    beyond = F.greatest(n_tokens - config.capacity, F.lit(0))
    more = F.ceil(beyond / F.lit(float(config.step))).cast("int")
    return F.when(n_tokens == 0, F.lit(0)).otherwise(more + 1)


def add_chunks(
    df: DataFrame, text: Column, config: WindowConfig = WindowConfig(), out: str = "chunks"
) -> DataFrame:
    """Add the window texts of `text` as array column `out`; empty and blank text gives an empty array."""
    tokens, count = f"_{out}_tokens", f"_{out}_count"

    def window_text(i: Column) -> Column:
        return F.array_join(F.slice(tokens, i * config.step + 1, F.lit(config.capacity)), config.joiner)

    numbers = F.sequence(F.lit(0), F.col(count) - 1)
    windows = F.when(F.col(count) > 0, F.transform(numbers, window_text))
    found = config.tokenizer(text)
    if config.tokenizer is not whitespace_tokens:  # a model's tokenizer may have tokens for blanks
        found = F.when(F.rlike(text, F.lit(rf"(?U)[^{fixed.WS}]")), found).otherwise(F.array().cast("array<string>"))
    return (
        df.withColumn(tokens, found)
        .withColumn(count, window_count(F.size(tokens), config))
        .withColumn(out, F.coalesce(windows, F.array().cast("array<string>")))
        .drop(tokens, count)
    )


def explode_chunks(
    df: DataFrame, keep: list[str], chunks: str = "chunks", fallback: Column | None = None
) -> DataFrame:
    """One row per window: the `keep` columns, chunk_no, chunk_text.

    With `fallback`, a document without windows gives one row holding that text, so that every
    document is scored; without it such documents give no row. The outer form matters: for the plain
    one the optimiser adds a filter "array is not empty" under the scan, which cuts every window a
    second time, inlined into its own lambda.
    """
    texts = F.col(chunks)
    if fallback is not None:
        texts = F.when(F.size(texts) > 0, texts).otherwise(F.array(fallback))
    rows = df.select(*keep, F.posexplode_outer(texts).alias("chunk_no", "chunk_text"))
    return rows.where("chunk_no is not null") if fallback is None else rows


def labelled_chunks(
    df: DataFrame,
    keep: list[str],
    text: str,
    label: str,
    labels: DataFrame,
    config: WindowConfig = WindowConfig(),
) -> DataFrame:
    """Training rows at window level, each with its document's label id; at least one per document.

    `labels` (label, label_id) should be a stored table, see `sources.shared`.
    """
    ids = labels.select(F.col("label").alias(label), "label_id")
    documents = df.select(*keep, text, label).join(ids, label, "left")
    windows = add_chunks(documents, F.col(text), config)
    return explode_chunks(windows, [*keep, label, "label_id"], fallback=F.lit(""))


def first_window(
    df: DataFrame,
    keep: list[str],
    text: str,
    label: str,
    labels: DataFrame,
    max_length: int = 512,
    config: WindowConfig = WindowConfig(),
) -> DataFrame:
    """One training row per document: its first tokens and its label id."""
    capacity = max_length - config.special_tokens
    head = F.array_join(F.slice(config.tokenizer(F.col(text)), 1, capacity), config.joiner)
    ids = labels.select(F.col("label").alias(label), "label_id")
    return df.select(*keep, label, head.alias("chunk_text")).join(ids, label, "left")

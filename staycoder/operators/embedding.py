"""Chunk vectors: a hashed bag of words, the user's encoder of texts, or the user's encoder of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycoder.functions.text import word_tokens
from staycoder.functions.vectors import l2_normalize, with_value
from staycoder.operators.checks import require_choice
from staycoder.operators.scoring import score

TOKEN_POOLINGS = ("mean", "first")


def word_bucket(word: Column, buckets: int) -> Column:
    """Place of a word among `buckets`: its first eight md5 digits as a number, modulo their count."""
    digits = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint")
    return (digits % buckets).cast("int")


def hashed_vector(words: Column, features: int) -> Column:
    """Unit-length counts of the words' buckets; no words give the zero vector.

    The buckets are sorted, so that a bucket's count is the distance from its first place to the next bucket's:
    one native search per bucket, whatever the number of words.
    """
    every = F.sequence(F.lit(0), F.lit(features - 1))
    nothing = F.array_repeat(F.lit(0.0), features)

    def scattered(places: Column, own: Column, firsts: Column) -> Column:
        nexts = F.concat(F.slice(firsts, 2, F.size(firsts)), F.array(F.size(places).cast("bigint") + 1))
        counts = F.zip_with(firsts, nexts, lambda first, following: (following - first).cast("double"))

        def scaled(counts: Column) -> Column:
            norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + n * n))
            return with_value(norm, lambda size: F.transform(counts, lambda n: n / size))

        place = lambda i: (F.array_position(own, i) - 1).cast("int")
        spread_out = lambda unit: F.transform(every, lambda i: F.coalesce(F.get(unit, place(i)), F.lit(0.0)))
        return with_value(with_value(counts, scaled), spread_out)

    def of(places: Column) -> Column:
        firsts = lambda own: F.transform(own, lambda bucket: F.array_position(places, bucket))
        dense = with_value(F.array_distinct(places), lambda own: with_value(firsts(own), lambda first: scattered(places, own, first)))
        return F.when(F.size(places) > 0, dense).otherwise(nothing)

    return with_value(F.sort_array(F.transform(words, lambda word: word_bucket(word, features))), of)


def embed_hashed(
    chunks: DataFrame, text: str = "chunk_text", out: str = "emb", features: int = 256
) -> DataFrame:
    """Hashed word counts as a unit vector (array<double>): a native stand-in for a frozen encoder.

    Any engine with md5 gives the same vectors. A text without words, or none, gives the zero vector.
    """
    words = F.coalesce(word_tokens(F.lower(F.col(text))), F.array().cast("array<string>"))
    return chunks.withColumn(out, hashed_vector(words, features))


def embed_with_model(
    chunks: DataFrame,
    model_factory: Callable[[], Callable],
    text: str = "chunk_text",
    out: str = "emb",
    batch_size: int = 16,
) -> DataFrame:
    """Unit-length vectors (array<double>) of the user's encoder, called on batches of chunk texts."""
    raw = f"_{out}_raw"
    encoded = chunks.withColumn(raw, score(F.col(text), model_factory, "array<double>", batch_size))
    return encoded.withColumn(out, l2_normalize(F.col(raw))).drop(raw)


def pooled_tokens(
    factory: Callable[[], Callable], pooling: str = "mean", last_layers: int = 4
) -> Callable[[], Callable]:
    """Model factory of chunk vectors from one of token vectors.

    The token model maps texts to (hidden states, mask): a sequence of layers, each texts x tokens x components, and
    texts x tokens of 0 and 1. `mean` averages the last layer over tokens with mask 1 (none: the zero vector), `first` the
    first tokens of the last layers. Pooling happens beside the model: a chunk's token vectors of all layers can be
    megabytes, of which one vector goes back to Spark. `operators.pooling` has the same poolings for stored token tables.
    """
    require_choice(pooling, TOKEN_POOLINGS, "token pooling")

    def make():
        import numpy as np

        model = factory()

        def encode(texts):
            hidden, mask = model(texts)
            if pooling == "first":
                return list(np.mean([np.asarray(layer)[:, 0, :] for layer in hidden[-last_layers:]], axis=0))
            weight = np.asarray(mask, dtype="float64")[:, :, None]
            total = (np.asarray(hidden[-1]) * weight).sum(axis=1)
            return list(total / np.maximum(weight.sum(axis=1), 1))

        return encode

    return make

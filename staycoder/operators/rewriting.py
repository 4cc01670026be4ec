"""Rewriting notes: copy, extract, or the user's generative model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycoder.functions.prompts import rewrite_messages
from staycoder.functions.text import first_present, sentences, strip, word_tokens
from staycoder.operators.scoring import GenerationOptions, score


@dataclass(frozen=True)
class RewriteConfig:
    """The options of generation reach the model factory; `seed` None means that the model draws by itself."""

    enabled: bool = False
    target_words: int | None = None
    model_name: str | None = None
    max_new_tokens: int = 128
    temperature: float = 0.3
    top_p: float = 0.95
    repetition_penalty: float = 1.1
    batch_size: int = 16
    seed: int | None = 42

    @property
    def options(self) -> GenerationOptions:
        return GenerationOptions(self.max_new_tokens, self.temperature, self.top_p, self.repetition_penalty)


def base_text(df: DataFrame) -> Column:
    """The normalised text where there is one, even if empty; else the text."""
    return first_present(*[F.col(c) for c in ("text_norm", "text") if c in df.columns])


def rewrite(
    df: DataFrame,
    config: RewriteConfig = RewriteConfig(),
    model_factory: Callable[[GenerationOptions], Callable] | None = None,
    out: str = "text_rw",
    row_key: Column | None = None,
) -> DataFrame:
    """Add the rewritten text. Disabled, or without a model, it is a copy; empty text stays empty.

    The model gets a list of messages per note (role, content) and returns only its answer. Its
    output is sampled: store the result before several consumers read it.
    """
    base = base_text(df)
    if not config.enabled or model_factory is None:
        return df.withColumn(out, base)
    messages = rewrite_messages(base, config.target_words)
    key = F.xxhash64(base) if row_key is None else row_key
    answer = score(messages, model_factory, "string", config.batch_size, config.seed, config.options, key)
    # two projections: an expression around the model call could run the model more than once
    answered = df.withColumn(out, answer)
    return answered.withColumn(out, F.coalesce(strip(F.col(out)), F.lit("")))


def rewrite_extract(
    df: DataFrame, target_words: int, out: str = "text_rw", lead: str = r"(?iU)\bconclusion\b"
) -> DataFrame:
    """A rewrite without a model: whole sentences up to `target_words` words in all, those matching
    `lead` first, then in text order. It shortens, it does not paraphrase."""
    ordered, sizes = f"_{out}_sentences", f"_{out}_sizes"
    pieces = df.withColumn(ordered, sentences(base_text(df)))
    leading = F.filter(ordered, lambda s: F.rlike(s, F.lit(lead)))
    others = F.filter(ordered, lambda s: ~F.rlike(s, F.lit(lead)))
    pieces = pieces.withColumn(ordered, F.concat(leading, others))
    pieces = pieces.withColumn(sizes, F.transform(ordered, lambda s: F.size(word_tokens(s))))
    # count the leading sentences whose running word total stays within the target
    nothing = F.struct(F.lit(0).alias("words"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def take(acc: Column, size: Column) -> Column:
        fits = acc["open"] & (acc["words"] + size <= target_words)
        return F.struct(
            F.when(fits, acc["words"] + size).otherwise(acc["words"]).alias("words"),
            F.when(fits, acc["kept"] + 1).otherwise(acc["kept"]).alias("kept"),
            fits.alias("open"),
        )

    kept = F.aggregate(sizes, nothing, take, lambda acc: acc["kept"])
    text = F.array_join(F.slice(ordered, F.lit(1), kept), ". ")
    return pieces.withColumn(out, text).drop(ordered, sizes)

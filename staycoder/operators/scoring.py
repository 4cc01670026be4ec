"""Models supplied by the user, run on batches inside the Python workers.

A model factory returns a callable `list of inputs -> sequence of outputs`. It takes no argument, or the sampling
options if the step has some (rewriters and generators do). With a seed the callable also gets a list of numpy random
generators, one for each input: an input's generator depends on the seed and the input's row key only, so
that sampled output is the same however rows are split and batched. The factory
runs once per Python worker and scoring step, not per task or batch; load weights there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from staycoder.functions.codes import answer_code
from staycoder.functions.prompts import coding_prompt
from staycoder.functions.text import first_filled
from staycoder.functions.vectors import argmax_id, softmax_at_max

PREDICTION_TYPE = "struct<code:string,score:double>"
ROWS_AT_ONCE = 256  # inputs that a task holds as Python objects (one model batch at least); the rest stays in Arrow
OUT_BYTES = 4 << 20  # answers that a task holds before they go back to Spark


@dataclass(frozen=True)
class GenerationOptions:
    """What a generating model is asked for; temperature 0 means no sampling."""

    max_new_tokens: int = 64
    temperature: float = 0.0
    top_p: float = 1.0
    repetition_penalty: float = 1.0


def score(
    inputs: Column,
    model_factory: Callable[..., Callable],
    return_type: str,
    batch_size: int = 16,
    seed: int | None = None,
    options: GenerationOptions | None = None,
    row_key: Column | None = None,
) -> Column:
    """Model outputs for a column; a null input is not sent to the model and gives null.

    `options` reach the factory in the worker, as an object with the same fields. `row_key` (a long; by default the
    hash of the input, so that equal inputs draw alike) matters with a seed only.

    Only the input column, and with a seed the key, travels to Python. Batches run over row borders of documents, so explode
    chunks first. The result is marked non-deterministic: Spark neither repeats nor reorders it
    within one plan, but a second action calls the model again; store it (`write_once`) before
    using it twice. Make the result a column of its own before computing with it.
    """
    size = max(1, int(batch_size))
    step_id, kept_models = uuid.uuid4().hex, 2
    given_options = [] if options is None else [asdict(options)]

    def load():
        """The step's model, kept for the later tasks of a reused worker; the oldest ones make room."""
        import sys
        import types

        store = sys.modules.setdefault("_staycoder_models", types.ModuleType("_staycoder_models"))
        models = store.__dict__.setdefault("models", {})
        if step_id not in models:
            while len(models) >= kept_models:
                del models[next(iter(models))]
            models[step_id] = model_factory(*(types.SimpleNamespace(**o) for o in given_options))
        return models[step_id]

    at_once = size * max(1, ROWS_AT_ONCE // size)
    from pyspark.sql.pandas.types import to_arrow_type

    out_bytes, kind = OUT_BYTES, to_arrow_type(DataType.fromDDL(return_type))

    def answers(model, column, keys):
        """Arrays of the answers to an Arrow array; only few rows at a time are Python objects, few answers wait."""
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        given = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        edges = [0, *given[at_once::at_once].tolist(), len(column)]
        done = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rows = (given[(given >= lo) & (given < hi)] - lo).tolist()
            values = column.slice(lo, hi - lo).drop_null().to_pandas()
            results = [None] * (hi - lo)
            for start in range(0, len(rows), size):
                part = rows[start : start + size]
                extra = ()
                if keys is not None:
                    own = ([seed % 2**64, keys[lo + i].as_py() % 2**64] for i in part)
                    extra = ([np.random.Generator(np.random.Philox(key=np.array(k, dtype=np.uint64))) for k in own],)
                inputs = [values.iloc[i] for i in range(start, start + len(part))]
                for i, result in zip(part, model(inputs, *extra), strict=True):
                    results[i] = result
            done.append(pa.Array.from_pandas(pd.Series(results, dtype=object), type=kind))
            if hi == len(column) or sum(d.nbytes for d in done) >= out_bytes:
                yield pa.concat_arrays(done)
                done = []

    def run(batches):
        model = load()
        for column in batches:
            yield from answers(model, column, None)

    def run_seeded(batches):
        model = load()
        for column, keys in batches:
            yield from answers(model, column, keys)

    # the annotations of an iterator Arrow UDF, set by hand so that the closures stay self-contained
    from collections.abc import Iterator

    import pyarrow as pa

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    run_seeded.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    if seed is None:
        return F.arrow_udf(run, return_type).asNondeterministic()(inputs)
    key = F.xxhash64(inputs) if row_key is None else row_key.cast("long")
    return F.arrow_udf(run_seeded, return_type).asNondeterministic()(inputs, F.coalesce(key, F.lit(0)))


def label_predictions(
    pooled: DataFrame,
    logits: str = "logits",
    labels: DataFrame | None = None,
    out: str = "pred",
    with_score: bool = True,
) -> DataFrame:
    """Add `out` = struct(code, score): label of the top logit and its softmax probability.

    `labels` (label_id, label) is the model's label table; an id without label is given as text.
    """
    scored = pooled.withColumn("label_id", argmax_id(F.col(logits)).cast("int"))
    code = F.col("label_id").cast("string")
    if labels is not None:
        names = labels.select(F.col("label_id").cast("int"), F.col("label").alias("_label"))
        scored = scored.join(names, "label_id", "left")
        code = F.coalesce(F.col("_label"), code)
    probability = softmax_at_max(F.col(logits)) if with_score else F.lit(None).cast("double")
    scored = scored.withColumn(out, F.struct(code.alias("code"), probability.alias("score")))
    return scored.drop("_label")


def linear_scorer(weights, intercepts) -> Callable[[], Callable]:
    """Model factory for `x @ weights.T + intercepts` (weights: classes x features)."""

    def factory():
        import numpy as np

        matrix, offset = np.asarray(weights, dtype="float64"), np.asarray(intercepts, dtype="float64")

        def model(rows):
            return list(np.stack([np.asarray(r, dtype="float64") for r in rows]) @ matrix.T + offset)

        return model

    return factory


def generate_codes(
    df: DataFrame,
    model_factory: Callable[[GenerationOptions], Callable],
    texts: tuple[str, ...] = ("text_rw", "text_norm", "text"),
    out: str = "pred",
    fallback: str = "full",
    batch_size: int = 16,
    seed: int | None = None,
    options: GenerationOptions = GenerationOptions(),
    row_key: Column | None = None,
) -> DataFrame:
    """Prompt a generative model for the code of each note and extract it from the answer.

    The model returns prompt and answer in one text. The note is the first filled of `texts`. The seed is
    passed on only if the options ask for sampling.
    """
    note = first_filled(*[F.col(t) for t in texts if t in df.columns])
    seed = seed if options.temperature > 0 else None
    generated = score(coding_prompt(note), model_factory, "string", batch_size, seed, options, row_key)
    answered = df.withColumn("_generated", generated)
    code = answer_code(F.col("_generated"), fallback)
    prediction = F.struct(code.alias("code"), F.lit(None).cast("double").alias("score"))
    return answered.withColumn(out, prediction).drop("_generated")

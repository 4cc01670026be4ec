"""From notes to one predicted code per note.

A step is a function DataFrame -> DataFrame; `build` chains the steps that a configuration asks
for, so that `documents.transform(build(config))` is the whole run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from staycoder.functions import fixed
from staycoder.functions.text import add_text_metrics, first_filled, normalize_text, strip
from staycoder.operators.checks import require_choice, require_rows
from staycoder.operators.chunking import WindowConfig, add_chunks, explode_chunks
from staycoder.operators.embedding import TOKEN_POOLINGS, embed_hashed, embed_with_model, pooled_tokens
from staycoder.operators.head import HeadConfig, fit_head, load_head, predict_head, save_head
from staycoder.operators.metrics import summary_columns
from staycoder.operators.pooling import pool_chunks, pool_logits
from staycoder.operators.rewriting import RewriteConfig, rewrite
from staycoder.operators.scoring import GenerationOptions, generate_codes, label_predictions, score
from staycoder.sources.documents import as_documents, read_table
from staycoder.sources.shared import file_row_key, spread, with_row_key, write_once
from staycoder.sources.sinks import prediction_output, write_table

Step = Callable[[DataFrame], DataFrame]
Factory = Callable[..., Callable]

BACKENDS = ("embedding_head", "chunk_classifier", "generation")
MODES = ("train", "predict")
KEY = "doc_key"


@dataclass(frozen=True)
class PredictConfig:
    """`encoder`, `token_encoder`, `classifier`, `generator` and `rewriter` are model factories (operators.scoring,
    for tokens operators.embedding).

    Without an encoder the hashed bag of words stands in. `head_path` is where a fitted head is
    saved (train) and found (predict). `seed` is for sampled codes, `rewrite` has its own; a note's draws depend on the
    seed, its id and its text. `with_scores` off leaves the score of classified notes empty.
    """

    backend: str = "embedding_head"
    mode: str = "predict"
    normalise: bool = False
    with_metrics: bool = False
    rewrite: RewriteConfig = field(default_factory=RewriteConfig)
    windows: WindowConfig = field(default_factory=WindowConfig)
    aggregate: str = "mean"
    aggregate_logits: str = "mean"
    hashed_features: int = 256
    head: HeadConfig = field(default_factory=HeadConfig)
    head_path: str | None = None
    batch_size: int = 16
    answer_fallback: str = "full"
    encoder: Factory | None = None
    token_encoder: Factory | None = None
    token_pooling: str = "mean"
    token_layers: int = 4
    classifier: Factory | None = None
    classifier_labels: DataFrame | None = None
    with_scores: bool = True
    generator: Factory | None = None
    generation: GenerationOptions = field(default_factory=GenerationOptions)
    seed: int | None = 42
    rewriter: Factory | None = None

    def __post_init__(self) -> None:
        require_choice(self.backend, BACKENDS, "backend")
        require_choice(self.mode, MODES, "mode")
        require_choice(self.token_pooling, TOKEN_POOLINGS, "token pooling")
        if self.backend == "chunk_classifier" and self.classifier is None:
            raise ValueError("the chunk_classifier backend needs a classifier")
        if self.backend == "generation" and self.generator is None:
            raise ValueError("the generation backend needs a generator")
        if self.backend == "embedding_head" and self.mode == "predict" and not self.head_path:
            raise ValueError("predict mode needs head_path, the place of a fitted head")

    @property
    def measures(self) -> bool:
        return self.with_metrics and self.rewrite.enabled


def _texts(df: DataFrame, *names: str) -> list:
    return [F.col(name) for name in names if name in df.columns]


def _carried(df: DataFrame) -> list[str]:
    return [c for c in ("id_sejour", "gold_dp", "metrics_before", "metrics_after") if c in df.columns]


def _draw_key(df: DataFrame) -> Column:
    """What a note's random draws hang on beside the seed: nothing of the table's layout."""
    return F.xxhash64(*(c for c in ("id_sejour", "text") if c in df.columns))


def _rewrite_step(df: DataFrame, config: PredictConfig) -> DataFrame:
    rewritten = rewrite(df, config.rewrite, config.rewriter, row_key=_draw_key(df))
    # sampled output has several readers downstream: compute it once
    return write_once(rewritten, "rewritten") if config.rewriter is not None else rewritten


def _windows(df: DataFrame, config: PredictConfig, *fallback: str) -> DataFrame:
    note = strip(first_filled(*_texts(df, "text_rw", "text_norm", "text")))
    chunked = add_chunks(df, note, config.windows)
    last_resort = first_filled(*_texts(df, *fallback))
    return explode_chunks(chunked, [KEY, *_carried(df)], fallback=last_resort)


def document_vectors(df: DataFrame, config: PredictConfig) -> DataFrame:
    """One vector per note: window, embed, pool. The windows of a note are pooled before the shuffle."""
    chunks = _windows(df, config, "text_rw", "text")
    encoder = config.encoder
    if config.token_encoder is not None:
        encoder = pooled_tokens(config.token_encoder, config.token_pooling, config.token_layers)
    if encoder is not None:
        embedded = embed_with_model(chunks, encoder, batch_size=config.batch_size)
    else:
        embedded = embed_hashed(chunks, features=config.hashed_features)
    return pool_chunks(embedded, KEY, "emb", config.aggregate, carry=tuple(_carried(df)))


def _embedding_head(df: DataFrame, config: PredictConfig) -> DataFrame:
    vectors = document_vectors(df, config)
    if config.mode == "train":
        vectors = write_once(vectors, "document-vectors")
        model = fit_head(vectors, "emb", "gold_dp", config.head)
        if config.head_path:
            save_head(model, config.head_path)
    else:
        model = load_head(config.head_path)
    return predict_head(vectors, model, "emb")


def _chunk_classifier(df: DataFrame, config: PredictConfig) -> DataFrame:
    chunks = _windows(df, config, "text")
    logits = score(F.col("chunk_text"), config.classifier, "array<double>", config.batch_size)
    scored = chunks.withColumn("logits", logits)
    pooled = pool_logits(scored, KEY, "logits", config.aggregate_logits, carry=tuple(_carried(df)))
    return label_predictions(pooled, "logits", config.classifier_labels, with_score=config.with_scores)


def _generation(df: DataFrame, config: PredictConfig) -> DataFrame:
    return generate_codes(
        df,
        config.generator,
        fallback=config.answer_fallback,
        batch_size=config.batch_size,
        seed=config.seed,
        options=config.generation,
        row_key=_draw_key(df),
    )


def steps(config: PredictConfig) -> list[Step]:
    chosen: list[Step] = []
    if config.normalise:
        chosen.append(lambda df: df.withColumn("text_norm", normalize_text(F.col("text"))))
    if config.measures:
        chosen.append(partial(add_text_metrics, text="text", out="metrics_before"))
    if config.rewrite.enabled:
        chosen.append(partial(_rewrite_step, config=config))
    if config.measures:
        chosen.append(partial(add_text_metrics, text="text_rw", out="metrics_after"))
    backend = {
        "embedding_head": _embedding_head,
        "chunk_classifier": _chunk_classifier,
        "generation": _generation,
    }[config.backend]
    chosen.append(partial(backend, config=config))
    return chosen


def build(config: PredictConfig) -> Step:
    """The steps in order; input columns doc_key, text and, if present, id_sejour and gold_dp."""
    chosen = steps(config)
    return lambda df: reduce(lambda table, step: table.transform(step), chosen, df)


def run_predict(
    spark: SparkSession,
    config: PredictConfig,
    input_path: str,
    output_path: str,
    input_format: str = "csv",
    output_format: str = "csv",
    key: str | None = None,
    col_text: str = fixed.COL_TEXT,
    col_gold: str | None = None,
    col_patient: str = fixed.COL_PATIENT,
    col_stay: str = fixed.COL_STAY,
    out_stay: str = fixed.COL_STAY,
    out_pred: str = fixed.COL_PREDICTION,
) -> dict[str, object]:
    """Read notes, predict, write; returns the run summary (documents, predictions, metric means).

    `key` names a unique column of the input. Without one, a row of a parquet file is known by the file and its place
    in it; other notes are stored with a generated key first, which also turns an unsplittable CSV file into
    splittable parquet.
    """
    training = config.backend == "embedding_head" and config.mode == "train"
    if training and col_gold is None:
        raise ValueError("train mode needs col_gold, the column of gold codes")
    table = read_table(spark, input_path, input_format)
    gold = col_gold if training else None
    if key is None and input_format != "parquet":
        documents = with_row_key(as_documents(table, col_text, gold, col_patient, col_stay), KEY)
    else:
        own = file_row_key() if key is None else F.col(key)
        documents = as_documents(
            table.withColumn(KEY, own), col_text, gold, col_patient, col_stay, keep=(KEY,)
        )
    require_rows(documents, f"no document in {input_path}")
    predicted = spread(documents, KEY).transform(build(config))
    phases = {"before": "metrics_before", "after": "metrics_after"} if config.measures else None
    output = prediction_output(predicted, "pred", out_stay, out_pred, phases)
    # counted while writing: no second pass, and no model runs twice
    summary = Observation("run summary")
    output = output.observe(summary, *summary_columns(F.col(out_pred), means=config.measures))
    write_table(output, output_path, output_format)
    return summary.get

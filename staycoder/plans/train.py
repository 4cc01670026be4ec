"""Training: label map, split, windows and class weights (`run_prepare`), and a weighted head on them (`run_train`)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staycoder.functions import fixed
from staycoder.operators.checks import require_rows
from staycoder.operators.chunking import WindowConfig, first_window, labelled_chunks
from staycoder.operators.embedding import embed_hashed, embed_with_model
from staycoder.operators.evaluation import classification_report, confusion_counts, eval_scores
from staycoder.operators.head import HeadConfig, class_logits, fit_head, save_head
from staycoder.operators.pooling import pool_logits
from staycoder.operators.scoring import label_predictions
from staycoder.operators.splitting import class_weights, label_map, per_class_split, split_stats
from staycoder.sources.documents import read_table, training_rows
from staycoder.sources.shared import spread, with_row_key, write_once
from staycoder.sources.sinks import label_map_json, split_stats_json, write_json_row, write_object, write_table


@dataclass(frozen=True)
class TrainConfig:
    text: str = fixed.COL_TEXT
    label: str = fixed.COL_GOLD
    val_frac: float = 0.1
    seed: int = 42
    do_chunk: bool = False
    max_length: int = 512
    windows: WindowConfig = field(default_factory=WindowConfig)
    head: HeadConfig = field(default_factory=HeadConfig)
    hashed_features: int = 256
    batch_size: int = 16


def training_table(rows: DataFrame, labels: DataFrame, config: TrainConfig, keep: list[str]) -> DataFrame:
    """Windows of all documents, or one truncated text each, with label ids."""
    if config.do_chunk:
        return labelled_chunks(rows, keep, config.text, config.label, labels, config.windows)
    return first_window(rows, keep, config.text, config.label, labels, config.max_length, config.windows)


def run_prepare(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    config: TrainConfig = TrainConfig(),
    fmt: str = "csv",
    key: str | None = None,
) -> dict[str, int]:
    """Write data/train, data/val, windows/train, windows/val, class_weights and the files label_map.json,
    split_stats.json and config_train.json under `output_path`; returns the number of training and
    validation rows (windows if chunked)."""
    table = read_table(spark, input_path, fmt)
    rows = training_rows(table, config.text, config.label, keep=(key,) if key else ())
    require_rows(rows, f"no row with a text and a label in {input_path}")
    if key is None:
        key = "doc_key"
        rows = with_row_key(rows, key)
    elif fmt == "csv":
        rows = write_once(rows, "rows")  # the split reads its input three times
    labels = write_once(label_map(rows, config.label), "labels")
    split = write_once(per_class_split(rows, config.label, key, config.val_frac, config.seed), "split")
    stats = split_stats(split, config.label)
    windows = training_table(spread(split, key), labels, config, [key, "split"])
    train = split.where("split = 'train'")

    sizes = {}
    for part in ("train", "val"):
        data = split.where(F.col("split") == part).select(config.text, config.label)
        write_table(data, f"{output_path}/data/{part}", fmt)
        windows.where(F.col("split") == part).drop("split").write.mode("overwrite").parquet(
            f"{output_path}/windows/{part}"
        )
        sizes[f"n_{part}"] = spark.read.parquet(f"{output_path}/windows/{part}").count()
    class_weights(train, config.label, labels).write.mode("overwrite").parquet(
        f"{output_path}/class_weights"
    )
    write_object(label_map_json(labels), f"{output_path}/label_map.json")
    write_object(split_stats_json(stats), f"{output_path}/split_stats.json")
    options = {"input": input_path, "output": output_path, "format": fmt}
    options |= {k: v for k, v in asdict(config).items() if k not in ("windows", "head")}
    options |= {"chunk_size": config.windows.chunk_size, "chunk_overlap": config.windows.overlap, **asdict(config.head), **sizes}
    settings = spark.range(1).select(*[F.lit(v).alias(k) for k, v in options.items()])
    write_json_row(settings, f"{output_path}/config_train.json")
    return sizes


def _window_vectors(windows: DataFrame, config: TrainConfig, encoder: Callable[[], Callable] | None) -> DataFrame:
    if encoder is not None:
        return embed_with_model(windows, encoder, batch_size=config.batch_size)
    return embed_hashed(windows, features=config.hashed_features)


def weighted_loss(scored: DataFrame, label_id: str = "label_id", weight: str = "weight", logits: str = "logits") -> float | None:
    """Mean cross-entropy of rows with log-probabilities, by weight; None without rows."""
    miss = -F.get(logits, F.col(label_id)) * F.col(weight)
    return scored.agg(F.try_divide(F.sum(miss), F.sum(weight).cast("double"))).first()[0]


def run_train(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    config: TrainConfig = TrainConfig(),
    encoder: Callable[[], Callable] | None = None,
    fmt: str = "csv",
    key: str | None = None,
) -> dict[str, object]:
    """`run_prepare`, a head fitted on the training windows with class weights, and its evaluation.

    Every window carries its document's label, and its loss the weight of that class. Beside the prepared data
    `output_path` gets final/head, predictions/val (one row per validation document: its windows' log-probabilities
    averaged), report/val and eval.json. Returns the sizes, the weighted loss of the validation windows, and accuracy and
    macro averages of the validation documents (all None without such documents).
    """
    sizes = run_prepare(spark, input_path, output_path, config, fmt, key)
    key = key or "doc_key"
    weights = spark.read.parquet(f"{output_path}/class_weights").select("label_id", F.col("weight").cast("double").alias("weight"))
    parts = {}
    for part in ("train", "val"):
        windows = spread(spark.read.parquet(f"{output_path}/windows/{part}"))
        vectors = _window_vectors(windows, config, encoder).drop("chunk_text").join(weights, "label_id")
        parts[part] = write_once(vectors, f"{part}-vectors")
    model = fit_head(parts["train"], "emb", config.label, config.head, "weight")
    save_head(model, f"{output_path}/final/head")

    scored = write_once(class_logits(parts["val"], model), "val-logits")
    pooled = pool_logits(scored, key, "logits", "mean", carry=(config.label,))
    known = spark.createDataFrame(list(enumerate(model.stages[-1].getOrDefault("classes"))), "label_id int, label string")
    predicted = label_predictions(pooled, "logits", known)
    predicted.select(key, config.label, "pred.code", "pred.score").write.mode("overwrite").parquet(f"{output_path}/predictions/val")
    documents = spark.read.parquet(f"{output_path}/predictions/val")
    result: dict[str, object] = {**sizes, "eval_loss": weighted_loss(scored)}
    counts = write_once(confusion_counts(documents, documents, key, key, config.label, "code"), "confusion-counts")
    scores = eval_scores(counts, ("macro",)).first()
    result |= {name: scores[name] if scores["n_pairs"] else None for name in ("accuracy", "precision", "recall", "f1")}
    classification_report(counts).write.mode("overwrite").parquet(f"{output_path}/report/val")
    write_json_row(spark.createDataFrame([tuple(result.values())], ", ".join(f"{k} {'long' if k in sizes else 'double'}" for k in result)), f"{output_path}/eval.json")
    return result

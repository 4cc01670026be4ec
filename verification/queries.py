"""Every operator as a query over the given tables: documents stand in for notes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staycoder.functions import codes, fixed, prompts, text, vectors
from staycoder.operators import (
    chunking,
    embedding,
    evaluation,
    head,
    metrics,
    pooling,
    rewriting,
    scoring,
    splitting,
)
from staycoder.plans import predict, rewrite, train
from staycoder.plans.evaluate import run_evaluate
from staycoder.sources import documents as sources
from staycoder.sources import sinks
from staycoder.sources.shared import shared_folder, spread, write_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SMALL_WINDOWS = chunking.WindowConfig(chunk_size=50, overlap=8)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with blank lines between paragraphs."""
    return docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n\n")).alias("text"))


def coded(name: str, number: str) -> Column:
    """A text with a code-like mark, A00.0 to Z99.9, at its end."""
    letter = F.char(65 + F.col(number) % 26)
    digits = F.lpad((F.col(number) % 100).cast("string"), 2, "0")
    code = F.concat(letter, digits, F.lit("."), (F.col(number) % 10).cast("string"))
    return F.concat(F.col(name), F.lit(" code "), code, F.lit(" fin"))


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks of documents, five each."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 5").alias("doc"),
        (F.col("vec_id") % 5).cast("int").alias("chunk_no"),
        "vec_id",
        "embedding",
        "label",
    )


def components(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    exploded = df.select(*keys, F.posexplode_outer(value).alias("i", "x"))
    return exploded.select(*keys, F.col("i").cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


def sixth(name: str) -> Column:
    return F.round(F.col(name).cast("double"), 6).alias(name)


def big(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("bigint").alias(alias or name)


def metric_columns(struct: str) -> list[Column]:
    return [
        (F.col(struct)[m] if m == "sent_len_avg" else F.col(struct)[m].cast("bigint")).alias(m)
        for m in fixed.METRICS
    ]


def flat_as_big(df: DataFrame) -> list[Column]:
    return [
        F.col(c) if c.startswith("sent_len_avg") or df.schema[c].dataType.typeName() != "integer" else big(c)
        for c in df.columns
    ]


# ---- sources and sinks -------------------------------------------------------------------------


@query
def scan_documents(spark, sf_dir):
    padded = table(spark, sf_dir, "documents").withColumn("code", F.concat(F.lit(" \t"), "lang", F.lit("\n")))
    return sources.as_documents(padded, "text", "code", "source", "doc_id")


def _as_csv(df: DataFrame, name: str) -> str:
    """The rows as CSV files under the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    sinks.write_table(df, path)
    return path


@query
def scan_csv(spark, sf_dir):
    """Documents written as CSV, with quotes and line breaks in their texts, and read as notes."""
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit(" "), F.lit(' "" ')), F.lit(',\n"'))
    rows = docs(spark, sf_dir).select("doc_id", quoted.alias("text"), F.expr("CASE WHEN lang <> 'de' THEN concat(lang, ' ') END").alias("code"))
    back = sources.read_table(spark, _as_csv(rows, "scan"))
    return sources.as_documents(back, "text", "code", "patient", "doc_id")


def _labelled(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query
def train_rows(spark, sf_dir):
    return sources.training_rows(_labelled(spark, sf_dir), "text", "quality", keep=("doc_id",))


def _predicted(spark, sf_dir) -> DataFrame:
    """Documents with a predicted code for those that have a quality label."""
    code = F.when(F.col("quality").isNotNull(), F.concat(F.lit("Q"), F.col("quality").cast("string")))
    pred = F.struct(code.alias("code"), F.lit(None).cast("double").alias("score"))
    stay = F.when(F.col("source") != "src0", F.col("doc_id").cast("string"))
    return _labelled(spark, sf_dir).select("doc_id", "text", stay.alias("id_sejour"), pred.alias("pred"))


@query
def prediction_output(spark, sf_dir):
    return sinks.prediction_output(_predicted(spark, sf_dir), "pred")


@query
def prediction_with_metrics(spark, sf_dir):
    noted = _predicted(spark, sf_dir).withColumn("text_rw", text.normalize_text(F.replace("text", F.lit("."), F.lit(".  ")), lower=True))
    noted = text.add_text_metrics(noted, "text", "before")
    noted = text.add_text_metrics(noted, "text_rw", "after")
    out = sinks.prediction_output(noted, "pred", metrics={"before": "before", "after": "after"})
    return out.select(flat_as_big(out))


def _rewritten(spark, sf_dir) -> DataFrame:
    notes = docs(spark, sf_dir).select("doc_id", "lang", "text")
    return rewrite.rewrite_dataset(notes, rewriter=lambda df: rewriting.rewrite_extract(df, 100))


@query
def rewrite_dataset(spark, sf_dir):
    out = _rewritten(spark, sf_dir)
    return out.select(flat_as_big(out))


@query
def metrics_recap(spark, sf_dir):
    return metrics.recap_means(_rewritten(spark, sf_dir))


@query
def run_summary(spark, sf_dir):
    return metrics.run_summary(_predicted(spark, sf_dir), "pred")


# ---- text --------------------------------------------------------------------------------------


@query
def normalize_text(spark, sf_dir):
    rough = F.replace(F.replace("text", F.lit(". "), F.lit(".  \t ")), F.lit("\n"), F.lit("\n\n\n\n"))
    rough = F.concat(F.lit(" \n\t"), rough, F.lit("\xa0 \n"))
    return docs(spark, sf_dir).select("doc_id", text.normalize_text(rough).alias("text_norm"))


@query
def normalize_pages(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    return pages.select("page_id", text.normalize_text(F.col("html"), lower=True).alias("text_norm"))


@query
def word_tokens(spark, sf_dir):
    words = docs(spark, sf_dir).select("doc_id", text.word_tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.array_join("w", " ").alias("words"))


@query
def sentences(spark, sf_dir):
    split = docs(spark, sf_dir).select("doc_id", text.sentences(F.col("text")).alias("s"))
    return split.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.array_join("s", "|").alias("sentences"))


@query
def text_metrics(spark, sf_dir):
    measured = text.add_text_metrics(sectioned(spark, sf_dir), "text", "m")
    return measured.select("doc_id", *metric_columns("m"))


@query
def lexicon(spark, sf_dir):
    words = docs(spark, sf_dir).select("doc_id", text.word_tokens(F.col("text")).alias("w"))
    forms = text.add_lexicon(words, "w", "forms")
    return forms.select(
        "doc_id",
        F.size("forms").cast("bigint").alias("lexicon_size"),
        F.array_join(F.array_sort("forms"), " ").alias("lexicon"),
    )


@query
def strip_accents(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query
def text_fallback(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.expr("CASE role WHEN 'user' THEN NULL WHEN 'system' THEN '' ELSE concat(' ', text, ' ') END").alias("text_rw"),
        F.expr("CASE WHEN turn = 0 THEN '' WHEN turn > 2 THEN text END").alias("text_norm"),
        "text",
    )
    rw, norm, raw = F.col("text_rw"), F.col("text_norm"), F.col("text")
    return turns.select(
        "conv_id",
        "turn",
        text.strip(text.first_filled(rw, norm, raw)).alias("for_chunks"),
        text.first_present(norm, raw).alias("for_rewrite"),
        text.first_filled(rw, raw).alias("for_embedding"),
        text.first_filled(raw).alias("for_classifier"),
        text.first_filled(rw, norm, raw).alias("for_generation"),
    )


# ---- codes and prompts -------------------------------------------------------------------------


@query
def first_icd10(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", codes.first_icd10(coded("text", "doc_id")).alias("code"))


@query
def answer_code(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").select("conv_id", "turn", coded("text", "conv_id").alias("note"))
    answer = F.expr("CASE turn % 3 WHEN 0 THEN 'DP: I21.4' WHEN 1 THEN 'DP: E11 DP: rien' ELSE 'sans reponse' END")
    answers = answers.withColumn("generated", F.concat("note", F.lit("\n\n"), answer))
    return answers.select(
        "conv_id",
        "turn",
        codes.answer_code(F.col("generated")).alias("code_full"),
        codes.answer_code(F.col("generated"), fallback="none").alias("code_strict"),
    )


@query
def rewrite_prompt(spark, sf_dir):
    messages = prompts.rewrite_messages(F.col("text"), 300)
    return docs(spark, sf_dir).select("doc_id", F.explode_outer(messages).alias("m")).where("m is not null").select("doc_id", "m.role", "m.content")


@query
def coding_prompt(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    body = F.when(F.col("role") == "system", "").otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    return turns.select("conv_id", "turn", prompts.coding_prompt(body).alias("prompt"))


@query
def normalize_code(spark, sf_dir):
    raw = F.when(F.col("lang") != "es", F.concat(F.lit("\t"), "source", F.lit("."), "lang", F.lit(" \n")))
    rows = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return rows.select(
        "doc_id",
        codes.normalize_code(F.col("raw")).alias("plain"),
        codes.normalize_code(F.col("raw"), upper=True).alias("upper"),
        codes.normalize_code(F.col("raw"), upper=True, strip_dot=True).alias("bare"),
    )


# ---- windows -----------------------------------------------------------------------------------


@query
def chunk_windows(spark, sf_dir):
    windows = chunking.add_chunks(docs(spark, sf_dir).select("doc_id", "text"), F.col("text"), SMALL_WINDOWS)
    return chunking.explode_chunks(windows, ["doc_id"]).withColumn("chunk_no", big("chunk_no"))


def _labels(df: DataFrame, label: str) -> DataFrame:
    return write_once(splitting.label_map(df, label), "labels")


@query
def labelled_chunks(spark, sf_dir):
    labels = _labels(table(spark, sf_dir, "documents"), "lang")
    rows = chunking.labelled_chunks(docs(spark, sf_dir), ["doc_id"], "text", "lang", labels)
    return rows.select("doc_id", "lang", big("chunk_no"), "chunk_text", big("label_id"))


@query
def first_window(spark, sf_dir):
    labels = _labels(table(spark, sf_dir, "documents"), "lang")
    rows = chunking.first_window(docs(spark, sf_dir), ["doc_id"], "text", "lang", labels, max_length=64)
    return rows.select("doc_id", "lang", "chunk_text", big("label_id"))


@query
def chunk_fallback(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn(
        "note", F.when(F.col("role") == "system", " \n ").otherwise(F.col("text"))
    )
    windows = chunking.add_chunks(turns, F.col("note"), SMALL_WINDOWS)
    rows = chunking.explode_chunks(windows, ["conv_id", "turn"], fallback=F.col("note"))
    return rows.withColumn("chunk_no", big("chunk_no"))


# ---- vectors -----------------------------------------------------------------------------------


@query
def embed_hashed(spark, sf_dir):
    windows = chunking.add_chunks(docs(spark, sf_dir).select("doc_id", "text"), F.col("text"))
    rows = embedding.embed_hashed(chunking.explode_chunks(windows, ["doc_id"]))
    found = rows.select("doc_id", big("chunk_no"), F.posexplode("emb").alias("i", "x")).where("x <> 0")
    return found.select("doc_id", "chunk_no", big("i"), sixth("x"))


def letter_encoder():
    def factory():
        def model(texts):
            return [[float(t.count(c)) for c in "aeiz"] for t in texts]

        return model

    return factory


@query
def embed_model(spark, sf_dir):
    windows = chunking.add_chunks(docs(spark, sf_dir).select("doc_id", "text"), F.col("text"))
    rows = embedding.embed_with_model(chunking.explode_chunks(windows, ["doc_id"]), letter_encoder())
    return components(rows.withColumn("chunk_no", big("chunk_no")), ["doc_id", "chunk_no"], "emb")


@query
def pool_masked_mean(spark, sf_dir):
    tokens = vecs(spark, sf_dir).withColumn("mask", (F.col("label") % 3 != 0).cast("int"))
    return components(pooling.masked_mean(tokens, "doc", "embedding", "mask"), ["doc"], "emb")


@query
def pool_first_token(spark, sf_dir):
    tokens = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 16").alias("chunk"),
        F.expr("vec_id div 8 % 2").alias("token_no"),
        (F.col("vec_id") % 8 + 1).alias("layer"),
        "embedding",
    )
    pooled = pooling.first_token_mean(tokens, "chunk", "embedding", "token_no", "layer", n_layers=8)
    return components(pooled, ["chunk"], "emb")


@query
def l2_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x * (F.col("vec_id") % 7))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(scaled).alias("unit"))
    return components(rows, ["vec_id"], "unit")


def _pooled(spark, sf_dir, strategy: str) -> DataFrame:
    return components(pooling.pool_chunks(vecs(spark, sf_dir), "doc", "embedding", strategy), ["doc"], "emb")


@query
def pool_chunks_mean(spark, sf_dir):
    return _pooled(spark, sf_dir, "mean")


@query
def pool_chunks_max(spark, sf_dir):
    return _pooled(spark, sf_dir, "max")


@query
def pool_chunks_median(spark, sf_dir):
    return _pooled(spark, sf_dir, "median")


@query
def pool_chunks_first(spark, sf_dir):
    return _pooled(spark, sf_dir, "first")


def _logits(spark, sf_dir) -> DataFrame:
    return vecs(spark, sf_dir).withColumn("logits", F.col("embedding"))


def _pooled_logits(spark, sf_dir, strategy: str) -> DataFrame:
    return components(pooling.pool_logits(_logits(spark, sf_dir), "doc", "logits", strategy), ["doc"], "logits")


@query
def pool_logits_mean(spark, sf_dir):
    return _pooled_logits(spark, sf_dir, "mean")


@query
def pool_logits_max(spark, sf_dir):
    return _pooled_logits(spark, sf_dir, "max")


@query
def pool_logits_median(spark, sf_dir):
    return _pooled_logits(spark, sf_dir, "median")


def _class_names(spark, sf_dir) -> DataFrame:
    """A model's label table with two names missing."""
    seen = table(spark, sf_dir, "embeddings").where("label < 8").select("label").distinct()
    named = seen.select(F.col("label").alias("label_id"), F.format_string("C%02d", "label").alias("label"))
    return write_once(named, "class-names")


@query
def argmax_label(spark, sf_dir):
    rows = scoring.label_predictions(_logits(spark, sf_dir), "logits", _class_names(spark, sf_dir), with_score=False)
    return rows.select("vec_id", big("label_id"), F.col("pred.code").alias("code"))


@query
def softmax_score(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    return rows.select("vec_id", F.round(vectors.softmax_at_max(F.col("logits")), 6).alias("score"))


@query
def doc_classifier(spark, sf_dir):
    pooled = pooling.pool_logits(_logits(spark, sf_dir), "doc", "logits", "mean")
    rows = scoring.label_predictions(pooled, "logits", _class_names(spark, sf_dir))
    return rows.select("doc", F.col("pred.code").alias("code"), F.round("pred.score", 6).alias("score"))


# ---- models ------------------------------------------------------------------------------------


@query
def plugin_scoring(spark, sf_dir):
    notes = docs(spark, sf_dir).select("doc_id", F.when(F.col("lang") != "es", F.col("text")).alias("text"))
    rows = notes.select("doc_id", scoring.score(F.col("text"), letter_encoder(), "array<double>").alias("x"))
    return rows.select("doc_id", F.expr("x[0] + 2 * x[1] + 3 * x[2]").alias("weighted"))


@query
def rewrite_copy(spark, sf_dir):
    notes = docs(spark, sf_dir).select("doc_id", "text", F.when(F.col("lang") == "en", "").alias("text_norm"))
    return rewriting.rewrite(notes).select("doc_id", "text_rw")


@query
def rewrite_extract(spark, sf_dir):
    notes = docs(spark, sf_dir).select("doc_id", "text")
    return rewriting.rewrite_extract(notes, 60, lead=r"(?iU)\b(?:das|los|les|by)\b").select("doc_id", "text_rw")


def tail_writer():
    def factory(options):
        def model(messages, draws):
            return [m[1]["content"] for m in messages]

        return model

    return factory


@query
def rewrite_model(spark, sf_dir):
    notes = docs(spark, sf_dir).select("doc_id", F.when(F.col("lang") == "es", "").otherwise(F.col("text")).alias("text"))
    config = rewriting.RewriteConfig(enabled=True, target_words=50)
    return rewriting.rewrite(notes, config, tail_writer()).select("doc_id", "text_rw")


def short_writer():
    """The last words it is given, as many as it may write, and its temperature."""

    def factory(options):
        def model(messages, draws):
            words = [m[1]["content"].split()[-options.max_new_tokens :] for m in messages]
            return [" ".join([*w, f"@{options.temperature}"]) for w in words]

        return model

    return factory


@query
def rewrite_options(spark, sf_dir):
    notes = docs(spark, sf_dir).select("doc_id", F.when(F.col("lang") == "es", "").otherwise(F.col("text")).alias("text"))
    config = rewriting.RewriteConfig(enabled=True, target_words=50, max_new_tokens=12, temperature=0.7)
    return rewriting.rewrite(notes, config, short_writer()).select("doc_id", "text_rw")


def cut_writer():
    """A code that depends on the prompt, written up to the number of new tokens (here characters)."""

    def factory(options):
        def model(prompts):
            return [p + f" I{10 + len(p) % 90}.4"[: options.max_new_tokens] for p in prompts]

        return model

    return factory


@query
def generation_options(spark, sf_dir):
    notes = docs(spark, sf_dir).select("doc_id", "text")
    options = scoring.GenerationOptions(max_new_tokens=4)
    return scoring.generate_codes(notes, cut_writer(), options=options).select("doc_id", F.col("pred.code").alias("code"))


def echo_writer():
    def factory(options):
        def model(prompts):
            return [p + (" I21.4." if len(p) % 2 else " rien") for p in prompts]

        return model

    return factory


@query
def generated_code(spark, sf_dir):
    notes = docs(spark, sf_dir).select("doc_id", coded("text", "doc_id").alias("text"))
    return scoring.generate_codes(notes, echo_writer()).select("doc_id", F.col("pred.code").alias("code"))


@query
def usable_train_rows(spark, sf_dir):
    embedded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("emb"))
    rows = _labelled(spark, sf_dir).select("doc_id", F.col("quality").cast("string").alias("gold_dp"))
    rows = rows.join(embedded, "doc_id", "left")
    return head.usable_rows(rows, "emb", "gold_dp").select("doc_id", "gold_dp")


def _class_vectors(spark, sf_dir) -> DataFrame:
    named = table(spark, sf_dir, "embeddings").withColumn("gold_dp", F.format_string("C%02d", "label"))
    return named.select("vec_id", "embedding", "gold_dp")


def _fitted(rows: DataFrame, weight: str | None = None) -> DataFrame:
    model = head.fit_head(rows, "embedding", "gold_dp", head.HeadConfig(max_iter=500, tolerance=1e-10), weight)
    return _applied(rows, model)


def _applied(rows: DataFrame, model) -> DataFrame:
    applied = head.predict_head(rows, model, "embedding", with_score=True)
    return applied.select("vec_id", "gold_dp", F.col("pred.code").alias("code"), F.round("pred.score", 4).alias("score"))


@query
def fit_head(spark, sf_dir):
    return _fitted(_class_vectors(spark, sf_dir))


@query
def fit_head_weighted(spark, sf_dir):
    rows = _class_vectors(spark, sf_dir)
    weights = splitting.class_weights(rows, "gold_dp", _labels(rows, "gold_dp"))
    weights = write_once(weights.select(F.col("label").alias("gold_dp"), "weight"), "class-weights")
    return _fitted(rows.join(weights, "gold_dp"), "weight")


@query
def predict_saved_head(spark, sf_dir):
    """A head with a stronger penalty, saved, loaded and applied."""
    rows = _class_vectors(spark, sf_dir)
    path = f"{shared_folder(spark)}/head-{uuid.uuid4().hex}"
    head.save_head(head.fit_head(rows, "embedding", "gold_dp", head.HeadConfig(C=0.2, max_iter=500, tolerance=1e-10)), path)
    return _applied(rows, head.load_head(path))


@query
def predict_linear(spark, sf_dir):
    """Nearest class mean by dot product: the weights are the class means, their number is the model's size."""
    rows = table(spark, sf_dir, "embeddings")
    vector = pooling.as_vector(rows, "embedding")
    means = rows.groupBy("label").agg(Summarizer.mean(vector).alias("mean")).orderBy("label").collect()
    model = scoring.linear_scorer([r["mean"].toArray().tolist() for r in means], [0.0] * len(means))
    scored = rows.withColumn("logits", scoring.score(F.col("embedding"), model, "array<double>", batch_size=256))
    return scored.select("vec_id", vectors.argmax_id(F.col("logits")).cast("bigint").alias("label_id"))


# ---- scoring -----------------------------------------------------------------------------------

GUESS = (
    "CASE WHEN text LIKE '% the %' THEN 'EN' WHEN text LIKE '% und %' THEN 'de ' "
    "WHEN text LIKE '% les %' THEN ' Fr' WHEN text LIKE '% los %' THEN 'e.s' "
    "WHEN text LIKE '% a %' THEN '' ELSE 'xx' END"
)


def _eval_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Gold: documents, ids of one source missing. Predictions: documents and conversation turns, so
    ids repeat; first turns have no id."""
    documents = docs(spark, sf_dir)
    gold = table(spark, sf_dir, "documents").select(F.expr("CASE WHEN source <> 'src0' THEN doc_id END").alias("gid"), "lang")
    turns = table(spark, sf_dir, "conversations")
    pred = documents.select(F.col("doc_id").alias("pid"), F.expr(GUESS).alias("guess")).unionByName(
        turns.select(F.expr("CASE WHEN turn > 0 THEN conv_id END").alias("pid"), F.expr(GUESS).alias("guess"))
    )
    return gold, pred


def _eval_args(spark, sf_dir) -> tuple:
    gold, pred = _eval_tables(spark, sf_dir)
    return gold, pred, "gid", "pid", "lang", "guess", True, True


@query
def eval_pairs(spark, sf_dir):
    return evaluation.matched_pairs(*_eval_args(spark, sf_dir))


@query
def confusion_counts(spark, sf_dir):
    return evaluation.confusion_counts(*_eval_args(spark, sf_dir))


@query
def eval_scores(spark, sf_dir):
    scores = evaluation.eval_scores(evaluation.confusion_counts(*_eval_args(spark, sf_dir)), evaluation.AVERAGES)
    return scores.select("average", "n_pairs", *[sixth(c) for c in ("accuracy", "precision", "recall", "f1")])


@query
def classification_report(spark, sf_dir):
    report = evaluation.classification_report(evaluation.confusion_counts(*_eval_args(spark, sf_dir)))
    return report.select("kind", "label", *[sixth(c) for c in ("precision", "recall", "f1")], "support")


@query
def eval_scores_shared_ids(spark, sf_dir):
    """Few ids, each with many rows on both sides: every id matches all its rows with each other."""
    documents = docs(spark, sf_dir)
    pred = documents.select("source", F.expr(GUESS).alias("guess"))
    counts = evaluation.confusion_counts(documents.select("source", "lang"), pred, "source", "source", "lang", "guess", True, True)
    scores = evaluation.eval_scores(counts, evaluation.AVERAGES)
    return scores.select("average", "n_pairs", *[sixth(c) for c in ("accuracy", "precision", "recall", "f1")])


@query
def eval_from_csv(spark, sf_dir):
    """Gold and predicted codes written as CSV, read again and scored."""
    gold, pred = _eval_tables(spark, sf_dir)
    paths = _as_csv(gold, "gold"), _as_csv(pred, "predictions")
    names = {"gold_id": "gid", "pred_id": "pid", "gold_col": "lang", "pred_col": "guess"}
    scores, _ = run_evaluate(spark, *paths, average="micro", upper=True, strip_dot=True, **names)
    return scores.select("average", "n_pairs", *[sixth(c) for c in ("accuracy", "precision", "recall", "f1")])


# ---- labels and split --------------------------------------------------------------------------


@query
def label_map(spark, sf_dir):
    labels = splitting.label_map(table(spark, sf_dir, "documents"), "source")
    return labels.select("label", big("label_id"))


def _split(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splitting.per_class_split(rows, "lang", "doc_id")


@query
def per_class_split(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "lang", "split")


@query
def split_stats(spark, sf_dir):
    return splitting.split_stats(_split(spark, sf_dir), "lang")


@query
def class_weights(spark, sf_dir):
    rows = _split(spark, sf_dir)
    weights = splitting.class_weights(rows.where("split = 'train'"), "lang", _labels(rows, "lang"))
    return weights.select("label", big("label_id"), F.round(F.col("weight").cast("double"), 5).alias("weight"))


# ---- whole runs --------------------------------------------------------------------------------


def _notes(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select(
        F.col("doc_id").alias(predict.KEY), F.col("doc_id").cast("string").alias("id_sejour"), "text", F.col("lang").alias("gold_dp")
    )


@query
def frozen_head_run(spark, sf_dir):
    """Normalise, window, embed, pool, fit and predict: the simple run in train mode."""
    config = predict.PredictConfig(mode="train", normalise=True)
    return sinks.prediction_output(_notes(spark, sf_dir).transform(predict.build(config)))


@query
def weighted_train_run(spark, sf_dir):
    """Label map, split, windows, class weights, weighted head; its predictions for the validation documents."""
    out = f"{shared_folder(spark)}/train-{uuid.uuid4().hex}"
    config = train.TrainConfig(text="text", label="lang", max_length=130, head=head.HeadConfig(C=2.0, max_iter=1000, tolerance=1e-10))
    train.run_train(spark, f"{sf_dir}/documents.parquet", out, config, fmt="parquet", key="doc_id")
    return spark.read.parquet(f"{out}/predictions/val").select("doc_id", "lang", "code", F.round("score", 4).alias("score"))


@query
def chunk_classifier_run(spark, sf_dir):
    """Normalise, rewrite, measure before and after, window, classify windows, pool, label."""
    config = predict.PredictConfig(
        backend="chunk_classifier",
        normalise=True,
        with_metrics=True,
        rewrite=rewriting.RewriteConfig(enabled=True),
        windows=SMALL_WINDOWS,
        aggregate_logits="max",
        classifier=letter_encoder(),
    )
    predicted = _notes(spark, sf_dir).transform(predict.build(config))
    out = sinks.prediction_output(predicted, metrics={"before": "metrics_before", "after": "metrics_after"})
    return out.select(flat_as_big(out))


def letter_tokens():
    """Tokens are words; every layer counts their letters, words of one letter are masked."""

    def factory():
        import numpy as np

        def model(texts):
            words = [t.split(" ") for t in texts]
            width = max(map(len, words))
            mask, counts = np.zeros((len(texts), width)), np.zeros((len(texts), width, 4))
            for i, row in enumerate(words):
                mask[i, : len(row)] = [len(w) > 1 for w in row]
                counts[i, : len(row)] = [[w.count(c) for c in "aeiz"] for w in row]
            return [counts * layer for layer in range(1, 6)], mask

        return model

    return factory


@query
def token_encoder_run(spark, sf_dir):
    """Normalise, window, encode tokens, pool them and then the windows: the vectors of a run."""
    config = predict.PredictConfig(mode="train", token_encoder=letter_tokens(), windows=SMALL_WINDOWS)
    notes = _notes(spark, sf_dir).withColumn("text_norm", text.normalize_text(F.col("text")))
    return components(predict.document_vectors(notes, config), [predict.KEY], "emb")


@query
def generation_run(spark, sf_dir):
    config = predict.PredictConfig(backend="generation", normalise=True, generator=echo_writer())
    return sinks.prediction_output(_notes(spark, sf_dir).transform(predict.build(config)))

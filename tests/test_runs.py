"""Whole runs on small files."""

import json

import pytest
from pyspark.sql import functions as F

from staycoder.operators.chunking import WindowConfig
from staycoder.operators.embedding import embed_hashed
from staycoder.operators.head import HeadConfig, class_logits, head_info, load_head
from staycoder.operators.rewriting import RewriteConfig
from staycoder.plans.evaluate import evaluate, run_evaluate
from staycoder.plans.predict import BACKENDS, PredictConfig, build, run_predict
from staycoder.plans.rewrite import run_rewrite
from staycoder.plans.train import TrainConfig, run_prepare, run_train
from staycoder.sources.documents import read_table
from staycoder.sources.shared import file_row_key
from staycoder.streaming.predictions import read_stream, start_predictions

TOPICS = {"C34.1": "tumeur du poumon toux fumeur", "I21.4": "infarctus douleur thoracique coronaire", "E11": "diabète glycémie insuline"}


@pytest.fixture(scope="module")
def notes(spark, tmp_path_factory):
    """60 notes in a CSV file with quoted line breaks; one is blank, one id is missing."""
    rows = []
    for i in range(60):
        code, words = list(TOPICS.items())[i % 3]
        rows.append((f"{i:03d}" if i != 7 else "", f'"Patient {i}.\n\n\n\n{words}.  Conclusion : {words}"' if i != 9 else '" "', code))
    path = tmp_path_factory.mktemp("in") / "notes.csv"
    path.write_text("code_sejour,text,code_dp\n" + "".join(f"{a},{b},{c}\n" for a, b, c in rows), encoding="utf-8")
    return str(path)


def table(spark, path):
    return {r.code_sejour: r for r in read_table(spark, path).collect()}


def test_train_predict_evaluate(spark, notes, tmp_path):
    head, first, second = (str(tmp_path / n) for n in ("head", "train-out", "predict-out"))
    train = PredictConfig(mode="train", normalise=True, head_path=head)
    assert run_predict(spark, train, notes, first, col_gold="code_dp") == {"n_documents": 60, "n_predicted": 60}
    assert run_predict(spark, PredictConfig(normalise=True, head_path=head), notes, second)["n_predicted"] == 60
    a, b = table(spark, first), table(spark, second)
    assert {k: r.dp_predit for k, r in a.items()} == {k: r.dp_predit for k, r in b.items()}
    scores, report = run_evaluate(spark, notes, second, average="micro")
    assert scores.first().accuracy > 0.9 and scores.first().n_pairs == 60
    assert report.where("kind = 'class'").count() == 3


def test_train_needs_gold(spark, notes, tmp_path):
    with pytest.raises(ValueError, match="col_gold"):
        run_predict(spark, PredictConfig(mode="train"), notes, str(tmp_path / "x"))


@pytest.mark.parametrize("bad", [dict(backend="x"), dict(mode="x", head_path="h"), dict(), dict(backend="generation"), dict(backend="chunk_classifier")])
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        PredictConfig(**bad)
    assert len(BACKENDS) == 3


def test_empty_input(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("code_sejour,text\n")
    with pytest.raises(ValueError, match="no document"):
        run_predict(spark, PredictConfig(head_path="h"), str(tmp_path / "empty.csv"), str(tmp_path / "out"))


def test_classifier_run_with_metrics(spark, notes, tmp_path):
    def classifier():
        words = ["poumon", "infarctus", "diabète"]
        return lambda texts: [[float(t.count(w)) for w in words] for t in texts]

    def rewriter(options):
        return lambda batch, draws: [m[1]["content"].split("\n\n")[-1] + f" {d.random()}" for m, d in zip(batch, draws)]

    labels = spark.createDataFrame(list(enumerate(TOPICS)), "label_id int, label string")
    config = PredictConfig(
        backend="chunk_classifier", normalise=True, with_metrics=True, rewrite=RewriteConfig(enabled=True), rewriter=rewriter,
        windows=WindowConfig(chunk_size=6, overlap=1), classifier=classifier, classifier_labels=labels,
    )
    out = str(tmp_path / "out")
    summary = run_predict(spark, config, notes, out, output_format="parquet")
    got = {r.code_sejour: r for r in spark.read.parquet(out).collect()}
    gold = {r.code_sejour or "": r.code_dp for r in read_table(spark, notes).collect()}
    assert all(r.dp_predit == gold[k] for k, r in got.items() if k != "009")
    assert len(got["000"]) == 14 and got["000"].n_sections_before == 2 and got["009"].len_words_before == 0
    assert summary["n_documents"] == 60 and summary["mean_len_words_before"] == pytest.approx(sum(r.len_words_before for r in got.values()) / 60)


def test_generation_run(spark, notes, tmp_path):
    def generator(options):
        return lambda prompts: [p + (" I21.4" if "infarctus" in p else " ?") for p in prompts]

    summary = run_predict(spark, PredictConfig(backend="generation", generator=generator), notes, str(tmp_path / "out"))
    assert summary == {"n_documents": 60, "n_predicted": 20}


def test_parquet_notes_need_no_copy(spark, notes, tmp_path, monkeypatch):
    import staycoder.plans.predict as module

    def generator(options):
        return lambda prompts: [p + " I21.4" for p in prompts]

    folder = str(tmp_path / "notes")
    read_table(spark, notes).repartition(3).write.parquet(folder)
    monkeypatch.setattr(module, "with_row_key", None)
    config = PredictConfig(backend="generation", generator=generator)
    assert run_predict(spark, config, folder, str(tmp_path / "out"), input_format="parquet")["n_documents"] == 60
    keyed = spark.read.parquet(folder).withColumn("k", file_row_key())
    assert keyed.select("k").distinct().count() == 60
    first = {r.k: r.code_sejour for r in keyed.collect()}
    assert {r.k: r.code_sejour for r in keyed.repartition(5).where("code_dp = 'E11'").collect()}.items() <= first.items()

    def classifier():
        return lambda texts: [[1.0, float(len(t))] for t in texts]

    out = str(tmp_path / "classified")
    config = PredictConfig(backend="chunk_classifier", classifier=classifier, with_scores=False, windows=WindowConfig(chunk_size=6, overlap=1))
    run_predict(spark, config, folder, out, input_format="parquet")
    assert read_table(spark, out).count() == 60


def test_evaluate_says_what_is_missing(spark, tmp_path):
    gold = spark.createDataFrame([("1", "E11"), ("2", "")], "code_sejour string, code_dp string")
    pred = lambda *rows: spark.createDataFrame(rows, "code_sejour string, dp_predit string")
    with pytest.raises(ValueError, match="no code_sejour of the gold table"):
        evaluate(gold, pred(("7", "E11")))
    with pytest.raises(ValueError, match="both a gold and a predicted code"):
        evaluate(gold, pred(("2", "E11"), ("1", None)))


def test_rewrite_run(spark, notes, tmp_path):
    def shorten(options):
        return lambda batch, draws: [m[1]["content"][-20:] + str(d.integers(10)) for m, d in zip(batch, draws)]

    out, recap_path = str(tmp_path / "rw"), str(tmp_path / "recap")
    config = RewriteConfig(enabled=True, target_words=30, model_name="toy")
    recap = run_rewrite(spark, notes, out, config, shorten, recap_path=recap_path).first()
    rows = read_table(spark, out).collect()
    assert rows[0].asDict().keys() >= {"code_sejour", "text", "code_dp", "text_rw", "n_abbr_after"} and len(rows) == 60
    assert recap.n_rows == 60 and recap.metrics_means.after.len_chars <= 21
    mean = sum(int(r.len_chars_before) for r in rows) / 60
    assert recap.metrics_means.before.len_chars == round(mean, 3)
    saved = json.loads(open(recap_path).read())
    run_rewrite(spark, notes, out, config, shorten)
    assert json.loads(open(str(tmp_path / "rw.metrics.json")).read())["n_rows"] == 60
    assert saved["rewrite"]["llm_model"] == "toy" and saved["n_rows"] == 60


@pytest.mark.parametrize("do_chunk", [False, True])
def test_prepare_run(spark, notes, tmp_path, do_chunk):
    out = str(tmp_path / "train")
    config = TrainConfig(do_chunk=do_chunk, max_length=8, windows=WindowConfig(chunk_size=8, overlap=2))
    sizes = run_prepare(spark, notes, out, config)
    train, val = read_table(spark, out + "/data/train"), read_table(spark, out + "/data/val")
    assert (train.count(), val.count()) == (54, 6) and {r[0] for r in val.groupBy("code_dp").count().select("count").collect()} == {2}
    windows = spark.read.parquet(out + "/windows/train")
    assert sizes["n_train"] == windows.count() and (sizes["n_train"] > 54) == do_chunk
    assert {r.label_id for r in windows.collect()} == {0, 1, 2}
    body = lambda name: json.loads(open(f"{out}/{name}", encoding="utf-8").read())
    assert body("label_map.json") == {"C34.1": 0, "E11": 1, "I21.4": 2}
    assert body("split_stats.json")["val_counts"] == {"C34.1": 2, "E11": 2, "I21.4": 2}
    assert body("config_train.json")["n_val"] == sizes["n_val"] and body("config_train.json")["seed"] == 42
    assert body("config_train.json")["input"] == notes and body("config_train.json")["C"] == 1.0
    weights = [r.weight for r in spark.read.parquet(out + "/class_weights").collect()]
    assert weights == [1.0] * 3


def test_recap_names():
    from staycoder.plans.rewrite import recap_name

    names = {"out.csv": "out.metrics.json", "/a/b.c/out": "/a/b.c/out.metrics.json", "hdfs://h/x/out.csv/": "hdfs://h/x/out.metrics.json", "/o.csv": "/o.metrics.json"}
    assert {k: recap_name(k) for k in names} == names


@pytest.mark.parametrize("do_chunk", [False, True])
def test_train_run(spark, notes, tmp_path, do_chunk):
    out = str(tmp_path / "train")
    config = TrainConfig(do_chunk=do_chunk, max_length=40, windows=WindowConfig(chunk_size=12, overlap=2), val_frac=0.2, head=HeadConfig(C=10.0))
    result = run_train(spark, notes, out, config)
    assert result["accuracy"] > 0.9 and 0 < result["eval_loss"] < 1 and (result["n_train"] > 48) == do_chunk
    assert json.loads(open(f"{out}/eval.json").read()) == result
    predicted = spark.read.parquet(f"{out}/predictions/val").collect()
    assert len(predicted) == 12 and sum(r.code == r.code_dp for r in predicted) == round(12 * result["accuracy"])
    assert head_info(load_head(f"{out}/final/head"))["classes"] == sorted(TOPICS)
    # the loss by hand, from the stored windows and weights
    weights = {r.label_id: r.weight for r in spark.read.parquet(out + "/class_weights").collect()}
    model = load_head(f"{out}/final/head")
    windows = class_logits(embed_hashed(spark.read.parquet(f"{out}/windows/val")), model).collect()
    total = sum(-r.logits[r.label_id] * weights[r.label_id] for r in windows)
    assert result["eval_loss"] == pytest.approx(total / sum(weights[r.label_id] for r in windows), rel=1e-5)


def test_train_run_without_validation_rows_or_any(spark, tmp_path):
    (tmp_path / "few.csv").write_text("text,code_dp\nun mot,A\ndeux mots,B\n")
    result = run_train(spark, str(tmp_path / "few.csv"), str(tmp_path / "out"))
    assert result["n_val"] == 0 and result["eval_loss"] is None and result["accuracy"] is None
    (tmp_path / "none.csv").write_text("text,code_dp\n,A\n")
    with pytest.raises(ValueError, match="text and a label"):
        run_prepare(spark, str(tmp_path / "none.csv"), str(tmp_path / "out"))


def test_stream_gives_the_batch_result(spark, notes, tmp_path):
    def generator(options):
        return lambda prompts: [p + " K35" for p in prompts]

    docs = read_table(spark, notes).select(F.monotonically_increasing_id().alias("doc_key"), F.col("code_sejour").alias("id_sejour"), F.coalesce("text", F.lit("")).alias("text"))
    folder, out = str(tmp_path / "arriving"), str(tmp_path / "out")
    step = build(PredictConfig(backend="generation", generator=generator))
    for part in (docs.where("doc_key % 2 = 0"), docs.where("doc_key % 2 = 1")):
        part.write.mode("append").parquet(folder)
        query = start_predictions(read_stream(spark, folder, docs.schema), step, out, str(tmp_path / "progress"))
        assert query.awaitTermination(60)
    got = spark.read.parquet(out)
    assert got.count() == 60 and got.where("dp_predit = 'K35'").count() == 60  # a blank note is still sent

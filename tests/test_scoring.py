import re

import pytest
from pyspark.sql import functions as F

from staycoder.operators.embedding import embed_hashed, embed_with_model, pooled_tokens
from staycoder.operators.rewriting import RewriteConfig, rewrite, rewrite_extract
from staycoder.operators.scoring import GenerationOptions, generate_codes, label_predictions, linear_scorer, score
from staycoder.plans.predict import PredictConfig, build


def test_batches_span_documents_and_skip_nulls(spark):
    def factory():
        def model(batch):
            return [f"{len(batch)}:{t}" for t in batch]

        return model

    rows = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(8)], "i int, t string").coalesce(1)
    got = [r.o for r in rows.select("i", score(F.col("t"), factory, "string", batch_size=4).alias("o")).orderBy("i").collect()]
    assert got == ["4:t0", "4:t1", "4:t2", None, "4:t4", "3:t5", "3:t6", "3:t7"]


def test_a_worker_loads_its_model_once(spark):
    def factory():
        import os
        import uuid

        instance = uuid.uuid4().hex
        return lambda batch: [f"{os.getpid()} {instance}" for _ in batch]

    rows = spark.range(0, 640, 1, 64)
    seen = {tuple(r.o.split()) for r in rows.select(score(F.col("id"), factory, "string").alias("o")).collect()}
    assert len(seen) == len({pid for pid, _ in seen}) < 64


def test_seeded_draws_do_not_hang_on_the_layout(spark):
    def factory():
        return lambda batch, draws: [float(d.random()) for d in draws]

    rows = spark.range(0, 40, 1, 4).withColumn("k", F.col("id") % 5)
    draw = lambda df, *args, **kw: {r.id: r.o for r in df.select("id", score(F.col("id"), factory, "double", *args, **kw).alias("o")).collect()}
    first = draw(rows, 5, 3)
    assert first != draw(rows, 5, 4) and len(set(first.values())) == 40
    for parts in (1, 4, 7):
        for size in (1, 16):
            assert draw(rows.repartition(parts), size, 3) == first
    keyed = draw(rows.repartition(3), 5, 3, row_key=F.col("k"))
    assert len(set(keyed.values())) == 5 and keyed[1] == keyed[6]
    assert draw(rows, 5, -1) and draw(rows, 5, 3, row_key=F.lit(None))[0] == draw(rows, 2, 3, row_key=F.lit(None))[39]


def test_rewriting_and_codes_are_the_same_in_any_layout(spark):
    def writer(options):
        return lambda batch, draws: [f"{d.random():.6f} {options.temperature} {options.max_new_tokens}" for d in draws]

    def coder(options):
        return lambda batch, draws: [p + f" I{d.integers(10, 99)}" for p, d in zip(batch, draws, strict=True)]

    rows = spark.createDataFrame([(f"s{i % 9}", f"note {i % 30}") for i in range(60)], "id_sejour string, text string").withColumn("doc_key", F.monotonically_increasing_id())
    sampled = GenerationOptions(temperature=0.5)
    config = PredictConfig(backend="generation", generator=coder, generation=sampled, rewrite=RewriteConfig(enabled=True, seed=5), rewriter=writer, seed=8)
    seen = []
    for parts in (1, 4, 7):
        out = rows.repartition(parts).transform(build(config))
        seen.append(sorted((r.id_sejour, r.text, r.text_rw, r.pred.code) for r in out.collect()))
    assert seen[0] == seen[1] == seen[2] and len({r[2:] for r in seen[0]}) > 20
    assert all(r[2].endswith(" 0.3 128") for r in seen[0])

    def greedy(options):
        return lambda batch: [p + (" I21" if options.temperature == 0 and options.max_new_tokens == 64 else "") for p in batch]

    assert {r.pred.code for r in generate_codes(rows, greedy, seed=1).collect()} == {"I21"}  # nothing is drawn


@pytest.mark.parametrize("pooling", ["mean", "first"])
def test_token_encoder(spark, pooling):
    def tokens():
        import numpy as np

        def model(texts):
            width = max(len(t) for t in texts)
            mask = np.array([[int(j < len(t) and t[j] != "-") for j in range(width)] for t in texts])
            last = np.array([[[ord(t[j]) % 7, j + 1.0] if j < len(t) else [99.0, 99.0] for j in range(width)] for t in texts])
            return [last * layer for layer in (5, 1, 2, 3)], mask

        return model

    texts = ["ab-c", "-", "xyz" * 5]
    rows = spark.createDataFrame([(t,) for t in texts], "chunk_text string").coalesce(1)
    got = {r.chunk_text: r.emb for r in embed_with_model(rows, pooled_tokens(tokens, pooling, last_layers=2), batch_size=2).collect()}
    for text in texts:
        points = [(ord(c) % 7, j + 1.0) for j, c in enumerate(text) if pooling == "first" or c != "-"]
        vector = points[0] if pooling == "first" else [sum(p[i] for p in points) for i in (0, 1)]
        norm = sum(v * v for v in vector) ** 0.5
        assert got[text] == pytest.approx([v / norm if norm else 0.0 for v in vector])
    with pytest.raises(ValueError, match="token pooling"):
        pooled_tokens(tokens, "max")


def test_a_model_must_answer_every_input(spark):
    def factory():
        return lambda batch: batch[1:]

    with pytest.raises(Exception, match="zip"):
        spark.range(3).select(score(F.col("id"), factory, "bigint")).collect()


def test_linear_scorer(spark):
    rows = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    model = linear_scorer([[1, 0], [0, 1], [1, 1]], [0, 0, -5])
    assert rows.select(score(F.col("v"), model, "array<double>").alias("o")).first().o == [1.0, 2.0, -2.0]


def test_hashed_embedding_matches_brute_force(spark):
    import hashlib

    texts = ["Rhume rhume, fièvre", "...", "", None, " ".join(f"mot{i % 700}" for i in range(20_000))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, chunk_text string")
    for features in (1, 16, 256):
        got = {r.i: r.emb for r in embed_hashed(rows, features=features).collect()}
        for i, text in enumerate(texts):
            counts = [0.0] * features
            for word in re.findall(r"[\w]+", (text or "").lower()):
                counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % features] += 1
            norm = sum(c * c for c in counts) ** 0.5 or 1.0
            assert got[i] == pytest.approx([c / norm for c in counts])


def test_model_embedding_is_normalised(spark):
    def factory():
        return lambda texts: [[float(len(t)), 4.0] for t in texts]

    rows = spark.createDataFrame([("abc",)], "chunk_text string")
    assert embed_with_model(rows, factory).first().emb == pytest.approx([0.6, 0.8])


def test_rewrite_modes(spark):
    def factory(options):
        return lambda batch, draws: [" R:" + m[1]["content"].split("\n\n")[1] + "\n" for m in batch]

    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "n")], "text string, text_norm string")
    out = lambda df: [r.text_rw for r in df.collect()]
    assert out(rewrite(rows)) == ["a", "", "n"]
    assert out(rewrite(rows, RewriteConfig(enabled=True))) == ["a", "", "n"]
    assert out(rewrite(rows, RewriteConfig(enabled=False), factory)) == ["a", "", "n"]
    assert out(rewrite(rows, RewriteConfig(enabled=True), factory)) == ["R:a", "", "R:n"]


def test_extract_leads_with_the_conclusion(spark):
    note = "Entrée hier. Fièvre et toux depuis deux jours. Conclusion : grippe. Sortie."
    rows = spark.createDataFrame([(note,), ("",), ("un deux trois quatre cinq",)], "text string")
    got = [r.text_rw for r in rewrite_extract(rows, 4).collect()]
    assert got == ["Conclusion : grippe. Entrée hier", "", ""]
    assert rewrite_extract(rows, 100).first().text_rw.startswith("Conclusion : grippe. Entrée hier. Fièvre")


def test_generated_codes(spark):
    def factory(options):
        return lambda prompts: [p + (" K35.8" if "appendicite" in p else " inconnu") for p in prompts]

    rows = spark.createDataFrame([("appendicite", "x"), ("", "note E11"), (None, "rien"), ("", "")], "text_rw string, text string")
    codes = lambda **kw: [r.pred.code for r in generate_codes(rows, factory, **kw).collect()]
    assert codes() == ["K35.8", "E11", "", ""]
    assert codes(fallback="none") == ["K35.8", "", "", ""]


def test_few_inputs_and_answers_are_python_objects_at_a_time(spark):
    def factory():
        import sys

        return lambda batch: [f"{sys.getallocatedblocks()} {m[0]['content']}" for m in batch]

    rows = spark.range(0, 9000, 1, 1).withColumn("t", F.expr("IF(id % 7 = 3, NULL, array(struct('user' AS role, concat('t', id) AS content)))"))
    rows = rows.select("id", score(F.col("t"), factory, "string", batch_size=10).alias("o"))
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(records)
    spark.conf.set(records, "9000")
    try:
        got = {r.id: r.o for r in rows.collect()}
    finally:
        spark.conf.set(records, before)
    assert all((got[i] is None) if i % 7 == 3 else got[i].split()[1] == f"t{i}" for i in range(9000))
    blocks = [int(got[i].split()[0]) for i in range(1000, 9000) if got[i]]  # of Python's memory
    assert max(blocks) - min(blocks) < 3_000

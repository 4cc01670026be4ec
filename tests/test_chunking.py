import pytest
from pyspark.sql import functions as F

from staycoder.operators.chunking import WindowConfig, add_chunks, explode_chunks, first_window, labelled_chunks, window_count


def brute_force_windows(tokens, capacity, step):
    """Cut from the left until a window reaches the end."""
    windows, start = [], 0
    while tokens and (not windows or windows[-1][1] < len(tokens)):
        windows.append((start, min(start + capacity, len(tokens))))
        start += step
    return [" ".join(tokens[a:b]) for a, b in windows]


def test_window_counts(one_column):
    sizes = [0, 1, 478, 479, 892, 893, 1306, 1307]
    assert one_column(lambda c: window_count(c, WindowConfig()), sizes, "int") == [0, 1, 1, 2, 2, 3, 3, 4]


@pytest.mark.parametrize("size, overlap", [(480, 64), (12, 3), (5, 0), (4, 1)])
def test_windows_match_brute_force(spark, size, overlap):
    config = WindowConfig(chunk_size=size, overlap=overlap)
    texts = [" ".join(f"w{i}" for i in range(n)) for n in [0, 1, 2, 3, 9, 10, 11, 17, 18, 477, 478, 479, 2000]]
    texts.append(" \n a\t b \xa0 ")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.chunks for r in add_chunks(rows, F.col("text"), config).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_force_windows(t.split(), config.capacity, config.step)


def test_overlap_must_leave_a_step():
    with pytest.raises(ValueError, match="overlap"):
        WindowConfig(chunk_size=66, overlap=64)


def test_fallback_keeps_every_document(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, " "), (3, "")], "doc int, text string")
    chunked = add_chunks(rows, F.col("text"))
    assert explode_chunks(chunked, ["doc"]).count() == 1
    kept = explode_chunks(chunked, ["doc"], fallback=F.col("text")).orderBy("doc").collect()
    assert [(r.doc, r.chunk_no, r.chunk_text) for r in kept] == [(1, 0, "a b"), (2, 0, " "), (3, 0, "")]


def test_training_tables(spark):
    rows = spark.createDataFrame([(1, "a b c d e", "X"), (2, " ", "Y")], "doc int, text string, code string")
    labels = spark.createDataFrame([("X", 0), ("Y", 1)], "label string, label_id int")
    config = WindowConfig(chunk_size=5, overlap=1)
    chunks = labelled_chunks(rows, ["doc"], "text", "code", labels, config).orderBy("doc", "chunk_no").collect()
    assert [(r.doc, r.chunk_text, r.label_id) for r in chunks] == [(1, "a b c", 0), (1, "c d e", 0), (2, "", 1)]
    heads = first_window(rows, ["doc"], "text", "code", labels, max_length=4).orderBy("doc").collect()
    assert [(r.chunk_text, r.label_id) for r in heads] == [("a b", 0), ("", 1)]


def test_other_tokenizer(spark):
    config = WindowConfig(chunk_size=4, overlap=0, tokenizer=lambda c: F.split(c, ""), joiner="")
    rows = spark.createDataFrame([("abcde",)], "text string")
    assert add_chunks(rows, F.col("text"), config).first().chunks == ["ab", "cd", "e"]


def test_windows_are_cut_once(spark):
    """No filter below the explode may repeat the window expression."""
    rows = spark.createDataFrame([(1, "a")], "doc int, text string")
    plan = explode_chunks(add_chunks(rows, F.col("text")), ["doc"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_blank_texts_have_no_windows_with_any_tokenizer(spark):
    config = WindowConfig(chunk_size=5, overlap=1, special_tokens=0, tokenizer=lambda t: F.split(t, ""), joiner="")
    rows = spark.createDataFrame([(0, " \n\xa0"), (1, ""), (2, None), (3, " ab")], "i int, text string")
    got = {r.i: r.chunks for r in add_chunks(rows, F.col("text"), config).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [" ab"]}

import glob
import json

import pytest
from pyspark.sql import functions as F

from staycoder.operators.checks import require_columns, require_rows
from staycoder.sources import shared
from staycoder.sources.documents import as_documents, distinct_names, read_table, training_rows
from staycoder.sources.sinks import label_map_json, prediction_output, recap_json, split_stats_json, write_json_row, write_object, write_table

CSV = 'code_sejour,text,code_dp\n001,"l1\nl2 ""q"", x",C34.1\n,NA,\n003,,I21.4\n'


@pytest.fixture
def notes_csv(tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def test_read_csv(spark, notes_csv):
    docs = as_documents(read_table(spark, notes_csv), col_gold="code_dp").collect()
    assert [(d.id_sejour, d.id_patient, d.text, d.gold_dp) for d in docs] == [
        ("001", None, 'l1\nl2 "q", x', "C34.1"),
        (None, None, "", None),
        ("003", None, "", "I21.4"),
    ]


def test_read_matches_pandas(spark, tmp_path):
    import pandas as pd

    body = 'a,b\n" x ","y\r\nz"\n"é;1","""q"""\nN/A,nan\n<NA>,\nnone,"NULL"\n\n12, NA\n'
    path = tmp_path / "odd.csv"
    path.write_bytes(body.encode())
    expected = pd.read_csv(path, dtype=str)
    expected = [tuple(None if pd.isna(v) else v for v in row) for row in expected.itertuples(index=False, name=None)]
    assert [tuple(r) for r in read_table(spark, str(path)).collect()] == expected


def test_training_rows(spark, notes_csv):
    assert training_rows(read_table(spark, notes_csv)).count() == 1


def test_missing_columns_are_named(spark, notes_csv):
    with pytest.raises(ValueError, match="text_rw"):
        as_documents(read_table(spark, notes_csv), col_text="text_rw")
    with pytest.raises(ValueError, match="label"):
        training_rows(read_table(spark, notes_csv), label="label")
    with pytest.raises(ValueError, match="x"):
        require_columns(spark.range(1), ["id", "x"], "table")
    with pytest.raises(ValueError, match="empty"):
        require_rows(spark.range(0), "empty")


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'a "b",\n c'), ("2", "  padded "), ("3", None), ("4", "\\back\\"), ("", "x,")]
    write_table(spark.createDataFrame(rows, "id string, t string").coalesce(1), str(tmp_path / "out"))
    part = glob.glob(str(tmp_path / "out" / "part-*.csv"))[0]
    import csv

    with open(part, newline="", encoding="utf-8") as f:
        assert list(csv.reader(f))[1:] == [[i, t or ""] for i, t in rows]
    back = read_table(spark, str(tmp_path / "out")).collect()
    assert sorted((r.id or "", r.t) for r in back) == sorted((i, t) for i, t in rows)


def test_prediction_output(spark):
    schema = "id_sejour string, pred struct<code:string,score:double>"
    rows = spark.createDataFrame([("s1", ("C34.1", 0.5)), (None, (None, None)), ("s3", None)], schema)
    out = prediction_output(rows, out_stay="stay", out_pred="dp")
    assert out.columns == ["stay", "dp"] and [tuple(r) for r in out.collect()] == [("s1", "C34.1"), ("", ""), ("s3", "")]


def read_json(path):
    return json.loads(open(path, encoding="utf-8").read())


def test_json_artefacts(spark, tmp_path):
    labels = spark.createDataFrame([("B", 1), ("A", 0)], "label string, label_id int")
    assert json.loads(label_map_json(labels).first().value) == {"A": 0, "B": 1}
    stats = spark.createDataFrame([("train", "A", 3), ("val", "A", 1), ("train", "B", 1)], "split string, label string, n_rows bigint")
    assert json.loads(split_stats_json(stats).first().value) == {
        "train_counts": {"A": 3, "B": 1}, "val_counts": {"A": 1}, "labels": ["A", "B"]
    }
    from staycoder.operators.metrics import recap_from_sums, recap_sums
    from staycoder.functions import fixed

    names = [f"{m}_{p}" for m in fixed.METRICS for p in ("before", "after")]
    flat = spark.range(2).select(*[F.lit(1.5).alias(n) for n in names])
    recap = recap_json(recap_from_sums(flat.agg(*recap_sums())), "in", "out", {"target_words": None, "top_p": 0.9})
    write_json_row(recap, str(tmp_path / "recap"))
    got = read_json(tmp_path / "recap")
    assert got["n_rows"] == 2 and got["rewrite"] == {"target_words": None, "top_p": 0.9}
    assert got["metrics_means"]["before"]["sent_len_avg"] == 1.5 and list(got["metrics_means"]) == ["before", "after"]
    empty = recap_from_sums(flat.limit(0).agg(*recap_sums())).first()
    assert empty.n_rows == 0 and empty.len_chars_before == 0.0


def test_shared_folder(spark, monkeypatch):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared.shared_folder(spark) == folder
    stored = shared.write_once(spark.range(3), "t")
    assert sorted(r.id for r in stored.collect()) == [0, 1, 2]
    assert all(folder in f for f in stored.inputFiles())


def test_row_key_is_stable(spark):
    keyed = shared.with_row_key(spark.range(100, numPartitions=4))
    first = {r.id: r.doc_key for r in keyed.collect()}
    again = {r.id: r.doc_key for r in keyed.repartition(7).where("id % 2 = 0").collect()}
    assert len(set(first.values())) == 100 and all(first[i] == k for i, k in again.items())


def test_spread_only_widens_small_scans(spark):
    path = shared.write_once(spark.range(10).coalesce(1), "narrow")
    assert shared.spread(path, "id").rdd.getNumPartitions() == 8
    wide = spark.range(0, 100, 1, 32)
    assert shared.spread(wide, "id") is wide


def test_csv_with_surplus_and_missing_fields(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,text,code\n1,"a, b",E11\n2,short\n3,"two\nlines",I10\n4\n5,"a ""q"", b"\n6,5" nail, 6" nail\n')
    rows = [tuple(r) for r in read_table(spark, str(path)).orderBy("id").collect()]
    expected = [("1", "a, b", "E11"), ("2", "short", None), ("3", "two\nlines", "I10"), ("4", None, None), ("5", 'a "q", b', None)]
    assert rows == [*expected, ("6", '5" nail', ' 6" nail')]
    for surplus in ("2,un, deux,E11", "2,un,E11,x,y", "2,deux,E12,,perdu", "2,deux,E12,", '2,"d,eux",E12,""', '2,"a"",",b,c', '2,5" x,6" y,z'):
        path.write_text(f"id,text,code\n1,a,E11\n{surplus}\n")
        for columns in (["code"], ["id"], ["id", "text", "code"]):
            with pytest.raises(Exception, match="more fields than the header"):
                read_table(spark, str(path)).select(*columns).collect()
    path.write_text('id,text,code\n1,a,E11\n2,"open,E12\n3,b,I10\n')
    with pytest.raises(Exception, match="does not close it"):
        read_table(spark, str(path)).collect()


def test_csv_files_of_a_folder_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code_sejour,text,code_dp\n1,un,E11\n")
    (tmp_path / "b.csv").write_text("code_sejour,text,code_dp\n2,deux,E12\n")
    assert sorted(tuple(r) for r in read_table(spark, str(tmp_path)).collect()) == [("1", "un", "E11"), ("2", "deux", "E12")]
    for header, row in (("text,code_sejour,code_dp", "deux,2,E12"), ("code_sejour,text", "2,deux"), ("code_sejour,text,code_dp,x", "2,deux,E12,y")):
        (tmp_path / "b.csv").write_text(f"{header}\n{row}\n")
        with pytest.raises(Exception, match="header"):
            read_table(spark, str(tmp_path)).select("code_dp").collect()


def test_csv_headers_with_repeated_and_empty_names(spark, tmp_path):
    import pandas as pd

    assert distinct_names(["a", "a", None, "a.1", "a"]) == ["a", "a.2", "Unnamed: 2", "a.1", "a.3"]
    path = tmp_path / "odd.csv"
    path.write_text("\ufeffa,b,,a\n1,2,3,4\n", encoding="utf-8")
    table = read_table(spark, str(path))
    assert table.columns == list(pd.read_csv(path).columns) and tuple(table.first()) == ("1", "2", "3", "4")
    (tmp_path / "more.csv").write_text("a,b,,a\n5,6,7,8\n")
    with pytest.raises(ValueError, match="distinct names"):
        read_table(spark, str(tmp_path))
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_table(spark, str(empty))


def test_artefacts_are_files_and_are_replaced(spark, tmp_path):
    path = tmp_path / "a.json"
    path.mkdir()
    (path / "part-0").write_text("old")
    for n in (1, 2):
        write_json_row(spark.range(n, n + 1), str(path))
        assert read_json(path) == {"id": n} and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.json"]
    with pytest.raises(ValueError, match="one text"):
        write_object(spark.range(1).selectExpr("id", "id AS b"), str(path))

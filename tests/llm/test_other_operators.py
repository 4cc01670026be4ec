"""Toxicity, top-k, archives, leaks, mixing and the pipeline on small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re

import pytest

from staycoder.llm.arc_to_warc import arc_records, convert, read_arc, warc_index, write_arc
from staycoder.llm.decontamination import Item, LeakConfig, leaks, with_leaks
from staycoder.llm.mixing import MixConfig, budgets, mix
from staycoder.llm.topk import exact_topk
from staycoder.llm.toxicity import ChainConfig, toxicity


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(800):
        text = [rng.choice(words) for _ in range(40)]
        bad = i % 7 == 0
        if bad:
            text[rng.randrange(40)] = rng.choice(["vile", "nasty", "stemmedA", "stemmedB"])
        rows.append((i, " ".join(text), "x"))
        if i % 2:
            labels.append((i, int(i % 3 == 0), int(bad)))
    rows += [(9000, None, "x"), (9001, "", "x"), (None, "vile", "x"), (9002, "vile " * 20_000, "x")]
    labels += [(5, None, 1), (6, 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_toxic string")
    found = toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(rows)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 800 and r["doc_id"] % 2 == 0]
    wrong = [r for r in held if r["is_toxic"] != (r["doc_id"] % 7 == 0)]
    assert len(wrong) <= 0.02 * len(held)
    assert not next(r for r in found if r["doc_id"] == 9000)["is_toxic"]
    nothing = toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), ChainConfig())
    assert {(r["is_toxic"], r["p_toxic"]) for r in nothing.collect()} == {(False, None)}


def test_exact_topk(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 / 8) for _ in range(40)]) for i in range(400)]
    rows += [(401, None), (402, [None] * 40), (403, [math.nan] * 40), (404, [math.inf] * 40), (405, rows[7][1]), (406, rows[7][1]), (None, rows[3][1]), (450, [0.5])]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<double>, queries string")
    got = [tuple(r) for r in exact_topk(df, block_rows=64).orderBy("query_id", "rank").collect()]
    sound = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in sound if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(sound[q], v, strict=False)), i) for i, v in sound.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert got == want
    assert exact_topk(df.where("vec_id = 50")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, tmp_path, version):
    rows = [(5, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "u", None), (8, "u", ""), (3, "u", "x\nWARC/1.1\r\n\r\nfiledesc:// 1\n"), (None, "u", "<p>é</p>"), (7, "u", "y" * 400_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    write_arc(pages, f"{tmp_path}/arc", version)
    records = read_arc(spark, f"{tmp_path}/arc")
    assert records.count() == len(rows)
    convert(records, f"{tmp_path}/warc")
    got = {r["page_id"]: tuple(r)[1:] for r in warc_index(spark, f"{tmp_path}/warc").collect()}
    first = {"<p>é</p>": 2, None: 8, "": 8}
    for page, _, html in rows:
        raw = (html or "").encode()
        original = first.get(html, page)
        kind = ("response", None) if page == original else ("revisit", original)
        assert got[page] == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *kind)


def test_archive_headers_follow_their_version():
    old = b"filedesc://x 0 20000101000000 text/plain 69\n1 0 org\nURL IP-address Archive-date Content-type Archive-length\n\n"
    block = old[old.index(b"\n") + 1 : -1]
    old = old.replace(b" 69\n", b" %d\n" % len(block))
    [record] = arc_records("f", old + b"http://a b/c 1.2.3.4 19990102030405 text/html 5\nhello\n")
    assert record["URL"] == "http://a b/c" and record["block"] == b"hello"
    with pytest.raises(ValueError, match="declared"):
        list(arc_records("f", old + b"u 1.2.3.4 19990102030405 text/html 50\nhello\n"))
    with pytest.raises(ValueError, match="header line"):
        list(arc_records("f", b"u 1.2.3.4 19990102030405 text/html 5\nhello\n"))


def common_by_hand(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(row[j - 1], old[j])
    return row[-1]


def test_common_subsequence():
    import numpy as np

    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 80))] for _ in range(2))
        assert Item.of(0, np.array(a, dtype=np.uint64)).common(b) == common_by_hand(a, b)


def test_leaks(spark):
    rng = random.Random(8)
    words = [f"term{i}" for i in range(3000)]

    def text(n):
        return [rng.choice(words) for _ in range(n)]

    items = [(k, " ".join(text(n))) for k, n in enumerate((12, 30, 45, 90))] + [(90, None), (91, "too short")]
    rows, want = [(1000, None, "x"), (1001, "", "x")], {1000: set(), 1001: set()}
    for i in range(200):
        body = text(rng.randrange(5, 300))
        planted = items[i % 4]
        if i % 3 == 0:
            copy = planted[1].split()
            if i % 2:  # a paraphrase: a tenth of the words differ, not the answer
                for _ in range(len(copy) // 10):
                    copy[rng.randrange(len(copy) - 5)] = rng.choice(words)
            at = rng.randrange(len(body))
            body = body[:at] + [w.upper() + "," for w in copy] + body[at:]
        rows.append((i, " ".join(body), "x"))
        want[i] = {planted[0]} if i % 3 == 0 else set()
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: {e["item_id"] for e in r["leaks"]} for r in with_leaks(docs, benchmark, LeakConfig(cosine=-1.0)).collect()}
    assert found == want
    assert with_leaks(docs.limit(0), benchmark).count() == 0
    assert with_leaks(docs, benchmark.limit(0)).where("size(leaks) > 0").count() == 0


def test_leaks_are_retrieved_with_production_parameters(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    texts = [tuple(r) for r in items.select("item_id", "text").collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in texts if t in r["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()}
    assert len(want) > 10 and len(want & found) >= 0.9 * len(want)


@pytest.mark.parametrize("n", [8, 12, 16, 20, 40])
def test_edited_leaks_are_found_with_production_parameters(spark, n):
    rng = random.Random(n)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(300).collect()
    bodies = [r["text"].split() for r in rows]
    common = sorted({w for b in bodies for w in b if re.fullmatch("[a-z]+", w)})
    items = [(i, " ".join(rng.sample(common, n))) for i in range(20)]
    docs, want = [], set()
    for k, body in enumerate(bodies):
        item_id, item = items[k % 20][0], items[k % 20][1].split()
        copied = k % 2 == 0  # else the answer stands and as little as 60% of the words are kept
        lost = int((0.2 if copied else 0.4) * n)
        for at in rng.sample(range(n if copied else n - 5), min(lost, n if copied else n - 5)):
            item[at] = f"edit{k}x{at}" if k % 3 else ""
        at = rng.randrange(len(body) + 1)
        docs.append((k, " ".join([*body[:at], *item, *body[at:]])))
        want.add((k, item_id))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert want <= {(r["doc_id"], r["item_id"]) for r in found}
    assert all(r["lcs"] >= 0.8 or (r["lcs"] >= 0.6 and r["answer"]) for r in found)


def test_budgets_go_to_siblings_first():
    config = MixConfig(levels=("d", "l"), weights={("a",): 3}, total=400, max_epochs=1)
    sizes = {("a", "x"): 10, ("a", "y"): 500, ("b", "x"): 1000}
    assert budgets(sizes, config) == {("a", "x"): 10, ("a", "y"): 290, ("b", "x"): 100}
    sizes = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 1000}
    assert budgets(sizes, config) == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 290}


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randrange(1, 30)), rng.choice(["en", "de", None]), rng.choice(["s1", "s2"]), "d" if i % 3 else "e") for i in range(300)]
    rows += [(900, None, "en", "s1", "d"), (901, "", "en", "s1", "d")]
    config = MixConfig(weights={("d",): 1, ("e",): 3, ("e", "en"): 2}, share=0.6, max_epochs=3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    got = sorted((r["doc_id"], r["mix_epoch"], r["mix_tokens"]) for r in mix(docs, config).collect())
    size = {r[0]: len(re.findall(r"\S+", r[1] or "")) for r in rows}
    leaves = {}
    for r in rows:
        if size[r[0]]:
            leaves.setdefault((r[4], r[2], r[3]), []).append(r[0])
    want = []
    for path, left in budgets({k: sum(size[i] for i in v) for k, v in leaves.items()}, config).items():
        epoch = 0
        while left:
            for i in sorted(leaves[path], key=lambda i: hashlib.md5(f"42:{epoch}:{i}".encode()).hexdigest()):
                taken = min(left, size[i])
                if taken:
                    want.append((i, epoch, taken))
                left -= taken
            epoch += 1
    assert got == sorted(want)
    assert sum(t for _, _, t in got) == int(0.6 * sum(size.values()))
    assert mix(docs.limit(0), config).count() == 0


def test_mixing_counts_tokens_once_a_pass(spark):
    rows = [(i, "w \u0085 x" * (i % 7), "en", "s", "d") for i in range(50)] + [(None, "\t \n", "en", "s", "d"), (7, " y", None, "s", "d"), (7, " y", None, "s", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    mixed = mix(docs, MixConfig(share=1.5, max_epochs=2))
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 4  # whole documents, those at the cut, and for each the slices
    size = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows)
    assert sum(r["mix_tokens"] for r in mixed.collect()) == size * 3 // 2


def test_near_duplicates_go_by_row(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a), (1, a), (2, f"{a} end"), (2, b), (None, c), (None, c), (None, f"{a} more"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(map(str, [(1, a), (2, b), (None, c), (3, None), (3, None)]))


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == n

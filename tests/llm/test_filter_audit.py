"""The transducer, its hash table and the audit of all orders against plain Python."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from staycoder.llm.filter_audit import count_texts, filter_audit, first_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def counted(texts: list[str], block: int) -> list[tuple[int, ...]]:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    got = count_texts(data, offsets, block)
    return list(zip(*(got[k].tolist() for k in ("words", "distinct", "capitals", "code_points", "symbols")), strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAb é😀 \t\n\x0b\x1f\xa0#|", max_size=40), max_size=12), st.integers(1, 60))
def test_counts(texts, block):
    assert counted(texts, block) == [plain(t) for t in texts]


def test_long_texts_and_many_words():
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    texts = ["", "x" * 300_000, long, "é" * 10, " " * 5000, long + "Y"]
    assert counted(texts, 1 << 14) == [plain(t) for t in texts]


def test_spans_with_one_key_are_told_apart_by_their_bytes():
    data = np.frombuffer(b"aabbaaccbb", dtype=np.uint8)
    start = np.arange(0, 10, 2)
    owner = np.zeros(5, dtype=np.int64)
    new = first_spans(data, start, start + 2, owner, key=np.full(5, 9, dtype=np.uint64))
    assert new.tolist() == [True, True, False, True, False]


def audit(rows, good, toxic):
    least = {}
    for i, text, _ in rows:
        key = text or ""
        if i is not None and (least.get(key) is None or i < least[key]):
            least[key] = i
    docs = []
    for i, text, part in rows:
        words, distinct, capitals, points, symbols = plain(text or "")
        first = least.get(text or "")
        fails = {"A": words < 100, "B": 100 * distinct < 80 * words, "C": 100 * capitals > 10 * points, "D": symbols > 0}
        fails["E"] = first is not None and (i is None or i > first)
        docs.append((i, part or "", {k for k, v in fails.items() if v}))
    out = {}
    for part in {p for _, p, _ in docs}:
        mine = [d for d in docs if d[1] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [d for d in mine if letter in d[2] and not d[2] & before]
                out[part, order, step] = [
                    sum(not d[2] & (before | {letter}) for d in mine), len(gone),
                    sum(letter in d[2] and bool(d[2] & before) for d in mine), sum(d[2] == {letter} for d in mine),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ]
    for (part, order, step), row in out.items():
        letter = order[step - 1]
        row.append(sum(out[part, o, o.index(letter) + 1][1] for o in map("".join, permutations("ABCDE"))))
    return out


def test_audit_of_all_orders(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        vocabulary = rng.choice([30, 400, 100_000])
        words = [f"{rng.choice('wWQ')}{rng.randrange(vocabulary)}" for _ in range(rng.choice([0, 5, 99, 100, 101, 300]))]
        rows.append((i, rng.choice([" ", "\n\n"]).join(words) + rng.choice(["", "", "#", " |"]), rng.choice(["en", "de", None, ""])))
    rows += [(200 + i, rows[i % 7][1], "en") for i in range(60)] + [(3, rows[3][1], "fr"), (3, rows[3][1], "fr")]
    rows += [(None, None, "en"), (None, None, "en"), (300, None, None), (301, "", "de"), (None, "only null ids", "x"), (None, "only null ids", "x")]
    docs = spark.createDataFrame([(*r, "y", 1) for r in rows], "doc_id long, text string, lang string, part string, fails int").repartition(4)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 250, 2)]
    labels += [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    expected = audit(rows, good, toxic)
    got = filter_audit(docs, table).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == expected
    assert len(got) == len(expected)
    assert filter_audit(docs.where("doc_id = -1"), table).count() == 0
    assert filter_audit(docs, table.where("doc_id = -1")).agg({"good_lost": "max"}).first()[0] == 0

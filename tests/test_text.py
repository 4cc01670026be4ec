"""Edge rows with known values, and brute force over random texts."""

import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from staycoder.functions import fixed, text

METRIC_ROWS = [
    (None, (0, 0, 0.0, 0, 0, 0)),
    ("", (0, 0, 0.0, 0, 0, 0)),
    ("   ", (3, 0, 0.0, 0, 0, 0)),
    ("...", (3, 0, 0.0, 0, 1, 0)),
    ("Patient vu au CHU. IDM traité en 2025.\n\nConclusion : IDM.", (57, 10, 3.333, 9, 2, 4)),
    ("C.H.U. de Nancy, e.g. ici", (25, 8, 1.333, 8, 1, 1)),
    ("Été ete ÉTÉ", (11, 3, 3.0, 1, 1, 1)),
    ("_foo-bar foo_ a/b -x-", (21, 4, 4.0, 4, 1, 0)),
    ("a\n\n\n\nb\n \nc", (10, 3, 1.0, 3, 2, 0)),
    ("a b c. " * 15 + "d e f g.", (113, 49, 3.062, 7, 1, 0)),
    ("😀 é", (3, 1, 1.0, 1, 1, 0)),
]


def test_text_metrics_edge_rows(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(METRIC_ROWS)], "i int, text string")
    measured = text.add_text_metrics(rows, "text", "m").orderBy("i").collect()
    assert [tuple(r.m) for r in measured] == [expected for _, expected in METRIC_ROWS]


def brute_force_metrics(t: str) -> tuple:
    """The metric definitions, one text at a time."""
    is_word = regex.compile(r"\b[\p{L}\p{N}][\p{L}\p{N}\-_/]*\b")
    words = is_word.findall(t)
    pieces = [p for p in regex.split(r"[.!?;\n]+", t) if p.strip()]
    per_piece = sum(len(is_word.findall(p)) for p in pieces) / len(pieces) if pieces else 0.0
    bare = {"".join(c for c in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(c) != "Mn") for w in words}
    blocks = sum(1 for b in regex.split(r"\n\n+", t) if b.strip())
    short = len(regex.findall(r"\b[A-ZÀ-Ý0-9]{2,}\b", t)) + len(regex.findall(r"\b(?:[A-Za-z]\.){2,}[A-Za-z]?\b", t))
    return len(t), len(words), round(per_piece, 3), len(bare), blocks, short


ALPHABET = "abAÉéœß ½²-_/.!?;\n\n\t\r\x0b\x1c\x1e\x85\xa0 ́CHU09 ÷×中か"


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=60), min_size=150, max_size=150))
def test_text_metrics_match_brute_force(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    measured = text.add_text_metrics(rows, "text", "m").orderBy("i").collect()
    for r in measured:
        assert tuple(r.m) == brute_force_metrics(r.text), repr(r.text)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=150, max_size=150))
def test_strip_and_sentences_match_python(spark, texts):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = rows.select("text", text.strip(F.col("text")).alias("s"), text.sentences(F.col("text")).alias("p")).collect()
    for r in got:
        assert r.s == r.text.strip(), repr(r.text)
        assert r.p == [p.strip() for p in regex.split(r"[.!?;\n]+", r.text) if p.strip()], repr(r.text)


def test_metric_switches(spark):
    rows = spark.createDataFrame([("Été ete ÉTÉ été",)], "text string")
    size = lambda **kw: text.add_text_metrics(rows, "text", "m", **kw).first().m.lexicon_size
    assert size() == 1
    assert size(lowercase=False) == 3
    assert size(remove_accents=False) == 2
    assert size(lowercase=False, remove_accents=False) == 4


@pytest.mark.parametrize(
    "given_text, expected",
    [
        ("  a  b \n", "a b"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("a\tb \t c", "a\tb c"),
        ("a\r\n\r\n\r\nb", "a\r\n\r\n\r\nb"),
        ("\xa0a\xa0", "a"),
        (" \n ", ""),
        (None, ""),
    ],
)
def test_normalize(one_column, given_text, expected):
    assert one_column(text.normalize_text, [given_text]) == [expected]


def test_normalize_switches(one_column):
    raw = " A  B\n\n\n\nC "
    off = dict(strip_ends=False, collapse_spaces=False, normalize_newlines=False)
    assert one_column(lambda c: text.normalize_text(c, **off), [raw]) == [raw]
    assert one_column(lambda c: text.normalize_text(c, lower=True), [raw]) == ["a b\n\nc"]
    assert one_column(lambda c: text.normalize_text(c, strip_ends=False), [raw]) == [" A B\n\nC "]


def test_word_tokens(one_column):
    got = one_column(text.word_tokens, ["_foo-bar foo_ -x- a/b/", "étude ok", "m² H2O x²"])
    assert got == [["bar", "foo_", "x", "a/b"], ["ok"], ["m", "H2O", "x"]]


def test_strip_accents(one_column):
    assert one_column(text.strip_accents, ["éàçñü ÉÅ łøœß が ế"]) == ["eacnu EA łøœß か e"]


def test_fallbacks(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None, "", "c"), ("a", "b", "c"), ("", None, "c")], "a string, b string, c string")
    cols = [F.col(c) for c in "abc"]
    got = rows.select(text.first_filled(*cols), text.first_present(*cols)).collect()
    assert [tuple(r) for r in got] == [("c", ""), ("a", "a"), ("c", "")]


def test_rounding_is_pythons(spark):
    from pyspark.sql import functions as F

    values = [i / s for s in (16, 80, 400, 2000) for i in range(0, 3000, 7)] + [-13.0375, 2.0625, 0.0005]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", text.round_half_even(F.col("v")).alias("r")).collect()
    assert all(r.r == round(r.v, 3) for r in got)


def test_long_whitespace_runs_stay_linear(one_column):
    junk = "a" + " \n" * 200_000 + "b"
    assert one_column(text.strip, [junk]) == [junk]
    assert one_column(text.count_sections, [junk]) == [1]
    assert one_column(text.count_sentences, [junk]) == [2]
    edges = "\n" * 300_000 + "a" + "\n" * 300_000
    assert one_column(text.count_sections, [edges, "\n" * 300_000]) == [1, 0]
    assert one_column(text.normalize_text, [edges]) == ["a"]


def test_whitespace_class_is_pythons(one_column):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert one_column(text.strip, [f"{b}x{b}" for b in blanks]) == ["x"] * len(blanks)
    assert fixed.METRICS[0] == "len_chars"


def test_strip_accents_of_every_character(one_column):
    import sys
    import unicodedata

    known = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    lines = ["x".join(known[i : i + 97]) for i in range(0, len(known), 97)]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    # one at a time: in a row of marks their order would play a part
    expected = ["x".join(plain(c) for c in known[i : i + 97]) for i in range(0, len(known), 97)]
    wrong = [(a, b) for a, b in zip(one_column(text.strip_accents, lines), expected, strict=True) if a != b]
    assert not wrong, wrong[0]

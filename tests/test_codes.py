from pyspark.sql import functions as F

from staycoder.functions import codes, prompts


def test_first_icd10(one_column):
    texts = ["C34.1", "C34.", "C34.12345", "C34.U1", "Z99.AB é", "U07.1", "c34.1", "xC34", "C345", "", None, "DP: I21.4 et E11"]
    expected = ["C34.1", "C34", "C34.", "C34.", "Z99.AB", None, None, None, None, None, None, "I21.4"]
    assert one_column(codes.first_icd10, texts) == expected


def test_answer_code(one_column):
    texts = ["prompt (DP). texte I21.4\n\nDP: C34.1 DP: rien", "E11 DP: K35", "E11", "rien", None]
    assert one_column(codes.answer_code, texts) == ["I21.4", "K35", "E11", "", ""]
    assert one_column(lambda c: codes.answer_code(c, "none"), texts) == ["", "K35", "E11", "", ""]


def test_normalize_code(one_column):
    assert one_column(codes.normalize_code, [" c34.1 ", None]) == ["c34.1", ""]
    assert one_column(lambda c: codes.normalize_code(c, upper=True), [" c34.1 "]) == ["C34.1"]
    assert one_column(lambda c: codes.normalize_code(c, upper=True, strip_dot=True), [" c34.1 "]) == ["C341"]


def test_prompts(one_column):
    got = one_column(prompts.coding_prompt, [" note\n", "", None])
    assert got[0].endswith("\n\nnote\n\nDP:") and got[1:] == [None, None]
    sized = one_column(lambda c: prompts.rewrite_messages(c, 300), ["x", ""])
    assert [m.role for m in sized[0]] == ["system", "user"] and "(~300 mots)" in sized[0][1].content
    assert sized[1] is None
    plain = one_column(lambda c: F.get(prompts.rewrite_messages(c), F.lit(1))["content"], [" x "])
    assert "mots" not in plain[0].split(":")[0].replace("propres mots", "") and plain[0].endswith("\n\nx")

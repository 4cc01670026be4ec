"""Diagnosis codes: finding, extracting from answers, normalising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staycoder.functions import fixed
from staycoder.functions.text import strip


def first_icd10(text: Column) -> Column:
    """First ICD-10 code of the text, else null. Case-sensitive."""
    return F.nullif(F.regexp_extract(text, fixed.ICD10, 0), F.lit(""))


def answer_code(generated: Column, fallback: str = "full") -> Column:
    """Code of a generated answer: after the last answer mark, else anywhere, else "".

    The generated text starts with the prompt, so the fallback may return a code that stands in
    the note itself; fallback="none" switches it off.
    """
    if fallback not in ("full", "none"):
        raise ValueError(f"fallback must be 'full' or 'none', not {fallback!r}")
    code = first_icd10(F.split_part(generated, F.lit(fixed.ANSWER_MARK), F.lit(-1)))
    if fallback == "full":
        code = F.coalesce(code, first_icd10(generated))
    return F.coalesce(code, F.lit(""))


def normalize_code(code: Column, upper: bool = False, strip_dot: bool = False) -> Column:
    """Stripped code, null as ""; optionally upper-cased, then freed of dots."""
    out = strip(F.coalesce(code, F.lit("")))
    if upper:
        out = F.upper(out)
    return F.replace(out, F.lit("."), F.lit("")) if strip_dot else out

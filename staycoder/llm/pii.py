"""Personal data in text: patterns propose spans, checksums confirm them, context words adjust scores.

Built-in functions only. A kind's matches and the stretches between them (`split` by the same pattern)
give every match its place in code points. The patterns find what the plain ones would, leftmost and
without overlap, but in one pass over long runs: possessive repeats, and starts only where a run starts
(or where the last match ended, `\\G`).

Base kinds are always kept when their check holds: email; ip (four parts of at most 255); card (a run of
digits with single blanks or hyphens, 16 to 19 digits, Luhn); phone (plus sign, 8 to 15 digits). Added
kinds need a score of `least_score`: iban (mod 97) and ssn (three groups, impossible ones excluded).
A span's score is its kind's prior, plus a bonus if a context word of the kind stands in the 40 code
points before it (back to the previous match of the kind).

Null text is empty: no spans. Every row is scored by itself, so repeated or null ids do no harm; other
columns are kept by `find_pii`, and a column named like its result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    prior: float
    context: str
    base: bool = True
    needs: str | None = None  # a string without which there is no match


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9, "mail|contact|write to", needs="@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|address|host|server"),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
        0.8, "card|credit|visa|payment",
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile", needs="+"),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        0.8, "iban|account|bank", base=False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        0.3, "ssn|social security|tax id", base=False,
    ),
)
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substr(back, i, F.lit(1))) - 48
        twice = digit * 2
        return total + F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 by 97 with its first four behind the rest."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        sign = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(sign < 58, rest * 10 + sign - 48).otherwise(rest * 100 + sign - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    if kind == "iban":
        code = F.replace(value, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & mod97(code)
    return F.lit(True)


def _located(hits: Column, gaps: Column) -> Column:
    """Array of (start, end, value, before) from the matches and the stretches between them."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

    def step(state: Column, i: Column) -> Column:
        gap, hit = F.get(gaps, i), F.get(hits, i)
        start = state["at"] + F.length(gap)
        span = F.struct(
            start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value"), F.right(gap, F.lit(CONTEXT)).alias("before")
        )
        return F.struct((start + F.length(hit)).alias("at"), F.array_append(state["spans"], span).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    walk = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step, lambda s: s["spans"])
    return F.when(F.size(hits) > 0, walk).otherwise(empty)


def _spans(kind: Kind, located: Column, least_score: float) -> Column:
    """Confirmed and scored matches of one kind."""

    def scored(s: Column) -> Column:
        bonus = F.when(s["before"].rlike(rf"(?i)\b(?:{kind.context})"), 0.3).otherwise(0.0)
        score = F.round(F.least(F.lit(1.0), F.lit(kind.prior) + bonus), 2)
        return F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score")
        )

    found = F.transform(F.filter(located, lambda s: confirmed(kind.name, s["value"])), scored)
    return found if kind.base else F.filter(found, lambda s: s["score"] >= least_score)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii", least_score: float = 0.5) -> DataFrame:
    """The columns of `docs` and `out`: array of (kind, start, end, value, score), by kind, then start.

    Places count code points from 0; the end is exclusive.
    """
    rows = docs.drop(out).withColumn("_pii_text", F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        source = F.col("_pii_text")
        hits = F.regexp_extract_all(source, F.lit(kind.pattern), F.lit(0))
        if kind.needs:
            hits = F.when(F.contains(source, F.lit(kind.needs)), hits).otherwise(none)
        rows = rows.withColumn(f"_hits_{kind.name}", hits)
    spans = []
    for kind in KINDS:
        hits = F.col(f"_hits_{kind.name}")
        gaps = F.when(F.size(hits) > 0, F.split("_pii_text", kind.pattern, -1))
        rows = rows.withColumn(f"_gaps_{kind.name}", gaps)
        spans.append(_spans(kind, _located(hits, F.col(f"_gaps_{kind.name}")), least_score))
    rows = rows.withColumn(out, F.concat(*spans))
    return rows.drop("_pii_text", *[f"_{part}_{k.name}" for part in ("hits", "gaps") for k in KINDS])


def pii_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans as text."""
    found = find_pii(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "pii")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    names = [k.name for k in KINDS if k.base]

    def count(name: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [count(name) for name in names]
    base = F.filter("pii", lambda s: s["kind"].isin(*names))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))

"""Text cleaning and measuring as native column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycoder.functions import fixed


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace the way Python's str.strip() does.

    The look-behind lets the trailing branch start at the head of a whitespace run only, so that
    long runs inside the text cost linear time. The input is evaluated once.
    """
    ws = fixed.WS
    return F.regexp_replace(text, rf"(?U)\A[{ws}]++|(?<![{ws}])[{ws}]++\z", "")


def first_filled(*texts: Column) -> Column:
    """First text that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def first_present(*texts: Column) -> Column:
    """First text that is not null (an empty one counts), else the empty string."""
    return F.coalesce(*texts, F.lit(""))


def normalize_text(
    text: Column,
    strip_ends: bool = True,
    collapse_spaces: bool = True,
    normalize_newlines: bool = True,
    lower: bool = False,
) -> Column:
    """Light cleaning; null becomes the empty string. Each step can be switched off."""
    out = F.coalesce(text, F.lit(""))
    if strip_ends:
        # most notes start and end with a visible character: look at those before scanning the text
        ends = F.concat(F.substring(out, 1, 1), F.substring(out, -1, 1))
        out = F.when(F.rlike(ends, F.lit(rf"(?U)[{fixed.WS}]")), strip(out)).otherwise(out)
    if normalize_newlines:
        out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    if collapse_spaces:
        out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return F.lower(out) if lower else out


def word_tokens(text: Column) -> Column:
    """Words: a letter or digit, then letters, digits, hyphens, underscores and slashes."""
    return F.regexp_extract_all(text, F.lit(fixed.WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Non-blank stripped pieces between strong punctuation or line breaks: from the first to the
    last visible character of a piece."""
    visible, inside = rf"[^{fixed.WS}{fixed.SENTENCE_BREAK}]", rf"[^\n{fixed.SENTENCE_BREAK}]"
    pattern = rf"(?U){visible}(?:{inside}*{visible})?"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count_sentences(text: Column) -> Column:
    """Number of `sentences`: one match per piece, from its first visible character to its end."""
    pattern = rf"(?U)[^{fixed.WS}{fixed.SENTENCE_BREAK}][^\n{fixed.SENTENCE_BREAK}]*+"
    return F.regexp_count(text, F.lit(pattern))


def count_sections(text: Column) -> Column:
    """Number of non-blank blocks between blank lines.

    Counts whitespace runs with two line breaks in a row; all but a leading and a trailing one part
    two blocks. Each run is consumed at once, so the time is linear whatever the whitespace.
    """
    ws = fixed.WS
    breaks = F.regexp_count(text, F.lit(rf"(?U)\n\n[{ws}]*+"))
    lead = F.regexp_extract(text, rf"(?U)[{ws}]*+", 0)
    ends_blank = F.rlike(F.substring(text, -1, 1), F.lit(rf"(?U)[{ws}]"))
    trail = F.when(ends_blank, F.regexp_extract(text, rf"(?U)(?<![{ws}])[{ws}]++\z", 0)).otherwise(F.lit(""))
    outer = [F.contains(run, F.lit("\n\n")).cast("int") for run in (lead, trail)]
    return F.when(lead == text, F.lit(0)).otherwise(1 + breaks - outer[0] - outer[1])


def count_abbreviations(text: Column) -> Column:
    """Upper-case or digit runs of two and more, plus dotted abbreviations."""
    upper = F.regexp_count(text, F.lit(fixed.UPPER_ABBREVIATION))
    return upper + F.regexp_count(text, F.lit(fixed.DOTTED_ABBREVIATION))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Characters whose decomposition, without marks, is one other character; behind them all marks, which have no target."""
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        bare = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(bare) == 1 and bare[0] != char:
            source.append(char)
            target.append(bare[0])
    marks = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Mn"]
    return "".join(source + marks), "".join(target)


@lru_cache(maxsize=1)
def _long_decompositions() -> dict[str, str]:
    """Characters, Hangul syllables aside, whose decomposition without marks is several characters."""
    found = {}
    for code in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, sys.maxunicode + 1)]:
        char = chr(code)
        if unicodedata.decomposition(char):
            bare = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
            if len(bare) > 1:
                found[char] = bare
    return found


def _expanded(char: Column) -> Column:
    """A character, or the several ones it decomposes into: Hangul by its arithmetic, the others by a map."""
    jamo = lambda first, n: F.array(*(F.lit(chr(first + i)) for i in range(n)))
    tails = F.array(F.lit(""), *(F.lit(chr(0x11A8 + i)) for i in range(27)))
    syllable = F.ascii(char) - 0xAC00
    place = lambda e: e.cast("int")
    hangul = F.concat(
        F.get(jamo(0x1100, 19), place(F.floor(syllable / 588))),
        F.get(jamo(0x1161, 21), place(F.floor(syllable % 588 / 28))),
        F.get(tails, place(syllable % 28)),
    )
    table = F.create_map(*(F.lit(x) for pair in _long_decompositions().items() for x in pair))
    other = F.coalesce(F.try_element_at(table, char), char)
    return F.when(syllable.between(0, 11171), hangul).otherwise(other)


def strip_accents(text: Column) -> Column:
    """Decompose and drop combining marks (é -> e; ł, ø, œ, ß stay).

    Characters that decompose into several (Hangul, some Indic vowels and compatibility forms) are expanded first,
    in the texts that hold one; all others take one native pass. Which characters are marks is read from Python's
    tables, which know more recent ones than the JVM's.
    """
    source, target = _accent_table()
    several = f"[\uac00-\ud7a3{''.join(_long_decompositions())}]"
    expanded = F.array_join(F.transform(F.split(text, ""), _expanded), "")
    whole = F.when(F.rlike(text, F.lit(several)), expanded).otherwise(text)
    return F.translate(whole, source, target)


def add_lexicon(
    df: DataFrame, words: str, out: str, lowercase: bool = True, remove_accents: bool = True
) -> DataFrame:
    """Add the distinct word forms of the array column `words` as `out`.

    Words hold no blank, so joining them lets one `lower` and one accent fold serve the whole list;
    only the distinct non-ASCII forms are folded. Each stage is its own projection, evaluated once.
    """
    none = F.array().cast("array<string>")
    forms = F.col(words)
    if lowercase:
        forms = F.split(F.lower(F.array_join(words, " ")), " ")
    df = df.withColumn(out, F.when(F.size(words) > 0, F.array_distinct(forms)).otherwise(none))
    if not remove_accents:
        return df
    accented = f"_{out}_accented"
    is_ascii = lambda w: F.octet_length(w) == F.length(w)
    df = df.withColumn(accented, F.filter(out, lambda w: ~is_ascii(w)))
    folded = F.split(strip_accents(F.array_join(accented, " ")), " ")
    merged = F.array_union(F.filter(out, is_ascii), folded)
    return df.withColumn(out, F.when(F.size(accented) > 0, merged).otherwise(F.col(out))).drop(accented)


def round_half_even(value: Column, digits: int = 3) -> Column:
    """Round a double like Python's round(): by its true binary value, exact ties to even.

    `bround` works on the shortest decimal form, so 13.0375 (stored slightly below) looks like a tie
    to it. Here the value is counted in half units: an even count is the answer, an odd one leaves
    the side of the midpoint, read from the exact error of the product (value split in two halves).
    """
    scale = float(2 * 10**digits)
    product = value * scale
    carry = value * 134217729.0
    high = carry - (carry - value)
    halves = F.rint(product)
    side = (product - halves) + ((high * scale - product) + (value - high) * scale)
    return (
        F.when(halves % 2 == 0, halves / scale)
        .when(side > 0, (halves + 1) / scale)
        .when(side < 0, (halves - 1) / scale)
        .otherwise(F.bround(value, digits))
    )


def add_text_metrics(
    df: DataFrame, text: str, out: str, lowercase: bool = True, remove_accents: bool = True
) -> DataFrame:
    """Add the six text metrics as a struct column `out`; null counts as the empty text.

    Words and their distinct forms get a projection of their own so that each is extracted once.
    A word never spans a sentence break, hence words per sentence = words / sentences.
    """
    body, words, forms, ratio = (f"_{out}_{part}" for part in ("text", "words", "forms", "ratio"))
    staged = df.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    staged = staged.withColumn(words, word_tokens(F.col(body)))
    staged = add_lexicon(staged, words, forms, lowercase, remove_accents)
    n_sentences = count_sentences(F.col(body)).cast("double")
    staged = staged.withColumn(ratio, F.try_divide(F.size(words).cast("double"), n_sentences))
    metrics = F.struct(
        F.char_length(F.col(body)).alias("len_chars"),
        F.size(words).alias("len_words"),
        F.coalesce(round_half_even(F.col(ratio)), F.lit(0.0)).alias("sent_len_avg"),
        F.size(forms).alias("lexicon_size"),
        count_sections(F.col(body)).alias("n_sections"),
        count_abbreviations(F.col(body)).alias("n_abbr"),
    )
    return staged.withColumn(out, metrics).drop(body, words, forms, ratio)

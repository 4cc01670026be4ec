"""Prompts as columns; a null prompt means that the model is not called and the result is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staycoder.functions import fixed
from staycoder.functions.text import strip

# Short neutral defaults; callers with a model in mind pass their own wording.
REWRITE_ROLE = "Assistant de rédaction."
REWRITE_REQUEST = "Texte à condenser"
CODING_REQUEST = "Quel code CIM-10 pour ce texte ?"


def rewrite_messages(
    text: Column,
    target_words: int | None = None,
    role: str = REWRITE_ROLE,
    request: str = REWRITE_REQUEST,
) -> Column:
    """System and user message for a condensing rewrite; null where the text is empty."""
    size = f" (~{target_words} mots)" if target_words else ""
    message = lambda who, what: F.struct(F.lit(who).alias("role"), what.alias("content"))
    messages = F.array(
        message("system", F.lit(role)),
        message("user", F.concat(F.lit(f"{request}{size} :\n\n"), strip(text))),
    )
    return F.when(text != "", messages)


def coding_prompt(text: Column, request: str = CODING_REQUEST) -> Column:
    """Instruction, note and answer mark; null where the text is empty."""
    prompt = F.concat(F.lit(f"{request}\n\n"), strip(text), F.lit(f"\n\n{fixed.ANSWER_MARK}"))
    return F.when(text != "", prompt)

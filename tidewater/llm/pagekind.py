"""Language and kind of writing of a page, told from its text in one pass."""

from __future__ import annotations

import re

from tidewater.llm.pagefeatures import known_language

#: Kinds of writing, and the language where no function word of a known one is found.
KINDS = ("discussion", "links", "figures", "questions", "note", "article", "empty")
UNKNOWN = "other"
_QUOTE = re.compile(r"^>|^\S+, \d{4}-\d\d-\d\d", re.MULTILINE)
_DIGIT = re.compile(r"\d")
_QUESTION = re.compile(r"[?？]")
#: Characters from which on a page is an article and no note; quoted lines, characters a link, share of digits, and questions that make the other kinds.
ARTICLE, QUOTES, LINK_EVERY, DIGITS, QUESTIONS = 800, 3, 400, 0.08, 4


def page_kind(text: str | None) -> tuple[str, str]:
    """``(language, topic)`` of a text; null and blank texts are ``other`` and ``empty``."""
    if not isinstance(text, str) or not text.strip():
        return UNKNOWN, "empty"
    n = len(text)
    if len(_QUOTE.findall(text)) >= QUOTES:
        kind = "discussion"
    elif text.count("http") * LINK_EVERY > n:
        kind = "links"
    elif len(_DIGIT.findall(text)) > DIGITS * n:
        kind = "figures"
    elif len(_QUESTION.findall(text)) >= QUESTIONS:
        kind = "questions"
    else:
        kind = "article" if n >= ARTICLE else "note"
    return known_language(text) or UNKNOWN, kind

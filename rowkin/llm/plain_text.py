"""Texts in plain words: one character form, one case, no accents. Shared by the operators on texts."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

from rowkin.llm.unicode_repair import clean_characters, repair_token

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


@lru_cache(maxsize=1 << 16)
def _fold_char(ch: str) -> str:
    kept = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c) or ord(c) > 0x8FF)
    return kept.replace("ß", "ss").replace("ø", "o").replace("œ", "oe").replace("æ", "ae")


def fold(text: str) -> str:
    """Usual characters, lower case, Latin letters without accents; line structure is kept."""
    if not text.isascii():
        text, _ = clean_characters(text)
        if not text.isascii():
            text = " ".join(t if t.isascii() else repair_token(t)[0] for t in text.split(" "))
            text = unicodedata.normalize("NFC", text)
            text = "".join(c if c < "\x80" else _fold_char(c) for c in text.casefold())
    return text.lower()


def words(text: str) -> list[str]:
    """The words of the folded text."""
    return WORD.findall(fold(text))

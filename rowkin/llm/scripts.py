"""Words of Indic scripts in Latin letters, read off the characters' Unicode names."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letter names whose spelling differs from the sound they are written for.
_SOUNDS = {"TTA": "ta", "TTHA": "tha", "DDA": "da", "DDHA": "dha", "NNA": "na", "NGA": "nga", "NYA": "nya", "SSA": "sha", "LLA": "la", "RRA": "ra", "LLLA": "la", "NNNA": "na", "CA": "cha", "CHA": "chha", "VA": "va", "JHA": "jha", "RRRA": "ra"}
_VOWELS = {"AA": "a", "II": "i", "UU": "u", "EE": "e", "OO": "o", "AI": "ai", "AU": "au", "A": "a", "I": "i", "U": "u", "E": "e", "O": "o", "VOCALIC R": "ri", "CANDRA E": "e", "CANDRA O": "o", "SHORT E": "e", "SHORT O": "o"}


@lru_cache(maxsize=4096)
def _part(ch: str) -> tuple[str, str]:
    """(kind, sound): consonant, vowel, sign, virama, nasal, nukta or other."""
    name = unicodedata.name(ch, "")
    head, _, rest = name.partition(" ")
    if head not in ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM"):
        return "other", ch
    if rest == "SIGN VIRAMA":
        return "virama", ""
    if rest in ("SIGN ANUSVARA", "SIGN CANDRABINDU"):
        return "nasal", "n"
    if rest == "SIGN NUKTA":
        return "nukta", ""
    if rest == "SIGN VISARGA":
        return "sign", "h"
    if rest.startswith("VOWEL SIGN "):
        return "vowelsign", _VOWELS.get(rest[11:], rest[11:].lower())
    if rest.startswith("LETTER "):
        letter = rest[7:]
        if letter in _VOWELS:
            return "vowel", _VOWELS[letter]
        return "consonant", _SOUNDS.get(letter, letter.lower())[:-1] if letter.endswith("A") else letter.lower()
    if rest.startswith("DIGIT "):
        return "other", str(unicodedata.digit(ch, 0))
    return "other", ""


def romanise(text: str) -> str:
    """The text with Indic letters in Latin; other characters stay."""
    if text.isascii():
        return text
    out: list[str] = []
    open_consonant = False
    for ch in text:
        if ch in "‌‍":
            continue
        kind, sound = _part(ch)
        if kind == "consonant":
            if open_consonant:
                out.append("a")
            out.append(sound)
            open_consonant = True
        elif kind in ("vowelsign", "virama"):
            out.append(sound)
            open_consonant = False
        elif kind == "nukta":
            continue
        else:
            # a consonant at a word's end keeps no vowel
            if open_consonant and kind in ("vowel", "nasal", "sign"):
                out.append("a")
            out.append(sound)
            open_consonant = False
    return "".join(out)

"""Scalar text functions as column expressions; Python runs only where Spark has no builtin (NFKD, dominant script)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# First and last code points of the scripts told apart, as blocks of the Unicode standard. Kana lie inside the wide CJK range and count as CJK.
SCRIPT_RANGES = {
    "LATIN": ((0x0041, 0x005A), (0x0061, 0x007A), (0x00C0, 0x024F), (0x1E00, 0x1EFF)),
    "DEVANAGARI": ((0x0900, 0x097F),),
    "BENGALI": ((0x0980, 0x09FF),),
    "GURMUKHI": ((0x0A00, 0x0A7F),),
    "GUJARATI": ((0x0A80, 0x0AFF),),
    "ORIYA": ((0x0B00, 0x0B7F),),
    "TAMIL": ((0x0B80, 0x0BFF),),
    "TELUGU": ((0x0C00, 0x0C7F),),
    "KANNADA": ((0x0C80, 0x0CFF),),
    "MALAYALAM": ((0x0D00, 0x0D7F),),
    "SINHALA": ((0x0D80, 0x0DFF),),
    "THAI": ((0x0E00, 0x0E7F),),
    "LAO": ((0x0E80, 0x0EFF),),
    "TIBETAN": ((0x0F00, 0x0FFF),),
    "MYANMAR": ((0x1000, 0x109F),),
    "KHMER": ((0x1780, 0x17FF),),
    "HANGUL": ((0xAC00, 0xD7AF),),
    "GREEK": ((0x0370, 0x03FF),),
    "CYRILLIC": ((0x0400, 0x04FF),),
    "ARMENIAN": ((0x0530, 0x058F),),
    "HEBREW": ((0x0590, 0x05FF),),
    "ARABIC": ((0x0600, 0x06FF),),
    "SYRIAC": ((0x0700, 0x074F),),
    "THAANA": ((0x0780, 0x07BF),),
    "GEORGIAN": ((0x10A0, 0x10FF),),
    "ETHIOPIC": ((0x1200, 0x137F),),
    "CHEROKEE": ((0x13A0, 0x13FF),),
    "MONGOLIAN": ((0x1800, 0x18AF),),
    "TIFINAGH": ((0x2D30, 0x2D7F),),
    "CJK": ((0x2E80, 0x9FFF),),
    "FULLWIDTH": ((0xFF00, 0xFFEF),),
}


def clean_text(text: str | None) -> str:
    """Lower case, ``&`` as ``and``, compatibility decomposition without the marks behind ASCII letters, other signs as single spaces."""
    if not text:
        return ""
    out: list[str] = []
    for ch in unicodedata.normalize("NFKD", text.lower().replace("&", " and ")):
        if unicodedata.combining(ch):
            if out and out[-1].isascii():
                continue
            out.append(ch)
        else:
            out.append(ch if ch.isalnum() or unicodedata.category(ch)[0] == "M" else " ")
    return " ".join("".join(out).split())


def basic_clean(c: Column | str) -> Column:
    """``clean_text`` of a column; null gives the empty string."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(clean_text)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return pandas_udf(run, "string")(c)


@lru_cache(maxsize=1)
def latin_folds() -> tuple[str, str, dict[str, str]]:
    """(letters, their plain forms, letters that become several): accented Latin letters by decomposition."""
    single: dict[str, str] = {}
    several = {"ß": "ss", "æ": "ae", "œ": "oe", "ĳ": "ij"}
    for a, b in ((0x00C0, 0x024F), (0x1E00, 0x1EFF)):
        for n in range(a, b + 1):
            low = chr(n).lower()
            plain = "".join(x for x in unicodedata.normalize("NFKD", low) if not unicodedata.combining(x))
            if plain and plain.isascii() and plain.isalpha() and plain != low:
                if len(plain) == 1:
                    single[low] = plain
                else:
                    several[low] = plain
    single.update({"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i"})
    keys = sorted(k for k in single if len(k) == 1)
    return "".join(keys), "".join(single[k] for k in keys), {k: v for k, v in several.items() if len(k) == 1}


def fold_latin(c: Column | str) -> Column:
    """Lower case without accents on Latin letters; other scripts stay. Runs in the JVM: replacements of one letter by several, then translate."""
    col = F.lower(F.col(c) if isinstance(c, str) else c)
    many, plain, several = latin_folds()
    for letter, text in sorted(several.items()):
        col = F.replace(col, F.lit(letter), F.lit(text))
    return F.translate(col, many, plain)


def script_of_text(text: str | None) -> str:
    """EMPTY, OTHER, or the script of most letters; ties go to the script seen first."""
    if not text or not text.strip():
        return "EMPTY"
    count: dict[str, int] = {}
    for ch in text:
        n = ord(ch)
        for name, ranges in SCRIPT_RANGES.items():
            if any(a <= n <= b for a, b in ranges):
                count[name] = count.get(name, 0) + 1
                break
    return max(count, key=count.get) if count else "OTHER"


def dominant_script(c: Column | str) -> Column:
    """``script_of_text`` of a column. ASCII values are decided in the JVM: LATIN with a letter, else OTHER or EMPTY."""
    col = F.col(c) if isinstance(c, str) else c

    def run(s: pd.Series) -> pd.Series:
        return s.map(script_of_text)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    plain = F.when(F.coalesce(F.trim(col), F.lit("")) == "", "EMPTY").when(col.rlike("[A-Za-z]"), "LATIN").otherwise("OTHER")
    return F.when(is_ascii(F.coalesce(col, F.lit(""))), plain).otherwise(pandas_udf(run, "string")(col))


def _class(name: str) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SCRIPT_RANGES[name])


def non_latin_scripts(c: Column | str) -> Column:
    """Sorted array of the scripts other than Latin that a value holds."""
    col = F.col(c) if isinstance(c, str) else c
    found = F.array(*[F.when(col.rlike(f"[{_class(n)}]"), F.lit(n)) for n in SCRIPT_RANGES if n != "LATIN"])
    return F.array_sort(F.array_compact(found))


def is_ascii(c: Column | str) -> Column:
    """Whether a value holds ASCII characters only."""
    col = F.col(c) if isinstance(c, str) else c
    return ~col.rlike(r"[^\x00-\x7F]")


def last_postcode(c: Column | str) -> Column:
    """The last run of exactly five or six digits, "" if none."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?<!\d)\d{5,6}(?!\d)"), F.lit(0)), F.lit(-1)), F.lit(""))


def first_number(c: Column | str) -> Column:
    """The first run of digits, "" if none."""
    return F.regexp_extract(c, r"(\d+)", 1)


def drop_placeholders(c: Column | str) -> Column:
    """The value without null placeholders."""
    return F.trim(F.regexp_replace(c, r"(?i)<\s*null\s*>|\bnull\b|\bn/a\b", ""))


def name_tokens(c: Column | str) -> Column:
    """Pieces between white space of more than two characters that are not numbers."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda t: (F.length(t) > 2) & ~t.rlike(r"^\p{Nd}+$"))


def word_tokens(c: Column | str) -> Column:
    """Runs of letters, marks and digits of more than one character that are not numbers, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.rlike(r"^\p{Nd}+$"))


# Legal words that may stand first in a name.
LEGAL_FIRST = (
    "m/s s/s msme private pvt proprietorship partnership sasuru sarl eurl sas sasu sca scs snc sci gmbh incorporated corporation company limited plc pte pty llc inc ltd corp llp sp sa co lp ab as bv nv oy"
)
# Endings of web names that profiles look for.
DOMAIN_ENDS = "com|in|net|org|co|us|fr"
# Wordings of landmarks, by kind.
LANDMARKS = {
    "near": "near|nearby",
    "opposite": "opposite|opp",
    "behind": "behind",
    "beside": "beside|adjacent to|next to",
    "in_front": "in front of|front of",
    "across": "across from|across the street",
    "esquina": "esquina|vista|frente",
    "corner": "corner",
    "rear": "rear|back of|backside",
}
#: Landmark words of the address normaliser.
LANDMARK_WORDS = "near|nr|opp|opposite|behind|beside|next to|adjacent to|above|below"
#: What a word may not touch: letters, digits and the underscore.
_EDGE = r"[^\p{L}\p{N}_]"
_INVISIBLE = "[\u00ad\u200b-\u200f\u2060\ufeff]"


def _word(words: str) -> str:
    return rf"(?i)(^|{_EDGE})({words})({_EDGE}|$)"


def _capitals(col: Column) -> Column:
    """Whether every cased letter is a capital and there is one; letters of scripts without case don't count."""
    return col.rlike("[A-Z\u00C0-\u00D6\u00D8-\u00DE]") & ~col.rlike("[a-z]")


def noise_flags(c: str) -> dict[str, Column]:
    """Named conditions on a name column that profiles count."""
    col = F.col(c)
    return {
        "leading_junk": col.rlike(rf"^{_EDGE}"),
        "leading_digit": col.rlike(r"^\p{Nd}"),
        "domain": col.rlike(rf"(?i)(www\.|https?:|\.({DOMAIN_ENDS})({_EDGE}|$))"),
        "dba": col.rlike(_word("dba")) | col.rlike("(?i)trading as"),
        "single_token": ~col.rlike(r"\s"),
        "has_digit": col.rlike(r"\p{Nd}"),
        "upper": _capitals(col),
        "legal_first": col.rlike(rf"(?i)^{_EDGE}*({LEGAL_FIRST.replace(' ', '|')})({_EDGE}|$)"),
        "zero_width": col.rlike(_INVISIBLE),
    }


def landmark_flags(c: str) -> dict[str, Column]:
    """Named wordings of landmarks in an address column."""
    return {k: F.col(c).rlike(_word(words)) for k, words in LANDMARKS.items()}


def address_flags(c: str) -> dict[str, Column]:
    """Named conditions on an address column that profiles count."""
    col = F.col(c)
    return {
        "upper": _capitals(col),
        "starts_number": col.rlike(r"^\s*\p{Nd}"),
        "bis": col.rlike(_word("bis|ter|quater")),
        "placeholder": col.rlike(r"(?i)<\s*null\s*>") | col.rlike(_word("null|n/a")),
        "landmark": col.rlike(_word("|".join(LANDMARKS.values()))),
        "zero_width": col.rlike(_INVISIBLE),
    }


# Word forms of addresses and their short form; states and countries are no part of it.
ADDRESS_SHORT = {
    "street": "st", "str": "st", "road": "rd", "avenue": "ave", "av": "ave", "boulevard": "blvd", "lane": "ln", "drive": "dr", "court": "ct", "suite": "ste", "near": "nr", "opposite": "opp", "mount": "mt", "fort": "ft",
    "north": "n", "south": "s", "east": "e", "west": "w", "market": "mkt", "station": "stn", "cross": "crs", "nagar": "ngr", "marg": "mg", "colony": "col", "apartment": "apt",
}
LEGAL_FORMS = [("PVT_LTD", r"(pvt|private|p) (ltd|limited)"), ("LLC", r"(llc|l l c)"), ("LLP", r"llp"), ("LTD", r"(ltd|limited)"), ("INC", r"(inc|incorporated)"), ("CORP", r"(corp|corporation)"), ("SARL", r"(sarl|s a r l)"), ("GMBH", r"(gmbh|g m b h)"), ("EURL", r"eurl"), ("SAS", r"(sas|s a s)"), ("SA", r"(sa|s a)"), ("SL", r"(sl|s l)")]


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", " "), r"\s+", " "))


def normalise_name(c: Column | str) -> dict[str, Column]:
    """name_norm, name_core, legal_form, name_alts and name_phon of a name column."""
    raw = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    norm = _spaced(fold_latin(F.replace(raw, F.lit("&"), F.lit(" and "))))
    alts = F.filter(F.transform(F.split(fold_latin(raw), r"\b(?:dba|d/b/a|t/a|trading as|aka|f/k/a)\b"), _spaced), lambda x: x != "")
    form = F.lit("")
    core = norm
    for label, pattern in reversed(LEGAL_FORMS):
        hit = norm.rlike(rf"(^| )({pattern})( |$)")
        form = F.when(hit, label).otherwise(form)
    for _, pattern in LEGAL_FORMS:
        core = F.regexp_replace(core, rf"(^| )(?:{pattern})(?= |$)", " ")
    core = _spaced(core)
    phon = F.array_join(F.transform(F.split(core, " "), lambda w: F.soundex(w)), " ")
    return {"name_norm": norm, "name_core": core, "legal_form": form, "name_alts": F.when(F.size(alts) > 1, alts).otherwise(F.array().cast("array<string>")), "name_phon": phon}


def normalise_address(c: Column | str) -> dict[str, Column]:
    """addr_norm, addr_numbers, postcode, unit, is_landmark and landmark of an address column; words are mapped one by one, never by country."""
    raw = drop_placeholders(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    folded = fold_latin(raw)
    words = F.create_map(*[F.lit(x) for kv in ADDRESS_SHORT.items() for x in kv])
    norm = F.array_join(F.transform(F.split(_spaced(folded), " "), lambda t: F.coalesce(words[t], t)), " ")
    numbers = F.transform(F.regexp_extract_all(folded, F.lit(r"\d+(?:[/-]\d+)*"), F.lit(0)), lambda t: F.replace(t, F.lit("/"), F.lit("-")))
    landmark = F.regexp_extract(folded, rf"(?:^|[^\p{{L}}])((?:{LANDMARK_WORDS})\.? [^,;]+)", 1)
    unit = F.regexp_extract(folded, r"\b((?:ste|suite|unit|apt|flat|shop|floor|room) (?:no )?\w+)", 1)
    return {"addr_norm": norm, "addr_numbers": numbers, "postcode": last_postcode(folded), "unit": unit, "is_landmark": landmark != "", "landmark": landmark}

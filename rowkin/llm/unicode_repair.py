"""One consistent form for texts that look alike but differ in their characters.

Every character of a text is judged by its script and its place. Characters that are never seen, odd spaces, full-width and other
compatibility forms and detached accents have one repair each. Look-alike letters are repaired script-aware: the dominant script of
a token is determined, and only in tokens of mixed script are the intruders replaced, and only when the result is a word of the
corpus. A token wholly in one script stays as it is. Whether a token that is no word of the corpus (a misspelt one) was mixed by
look-alikes is asked of the vocabulary too: every three letters in a row of the result must stand in some of its words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.session import cut

# Letters that look like a Latin letter, by script.
LOOKS_LATIN = {
    "CYRILLIC": ("аеорсхуіјѕһԁԛԝкмтнгпАВСЕНІЈКМОРЅТХУԚԜЅ", "aeopcxyijshdqwkmthrnABCEHIJKMOPSTXYQWS"),
    "GREEK": ("αονρυικγωτβχΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "aovpuikywtbxABEZHIKMNOPTYXcj"),
    "ARMENIAN": ("օսհոցյզգՕՏՍԼ", "ouhngjqqOSUL"),
    "CHEROKEE": ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHYGhZbRWSVSLCPKdGB"),
}
# Latin letters that look like a plainer Latin letter and belong to no usual spelling of one.
LATIN_LIKE = ("ɑɡɩⱺ", "agio")
# Blocks of scripts that write marks and joiners inside words.
INDIC = ((0x0900, 0x0DFF), (0x1CD0, 0x1CFF), (0xA8E0, 0xA8FF), (0x0F00, 0x109F))
# Not format characters by class, yet never seen.
UNSEEN = "͏ᅟᅠ឴឵᠎ㅤﾠ"

TO_LATIN = {a: b for x, y in LOOKS_LATIN.values() for a, b in zip(x, y, strict=True)}
FROM_LATIN = {"CYRILLIC": dict(zip("aeopcxyijsABCEHIJKMOPSTXY", "аеорсхуіјѕАВСЕНІЈКМОРЅТХУ", strict=True)), "GREEK": dict(zip("ovABEZHIKMNOPTYX", "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", strict=True))}


def _indic(ch: str) -> bool:
    n = ord(ch)
    return any(a <= n <= b for a, b in INDIC)


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    """The script of a letter, "" for anything else."""
    if not ch.isalpha():
        return ""
    if ch < "ɐ":
        return "LATIN"
    head = unicodedata.name(ch, "?").split(" ")[0]
    return "LATIN" if ch in LATIN_LIKE[0] else head


@lru_cache(maxsize=1 << 16)
def _kind(ch: str) -> tuple[str, str]:
    """(kind, usual form): unseen, space, compat, mark, or plain."""
    n = ord(ch)
    if n < 0x80:
        return "plain", ch
    cat = unicodedata.category(ch)
    if ch in UNSEEN or (cat == "Cf" and ch not in "؀؁؂؃۝") or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF:
        return "unseen", ""
    if cat in ("Zs", "Zl", "Zp"):
        return "space", " "
    how = unicodedata.decomposition(ch)
    if how.startswith(("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")) and (cat[0] == "L" or cat in ("Nl", "Nd") or how.startswith(("<wide>", "<narrow>", "<font>"))):
        return "compat", unicodedata.normalize("NFKC", ch)
    if 0x0300 <= n <= 0x036F or 0x1AB0 <= n <= 0x1AFF or 0x1DC0 <= n <= 0x1DFF:
        return "mark", ch
    return "plain", ch


def clean_characters(text: str) -> tuple[str, int]:
    """The text with unseen characters, odd spaces, compatibility forms and detached accents in their usual form, and how many there were."""
    if text.isascii():
        return text, 0
    out: list[str] = []
    odd = marks = 0
    for i, ch in enumerate(text):
        kind, usual = _kind(ch)
        if kind == "plain":
            out.append(ch)
            continue
        if kind == "unseen" and ch in "‌‍" and i and _indic(text[i - 1]) and (unicodedata.combining(text[i - 1]) == 9 or unicodedata.combining(text[i + 1 : i + 2] or " ") == 9):
            out.append(ch)  # a joiner at the virama of an Indic word
            continue
        if kind == "mark":
            marks += 1
        odd += 1
        out.append(usual)
    fixed = "".join(out)
    if marks:
        fixed = unicodedata.normalize("NFC", fixed)
    return fixed, odd


def _runs(token: str) -> Iterator[tuple[int, int]]:
    """Ends of the runs of letters and marks in a token."""
    start = None
    for i, ch in enumerate(token):
        if ch.isalpha() or unicodedata.category(ch)[0] == "M":
            start = i if start is None else start
        elif start is not None:
            yield start, i
            start = None
    if start is not None:
        yield start, len(token)


def _replace(token: str, dominant: str) -> str | None:
    """The token with every letter of another script than the dominant one replaced by its look-alike; None if one has none."""
    out = []
    for ch in token:
        s = script(ch)
        if ch in LATIN_LIKE[0]:
            ch = LATIN_LIKE[1][LATIN_LIKE[0].index(ch)]
            s = "LATIN"
        if s in ("", dominant):
            out.append(ch)
        elif dominant == "LATIN" and ch in TO_LATIN:
            out.append(TO_LATIN[ch])
        elif s == "LATIN" and ch in FROM_LATIN.get(dominant, ()):
            out.append(FROM_LATIN[dominant][ch])
        else:
            return None
    return "".join(out)


def repair_token(token: str) -> tuple[str, bool]:
    """(the token in one script, whether its scripts were mixed by look-alikes).

    The dominant script is the one of most letters; where every letter foreign to Latin looks Latin, Latin is tried first when it holds
    at least a letter, since look-alikes can outnumber the letters they stand among. Runs of letters that are each wholly in one script
    and longer than two letters are words of their own and don't mix.
    """
    if token.isascii():
        return token, False
    pieces = [token[a:b] for a, b in _runs(token)]
    scripts = [{script(c) for c in p} - {""} for p in pieces]
    special = any(c in LATIN_LIKE[0] for c in token)
    everything = set().union(*scripts) if scripts else set()
    if not special and len(everything) < 2:
        return token, False
    if not special and all(len(s) < 2 for s in scripts) and not any(s != {"LATIN"} and len(p) <= 2 for p, s in zip(pieces, scripts, strict=True)):
        return token, False
    count: dict[str, int] = {}
    for ch in token:
        if s := script(ch):
            count[s] = count.get(s, 0) + 1
    order = sorted(count, key=lambda s: (-count[s], s))
    if "LATIN" in count:
        order = ["LATIN", *[s for s in order if s != "LATIN"]] if all(c in TO_LATIN for c in token if script(c) not in ("", "LATIN")) else order
    for dominant in order:
        fixed = _replace(token, dominant)
        if fixed is not None and fixed != token:
            return fixed, True
    return token, False


#: Result of the search in one value; ``words`` are the runs of letters that the repair changed, in lower case.
_FOUND = "odd_chars int, base string, mixed array<struct<token:string,fixed:string,words:array<string>>>"
_TOKEN = regex.compile(r"\S+")
#: What separates words of the vocabulary, and words of a token.
_BETWEEN = r"[^\p{L}\p{M}]+"
_BETWEEN_WORDS = regex.compile(_BETWEEN)


def _changed(token: str, fixed: str) -> list[str]:
    """The runs of letters of ``fixed`` that differ from ``token``'s; both have the same length."""
    out = []
    for a, b in _runs(fixed):
        if fixed[a:b] != token[a:b]:
            out += [w for w in _BETWEEN_WORDS.split(fixed[a:b].lower()) if w]
    return out


def _examine(texts: pd.Series) -> pd.DataFrame:
    odd, base, mixed = [], [], []
    for text in texts:
        fixed, n = clean_characters(text)
        odd.append(n)
        base.append(fixed)
        found = []
        if not fixed.isascii():
            for token in _TOKEN.findall(fixed):
                to, is_mixed = repair_token(token)
                if is_mixed:
                    found.append({"token": token, "fixed": to, "words": _changed(token, to)})
        mixed.append(found)
    return pd.DataFrame({"odd_chars": odd, "base": base, "mixed": mixed})


def _substitute(base: pd.Series, mixed: pd.Series, known: pd.Series) -> pd.Series:
    out = []
    for text, tokens, words in zip(base, mixed, known, strict=True):
        if tokens is not None and len(tokens) and words is not None and len(words):
            good = set(words)
            to = {t["token"]: t["fixed"] for t in tokens if all(w in good for w in t["words"])}
            text = _TOKEN.sub(lambda m, to=to: to.get(m.group(), m.group()), text)
        out.append(text)
    return pd.Series(out)


def _letters(word: Column) -> Column:
    """Every three letters in a row of a word with its ends marked."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word))), lambda i: F.substring(padded, i, 3))


def repair_values(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``(<keys>, field, value, repaired, odd_chars, mixed_tokens, likely_tokens, substituted_tokens)`` of every value holding a character beyond ASCII.

    ``odd_chars`` counts characters with a repair of their own, ``mixed_tokens`` the tokens of mixed script whose intruders all are
    look-alikes, ``substituted_tokens`` those of them whose repaired words are all words of the corpus (letters between other
    characters in values of ``fields``, compared in lower case); only these are replaced in ``repaired``. ``likely_tokens`` adds those whose
    repaired words are made of three-letter sequences of such words. Values in ASCII alone need no repair and give no row, nor do null and
    empty values. Rows keep their number: repeated deliveries give repeated rows.
    """
    from pyspark.sql.functions import pandas_udf

    keys, fields = list(keys), list(fields)
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("v")).select(*keys, "v.field", "v.value")
    beyond = long.filter(F.col("value").rlike(r"[^\x00-\x7F]"))
    examine = pandas_udf(_examine, _FOUND)
    substitute = pandas_udf(_substitute, "string")
    seen = cut(beyond.withColumn("f", examine("value")).select(*keys, "field", "value", "f.odd_chars", "f.base", "f.mixed"), "repair")

    # which repaired words are words of the corpus: the words wanted are few, the corpus is reduced to its distinct words first
    wanted = cut(seen.filter(F.size("mixed") > 0).select(F.explode("mixed").alias("m")).select(F.explode("m.words").alias("word")).distinct(), "wanted")
    words = long.select(F.explode(F.split(F.lower("value"), _BETWEEN)).alias("word")).filter("word <> ''").distinct()
    known = cut(wanted.join(words, "word", "left_semi"), "known")
    # which of the others are made of sequences of letters that words of the corpus hold
    parts = wanted.join(known, "word", "left_anti").select("word", F.explode(_letters(F.col("word"))).alias("three")).distinct()
    held = words.select(F.explode(_letters(F.col("word"))).alias("three")).join(parts.select("three").distinct(), "three", "left_semi").distinct()
    likely = parts.join(held.withColumn("held", F.lit(1)), "three", "left").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count("held").alias("n_held")).filter("n = n_held").select("word")
    marks = known.withColumn("sure", F.lit(True)).unionByName(likely.withColumn("sure", F.lit(False)))

    tokens = seen.filter(F.size("mixed") > 0).select("base", F.explode("mixed").alias("m")).select("base", F.explode("m.words").alias("word")).distinct()
    per_value = tokens.join(marks, "word").groupBy("base").agg(F.collect_set(F.when(F.col("sure"), F.col("word"))).alias("known"), F.collect_set("word").alias("likely"))
    empty = F.array().cast("array<string>")
    plain = seen.filter(F.size("mixed") == 0).withColumn("known", empty).withColumn("likely", empty)
    mixed = seen.filter(F.size("mixed") > 0).join(per_value, "base", "left").withColumn("known", F.coalesce("known", empty)).withColumn("likely", F.coalesce("likely", empty))
    cols = [*keys, "field", "value", "base", "odd_chars", "mixed", "known", "likely"]
    both = plain.select(*cols).unionByName(mixed.select(*cols))

    def n_in(name: str) -> Column:
        return F.size(F.filter("mixed", lambda m: F.forall(m["words"], lambda w: F.array_contains(name, w))))

    repaired = F.when(F.size("mixed") > 0, substitute("base", "mixed", "known")).otherwise(F.col("base"))
    return both.select(*keys, "field", "value", repaired.alias("repaired"), "odd_chars", F.size("mixed").alias("mixed_tokens"), n_in("likely").alias("likely_tokens"), n_in("known").alias("substituted_tokens"))


def odd_values(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``(<keys>, field)``, each once, of the values with a character that is not the usual one for what the reader sees, or that is not seen.

    A token of mixed script counts when the vocabulary supports its repaired form, as a word or by its sequences of letters.
    """
    found = repair_values(df, keys, fields).filter((F.col("odd_chars") > 0) | (F.col("likely_tokens") > 0))
    return found.select(*keys, "field").distinct()

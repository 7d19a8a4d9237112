"""String likeness: bit-parallel indel similarity and its token variants, Jaro-Winkler, normalised edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over one big integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=1 << 16)
def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * common subsequence / total length; 100 for two empty texts."""
    if not a and not b:
        return 100.0
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    """Ratio of the words in order of the alphabet."""
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """100 where one word set holds the other, else the best ratio among the common words and each side; 0 when a side has no word."""
    p, q = set(a.split()), set(b.split())
    if not p or not q:
        return 0.0
    both, left, right = sorted(p & q), sorted(p - q), sorted(q - p)
    if both and (not left or not right):
        return 100.0
    base, x, y = " ".join(both), " ".join(both + left), " ".join(both + right)
    best = indel_ratio(x, y)
    return max(best, indel_ratio(base, x), indel_ratio(base, y)) if both else best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against the windows of the longer, those hanging over its ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, best = len(short), 0.0
    for i in range(1 - n, len(long)):
        window = long[max(0, i) : i + n]
        if 200.0 * len(window) / (n + len(window)) > best:
            best = max(best, indel_ratio(short, window))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity with prefix weight 0.1 on at most four characters; 1 for equal texts."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(a)
    seen = []
    for j, c in enumerate(b):
        for i in range(max(0, j - reach), min(len(a), j + reach + 1)):
            if not taken[i] and a[i] == c:
                taken[i] = True
                seen.append(c)
                break
    if not seen:
        return 0.0
    m = len(seen)
    moved = sum(x != y for x, y in zip(seen, (c for c, t in zip(a, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


SCORERS = {"ratio": indel_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio, "jaro_winkler": jaro_winkler}


def similarity(scorer: str, a: Column | str, b: Column | str) -> Column:
    """A scorer of ``SCORERS`` over two columns, in Arrow batches; null counts as the empty text. Equal pairs of a task are scored once."""
    fn = SCORERS[scorer]

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple[str, str], float] = {}
        for x, y in parts:
            if len(known) > 1 << 17:
                known.clear()
            out = []
            for p, q in zip(x, y, strict=True):
                key = (p or "", q or "")
                score = known.get(key)
                if score is None:
                    score = known[key] = fn(*key)
                out.append(score)
            yield pd.Series(out, dtype="float64")

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return pandas_udf(run, "double")(a, b)


def normalised_edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance over the greater length, in the JVM; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)

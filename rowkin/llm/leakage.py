"""Evaluation items whose wording appears in documents, found by template canonicalisation.

Texts become words; words that few items hold are names, digits are numbers and measures are units, each replaced by a typed
placeholder. Windows of five places, the templates, are hash-joined between items and documents, which finds an item's wording also where
its names and numbers were exchanged. Slot consistency then parts the item itself from questions of the same template: where the values
standing in the placeholders agree, document and item are aligned word by word, and the share of the item that the document reproduces
in order is measured; where the template agrees over most of the item but the values don't, the question is a re-parameterised one.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm.plain_text import WORD, fold
from rowkin.session import cut

#: Places of a template window.
WINDOW = 5
#: A word in at least so many items, and in this share of them, is part of their common wording; others are names. The share bounds the
#: number of common words by 60 times the mean number of words of an item, however many items there are.
COMMON_ITEMS, COMMON_SHARE = 3, 1 / 60
#: A sentence in front of at least so many items is an instruction.
INSTRUCTION_ITEMS = 3
#: Share of an item's words that must be reproduced.
SHARE = 1 / 3
#: Share of an item's template windows that a re-parameterised copy has.
TEMPLATE_SHARE = 1 / 2
#: Bits of the filter that document windows pass before the join; its size does not depend on the items.
FILTER_BITS = 1 << 26
# Words for measures.
UNITS = frozenset(
    "second seconds minute minutes hour hours day days night nights evening evenings week weeks month months winter winters year years inch inches foot feet yard yards mile miles metre metres meter meters km cm gram grams kilo kilos "
    "kg pound pounds ounce ounces litre litres liter liters dollar dollars euro euros cent cents coin coins percent knots heure heures jour jours nuit nuits semaine semaines mois an ans hiver hivers stunde stunden tag tage tagen woche "
    "wochen monat monate jahr jahre winter abend abende hora horas dia dias noche noches semana semanas mes meses ano anos invierno inviernos".split()
)
SENTENCE = regex.compile(r"(?<=[.!?。])\s+|\n+")


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class WordCodes(dict):
    """(code of the word, code of its place in a template, whether the place is the word itself) of words, each hashed once."""

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.common = common

    def __missing__(self, word: str) -> tuple[int, int, bool]:
        kind = "<n>" if word.isdigit() else "<u>" if word in UNITS else word if word in self.common else "<p>"
        exact, typed = pd.util.hash_array(np.array([word, kind], dtype=object), categorize=False)
        if len(self) > 1 << 18:
            self.clear()
        self[word] = found = (int(exact), int(typed), kind[0] != "<")
        return found


def _keys(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes) - size + 1
    key = np.full(n, size, np.uint64) if size < WINDOW else np.zeros(n, np.uint64)
    mixed = codes ^ (codes >> np.uint64(29))
    with np.errstate(over="ignore"):
        for k in range(size):
            key += mixed[k : k + n] * _FACTORS[k]
    return key


def windows(tokens: list[str], codes: WordCodes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template keys, keys with the slots' values, whether the window has a slot) of each window of ``tokens``.

    A window of fewer than two common words has no template of its own; its key then is made of the words themselves, and so are the keys
    of windows shorter than WINDOW, which stand for items as short; these count as slots.
    """
    if len(tokens) < size:
        empty = np.zeros(0, np.uint64)
        return empty, empty, np.zeros(0, bool)
    exact, typed, literal = (np.array(c) for c in zip(*[codes[t] for t in tokens], strict=True))
    exact_key = _keys(exact.astype(np.uint64), size)
    if size < WINDOW:
        return exact_key, exact_key, np.ones(len(exact_key), bool)
    typed_key = _keys(typed.astype(np.uint64), size)
    count = np.concatenate([[0], np.cumsum(literal)])
    literals = count[size:] - count[:-size]
    return np.where(literals >= 2, typed_key, exact_key), exact_key, literals < size


def reproduced(item: list[str], doc: list[str], rare: set[str]) -> float:
    """The share of the item's words that ``doc`` holds in their order, in passages with the item's own slots.

    Agreeing blocks join into passages over up to three changed words, which then count as reproduced. Single agreeing words count only
    when they are names or numbers. A passage counts when at least half of its names and numbers agree, and one without any when it has
    eight words or the whole item: a passage of the template alone, with other values in its slots, reproduces nothing.
    """
    if not item:
        return 0.0
    if len(item) == 1:
        return float(item[0] in doc)
    kept = [(b.a, b.b, b.size) for b in SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks() if b.size >= 2 or b.size == 1 and item[b.a] in rare]
    total = 0
    passage: list[tuple[int, int, int]] = []

    def worth() -> int:
        if not passage:
            return 0
        start, stop = passage[0][0], passage[-1][0] + passage[-1][2]
        slots = sum(t in rare for t in item[start:stop])
        agreeing = sum(t in rare for a, _, n in passage for t in item[a : a + n])
        if slots == 0:
            return stop - start if stop - start >= min(8, len(item)) else 0
        return stop - start if 2 * agreeing >= slots else 0

    for block in kept:
        if passage and not (block[0] - passage[-1][0] - passage[-1][2] <= 3 and block[1] - passage[-1][1] - passage[-1][2] <= 4):
            total += worth()
            passage = []
        passage.append(block)
    return (total + worth()) / len(item)


def item_tables(items: DataFrame) -> tuple[DataFrame, frozenset[str]]:
    """(``item_id, body``: the words without instruction, joined by spaces; words common to several items).

    Items without words are dropped.
    """

    def sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                for k, s in enumerate(SENTENCE.split(text or "")):
                    if w := WORD.findall(fold(s)):
                        rows.append((item, k, " ".join(w)))
            yield pd.DataFrame(rows, columns=["item_id", "k", "s"])

    parts = cut(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna().mapInPandas(sentences, "item_id long, k int, s string"), "items")
    whole = parts.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("p"))
    texts = whole.groupBy("p").agg(F.min("item_id").alias("rep"))
    distinct = texts.select("rep", F.explode("p").alias("x")).select("rep", "x.k", "x.s")
    instruction = distinct.filter("k = 0").groupBy("s").agg(F.countDistinct("rep").alias("n")).filter(F.col("n") >= INSTRUCTION_ITEMS).select("s", F.lit(True).alias("is_instruction"))
    body = parts.join(instruction, "s", "left").filter(F.col("is_instruction").isNull() | (F.col("k") > 0))
    body = body.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("p")).select("item_id", F.array_join("p.s", " ").alias("body"))
    body = cut(body, "bodies")
    bodies = body.groupBy("body").agg(F.min("item_id").alias("rep"))
    spread = bodies.select("rep", F.explode(F.array_distinct(F.split("body", " "))).alias("w")).groupBy("w").count().filter(F.col("count") >= max(COMMON_ITEMS, bodies.count() * COMMON_SHARE))
    common = frozenset(r["w"] for r in spread.select("w").collect())
    return body, common


def key_filter(index: DataFrame) -> np.ndarray:
    """A bit per key of ``index`` (by its low bits), as words of 64 bits: at most FILTER_BITS / 64 rows come to the driver, whatever the index holds."""
    bit = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    packed = index.select(F.shiftright(bit, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for r in packed.collect():
        table[r["at"]] = r["bits"]
    return table.view(np.uint64)


def leaked_items(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``(doc_id, item_id, share, kind)``: documents with items that leak into them.

    Kind ``wording``: the document reproduces ``share`` of the item's text (without its instruction) or more, in order. Kind ``template``:
    it holds the item's templates, TEMPLATE_SHARE of them or more, with other values in their slots; ``share`` then is that of the templates.
    Items with the same text all count. Null, empty and wordless texts leak nothing; items without words are never leaked; items shorter
    than a window are found as a whole. Copies of a document are searched once and all reported. Texts are read whole. Other columns are
    not read.
    """
    spark = documents.sparkSession
    body, common = item_tables(items)
    held = spark.sparkContext.broadcast(common)

    def item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes(held.value)
        for pdf in batches:
            for rep, text in zip(pdf["rep"], pdf["body"], strict=True):
                tokens = text.split(" ")
                size = min(WINDOW, len(tokens))
                key, exact, slot = windows(tokens, codes, size)
                yield pd.DataFrame({"rep": rep, "key": key.view(np.int64), "exact": exact.view(np.int64), "slot": slot, "size": size})

    bodies = cut(body.groupBy("body").agg(F.min("item_id").alias("rep")), "bodies")
    index = cut(bodies.mapInPandas(item_windows, "rep long, key long, exact long, slot boolean, size int").distinct(), "index")
    sizes = sorted({WINDOW} | {r["size"] for r in index.select("size").distinct().collect()})
    passing = spark.sparkContext.broadcast(key_filter(index))

    def doc_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, table = WordCodes(held.value), passing.value
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                tokens = WORD.findall(fold(text))
                keys, exacts = [], []
                for size in sizes:
                    key, exact, _ = windows(tokens, codes, size)
                    bit = key & np.uint64(FILTER_BITS - 1)
                    good = (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    keys += key[good].view(np.int64).tolist()
                    exacts += exact[good].view(np.int64).tolist()
                if keys:
                    rows.append((doc, " ".join(tokens), keys, exacts))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "keys", "exacts"])

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).dropna()
    hits = cut(texts.mapInPandas(doc_windows, "doc_id long, words string, keys array<long>, exacts array<long>").withColumn("copy", F.sha2("words", 256)), "hits")
    reps = hits.groupBy("copy").agg(F.min("doc_id").alias("doc_id")).join(hits, ["copy", "doc_id"])
    pairs = reps.select("copy", F.explode(F.arrays_zip("keys", "exacts")).alias("z")).select("copy", F.col("z.keys").alias("key"), F.col("z.exacts").alias("exact")).distinct()
    met = pairs.join(index.withColumnRenamed("exact", "item_exact"), "key")
    # slot consistency: windows whose slots hold the item's own values; the rest is the template only
    consistent = F.count_if((F.col("exact") == F.col("item_exact")) & F.col("slot"))
    asked = index.groupBy("rep").agg(F.countDistinct("key").alias("n_keys"))
    candidates = met.groupBy("copy", "rep").agg(consistent.alias("n_consistent"), F.countDistinct("key").alias("n_template")).join(asked, "rep")
    candidates = cut(candidates.filter((F.col("n_consistent") >= 1) | (F.col("n_template") >= TEMPLATE_SHARE * F.col("n_keys"))), "candidates")
    aligned = candidates.filter("n_consistent >= 1").join(reps.select("copy", "words"), "copy").join(bodies, "rep")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for words, text in zip(pdf["words"], pdf["body"], strict=True):
                item = text.split(" ")
                out.append(reproduced(item, words.split(" "), {t for t in item if t.isdigit() or t not in held.value}))
            yield pd.DataFrame({"copy": pdf["copy"], "rep": pdf["rep"], "share": out})

    wording = cut(aligned.select("copy", "rep", "words", "body").mapInPandas(measure, "copy string, rep long, share double").filter(F.col("share") >= share), "wording")
    template = candidates.filter(F.col("n_template") >= TEMPLATE_SHARE * F.col("n_keys")).join(wording, ["copy", "rep"], "left_anti")
    leaks = wording.withColumn("kind", F.lit("wording")).unionByName(template.select("copy", "rep", (F.col("n_template") / F.col("n_keys")).alias("share"), F.lit("template").alias("kind")))
    return leaks.join(bodies, "rep").join(body, "body").join(hits.select("copy", "doc_id"), "copy").select("doc_id", "item_id", "share", "kind")

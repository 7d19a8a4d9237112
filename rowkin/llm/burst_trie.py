"""Occurrence and record counts of every term, by burst tries.

Each input split counts its terms in a compact trie: prefixes lead to containers of suffixes, and a container that grows too large
bursts into one container per next character. A finished trie is sent as subtrees, one row per container; rows are routed by
adaptive prefixes, i.e. prefixes are lengthened until none holds more than a small share of all terms, and the subtrees of one
route are merged into one trie.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkin.session import cut

#: A container of more suffixes bursts.
BURST = 256
#: Prefixes that lead to subtrees; longer terms keep their rest as suffix.
MAX_PREFIX = 4
#: A prefix that holds more than this share of the terms sent is lengthened by a character; so at most MAX_PREFIX / HEAVY prefixes are heavy.
HEAVY = 1 / 512
#: Terms with a heavy prefix of full length are spread over so many routes by a hash of the term.
SALTS = 64
#: A split's trie is sent off and begun anew beyond this many terms, which bounds a task's memory.
MAX_LOCAL_TERMS = 400_000


class BurstTrie:
    """Terms with two counters; inner nodes are dicts by character, containers are dicts by suffix."""

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.root: dict = {}
        self.leaf = {id(self.root)}
        self.size = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at = self.root, 0
        while id(node) not in self.leaf:
            head = term[at : at + 1]
            if head == "":
                counters = node.get("")
                if counters is None:
                    node[""] = [occurrences, records]
                    self.size += 1
                else:
                    counters[0] += occurrences
                    counters[1] += records
                return
            child = node.get(head)
            if child is None:
                child = node[head] = {}
                self.leaf.add(id(child))
            node, at = child, at + 1
        counters = node.get(term[at:])
        if counters is not None:
            counters[0] += occurrences
            counters[1] += records
            return
        node[term[at:]] = [occurrences, records]
        self.size += 1
        if len(node) > self.burst:
            self._burst(node)

    def _burst(self, node: dict) -> None:
        held = list(node.items())
        node.clear()
        self.leaf.discard(id(node))
        for suffix, counters in held:
            if suffix == "":
                node[""] = counters
                continue
            child = node.get(suffix[0])
            if child is None:
                child = node[suffix[0]] = {}
                self.leaf.add(id(child))
            child[suffix[1:]] = counters
        for head, child in list(node.items()):
            if head and len(child) > self.burst:
                self._burst(child)

    def items(self) -> Iterator[tuple[str, int, int]]:
        stack: list[tuple[str, dict]] = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if id(node) in self.leaf:
                for suffix, (occurrences, records) in node.items():
                    yield prefix + suffix, occurrences, records
            else:
                for head, child in node.items():
                    if head == "":
                        yield prefix, child[0], child[1]
                    else:
                        stack.append((prefix + head, child))

    def subtrees(self, depth: int) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """(prefix of at most ``depth`` characters, suffixes, occurrences, records) of every subtree cut off at ``depth``."""
        parts: dict[str, tuple[list, list, list]] = {}
        for term, occurrences, records in self.items():
            part = parts.setdefault(term[:depth], ([], [], []))
            part[0].append(term[depth:])
            part[1].append(occurrences)
            part[2].append(records)
        for prefix, part in parts.items():
            yield prefix, *part


def _batch_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of a batch with their occurrences and records; terms are the non-empty pieces between spaces."""
    lists = pc.split_pattern(texts, " ")
    flat = pc.list_flatten(lists)
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    code = flat.dictionary_encode()
    index = code.indices.to_numpy(zero_copy_only=False)
    width = len(code.dictionary)
    occurrences = np.bincount(index, minlength=width)
    once = np.unique(parent.astype(np.int64) * max(1, width) + index) % max(1, width)
    records = np.bincount(once, minlength=width)
    return code.dictionary, occurrences, records


_SUBTREES = T.StructType(
    [T.StructField("field", T.StringType()), T.StructField("prefix", T.StringType()), T.StructField("suffixes", T.ArrayType(T.StringType())), T.StructField("occ", T.ArrayType(T.LongType())), T.StructField("rec", T.ArrayType(T.LongType()))]
)
_COUNTS = "field string, term string, occurrences long, records long"


def term_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, term, occurrences, records)`` of every term of the string columns ``fields``; every row of ``df`` is one record.

    Null and empty texts have no terms; the empty string is never a term. An empty table gives no rows. Other columns are not read.
    """
    fields = list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {f: BurstTrie() for f in fields}

        def sent(field: str) -> pa.RecordBatch:
            rows = list(tries[field].subtrees(MAX_PREFIX))
            tries[field] = BurstTrie()
            return pa.RecordBatch.from_arrays(
                [pa.array([field] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                names=["field", "prefix", "suffixes", "occ", "rec"],
            )

        for batch in batches:
            for i, field in enumerate(fields):
                terms, occurrences, records = _batch_terms(batch.column(i))
                trie = tries[field]
                for term, o, r in zip(terms.to_pylist(), occurrences.tolist(), records.tolist(), strict=True):
                    if term:
                        trie.add(term, o, r)
                if trie.size > MAX_LOCAL_TERMS:
                    yield sent(field)
        for field in fields:
            if tries[field].size:
                yield sent(field)

    texts = df.select(*[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    parts = cut(texts.mapInArrow(count, _SUBTREES), "tries")

    # adaptive prefixes: bounded by 1 / HEAVY prefixes of each length and field
    sizes = parts.select("field", "prefix", F.size("suffixes").alias("n")).groupBy("field", "prefix").agg(F.sum("n").alias("n"))
    levels = sizes.filter(F.length("prefix") > 0).select("field", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("prefix")), lambda k: F.substring("prefix", F.lit(1), k))).alias("prefix"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    heavy = {(r["field"], r["prefix"]) for r in levels.groupBy("field", "prefix").agg(F.sum("n").alias("n")).filter(F.col("n") > HEAVY * total).collect()}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routes = []
            for field, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = 1
                while k < len(prefix) and (field, prefix[:k]) in heavy:
                    k += 1
                routes.append(prefix[:k] + ("*" if k == MAX_PREFIX and (field, prefix) in heavy else ""))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(routes, pa.string())], names=["field", "prefix", "suffixes", "occ", "rec", "route"])

    routed = parts.mapInArrow(merge, T.StructType([*_SUBTREES.fields, T.StructField("route", T.StringType())]))
    plain = routed.filter(~F.col("route").endswith("*")).withColumn("salt", F.lit(0))
    # a heavy prefix of full length: its subtrees are split by term
    pieces = routed.filter(F.col("route").endswith("*")).select("field", "prefix", "route", F.explode(F.arrays_zip("suffixes", "occ", "rec")).alias("t"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("t.suffixes"), F.lit(SALTS)).cast("int"))
    pieces = pieces.groupBy("field", "prefix", "route", "salt").agg(F.collect_list("t").alias("t"))
    pieces = pieces.select("field", "prefix", F.col("t.suffixes").alias("suffixes"), F.col("t.occ").alias("occ"), F.col("t.rec").alias("rec"), "route", "salt")

    def merged(key: tuple, part: pa.Table) -> pa.Table:
        trie = BurstTrie()
        for row in part.select(["prefix", "suffixes", "occ", "rec"]).to_pylist():
            for suffix, o, r in zip(row["suffixes"], row["occ"], row["rec"], strict=True):
                trie.add(row["prefix"] + suffix, o, r)
        items = list(trie.items())
        return pa.table([pa.array([key[0].as_py()] * len(items), pa.string()), pa.array([i[0] for i in items], pa.string()), pa.array([i[1] for i in items], pa.int64()), pa.array([i[2] for i in items], pa.int64())], names=["field", "term", "occurrences", "records"])

    return plain.unionByName(pieces).groupBy("field", "route", "salt").applyInArrow(merged, _COUNTS)


def latest_records(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per (split, entity_id) with ``fields``: the delivery loaded last; ties by the greater contents."""
    newest = records.groupBy("split", "entity_id").agg(F.max(F.struct("loaded_at", *fields)).alias("v"))
    return newest.select("split", "entity_id", *[F.col(f"v.{f}").alias(f) for f in fields])


def marked_terms(records: DataFrame, fields: Sequence[str] = ("name_core", "addr_norm"), common_share: float = 0.05) -> DataFrame:
    """``(field, term, occurrences, records, mark)``; repeated deliveries count once.

    ``mark`` is ``rare`` for a term held by exactly one record, ``common`` for one held by more than ``common_share`` of all records, else null.
    """
    kept = cut(latest_records(records, list(fields)), "records")
    n = kept.count()  # from the file footers
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") > common_share * n, "common")
    return term_counts(kept, fields).withColumn("mark", mark)

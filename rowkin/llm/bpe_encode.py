"""Encoding of texts with a public byte-level BPE vocabulary; merges are found with a segment tree.

The tree lies over the ranks of adjacent pairs; its root names the leftmost pair of lowest rank. A merge updates the merged place, its
left neighbour and the place that vanished, each in logarithmic time, until no mergeable pair remains. So a piece of n bytes costs
O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; never copied into the repository.
TOKENIZERS = os.environ.get("ROWKIN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pieces the vocabulary's pattern cuts a text into.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 40
#: Distinct pieces a worker remembers; beyond it the memory is begun anew, which changes no result.
MEMORY = 200_000


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks from the file's lines."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    width = 1 << max(1, (n - 1).bit_length())
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = ranks.get(piece[i : i + 2], NONE)
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a <= b else b

    def put(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            low = a if a <= b else b
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1

    while (low := tree[1]) != NONE:
        node = 1
        while node < width:
            node = 2 * node if tree[2 * node] == low else 2 * node + 1
        i = node - width
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        after[i] = k = after[j]
        put(j, NONE)
        if k < n:
            before[k] = i
            put(i, ranks.get(parts[i] + parts[k], NONE))
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            put(h, ranks.get(parts[h] + parts[i], NONE))
    return [ranks[p] for p in parts if p is not None]


def encode_text(text: str, ranks: dict[bytes, int], memory: dict[str, list[int]], pattern: regex.Pattern) -> list[int]:
    """The ids of a text; special strings are plain text."""
    out: list[int] = []
    for piece in pattern.findall(text):
        ids = memory.get(piece)
        if ids is None:
            if len(memory) >= MEMORY:
                memory.clear()
            ids = memory[piece] = encode_piece(piece.encode("utf-8", "surrogatepass"), ranks)
        out += ids
    return out


def encode_column(df: DataFrame, text_col: str, keep: list[str], vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``ids``, an array of the text's ids by the byte-level BPE file ``vocabulary`` in ``folder``.

    The empty text and null both give an empty array; texts are encoded whole. The vocabulary, a file of fixed size (under 1 MB), is read
    on the driver and broadcast. Columns besides ``keep`` and the text are dropped, so their names cannot clash.
    """
    with open(os.path.join(folder, vocabulary), "rb") as f:
        raw = f.read()
    held = df.sparkSession.sparkContext.broadcast(raw)
    state: dict = {}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.update(ranks=load_ranks(held.value), memory={}, pattern=regex.compile(PIECES))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lists = [encode_text(t, state["ranks"], state["memory"], state["pattern"]) if t else [] for t in texts]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*keep, "ids"])

    narrow = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(encode, f"{fields}, ids array<int>")

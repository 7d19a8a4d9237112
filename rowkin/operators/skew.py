"""Per-key results that do not depend on how rows are spread over keys.

Rows never move by key. Every input split is dictionary-encoded where it lies and its codes are counted into dense numpy arrays
(bincount for counts, scatter-add for sums); only the arrays move, cut into blocks by a hash of the key, and blocks of the same
number are added up. A key that holds a third of the table costs one array slot per split, like any other key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkin.session import shuffle_width

#: A split's dictionary is sent off in blocks and begun anew beyond this many keys, which bounds a task's memory.
MAX_LOCAL_KEYS = 500_000


class DenseAccumulator:
    """Dictionary of the keys seen so far and one dense array per measure."""

    def __init__(self, n_sums: int):
        self.keys: list[pa.Array] = []
        self.arrays: list[list[np.ndarray]] = []
        self.n_sums = n_sums
        self.size = 0

    def add(self, keys: pa.Array, sums: Sequence[np.ndarray]) -> None:
        """Rows as they come: one count each, and the sums."""
        code = keys.dictionary_encode(null_encoding="encode")
        index = code.indices.to_numpy(zero_copy_only=False)
        width = len(code.dictionary)
        arrays = [np.bincount(index, minlength=width)]
        for values in sums:
            out = np.zeros(width, dtype=np.int64)
            np.add.at(out, index, values)
            arrays.append(out)
        self.keys.append(code.dictionary)
        self.arrays.append(arrays)
        self.size += width

    def add_block(self, keys: pa.Array, arrays: Sequence[np.ndarray]) -> None:
        """Keys with their partial arrays."""
        self.keys.append(keys)
        self.arrays.append(list(arrays))
        self.size += len(keys)

    def merged(self) -> tuple[pa.Array, list[np.ndarray]]:
        """One dictionary and its arrays; parts are added by scatter-reduce."""
        keys = pa.chunked_array(self.keys, type=pa.string()).combine_chunks() if self.keys else pa.array([], pa.string())
        if isinstance(keys, pa.ChunkedArray):
            keys = pa.concat_arrays(keys.chunks) if keys.num_chunks else pa.array([], pa.string())
        code = keys.dictionary_encode(null_encoding="encode")
        index = code.indices.to_numpy(zero_copy_only=False)
        out = []
        for k in range(1 + self.n_sums):
            total = np.zeros(len(code.dictionary), dtype=np.int64)
            if len(index):
                np.add.at(total, index, np.concatenate([a[k] for a in self.arrays]))
            out.append(total)
        return code.dictionary, out


def dense_key_counts(df: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Rows ``(field, key_value, n_rows, <sums>)``: for each column of ``keys`` and each of its values the number of rows and the sums.

    ``sums`` are integer columns. Null keys form their own group with key_value null; null measures count as 0. An empty table gives
    no rows. Columns besides ``keys`` and ``sums`` are neither read nor touched, so their names may clash with the result's.
    """
    keys, sums = list(keys), list(sums)
    blocks = 4 * shuffle_width(df.sparkSession)
    n_sums = len(sums)
    sum_names = [f"s{i}" for i in range(n_sums)]
    block_schema = T.StructType(
        [T.StructField("field", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("keys", T.ArrayType(T.StringType()))]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in ["n", *sum_names]]
    )
    narrow = df.select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"s{i}") for i, c in enumerate(sums)])
    arrow_block = pa.schema([("field", pa.string()), ("block", pa.int32()), ("keys", pa.list_(pa.string()))] + [(c, pa.list_(pa.int64())) for c in ["n", *sum_names]])

    def blocks_of(field: str, acc: DenseAccumulator) -> pa.RecordBatch | None:
        values, arrays = acc.merged()
        if not len(values):
            return None
        at = (pd.util.hash_array(np.asarray(values.to_pandas().fillna("\0"), dtype=object), categorize=False) % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        number, start = np.unique(at[order], return_index=True)
        offsets = pa.array(np.append(start, len(order)), pa.int32())
        cols = [pa.array([field] * len(number)), pa.array(number, pa.int32()), pa.ListArray.from_arrays(offsets, values.take(pa.array(order)))]
        cols += [pa.ListArray.from_arrays(offsets, pa.array(a[order], pa.int64())) for a in arrays]
        return pa.RecordBatch.from_arrays(cols, schema=arrow_block)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {k: DenseAccumulator(n_sums) for k in keys}
        for batch in batches:
            measures = [batch.column(len(keys) + j).to_numpy(zero_copy_only=False) for j in range(n_sums)]
            for i, k in enumerate(keys):
                acc[k].add(batch.column(i), measures)
                if acc[k].size > MAX_LOCAL_KEYS:
                    values, arrays = acc[k].merged()
                    if len(values) > MAX_LOCAL_KEYS // 2:
                        if (out := blocks_of(k, acc[k])) is not None:
                            yield out
                        acc[k] = DenseAccumulator(n_sums)
                    else:
                        acc[k] = DenseAccumulator(n_sums)
                        acc[k].add_block(values, arrays)
        for k in keys:
            if (out := blocks_of(k, acc[k])) is not None:
                yield out

    out_schema = T.StructType([T.StructField("field", T.StringType()), T.StructField("key_value", T.StringType()), T.StructField("n_rows", T.LongType())] + [T.StructField(c, T.LongType()) for c in sum_names])
    arrow_out = pa.schema([("field", pa.string()), ("key_value", pa.string()), ("n_rows", pa.int64())] + [(c, pa.int64()) for c in sum_names])

    def add_up(key: tuple, part: pa.Table) -> pa.Table:
        acc = DenseAccumulator(n_sums)
        for row in range(part.num_rows):
            acc.add_block(part["keys"][row].values, [np.asarray(part[c][row].values) for c in ["n", *sum_names]])
        values, arrays = acc.merged()
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(values), pa.string()), values, *[pa.array(a, pa.int64()) for a in arrays]], schema=arrow_out)

    out = narrow.mapInArrow(encode, block_schema).groupBy("field", "block").applyInArrow(add_up, out_schema)
    return out.select("field", "key_value", "n_rows", *[F.col(f"s{i}").alias(c) for i, c in enumerate(sums)])


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01) -> DataFrame:
    """``(field, key_value)`` of the values that hold at least ``share`` of all rows; null and "" are no values."""
    total = df.count()  # from the file footers
    counts = dense_key_counts(df, keys)
    return counts.filter(F.col("key_value").isNotNull() & (F.col("key_value") != "") & (F.col("n_rows") >= share * total)).select("field", "key_value")

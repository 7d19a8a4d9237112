"""A sample that neither runs, partitions nor growth change: randomised block selection.

Ids carry persistent sequence numbers. Numbers are cut into fixed blocks, and a hash of the block number alone decides which positions
of the block are in the sample, whether or not they are filled yet. New records fill positions whose fate was settled before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions in a block (a power of two) and how many of them are chosen.
BLOCK = 64
CHOSEN = 8


def _word(block: Column, seed: str, k: int) -> Column:
    """An integer of 28 bits from the block's number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), block.cast("string"))), 1, 7), 16, 10).cast("long")


def block_sample(df: DataFrame, id_col: str, block: int = BLOCK, chosen: int = CHOSEN, seed: str = "rowkin") -> DataFrame:
    """``(<id_col>, seq, block_no, position)`` of the chosen ids, each once.

    The sequence number is the digits at the id's end (at most 15 of them); an id without digits gets a number from its md5. Within a
    block, three rounds of keyed multiply-add and shift permute the positions (a bijection, so exactly ``chosen`` of ``block`` positions
    are in); a position is chosen when its image is below ``chosen``. Null ids are never chosen; the empty id is treated like any other.
    Other columns are dropped, repeated ids count once.
    """
    if block & (block - 1) or not 0 <= chosen <= block:
        raise ValueError("block must be a power of two and chosen at most as large")
    ids = df.select(F.col(id_col).cast("string").alias("id")).filter(F.col("id").isNotNull()).distinct()
    tail = F.regexp_extract("id", r"([0-9]{1,15})$", 1)
    seq = F.when(tail != "", tail.cast("long")).otherwise(F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("long"))
    rows = ids.select("id", seq.alias("seq")).select("id", "seq", F.floor(F.col("seq") / block).cast("long").alias("block_no"), (F.col("seq") % block).cast("long").alias("position"))
    half = max(1, (block.bit_length() - 1) // 2)
    rows = rows.withColumns({f"w{k}": _word(F.col("block_no"), seed, k) for k in range(3)})
    image = F.col("position")
    for k in range(3):
        odd = F.col(f"w{k}") * 2 + 1
        image = (image * odd + F.floor(F.col(f"w{k}") / 4096).cast("long")) % block
        image = image.bitwiseXOR(F.floor(image / (1 << half)).cast("long"))
    return rows.filter(image < chosen).select(F.col("id").alias(id_col), "seq", "block_no", "position")

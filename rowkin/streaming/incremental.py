"""Candidates for records as they arrive: a streaming form of the key passes.

The batch operators need whole tables; the passes on equal keys do not. Each micro-batch of new pool records meets the stored records of
source 1 on their keys, and only the pairs it gives are appended. A batch number is written once, so a restarted stream repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rowkin.operators.blocking import addr_key, exact_name, union_passes


def batch_candidates(first: DataFrame, arrived: DataFrame) -> DataFrame:
    """Candidate pairs of a batch of pool records with the records of source 1."""
    both = first.filter("source = 1").unionByName(arrived.filter("source in (2, 3)"))
    return union_passes({"exact_name": exact_name(both), "addr_key": addr_key(both)})


def start_candidates(first: DataFrame, arriving: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream ``arriving`` (records of one split) and writes each batch's pairs below ``out`` under its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch_candidates(first, batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Scans and sinks of the pipeline's files."""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkin.operators.common import cumulative
from rowkin.session import scratch_dir

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def scan_tsv(spark: SparkSession, path: str, schema: T.StructType = RAW, check_rows: bool = False) -> DataFrame:
    """Tab-separated text without quoting, all columns text, empty fields as ""; with ``check_rows`` raises when rows and non-blank lines differ."""
    df = spark.read.csv(path, sep="\t", quote="", escape="", header=True, schema=schema, mode="FAILFAST", enforceSchema=False).fillna("")
    if check_rows:
        lines = spark.read.text(path).filter(F.trim("value") != "").count() - 1
        if (rows := df.count()) != lines:
            raise ValueError(f"{path}: {rows} rows from {lines} lines")
    return df


def scan_source(spark: SparkSession, folder: str, split: str, source: int) -> DataFrame:
    """One source file of a split."""
    return scan_tsv(spark, f"{folder}/{split}_source{source}.tsv")


def scan_union(parts: Iterable[tuple[str, int, DataFrame]]) -> DataFrame:
    """Source files under one another with their split and source."""
    tagged = [df.withColumn("split", F.lit(s)).withColumn("source", F.lit(n).cast("tinyint")) for s, n, df in parts]
    return reduce(DataFrame.unionByName, tagged)


def scan_all(spark: SparkSession, folder: str, splits: Sequence[str] = ("train", "test"), sources: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """All source files below ``folder``."""
    return scan_union((s, n, scan_source(spark, folder, s, n)) for s in splits for n in sources)


def parse_id_lists(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """``(s1_id, matches)``: comma lists as arrays of trimmed non-empty ids."""
    parts = F.transform(F.split(F.coalesce(F.col(list_col), F.lit("")), ","), lambda x: F.trim(x))
    return df.select(F.col(id_col).alias("s1_id"), F.filter(parts, lambda x: x != "").alias("matches"))


def scan_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth file as ``(s1_id, matches)``."""
    return parse_id_lists(scan_tsv(spark, path, TRUTH), "source1_entity_id", "matched_entity_ids")


def scan_by_ids(df: DataFrame, ids: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Rows of ``df`` whose id is in ``ids``; Spark broadcasts the ids only while they are under its own size limit."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that its scheme, or the session's default, names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def load_records(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The stage's record table if it was written, else the raw files with ``name_core`` as the name in lower case."""
    path = f"{folder}/records.parquet"
    if path_exists(spark, path):
        return spark.read.parquet(path).filter(F.col("split") == split)
    raw = scan_all(spark, folder, (split,))
    return raw.withColumn("name_core", F.lower("business_name")).withColumn("addr_norm", F.lower("business_address"))


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A stage's output as parquet; types stay as they are."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_vectors(df: DataFrame, path: str, part_col: str) -> list[str]:
    """Vectors as array columns, one folder per value of ``part_col``; parts that exist are kept, so a broken run goes on where it stopped.

    Returns the parts written.
    """
    done = []
    for (part,) in df.select(F.col(part_col).cast("string")).distinct().orderBy(part_col).collect():
        target = f"{path}/{part_col}={part}"
        if path_exists(df.sparkSession, f"{target}/_SUCCESS"):
            continue
        df.filter(F.col(part_col).cast("string") == part).drop(part_col).write.mode("overwrite").parquet(target)
        done.append(part)
    return done


def id_list_frame(universe: DataFrame, pairs: DataFrame, pool: DataFrame | None = None, order_col: str = "row_no", list_col: str = "matched_entity_ids") -> DataFrame:
    """``(<order_col>, source1_entity_id, <list_col>)``: one row per record of the universe, its ids without repeats in first order, "" for none.

    ``pairs`` has s1_id, cand_id and optionally ``pos``. With ``pool`` (entity_id), ids it doesn't hold raise.
    """
    if pool is not None and (bad := pairs.join(pool.select(F.col("entity_id").alias("cand_id")), "cand_id", "left_anti").limit(3).collect()):
        raise ValueError(f"ids not in the pool: {[r['cand_id'] for r in bad]}")
    pos = F.col("pos") if "pos" in pairs.columns else F.col("cand_id")
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), "cand_id"))), lambda x: x["cand_id"])), ",").alias(list_col))
    return universe.select("s1_id", order_col).join(lists, "s1_id", "left").select(order_col, F.col("s1_id").alias("source1_entity_id"), F.coalesce(list_col, F.lit("")).alias(list_col))


def write_id_lists(frame: DataFrame, path: str, order_col: str = "row_no") -> None:
    """The list file: a header and the rows in order, tabs between, one newline per row.

    Executors write the rows in ranges of their order; the parts are then joined byte by byte into the one file asked for, which no row
    passes through Python for.
    """
    spark = frame.sparkSession
    cols = [c for c in frame.columns if c != order_col]
    parts = f"{scratch_dir(spark)}/lists-{uuid.uuid4().hex}"
    frame.orderBy(order_col).select(F.concat_ws("\t", *cols).alias("line")).write.option("lineSep", "\n").text(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    there = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray("\t".join(cols) + "\n", "utf-8"))
        for name in sorted(s.getPath().getName() for s in there.listStatus(source)):
            if name.startswith("part-"):
                part = there.open(hadoop.fs.Path(source, name))
                hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
    finally:
        out.close()
        there.delete(source, True)


def validate_id_lists(spark: SparkSession, matches: str, candidates: str | None, universe: DataFrame, pool: DataFrame) -> list[str]:
    """Faults of a list file: rows missing, repeated or out of order, ids unknown, repeated or of a wrong prefix, matches outside the candidates."""
    faults: list[str] = []

    def read(path: str) -> DataFrame:
        head = spark.read.text(path).first()[0].split("\t")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
        return parse_id_lists(scan_tsv(spark, path, schema), head[0], head[1])

    m = read(matches)
    # the rows of the file by their place in it, and those of the universe by theirs, side by side
    place = F.shiftleft(F.col("_metadata.file_block_start"), 20) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(matches).select(place.alias("place"), F.substring_index("value", "\t", 1).alias("have")).filter("have <> ''")
    have = cumulative(lines.withColumn("one", F.lit(1)), "place", "one").select((F.col("upto") - 1).alias("no"), "have").filter("no > 0")
    want = cumulative(universe.select("row_no", "s1_id", F.lit(1).alias("one")), "row_no", "one").select(F.col("upto").alias("no"), "s1_id")
    if want.join(have, "no", "full").filter(~F.col("s1_id").eqNullSafe(F.col("have"))).limit(1).count():
        faults.append("rows missing, repeated or out of order")
    ids = m.select("s1_id", F.explode("matches").alias("cand_id"))
    if ids.groupBy("s1_id", "cand_id").count().filter("count > 1").limit(1).count():
        faults.append("ids repeated in a list")
    if ids.filter(~F.col("cand_id").rlike("^S[23]-")).limit(1).count():
        faults.append("ids of a wrong prefix")
    if ids.join(pool.select(F.col("entity_id").alias("cand_id")), "cand_id", "left_anti").limit(1).count():
        faults.append("ids not in the pool")
    if candidates is not None:
        c = read(candidates).select("s1_id", F.explode("matches").alias("cand_id"))
        if ids.join(c, ["s1_id", "cand_id"], "left_anti").limit(1).count():
            faults.append("matches outside the candidates")
    return faults


def append_log(path: str, row: dict) -> None:
    """One row to a CSV log; new columns widen the file."""
    new = pd.DataFrame([row])
    if os.path.exists(path):
        new = pd.concat([pd.read_csv(path, dtype=str, keep_default_na=False), new.astype(str)], ignore_index=True).fillna("")
    new.to_csv(path, index=False)


def save_json(path: str, value: dict) -> None:
    """Parameters or model data as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)


def load_json(path: str) -> dict:
    """A JSON object; anything else raises."""
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no object")
    return value


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table: numbers to the right, bars escaped."""
    pdf = df.limit(limit).toPandas()
    numeric = [pd.api.types.is_numeric_dtype(t) for t in pdf.dtypes]
    rows = ["| " + " | ".join(pdf.columns) + " |", "|" + "|".join("---:" if n else "---" for n in numeric) + "|"]
    rows += ["| " + " | ".join(str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in pdf.itertuples(index=False)]
    return "\n".join(rows) + "\n"


def package_zip(path: str, files: Sequence[str]) -> None:
    """Result files in one archive, by their own names."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, os.path.basename(f))

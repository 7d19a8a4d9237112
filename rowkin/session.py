"""Session, scratch space and table access shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_scratch: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cpus: str = "*", app: str = "rowkin", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the tests and the bench use; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a temporary folder of this process on a local master, and an error
    on a cluster, whose machines would each write into a folder of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master or ""
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_scratch:
        _own_scratch[key] = tempfile.mkdtemp(prefix="rowkin-")
        atexit.register(shutil.rmtree, _own_scratch[key], True)
    return _own_scratch[key]


def _forget_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete a scratch table when the application's JVM ends."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once into the shared scratch folder and read it back.

    The lineage ends at the written table, so a lost executor only re-reads files; results used twice are computed once. What was shuffled
    for the table is deleted as soon as it is written, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    _forget_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables as ``cut`` returned them. Only for tables that no other reads any more: what is made of them must be written itself."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """The number of reduce partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

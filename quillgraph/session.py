"""Session factory and small helpers shared by the whole library."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the library assumes: UTC, AQE and Arrow."""
    builder = (
        SparkSession.builder.master(master)
        .appName("quillgraph")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where the session names none."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written within leaves no shuffle files behind when it has ended; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def bound_batches(spark: SparkSession, most: str = "16m") -> None:
    """Bounds the bytes of an Arrow batch that goes to Python, where the session leaves them without a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "2147483647", "2147483647b"):
        spark.conf.set(key, most)


#: Rows that a task should hold at most when it sorts or groups them.
TASK_ROWS = 1 << 20


def dealt(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """rows dealt by keys to as many tasks as their number n asks for; what one task holds stays as it is. Without n they are counted, which a scan does from footers."""
    tasks = -(-(rows.count() if n is None else n) // TASK_ROWS)
    return rows if tasks <= 1 else rows.repartition(max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once to the folder that driver and executors share, and read back: cuts the lineage of loops."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

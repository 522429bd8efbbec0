"""Session settings the engine relies on, and where lineage may be cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hub relation can hold a large share of all foreign keys: split its
    # join partition even when that costs another shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows may be whole texts: batches for Python are bounded in rows and bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

#: A table is broadcast by its size up to so many bytes.
BROADCAST = 256 << 10


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    # A plan takes the bytes of a table's files for those of its rows. Stored
    # names and ids take some twentieth of that: 10 MB of files, Spark's own
    # threshold, are 200 MB in the driver, several of them at once. A lower
    # threshold, or none, is left as it is.
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST))
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cartulary")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


#: Rows of a table that every task may hold whole.
SMALL = 200_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, to be broadcast if it really has ``rows`` rows at most.

    Adaptive execution learns that a side is small only after it has shuffled
    the large one; so a side that is made by joins or grouping is counted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder.

    Used where several branches read the same expensive result. The folder is
    the one the cluster names in ``spark.checkpoint.dir``; only a session
    without it (a test) gets a temporary one. Columns are stored, which take a
    fraction of the rows that a checkpoint keeps as they are.
    """
    path = f"{shared_folder(df.sparkSession)}/cartulary/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of its own only in local mode, where all tasks see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cartulary-"))
    return named or context.getCheckpointDir()

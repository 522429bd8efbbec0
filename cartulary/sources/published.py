"""Keyed content that is written only where it changed, and logs that know their run.

A published folder holds data files of several versions, one manifest a
version (which key stands in which version, with the hash of its content), and
``heads``: one row a version, written last. Readers follow the newest head, so
a run that dies before that leaves the old version standing, and what it wrote
is never read. A task that runs again writes its own file again; Spark commits
one of them. There is one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_HEAD = "version long, name string"


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``; empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _head(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The newest version and its manifest."""
    row = _stored(spark, f"{path}/heads", _HEAD).agg(F.max("version"), F.max_by("name", "version")).first()
    return (row[0] or 0), row[1]


def _manifest(spark: SparkSession, path: str, name: str | None, key_schema) -> DataFrame:
    schema = [*key_schema, ("hash", "string"), ("stored_in", "string")]
    ddl = ", ".join(f"`{n}` {t}" for n, t in schema)
    return spark.createDataFrame([], ddl) if name is None else spark.read.schema(ddl).parquet(f"{path}/manifests/{name}")


def _keys(df: DataFrame, key: list[str]) -> list[tuple[str, str]]:
    return [(c, df.schema[c].dataType.simpleString()) for c in key]


def publish(rows: DataFrame, key: list[str], content: str, path: str) -> DataFrame:
    """Store ``rows`` so that ``path`` has exactly them; gives ``key, written, removed`` for each key, old or new.

    ``written`` is true where content is new or differs from what is stored;
    only that is written. Keys that are gone leave the manifest (``removed``).
    Where nothing differs no version is made and no file written. Keys are
    unique and not null; content is a string or null.
    """
    spark = rows.sparkSession
    version, name = _head(spark, path)
    before = _manifest(spark, path, name, _keys(rows, key)).select(*key, F.col("hash").alias("__hash"), F.col("stored_in").alias("__in"))
    name = uuid.uuid4().hex
    # Null and empty content differ.
    told = rows.select(*key, content, F.coalesce(F.sha2(content, 256), F.lit("null")).alias("hash"))
    joined = told.join(before, key, "full")
    plan = joined.select(*key, content, "hash", "__in", F.col("hash").isNull().alias("removed"), (F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("__hash"))).alias("written"))
    # The comparison is stored once: the data, the manifest and the answer come from the same rows.
    plan.select(*key, "hash", "__in", "removed", "written").write.parquet(f"{path}/plans/{name}")
    plan = spark.read.parquet(f"{path}/plans/{name}")
    answer = plan.select(*key, "written", "removed")
    if not plan.filter("written OR removed").limit(1).count():
        return answer
    new = rows.select(*key, content).join(plan.filter("written").select(*key), key, "left_semi")
    new.write.parquet(f"{path}/data/version={name}")
    kept = plan.filter("NOT removed").select(*key, "hash", F.when(F.col("written"), F.lit(name)).otherwise(F.col("__in")).alias("stored_in"))
    kept.write.parquet(f"{path}/manifests/{name}")
    spark.createDataFrame([(version + 1, name)], _HEAD).coalesce(1).write.mode("append").parquet(f"{path}/heads")
    return answer


def published(spark: SparkSession, key: list[tuple[str, str]], content: str, path: str) -> DataFrame:
    """``key, content`` of the newest version below ``path``. ``key``: names and types."""
    _, name = _head(spark, path)
    names = [c for c, _ in key]
    manifest = _manifest(spark, path, name, key)
    if name is None:
        return manifest.select(*names, F.lit(None).cast("string").alias(content))
    ddl = ", ".join(f"`{n}` {t}" for n, t in [*key, (content, "string"), ("version", "string")])
    stored = spark.read.schema(ddl).parquet(f"{path}/data").withColumnRenamed("version", "stored_in")
    return manifest.join(stored, [*names, "stored_in"]).select(*names, content)


def append_once(lines: DataFrame, path: str, run_id: str) -> None:
    """Lines of one run: written again under the same ``run_id`` they replace what an earlier try left."""
    if not run_id:
        raise ValueError("a run needs an id")
    dated = lines.withColumn("run_id", F.lit(run_id))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)

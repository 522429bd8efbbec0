"""What the operators share: landed tables, global row numbers, Arrow pieces of bounded size."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import shared_folder
from . import flat

#: White space of all word rules here, as text for translate().
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of text that a task looks at together; one longer text is a piece of its own.
PIECE = 2 << 20
#: Stands for a null key: it comes last.
NONE = (1 << 63) - 1
#: Bits of the map that tells which rows are looked at again.
SLOTS = 1 << 26


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """0-based position of each row in the whole order, with no task that sees all rows.

    ``by``: the first columns of ``order``, where they are enough to part the rows.

    Range partitions are sorted and landed; a row's number is its place in its
    partition plus the rows of earlier partitions. Only one count per partition
    meets in a window.
    """
    ranged = land(
        df.repartitionByRange(*(by or order)).sortWithinPartitions(*order).withColumn("__seq", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("__part", F.shiftright("__seq", 33))
    counts = ranged.groupBy("__part").agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return ranged.join(offsets, "__part").select(*df.columns, (F.col("__seq") - F.col("__first") + F.col("__before")).alias(name))


def identified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with ``__id``, a number for each row in the order of ``key`` (null last), and what key each number has.

    Where every key is there once, the number is the key itself, and there is
    no such table. Otherwise rows are numbered by key and a 64-bit hash of key
    and text; rows that agree in both are one document told twice and share a
    number.
    """
    several = docs.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter((F.col("__n") > 1) | F.col(key).isNull())
    if not several.limit(1).count():
        return docs.withColumn("__id", F.col(key).cast("long")), None
    own = F.xxhash64(F.col(key).isNull(), key, text)
    known = docs.select(own.alias("__self"), F.col(key).isNull().alias("__null"), F.col(key).alias("__key")).distinct()
    numbers = land(numbered(known, ["__null", "__key", "__self"], "__id"), "numbers")
    return docs.withColumn("__self", own).join(numbers.select("__self", "__id"), "__self").drop("__self"), numbers.select("__id", "__key")


def marked(rows: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """``rows`` with ``__maybe``: false only where ``key`` is not among ``members``.

    This lets most rows go their way without a shuffle. The members set bits of
    a map of ``SLOTS`` bits, in rows of 4 KB, which is the bound of what is
    broadcast; when many bits are set more rows say maybe, and a join on the
    key decides.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    bits = members.select(slot(member).alias("__slot")).groupBy(F.bitmap_bucket_number("__slot").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits"))
    asked = rows.withColumn("__slot", slot(key))
    met = asked.join(F.broadcast(bits), F.bitmap_bucket_number("__slot") == F.col("__bucket"), "left")
    at = F.bitmap_bit_position("__slot")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    return met.select(*rows.columns, F.coalesce(bit, F.lit(False)).alias("__maybe"))


def release() -> None:
    """Give the system back what this worker has freed: it is kept for tasks of one stage after the other."""
    flat.forget()
    pa.default_memory_pool().release_unused()
    # Only some C libraries keep freed memory and have a call for it.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts have ``limit`` bytes at most (one row at least)."""
    release()
    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if len(sizes) > start:
            yield batch.slice(start)
    release()


def texts(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The text column, null as empty."""
    return pa.compute.fill_null(batch.column(batch.schema.names.index(text)), "")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")

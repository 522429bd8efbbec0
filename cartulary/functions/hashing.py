"""Content hashes that need no ordered collection.

A value is encoded with its length in front, so null, empty and adjacent
strings never collide. A *set* of rows is hashed by adding up the rows' own
SHA-256 values in 28-bit lanes: the sums are ordinary aggregates, so Spark
combines them before the shuffle and a group of any size costs one row per
task. Rows whose order counts carry their position in the encoded content.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Nine lanes of seven hex digits: a bigint sum holds 2**35 rows.
LANES = 9
_DIGITS = 7


def encode(value: Column) -> Column:
    """Injective text form of a scalar; null differs from every string."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def encode_list(values: Column) -> Column:
    """Injective text form of an array of strings."""
    body = F.array_join(F.transform(values, encode), "")
    return F.coalesce(
        F.concat(F.lit("["), F.size(values).cast("string"), F.lit("]"), body), F.lit("~")
    )


def digest(*encoded: Column) -> Column:
    return F.sha2(F.concat(*encoded), 256)


def lane_sums(row_hash: Column, only: Column | None = None) -> list[Column]:
    """Aggregates ``n, lane_0 … lane_8`` of a set of row hashes."""
    chosen = row_hash if only is None else F.when(only, row_hash)
    sums = [F.count(chosen).alias("n")]
    for lane in range(LANES):
        part = F.conv(F.substring(chosen, 1 + lane * _DIGITS, _DIGITS), 16, 10).cast("bigint")
        sums.append(F.coalesce(F.sum(part), F.lit(0)).alias(f"lane_{lane}"))
    return sums


def lane_digest(within: str | None = None) -> Column:
    """Hash of the columns made by :func:`lane_sums`, or of those ``within`` a struct."""
    names = [name if within is None else f"{within}.{name}" for name in ["n"] + [f"lane_{lane}" for lane in range(LANES)]]
    return F.sha2(F.concat_ws(",", *[F.col(name).cast("string") for name in names]), 256)


# Hash of the empty set, for parents without children.
def empty_digest() -> Column:
    return F.sha2(F.lit(",".join(["0"] * (LANES + 1))), 256)

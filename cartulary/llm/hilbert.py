"""Shards along a Hilbert curve over document metadata (DataFrame operations only).

Each dimension becomes an order-preserving number, is quantised to equally
filled levels, and the levels are mapped to a place on the Hilbert curve. Rows
sorted by that place are cut into runs, so each shard covers a narrow range of
every dimension and a filter on any of them skips files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import numbered

BITS = 4
SHARDS = 16


def tag_places(rows: DataFrame, tag: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the place of the whole string ``tag`` among its distinct values; null and empty come first."""
    value = F.coalesce(F.col(tag), F.lit(""))
    places = numbered(rows.select(value.alias("__value")).distinct(), ["__value"], name)
    return rows.withColumn("__tag", value).join(places, F.col("__tag") == F.col("__value")).drop("__tag", "__value")


def borders(rows: DataFrame, dims: list[str], bits: int = BITS) -> dict[str, list[int]]:
    """Approximate quantiles of each dimension over all rows: 2**bits - 1 numbers each."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = rows.agg(*(F.percentile_approx(d, shares, 10_000).alias(d) for d in dims)).first()
    return {d: list(found[d] or []) for d in dims}


def _below(value: F.Column, limits: list[int]) -> F.Column:
    """How many of ``limits`` lie below ``value``."""
    return F.size(F.filter(F.array(*map(F.lit, limits)), lambda b: b < value))


def curve(rows: DataFrame, levels: list[str], bits: int, name: str) -> DataFrame:
    """``name``: the place of the levels (0 to 2**bits - 1 each) on the Hilbert curve.

    Skilling's transform: undo the rotations from the highest bit down, then
    Gray-encode and interleave. Every step is a projection of its own, so the
    expression stays linear in dimensions times bits.
    """
    n, axes = len(levels), [f"__x{i}" for i in range(len(levels))]
    out = rows.withColumns({a: F.col(d).cast("int") for a, d in zip(axes, levels)})
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        for i, axis in enumerate(axes):
            x, first, set_ = F.col(axis), F.col(axes[0]), F.col(axis).bitwiseAND(q) != 0
            swap = first.bitwiseXOR(x).bitwiseAND(q - 1)
            if i == 0:
                out = out.withColumn(axis, F.when(set_, x.bitwiseXOR(q - 1)).otherwise(x))
            else:
                out = out.withColumns({
                    axes[0]: F.when(set_, first.bitwiseXOR(q - 1)).otherwise(first.bitwiseXOR(swap)),
                    axis: F.when(set_, x).otherwise(x.bitwiseXOR(swap))})
    for before, axis in zip(axes, axes[1:]):
        out = out.withColumn(axis, F.col(axis).bitwiseXOR(F.col(before)))
    turn = F.lit(0)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        turn = turn.bitwiseXOR(F.when(F.col(axes[-1]).bitwiseAND(q) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
    out = out.withColumn("__turn", turn)
    place = F.lit(0).cast("long")
    for bit in range(bits):
        for i, axis in enumerate(axes):
            one = F.shiftright(F.col(axis).bitwiseXOR(F.col("__turn")), bit).bitwiseAND(1).cast("long")
            place = place + F.shiftleft(one, bit * n + n - 1 - i)
    return out.select(*rows.columns, place.alias(name))


def hilbert_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", tags: tuple[str, ...] = ("lang", "source"),
                   shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard, curve`` of each row.

    Dimensions: size in bytes, key, and the string columns ``tags``. Law
    ``rows``: shards differ by one row at most. Null texts have size 1, null
    tags come first, null keys sort first; rows that repeat a key are rows like
    others, ties in the curve go by key, size and checksum. An empty table
    gives an empty result; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("__key"), (F.octet_length(body) + 1).cast("long").alias("__size"), F.crc32(body.cast("binary")).alias("__crc"),
        F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("__d0"), *(F.col(t).alias(f"__t{i}") for i, t in enumerate(tags)))
    for i in range(len(tags)):
        rows = tag_places(rows, f"__t{i}", f"__d{i + 2}")
    rows = rows.withColumn("__d1", F.col("__size"))
    dims = [f"__d{i}" for i in range(len(tags) + 2)]
    found = borders(rows, dims, bits)
    if all(found.values()):
        placed = curve(rows.withColumns({d: _below(F.col(d), found[d]) for d in dims}), dims, bits, "__curve")
    else:  # only an empty table has no quantiles
        placed = rows.withColumn("__curve", F.lit(0).cast("long"))
    placed = placed.select("__key", "__size", "__crc", "__curve")
    ranked = numbered(placed, ["__curve", "__key", "__size", "__crc"], "__rank")
    n = max(ranked.count(), 1)
    shard = F.expr(f"__rank * {shards} div {n}")
    out = ranked.withColumn("__shard", shard.cast("int"))
    begin = F.expr(f"(__shard * {n}L + {shards - 1}) div {shards}")
    return out.select(
        F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"), (F.col("__rank") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("__curve").alias("curve"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", **options) -> None:
    """Write ``docs`` as one folder per shard, rows in curve order inside; keys must be unique."""
    plan = hilbert_shards(docs, key, **options).select(F.col(key).alias("__k"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    rows = docs.join(plan, F.col(key).eqNullSafe(F.col("__k"))).drop("__k")
    rows.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").drop("__slot").withColumnRenamed(
        "__shard", "shard_number").write.partitionBy("shard_number").parquet(path)

"""Exact duplicates by deterministic block naming (DataFrame operations only).

A text without its white space is cut into blocks of a fixed number of
characters. All distinct blocks are sorted, and a block's name is its place in
that order. Then adjacent names are paired, the distinct pairs are sorted and
numbered in the same way, and so on until one name is left for a document.
Names are places in a list of distinct things, so two documents have the same
last name exactly if their texts are the same; no hash decides.

Only texts that share length and hash with another text can be equal, so the
others need no name. Both sides of that test are small rows; hot groups are
combined before each shuffle and their join partitions are split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import BLANKS, land, numbered

BLOCK = 2048


def normalised(text: str = "text") -> F.Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A null-safe join that keeps the left columns and the new right ones."""
    renamed = right.select(*(F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, on, how).select(*left.columns, *([] if how == "left_semi" else [c for c in right.columns if c not in keys]))


def names(candidates: DataFrame, block: int = BLOCK) -> DataFrame:
    """``__doc, __len, __sig, __name``: one collision-free name for each distinct text of ``__norm``."""
    keys = ["__doc", "__len", "__sig"]
    last = F.greatest(F.lit(0), F.floor((F.col("__len") - 1) / block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("__norm"), i * block + 1, F.lit(block)))
    parts = candidates.select(*keys, F.posexplode(cut).alias("__at", "__block"))
    # Sorted by first characters, then by hash, then whole: only short values are sampled for the ranges.
    distinct = parts.select("__block").distinct().withColumns({"__head": F.substring("__block", 1, 16), "__mark": F.xxhash64("__block")})
    level = numbered(distinct, ["__head", "__mark", "__block"], "__name", by=["__head", "__mark"]).select("__block", "__name")
    rows = land(parts.join(level, "__block").select(*keys, "__at", "__name"), "names")
    longest = rows.agg(F.max("__at")).first()[0] or 0
    while longest > 0:
        even = F.col("__at") % 2 == 0
        # Rows that repeat a document agree, so max() only picks the one name.
        pairs = rows.groupBy(*keys, F.floor(F.col("__at") / 2).cast("int").alias("__at")).agg(
            F.max(F.when(even, F.col("__name"))).alias("__left"), F.coalesce(F.max(F.when(~even, F.col("__name"))), F.lit(-1)).alias("__right"))
        pairs = land(pairs, "pairs")
        level = numbered(pairs.select("__left", "__right").distinct(), ["__left", "__right"], "__name")
        rows = land(pairs.join(level, ["__left", "__right"]).select(*keys, "__at", "__name"), "names")
        longest //= 2
    return rows.select(*keys, "__name").distinct()


def _named(docs: DataFrame, key: str, text: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``__doc, __chars, __len, __sig, __sha, __name`` of the rows with a name, and of those that are equal to none."""
    rows = docs.select(F.col(key).alias("__doc"), normalised(text).alias("__norm"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("__chars"))
    rows = rows.withColumns({"__len": F.length("__norm"), "__sig": F.xxhash64("__norm")})
    small = land(rows.select("__doc", "__chars", "__len", "__sig", F.sha2("__norm", 256).alias("__sha")), "signatures")
    shared = small.groupBy("__len", "__sig").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__len", "__sig")
    candidates = rows.join(shared, ["__len", "__sig"], "left_semi").select("__doc", "__len", "__sig", "__norm")
    named = _same(small, names(candidates, block), ["__doc", "__len", "__sig"], "left")
    named = land(named, "identities")
    return named.filter(F.col("__name").isNotNull()), named.filter(F.col("__name").isNull())


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """For each row: ``key, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without white space; null is an empty text.
    Of equal texts the row with the most code points in its original text stays,
    then the one with the smallest key; a null key comes last and is a value
    like any other. Rows that repeat a key get the same answer, each counts in
    ``group_size``. An empty table gives an empty result; other columns are
    not read.
    """
    several, alone = _named(docs, key, text, block)
    order = F.struct((-F.col("__chars")).alias("c"), F.col("__doc").isNull().alias("n"), F.col("__doc").alias("d"))
    groups = several.groupBy("__name").agg(F.count(F.lit(1)).alias("__size"), F.min(order)["d"].alias("__keep"))
    # Documents without a name have no part in the join: their null keys would meet in one task.
    alone = alone.withColumns({"__size": F.lit(1).cast("long"), "__keep": F.col("__doc")})
    out = several.join(groups, "__name").unionByName(alone)
    return out.select(
        F.col("__doc").alias(key), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
        F.col("__doc").eqNullSafe(F.col("__keep")).alias("kept"), F.col("__sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of equal texts stays, with the columns of ``docs``.

    A row is known by its key and its text, so rows that share a key, or have
    none, are judged one by one and only go if their own text is told again.
    """
    order = F.struct((-F.col("__chars")).alias("c"), F.col("__doc").isNull().alias("n"), F.col("__doc").alias("d"))
    several, alone = _named(docs, key, text)
    best = several.groupBy("__name").agg(F.min(F.struct(order.alias("o"), F.col("__sha").alias("s"))).alias("b"))
    first = best.select(F.col("b.o.d").alias("__doc"), (-F.col("b.o.c")).alias("__chars"), F.col("b.s").alias("__sha"))
    kept = first.unionByName(alone.select("__doc", "__chars", "__sha")).select(_self("__doc", "__chars", "__sha").alias("__self")).distinct()
    told = docs.withColumn("__self", _self(key, F.length(F.coalesce(F.col(text), F.lit(""))), F.sha2(normalised(text), 256)))
    return told.join(kept, "__self", "left_semi").dropDuplicates(["__self"]).select(*docs.columns)


def _self(key: str, chars: str | F.Column, sha: str | F.Column) -> F.Column:
    """What tells a row from others: length, hash and key; a null key is no text."""
    return F.concat_ws(":", chars, sha, F.col(key).cast("string"))

"""Overview, literal search and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.idents import trim_all
from ..functions.text import clip, is_cut, prose
from ..keys import OVERVIEW_LIMIT, PAGE_DEFAULT, PAGE_MAX, RELATION
from ..operators import diff, rules
from ..operators.pages import column_notes, subjects
from ..operators.positions import number_within

Tables = dict[str, DataFrame]


def overview(tables: Tables, parsed_pages: DataFrame) -> DataFrame:
    """Active relations of one snapshot: kind, column and warning counts, short purpose.

    Empty values are null: no warnings, no purpose.
    """
    notes = column_notes(parsed_pages)
    valid = parsed_pages.filter("ok")
    subject = subjects(tables["hashes"], parsed_pages, tables["scopes"])
    broken = parsed_pages.filter(~F.col("ok")).select("catalog_id", "relation_id", F.lit(True).alias("broken"))
    # A relation is not called undocumented while its page cannot be read.
    rule = (
        rules.warnings(tables, valid, notes).join(broken, ["catalog_id", "relation_id"], "left")
        .filter(~((F.col("code") == "undocumented") & F.coalesce("broken", F.lit(False))))
        .select("catalog_id", "relation_id")
    )
    page = diff.page_warnings(subject).select("catalog_id", "relation_id")
    warned = rule.unionByName(page).groupBy("catalog_id", "relation_id").agg(F.count(F.lit(1)).alias("warnings"))
    sized = tables["columns"].groupBy(*RELATION).agg(F.count(F.lit(1)).alias("columns"))
    purpose = valid.select("catalog_id", "relation_id", prose(F.col("purpose")).alias("full"))
    return (
        tables["relations"].select(*RELATION, "kind")
        .join(sized, RELATION, "left").join(warned, ["catalog_id", "relation_id"], "left")
        .join(purpose, ["catalog_id", "relation_id"], "left")
        .select(*RELATION, "kind", F.coalesce("columns", F.lit(0)).alias("columns"), "warnings",
                clip(F.col("full"), OVERVIEW_LIMIT).alias("purpose"), is_cut(F.col("full"), OVERVIEW_LIMIT).alias("truncated"))
    )


def _texts(texts: list[str]) -> Column:
    if not texts or any(not text.strip() for text in texts):
        raise ValueError("search text must not be empty")
    return F.array(*[F.lower(trim_all(F.lit(text))) for text in texts])


def search(tables: Tables, texts: list[str]) -> DataFrame:
    """Relations matching each text, ranked: name, column name, then containment.

    The texts travel as a literal array inside the scan, so no join multiplies
    rows: a column row is expanded only by the texts it really contains.
    """
    wanted = _texts(texts)
    hits = lambda names: F.filter(wanted, lambda t: F.exists(names, lambda n: F.contains(n, t)))
    names = F.array(F.lower("name"), F.lower(F.concat("schema", F.lit("."), "name")), F.lower("relation_id"))
    by_name = (
        tables["relations"].withColumn("names", names).select(*RELATION, "names", F.explode(hits(F.col("names"))).alias("text"))
        .select(*RELATION, "text", F.when(F.array_contains("names", F.col("text")), 0).otherwise(2).alias("rank"),
                F.lit(None).cast("struct<ordinal: int, name: string>").alias("column"))
    )
    low = F.lower("name")
    by_column = (
        tables["columns"].select(*RELATION, "ordinal", "name", F.explode(hits(F.array(low))).alias("text"))
        .select(*RELATION, "text", F.when(low == F.col("text"), 1).otherwise(2).alias("rank"), F.struct("ordinal", "name").alias("column"))
    )
    # At most the columns of one relation per group.
    matched = F.transform(F.array_sort(F.collect_list("column")), lambda c: c["name"])
    return by_name.unionByName(by_column).groupBy(*RELATION, "text").agg(
        F.min("rank").alias("rank"), matched.alias("matched_columns"))


def page(df: DataFrame, order: list[str], limit: int = PAGE_DEFAULT, after: tuple | None = None) -> DataFrame:
    """One page of ``limit`` rows that follow the row with the order values ``after``.

    Keyset paging: page one thousand costs as much as page one, because only
    the first ``limit`` rows beyond the given key are ever kept.
    """
    if not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be from 1 to {PAGE_MAX}")
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, value in zip(order, after, strict=True):
            beyond = beyond | (equal & (F.col(name) > F.lit(value)))
            equal = equal & (F.col(name) == F.lit(value))
        df = df.filter(beyond)
    return df.orderBy(*order).limit(limit)


def pages_of(df: DataFrame, group: list[str], order: list[str], limit: int = PAGE_DEFAULT) -> DataFrame:
    """Every row with its page number, for all groups at once."""
    numbered = number_within(df, group, order)
    totals = numbered.groupBy(*group).agg(F.max("position").alias("total"))
    at = F.floor((F.col("position") - 1) / limit)
    return numbered.join(totals, group).withColumn("page", at.cast("int")).withColumn(
        "next_position", F.when((at + 1) * limit < F.col("total"), ((at + 1) * limit).cast("bigint")))

"""Repairs of stored notices from raw records: dates, awards and procurers. Each is a join, and idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp_date
from . import health

KEY = ["source", "source_id"]


def rederived_dates(notices: DataFrame, raw: DataFrame, now_year: int, field: str = "publication_date") -> DataFrame:
    """(source, source_id, before, after) of notices with an implausible date for which raw records (source, source_id,
    signed_on, effective_from, published_at) have a plausible one, taken in this order."""
    bad = health.implausible(notices, field).select(*KEY, F.col(field).alias("before"))
    found = F.coalesce(*[clamp_date(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"), now_year) for c in ("signed_on", "effective_from", "published_at")])
    return bad.join(raw.select(*KEY, found.alias("after")), KEY).where("after IS NOT NULL")


def with_repaired_dates(notices: DataFrame, repaired: DataFrame, field: str = "publication_date") -> DataFrame:
    """The table with these dates put in."""
    return notices.join(repaired.select(*KEY, F.col("after").alias("_after")), KEY, "left").withColumn(field, F.coalesce("_after", field)).drop("_after")


def years_to_backfill(notices: DataFrame, awards: DataFrame, source: str = "ted") -> DataFrame:
    """(year, first, after, n): the years in which a source has notices without an award, as half-open ranges to read,
    since a source gives out a limited number of rows a query."""
    open_ = notices.where((F.col("source") == source) & (F.col("notice_type") == "contract_award") & F.col("publication_date").isNotNull()).join(awards.select("notice_id"), "notice_id", "left_anti")
    by = open_.groupBy(F.year("publication_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("year", F.make_date("year", F.lit(1), F.lit(1)).alias("first"), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)).alias("after"), "n")


def spans_to_read(years: DataFrame) -> list[tuple]:
    """The ranges of `years_to_backfill`, one row a year, for a capped source, which halves those over its limit."""
    return [(r["first"], r["after"]) for r in years.select("first", "after").orderBy("first").collect()]


def refilled_procurers(notices: DataFrame, enriched: DataFrame) -> DataFrame:
    """Notices with an empty procurer's name take name and ICO from enriched records (source, source_id, procurer_ico,
    procurer_name), where these have a name."""
    new = enriched.where(F.coalesce(F.trim("procurer_name"), F.lit("")) != "").select(*KEY, F.col("procurer_ico").alias("_ico"), F.col("procurer_name").alias("_name"))
    empty = F.coalesce(F.trim("procurer_name"), F.lit("")) == ""
    joined = notices.join(new, KEY, "left")
    return joined.select(*[(F.when(empty & F.col("_name").isNotNull(), F.coalesce(x, c)).otherwise(F.col(c)).alias(c) if x else F.col(c)) for c in notices.columns for x in [{"procurer_ico": "_ico", "procurer_name": "_name"}.get(c)]])

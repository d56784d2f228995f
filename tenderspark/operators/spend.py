"""Dashboard read models: spend by year, month and category, top lists, year-over-year change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import col, cpv_label, cpv_prefix, date_expr, final_expr, money, value_expr, year_str
from ..functions.dealing import dealt

AWARD = "contract_award"


def awarded(notices: DataFrame) -> DataFrame:
    return notices.where(F.col("notice_type") == AWARD)


def with_supplier(notices: DataFrame, awards: DataFrame, ico: str) -> DataFrame:
    """Notices of which some award goes to a supplier: a semi-join, so a notice counts once."""
    return notices.join(awards.where(F.col("supplier_ico") == ico).select("notice_id"), "notice_id", "left_semi")


def of_entity(notices: DataFrame, awards: DataFrame | None, ico: str | None, role: str | None) -> DataFrame:
    if ico is None:
        return notices
    return with_supplier(notices, awards, ico) if role == "supplier" else notices.where(F.col("procurer_ico") == ico)


def spend_by_year(notices: DataFrame, awards: DataFrame | None = None, ico: str | None = None, role: str | None = None) -> DataFrame:
    rows = of_entity(awarded(notices), awards, ico, role)
    return rows.groupBy(year_str().alias("year")).agg(money(value_expr()).alias("total"), F.count(F.lit(1)).alias("n"))


def valid_years(by_year: DataFrame, first: int = 1993, last: int = 2100) -> DataFrame:
    return by_year.where(F.col("year").try_cast("int").between(first, last))


def cpv_breakdown(notices: DataFrame, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    rows = awarded(notices)
    y = year_str().try_cast("int")
    if first_year is not None:
        rows = rows.where(y >= first_year)
    if last_year is not None:
        rows = rows.where(y <= last_year)
    return rows.groupBy("cpv_code").agg(money(value_expr()).alias("total"), F.count(F.lit(1)).alias("n"))


def by_cpv_share(breakdown: DataFrame) -> DataFrame:
    """Categories by eight-digit prefix with label and share of the total; the groups, not the rows, meet in a window."""
    by = breakdown.groupBy(cpv_prefix().alias("cpv")).agg(money("total").alias("total"), F.sum("n").alias("n"))
    whole = by.agg(money("total").alias("whole"))
    # one row
    return by.crossJoin(F.broadcast(whole)).select("cpv", cpv_label(F.col("cpv")).alias("label"), "total", "n", F.when(F.col("whole") > 0, F.round(F.col("total") / F.col("whole") * 100, 1)).otherwise(0.0).alias("share_pct"))


def in_year(date: Column | str, year: int) -> Column:
    """A half-open range, which reaches the scan as a pushed filter."""
    return (col(date) >= F.lit(f"{year}-01-01").cast("date")) & (col(date) < F.lit(f"{year + 1}-01-01").cast("date"))


def monthly_buckets(notices: DataFrame, year: int) -> DataFrame:
    return awarded(notices).where(in_year(date_expr(), year)).groupBy(F.month(date_expr()).alias("month")).agg(money(value_expr()).alias("total"), F.count(F.lit(1)).alias("n"))


def monthly_filled(notices: DataFrame, year: int) -> DataFrame:
    months = notices.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(monthly_buckets(notices, year), "month", "left").select("month", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def summary_with_change(by_year: DataFrame) -> DataFrame:
    """One row: totals over all years, and the last valid year against the one before."""
    totals = by_year.agg(money("total").alias("total"), F.sum("n").alias("n"))
    w = Window.orderBy("year")  # one row a year
    last = valid_years(by_year).withColumns({"before": F.lag("total").over(w), "before_n": F.lag("n").over(w)}).groupBy().agg(*[F.max_by(c, "year").alias(c) for c in ("year", "total", "before", "n", "before_n")])
    last = last.select(F.col("year").alias("last_year"), F.col("total").alias("last_total"), F.col("before").alias("previous_total"), (F.col("n") - F.col("before_n")).alias("delta_n"), F.round(F.col("total") - F.col("before"), 2).alias("delta_total"), F.when(F.col("before") > 0, F.round((F.col("total") - F.col("before")) / F.col("before") * 100, 1)).alias("delta_pct"))
    return totals.select("total", "n", F.when(F.col("n") > 0, F.round(F.col("total") / F.col("n"), 2)).otherwise(0.0).alias("average")).crossJoin(last)


def wholly_identified(awards: DataFrame) -> DataFrame:
    """Awards of notices of which every award names its supplier's ICO. The awards are dealt by notice, so that what
    follows by notice needs no other shuffle; a window holds the awards of one notice."""
    least = F.min(F.coalesce("supplier_ico", F.lit(""))).over(Window.partitionBy("notice_id"))
    return dealt(awards, awards.count(), "notice_id").withColumn("_least", least).where("_least <> ''").drop("_least")


def top_suppliers(notices: DataFrame, awards: DataFrame, n: int | None = None, strict: bool = True) -> DataFrame:
    """Suppliers by the notices' final values, once an award. `strict`: a notice with any unnamed award is left out."""
    rows = wholly_identified(awards) if strict else awards.where(F.coalesce("supplier_ico", F.lit("")) != "")
    by = rows.join(notices.select("notice_id", final_expr().alias("v")), "notice_id").groupBy(F.col("supplier_ico").alias("ico")).agg(F.min("supplier_name").alias("name"), F.count(F.lit(1)).alias("n"), money("v").alias("total"))
    return by if n is None else by.orderBy(F.desc("total"), "ico").limit(n)


def top_procurers(notices: DataFrame, n: int | None = None) -> DataFrame:
    by = notices.where(F.coalesce("procurer_ico", F.lit("")) != "").groupBy(F.col("procurer_ico").alias("ico")).agg(F.min("procurer_name").alias("name"), F.count(F.lit(1)).alias("n"), money(final_expr()).alias("total"))
    return by if n is None else by.orderBy(F.desc("total"), "ico").limit(n)


def market_cpv(notices: DataFrame, n: int | None = None, exact: bool = True) -> DataFrame:
    """Categories with count, total and median of the final value; a null counts as 0."""
    middle = F.median("v") if exact else F.percentile_approx("v", 0.5, 10000)
    rows = notices.where(F.coalesce("cpv_code", F.lit("")) != "").select("cpv_code", final_expr().alias("v"))
    by = rows.groupBy("cpv_code").agg(F.count(F.lit(1)).alias("n"), money("v").alias("total"), middle.alias("median"))
    return by if n is None else by.orderBy(F.desc("n"), "cpv_code").limit(n)


def top_k_shares(rows: DataFrame, key: str, value: Column, k: int) -> DataFrame:
    """The largest groups with their share of the whole, in percent."""
    by = rows.groupBy(key).agg(money(value).alias("total"))
    return by.crossJoin(F.broadcast(by.agg(money("total").alias("whole")))).withColumn("share_pct", F.round(F.col("total") / F.col("whole") * 100, 2)).orderBy(F.desc("total"), key).limit(k).drop("whole")

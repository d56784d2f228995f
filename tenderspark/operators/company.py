"""Company read models: core statistics, partners, timelines, profiles, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cpv_prefix, final_expr, money, value_expr, year_str
from .spend import of_entity, top_procurers, wholly_identified, with_supplier


def roles_of(notices: DataFrame, awards: DataFrame, ico: str) -> DataFrame:
    """Notices in which a company is procurer or supplier, with both flags, from one pass over either table."""
    won = awards.where(F.col("supplier_ico") == ico).select("notice_id").distinct().withColumn("supplies", F.lit(True))
    joined = notices.join(won, "notice_id", "left").withColumns({"supplies": F.coalesce("supplies", F.lit(False)), "procures": F.coalesce(F.col("procurer_ico") == ico, F.lit(False))})
    return joined.where("supplies OR procures")


def core_stats_roles(notices: DataFrame, awards: DataFrame, ico: str) -> DataFrame:
    rows = roles_of(notices, awards, ico)

    def one(flag: str, role: str) -> list:
        return [F.struct(F.lit(role).alias("role"), F.count_if(flag).alias("n"), F.coalesce(money(F.when(F.col(flag), final_expr())), F.lit(0.0)).alias("total"), F.max(F.when(F.col(flag), F.col("award_date"))).alias("last_contract_at"))]

    return rows.agg(F.array(*one("supplies", "supplier"), *one("procures", "procurer")).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def core_stats_cpv(notices: DataFrame, awards: DataFrame, ico: str, k: int = 5) -> DataFrame:
    return roles_of(notices, awards, ico).groupBy("cpv_code").agg(F.count(F.lit(1)).alias("n"), money(final_expr()).alias("total")).orderBy(F.desc("total"), F.asc_nulls_first("cpv_code")).limit(k)


def core_stats_year(notices: DataFrame, awards: DataFrame, ico: str) -> DataFrame:
    return roles_of(notices, awards, ico).groupBy(year_str().alias("year")).agg(money(final_expr()).alias("total"), F.count(F.lit(1)).alias("n"))


def core_stats_facet(notices: DataFrame, awards: DataFrame, ico: str) -> DataFrame:
    """All groupings of the core statistics from one scan, as grouping sets."""
    rows = roles_of(notices, awards, ico).select("cpv_code", year_str().alias("year"), final_expr().alias("v"), "award_date")
    sets = rows.groupingSets([[], [F.col("cpv_code")], [F.col("year")]], F.col("cpv_code"), F.col("year"))
    return sets.agg(F.grouping("cpv_code").cast("int").alias("no_cpv"), F.grouping("year").cast("int").alias("no_year"), F.count(F.lit(1)).alias("n"), money("v").alias("total"), F.max("award_date").alias("last_contract_at"))


def partners(notices: DataFrame, awards: DataFrame, ico: str, role: str | None = None, sort_by: str = "value", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Counterparties of a company. As a supplier: procurers by notice, null included. As a procurer: suppliers by award,
    each with the notice's full value."""
    parts = []
    if role in (None, "supplier"):
        parts.append(with_supplier(notices, awards, ico).groupBy(F.col("procurer_ico").alias("ico")).agg(F.lit("procurer").alias("role"), F.min("procurer_name").alias("name"), F.count(F.lit(1)).alias("n"), money(final_expr()).alias("total")))
    if role in (None, "procurer"):
        bought = notices.where(F.col("procurer_ico") == ico).select("notice_id", final_expr().alias("v"))
        named = awards.where(F.coalesce("supplier_ico", F.lit("")) != "")
        parts.append(named.join(bought, "notice_id").groupBy(F.col("supplier_ico").alias("ico")).agg(F.lit("supplier").alias("role"), F.min("supplier_name").alias("name"), F.count(F.lit(1)).alias("n"), money("v").alias("total")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if limit is None:
        return out
    key = F.coalesce("total", F.lit(0.0)) if sort_by == "value" else F.col("n")
    return out.orderBy(key.desc(), F.asc_nulls_first("ico"), "role").offset(offset).limit(limit)


def award_timeline(notices: DataFrame, awards: DataFrame, ico: str) -> DataFrame:
    """Dated awards of both roles: what the company won, and what it gave (an award each)."""
    keep = ["notice_id", "cpv_code", value_expr().alias("v"), F.coalesce("award_date", "publication_date").alias("date"), "procurer_ico"]
    n = notices.select(*keep)
    won = with_supplier(n, awards, ico).select("notice_id", F.lit("supplier").alias("role"), F.col("procurer_ico").alias("counterparty"), "cpv_code", F.col("v").alias("value"), "date")
    gave = awards.where("supplier_ico IS NOT NULL").select("notice_id", "supplier_ico").join(n.where(F.col("procurer_ico") == ico), "notice_id").select("notice_id", F.lit("procurer").alias("role"), F.col("supplier_ico").alias("counterparty"), "cpv_code", F.col("v").alias("value"), "date")
    return won.unionByName(gave)


def entity_stats_procurers(notices: DataFrame) -> DataFrame:
    return top_procurers(notices.withColumn("procurer_name", F.lit(None).cast("string"))).select("ico", F.col("n").alias("contract_count"), F.col("total").alias("total_value"))


def entity_stats_suppliers(notices: DataFrame, awards: DataFrame) -> DataFrame:
    """Per supplier: notices, each once, in which every award is named."""
    pairs = wholly_identified(awards).select("notice_id", F.col("supplier_ico").alias("ico")).distinct()
    return pairs.join(notices.select("notice_id", final_expr().alias("v")), "notice_id").groupBy("ico").agg(F.count(F.lit(1)).alias("contract_count"), money("v").alias("total_value"))


def refresh_entity_stats(entities: DataFrame, stats: DataFrame) -> DataFrame:
    """Entities (ico, name, contract_count, total_value) with fresh statistics where there are some; idempotent."""
    fresh = stats.select("ico", F.col("contract_count").alias("_n"), F.col("total_value").alias("_v"))
    return entities.join(fresh, "ico", "left").withColumns({"contract_count": F.coalesce("_n", "contract_count"), "total_value": F.coalesce("_v", "total_value")}).drop("_n", "_v")


def entity_summary(notices: DataFrame, awards: DataFrame, ico: str, role: str) -> DataFrame:
    """One row: count, spend, average and the years of activity of a company in a role."""
    rows = of_entity(notices, awards, ico, role)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(money(value_expr()), F.lit(0.0)).alias("total"), F.round(F.coalesce(money(value_expr()), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("average"), F.array_join(F.sort_array(F.collect_set(year_str())), ",").alias("years_active"))


def counterparties(notices: DataFrame, awards: DataFrame, ico: str, role: str, k: int = 10) -> DataFrame:
    return partners(notices, awards, ico, role, "value", k)


def first_awards(awards: DataFrame) -> DataFrame:
    """(notice_id, supplier_ico, supplier_name) of each notice's first award."""
    first = awards.groupBy("notice_id").agg(F.min(F.struct("pos", "supplier_ico", "supplier_name")).alias("f"))
    return first.select("notice_id", "f.supplier_ico", "f.supplier_name")


def concentration(notices: DataFrame, awards: DataFrame) -> DataFrame:
    """(procurer_ico, supplier_ico, total, share_pct, hhi) for all procurers at once: shares of spend over the suppliers of
    notices' first awards, and the index from 0 to 10000."""
    by = notices.where("procurer_ico IS NOT NULL").select("notice_id", "procurer_ico", value_expr().alias("v")).join(first_awards(awards).where("supplier_ico IS NOT NULL"), "notice_id").groupBy("procurer_ico", "supplier_ico").agg(money("v").alias("total"))
    whole = by.groupBy("procurer_ico").agg(money("total").alias("whole"), F.sum(F.col("total") * F.col("total")).alias("squares"))
    return by.join(whole, "procurer_ico").select("procurer_ico", "supplier_ico", "total", F.when(F.col("whole") > 0, F.round(F.col("total") / F.col("whole") * 100, 2)).otherwise(0.0).alias("share_pct"), F.when(F.col("whole") > 0, F.round(F.col("squares") / (F.col("whole") * F.col("whole")) * 10000, 2)).otherwise(0.0).alias("hhi"))


def concentration_index(notices: DataFrame, awards: DataFrame) -> DataFrame:
    return concentration(notices, awards).groupBy("procurer_ico").agg(F.count(F.lit(1)).alias("suppliers"), F.max("hhi").alias("hhi"))


def concentration_top(notices: DataFrame, awards: DataFrame, ico: str, k: int = 5) -> DataFrame:
    own = notices.where(F.col("procurer_ico") == ico)
    return concentration(own, awards).select("supplier_ico", "total", "share_pct").orderBy(F.desc("total"), "supplier_ico").limit(k)


def cpv_hhi(notices: DataFrame) -> DataFrame:
    """Per procurer, the index from 0 to 1 over categories; totals that are not positive have no share."""
    by = notices.where("procurer_ico IS NOT NULL").groupBy("procurer_ico", "cpv_code").agg(money(final_expr()).alias("total")).withColumn("p", F.when(F.col("total") > 0, F.col("total")).otherwise(0.0))
    return by.groupBy("procurer_ico").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")).select("procurer_ico", F.when(F.col("s") > 0, F.round(F.col("q") / (F.col("s") * F.col("s")), 4)).otherwise(0.0).alias("hhi"))


def merge_companies(suppliers: DataFrame, procurers: DataFrame) -> DataFrame:
    """Full merge of (ico, name, n, total) of both roles, with accumulated figures and the primary role."""
    both = suppliers.select("ico", "name", F.col("n").alias("sn"), F.col("total").alias("st"), F.lit(0).cast("long").alias("pn"), F.lit(0.0).alias("pt"), F.lit(0).alias("rank")).unionByName(procurers.select("ico", "name", F.lit(0).cast("long").alias("sn"), F.lit(0.0).alias("st"), F.col("n").alias("pn"), F.col("total").alias("pt"), F.lit(1).alias("rank")))
    by = both.groupBy("ico").agg(F.min_by("name", "rank").alias("name"), F.sum("sn").alias("sn"), F.sum("pn").alias("pn"), money("st").alias("st"), money("pt").alias("pt"), F.array_join(F.transform(F.sort_array(F.collect_set("rank")), lambda r: F.when(r == 0, "supplier").otherwise("procurer")), ",").alias("roles"))
    return by.select("ico", "name", "roles", (F.col("sn") + F.col("pn")).alias("n"), F.round(F.col("st") + F.col("pt"), 2).alias("total"), primary_role(F.col("sn"), F.col("pn")).alias("primary_role"))


def primary_role(as_supplier, as_procurer):
    """The role with more notices; a supplier at a tie, none without any."""
    return F.when((as_supplier == 0) & (as_procurer == 0), None).when(as_supplier >= as_procurer, "supplier").otherwise("procurer")


def company_cpv_profile(notices: DataFrame, awards: DataFrame, ico: str) -> DataFrame:
    """Per category of a company: its share of the company's spend and the share in the market of the same categories."""
    own = roles_of(notices, awards, ico).groupBy(cpv_prefix().alias("cpv")).agg(money(final_expr()).alias("own"))
    market = notices.groupBy(cpv_prefix().alias("cpv")).agg(money(final_expr()).alias("market")).join(own.select("cpv"), "cpv", "left_semi")
    both = own.join(market, "cpv")
    whole = both.agg(money("own").alias("own_all"), money("market").alias("market_all"))
    return both.crossJoin(F.broadcast(whole)).select("cpv", "own", "market", F.round(F.col("own") / F.col("own_all") * 100, 1).alias("own_pct"), F.round(F.col("market") / F.col("market_all") * 100, 1).alias("market_pct"))


def company_profile(notices: DataFrame, awards: DataFrame, ico: str) -> DataFrame:
    """One row: both roles' counts and totals, roles and primary role."""
    s = core_stats_roles(notices, awards, ico)
    p = s.groupBy().agg(*[F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("supplier", "procurer") for c in ("n", "total")], F.max("last_contract_at").alias("last_contract_at"))
    return p.select(F.lit(ico).alias("ico"), "*", primary_role(F.col("supplier_n"), F.col("procurer_n")).alias("primary_role"))


def top_contracts(notices: DataFrame, awards: DataFrame, ico: str, k: int = 5) -> DataFrame:
    """The largest contracts by value over both roles."""
    rows = roles_of(notices, awards, ico).select("notice_id", "title", value_expr().alias("value"), "publication_date", F.when(F.col("supplies"), "supplier").otherwise("procurer").alias("role"))
    return rows.orderBy(F.desc("value"), "notice_id").limit(k)

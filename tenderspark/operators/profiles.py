"""Assembled answers: public profile, evidence of flags, lists of hits, the full health report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cpv_label, cpv_prefix, final_expr, money, value_expr, year_from_date, year_str
from . import health, risk
from .company import first_awards, partners, roles_of


def _part(rows: DataFrame, section: str, key: Column, label: Column, role: Column, n: Column, total: Column, share: Column) -> DataFrame:
    columns = {"key": (key, "string"), "label": (label, "string"), "role": (role, "string"), "n": (n, "long"), "total": (total, "double"), "share": (share, "double")}
    return rows.select(F.lit(section).alias("section"), *[c.cast(kind).alias(name) for name, (c, kind) in columns.items()])


def public_profile(notices: DataFrame, awards: DataFrame, ico: str, most_partners: int = 10, most_contracts: int = 5) -> DataFrame:
    """(section, key, label, role, n, total, share): a company's totals over both roles, spend by valid year, largest
    counterparties by role, categories with their share, their index, and largest contracts. The company's rows are few
    beside the tables and are found once for all sections but the partners."""
    rows, none = roles_of(notices, awards, ico), F.lit(None)
    name = awards.where(F.col("supplier_ico") == ico).agg(F.min("supplier_name").alias("as_supplier"))
    both = rows.agg(*[F.count_if(f).alias(f"{f}_n") for f in ("supplies", "procures")], *[F.coalesce(money(F.when(F.col(f), final_expr())), F.lit(0.0)).alias(f"{f}_total") for f in ("supplies", "procures")], F.min(F.when(F.col("procures"), F.col("procurer_name"))).alias("as_procurer"))
    summary = both.join(F.broadcast(name))  # one row with one row
    roles = F.array_join(F.array_compact(F.array(F.when(F.col("supplies_n") > 0, "supplier"), F.when(F.col("procures_n") > 0, "procurer"))), ",")
    out = _part(summary, "summary", F.lit(ico), F.coalesce("as_supplier", "as_procurer"), roles, F.col("supplies_n") + F.col("procures_n"), F.col("supplies_total") + F.col("procures_total"), none)
    years = rows.groupBy(year_str().alias("year")).agg(F.count(F.lit(1)).alias("n"), money(final_expr()).alias("total")).where(F.col("year").try_cast("int").between(1993, 2100))
    out = out.unionByName(_part(years, "year", F.col("year"), none, none, F.col("n"), F.col("total"), none))
    out = out.unionByName(_part(partners(notices, awards, ico, None, "value", most_partners), "partner", F.col("ico"), F.col("name"), F.col("role"), F.col("n"), F.col("total"), none))
    codes = rows.groupBy(cpv_prefix().alias("cpv")).agg(F.count(F.lit(1)).alias("n"), money(final_expr()).alias("total")).withColumn("p", F.greatest("total", F.lit(0.0)))
    whole = codes.agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))  # one row
    share = F.when(F.col("s") > 0, F.round(F.col("p") / F.col("s") * 100, 1)).otherwise(0.0)
    out = out.unionByName(_part(codes.join(F.broadcast(whole)), "cpv", F.col("cpv"), cpv_label(F.col("cpv")), none, F.col("n"), F.col("total"), share))
    out = out.unionByName(_part(whole, "index", F.lit(ico), none, none, none, F.when(F.col("s") > 0, F.round(F.col("q") / (F.col("s") * F.col("s")), 4)).otherwise(0.0), none))
    return out.unionByName(_part(top_contracts_with_partner(notices, awards, ico, most_contracts), "contract", F.col("notice_id"), F.col("title"), F.col("role"), none, F.col("value"), none))


def top_contracts_with_partner(notices: DataFrame, awards: DataFrame, ico: str, k: int = 5) -> DataFrame:
    """The largest contracts over both roles and the other side: the procurer, or the first award's supplier."""
    rows = roles_of(notices, awards, ico).select("notice_id", "title", value_expr().alias("value"), "supplies", "procurer_ico").orderBy(F.desc("value"), "notice_id").limit(k)
    first = first_awards(awards.join(F.broadcast(rows.select("notice_id")), "notice_id", "left_semi"))  # k notices
    both = rows.join(first, "notice_id", "left")
    return both.select("notice_id", "title", "value", F.when(F.col("supplies"), "supplier").otherwise("procurer").alias("role"), F.when(F.col("supplies"), F.col("procurer_ico")).otherwise(F.col("supplier_ico")).alias("counterparty"))


def partners_of_top_contracts(notices: DataFrame, awards: DataFrame, ico: str, contracts: int = 5, k: int = 5) -> DataFrame:
    top = top_contracts_with_partner(notices, awards, ico, contracts).where("counterparty IS NOT NULL")
    return top.groupBy(F.col("counterparty").alias("ico")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ico").limit(k)


def _text(c: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(c).cast(kind).cast("string"), F.lit(""))


#: What each flag rests on, in order: column and type of its text.
EVIDENCE = {
    "concentration": (("suppliers", "string"), ("value", "decimal(18,2)"), ("hhi", "decimal(9,4)"), ("top_share", "decimal(9,4)")),
    "pair": (("counterparties", "string"), ("value", "decimal(18,2)"), ("top", "string"), ("value_share", "decimal(9,4)"), ("count_share", "decimal(9,4)")),
    "market": (("multiple", "decimal(18,2)"), ("compared", "string")),
    "cluster": (("counterparty", "string"), ("burst", "string"), ("window_value", "decimal(18,2)"), ("first_day", "string"), ("last_day", "string"), ("division", "string")),
}


def risk_evidence(notices: DataFrame, awards: DataFrame) -> DataFrame:
    """(ico, flag, triggered, severity, score, evidence, disclaimer): all flags of all companies with the figures that
    each rests on, as a map of texts, and the notice that goes with them."""
    known, met = risk.materialised(notices, awards)
    rows = met.count()
    pairs = risk.pairs(met, rows)
    worst = risk.cluster_flag(met, rows, "window_value", "first_day", "last_day", "division")
    flags = {"concentration": risk.concentration_flag(pairs), "pair": risk.pair_flag(pairs), "market": risk.market_flag(known, met), "cluster": worst}
    out = None
    for name, df in flags.items():
        evidence = F.create_map(*[x for c, kind in EVIDENCE[name] for x in (F.lit(c), _text(c, kind))])
        one = df.select("ico", F.lit(name).alias("flag"), F.coalesce("triggered", F.lit(False)).alias("triggered"), "severity", "score", evidence.alias("evidence"), F.lit(risk.DISCLAIMER).alias("disclaimer"))
        out = one if out is None else out.unionByName(one)
    return out


def contract_hits(notices: DataFrame, now_year: int) -> DataFrame:
    """Contracts as hits, in which a value or year of 0 is none."""
    return notices.select("notice_id", F.coalesce("title", F.lit("")).alias("title"), F.nullif(F.col("procurer_name"), F.lit("")).alias("procurer_name"), F.nullif(value_expr(), F.lit(0.0)).alias("value"), F.nullif(year_from_date("publication_date", now_year), F.lit(0)).alias("year"))


def company_list(merged: DataFrame, role: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of merged companies (ico, roles, n, ...), those of a role alone, by contracts; ties by ICO."""
    rows = merged if role is None else merged.where(F.array_contains(F.split("roles", ","), role))
    return rows.orderBy(F.desc("n"), "ico").offset(offset).limit(limit)


def merge_by_rank(parts: list[DataFrame]) -> DataFrame:
    """Hits (ico, ...) of several searches without adding them up: of a company, those of the first search that has it."""
    ranked = None
    for rank, df in enumerate(parts):
        one = df.withColumn("_rank", F.lit(rank))
        ranked = one if ranked is None else ranked.unionByName(one)
    rest = [c for c in parts[0].columns if c != "ico"]
    return ranked.groupBy("ico").agg(F.min_by(F.struct(*rest), "_rank").alias("_h")).select("ico", "_h.*")


def recent_of_company(found: DataFrame, k: int = 10) -> DataFrame:
    """The newest of a company's contracts."""
    return found.orderBy(F.desc_nulls_last("publication_date"), "notice_id").limit(k)


def name_histogram(entities: DataFrame) -> DataFrame:
    """(ico, name, n) of ICOs under which several names stand."""
    by = entities.groupBy("ico", "name").agg(F.count(F.lit(1)).alias("n"))
    return by.join(health.ico_collisions(by).select("ico"), "ico", "left_semi")


def health_report(notices: DataFrame, registry: DataFrame, sizes: DataFrame, now: Column, sources: tuple[str, ...]) -> DataFrame:
    """Every source with its notices, registry entries and bytes; sources without any too. The inputs are one row a
    source once they are aggregated."""
    report = health.health_by_source(notices, now, sources).join(health.registry_stats(registry), "source", "left").join(sizes, "source", "left")
    return report.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("entries", "skips", "bytes")})


def ordered_sources(status: DataFrame, by: str = "status") -> DataFrame:
    """Sources (source, status, age_seconds) with the worst first, or the oldest; without an age last."""
    rank = F.when(F.col("status") == "error", 0).when(F.col("status") == "warning", 1).otherwise(2)
    return status.orderBy(*([rank] if by == "status" else []), F.desc_nulls_last("age_seconds"), "source")


def report_text(report: DataFrame) -> DataFrame:
    """The health report as a line a source."""
    line = F.format_string("%-10s %10d notices, %6d in 24 h, last %s%s", "source", "notices", "last_24h", F.coalesce(F.col("last_ingested").cast("string"), F.lit("never")), F.when(F.col("stale"), " STALE").otherwise(""))
    return report.select("source", line.alias("line"))

"""Profiles, evidence, lists of hits, health report and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import CPV_LABELS
from ..operators import company, graph, health, profiles, repairs, risk, search, upsert
from ..sources.binding import award_rows, ico, notices, registry, table
from .registry import query
from .risk_queries import BURSTS, CONCENTRATION, MARKET, PAIR, PAIRS, TIMELINE
from .search_queries import SOURCE_ROWS, SOURCES
from .spend_queries import BOTH, FIRST, ICO, MERGED, P_PROCURER, P_SUPPLIER

PREFIX = "rpad(substr(coalesce(cpv_code, ''), 1, 8), 8, '0')"
LABEL = f"CASE cpv {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in CPV_LABELS.items())} ELSE cpv END"


@query(
    BOTH
    + f""", w AS (SELECT count(*) FILTER (supplies) AS s, count(*) FILTER (procures) AS p,
      coalesce(CAST(sum(fin) FILTER (supplies) AS DOUBLE), 0) + coalesce(CAST(sum(fin) FILTER (procures) AS DOUBLE), 0) AS total,
      min(procurer_name) FILTER (procures) AS as_procurer FROM r),
    partner AS (SELECT * FROM (SELECT * FROM ({P_SUPPLIER}) UNION ALL SELECT * FROM ({P_PROCURER})) ORDER BY coalesce(total, 0) DESC, ico NULLS FIRST, role LIMIT 10),
    code AS (SELECT {PREFIX} AS cpv, count(*) AS n, CAST(sum(fin) AS DOUBLE) AS total, greatest(CAST(sum(fin) AS DOUBLE), 0) AS p FROM r GROUP BY 1),
    whole AS (SELECT sum(p) AS s, sum(p * p) AS q FROM code),
    top AS (SELECT notice_id, title, coalesce(final_value, estimated_value, 0) AS value, CASE WHEN supplies THEN 'supplier' ELSE 'procurer' END AS role FROM r ORDER BY value DESC, notice_id LIMIT 5)
    SELECT 'summary' AS section, '{ICO}' AS key, coalesce((SELECT min(supplier_name) FROM a WHERE supplier_ico = '{ICO}'), as_procurer) AS label,
      concat_ws(',', CASE WHEN s > 0 THEN 'supplier' END, CASE WHEN p > 0 THEN 'procurer' END) AS role, s + p AS n, total, CAST(NULL AS DOUBLE) AS share FROM w
    UNION ALL SELECT 'year', year, NULL, NULL, count(*), CAST(sum(fin) AS DOUBLE), NULL FROM r WHERE CAST(year AS INTEGER) BETWEEN 1993 AND 2100 GROUP BY year
    UNION ALL SELECT 'partner', ico, name, role, n, total, NULL FROM partner
    UNION ALL SELECT 'cpv', cpv, {LABEL}, NULL, n, total, CASE WHEN s > 0 THEN round(p / s * 100, 1) ELSE 0 END FROM code, whole
    UNION ALL SELECT 'index', '{ICO}', NULL, NULL, NULL, CASE WHEN s > 0 THEN round(q / (s * s), 4) ELSE 0 END, NULL FROM whole
    UNION ALL SELECT 'contract', CAST(notice_id AS VARCHAR), title, role, NULL, value, NULL FROM top"""
)
def public_profile(spark, sf_dir):
    return profiles.public_profile(notices(spark, sf_dir, cpv=True, names=True), award_rows(spark, sf_dir), ICO)


@query(
    FIRST
    + BOTH
    + """, top AS (SELECT notice_id, coalesce(final_value, estimated_value, 0) AS value, supplies, procurer_ico FROM r ORDER BY value DESC, notice_id LIMIT 5),
    x AS (SELECT CASE WHEN supplies THEN procurer_ico ELSE f.supplier_ico END AS ico FROM top LEFT JOIN f ON f.notice_id = top.notice_id)
    SELECT ico, count(*) AS n FROM x WHERE ico IS NOT NULL GROUP BY 1 ORDER BY n DESC, ico LIMIT 5"""
)
def partners_of_top_contracts(spark, sf_dir):
    return profiles.partners_of_top_contracts(notices(spark, sf_dir, cpv=True), award_rows(spark, sf_dir), ICO)


def _evidence(flag: str) -> str:
    parts = [f"'{c}=' || coalesce(CAST({c if kind == 'string' else f'CAST({c} AS {kind})'} AS VARCHAR), '')" for c, kind in profiles.EVIDENCE[flag]]
    return " || ';' || ".join(parts)


@query(
    PAIRS + CONCENTRATION + PAIR + MARKET + TIMELINE + BURSTS
    + ", cluster AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ico ORDER BY score DESC, counterparty DESC) AS rn FROM bursts) WHERE rn = 1) "
    + " UNION ALL ".join(f"SELECT ico, '{f}' AS flag, coalesce(triggered, false) AS triggered, severity, score, {_evidence(f)} AS evidence, '{risk.DISCLAIMER}' AS disclaimer FROM {f}" for f in profiles.EVIDENCE)
)
def risk_evidence(spark, sf_dir):
    rows = profiles.risk_evidence(notices(spark, sf_dir, cpv=True), award_rows(spark, sf_dir, False))
    return rows.withColumn("evidence", F.array_join(F.transform(F.map_entries("evidence"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";"))


@query("SELECT notice_id, title, procurer_name, nullif(coalesce(final_value, estimated_value, 0), 0) AS value, CAST(year(publication_date) AS INTEGER) AS year FROM n")
def contract_hits(spark, sf_dir):
    return profiles.contract_hits(notices(spark, sf_dir, cpv=True, names=True), 2026)


LISTED = MERGED + """, merged AS (SELECT coalesce(s.ico, p.ico) AS ico, coalesce(s.name, p.name) AS name, CASE WHEN s.ico IS NULL THEN 'procurer' WHEN p.ico IS NULL THEN 'supplier' ELSE 'supplier,procurer' END AS roles,
    coalesce(s.n, 0) + coalesce(p.n, 0) AS n FROM s FULL JOIN p ON s.ico = p.ico)"""


@query(LISTED + " SELECT * FROM merged WHERE roles <> 'supplier' ORDER BY n DESC, ico LIMIT 20 OFFSET 10")
def company_list_page(spark, sf_dir):
    n, a = notices(spark, sf_dir, names=True), award_rows(spark, sf_dir)
    merged = company.merge_companies(search.entity_table(n, a, "supplier"), search.entity_table(n, a, "procurer"))
    return profiles.company_list(merged, "procurer", 20, 10).select("ico", "name", "roles", "n")


@query(MERGED + " SELECT coalesce(s.ico, p.ico) AS ico, CASE WHEN s.ico IS NOT NULL THEN s.name ELSE p.name END AS name, CASE WHEN s.ico IS NOT NULL THEN s.n ELSE p.n END AS n FROM (SELECT * FROM s WHERE n % 2 = 0) s FULL JOIN p ON s.ico = p.ico")
def hit_merge_by_rank(spark, sf_dir):
    n, a = notices(spark, sf_dir, names=True), award_rows(spark, sf_dir)
    return profiles.merge_by_rank([search.entity_table(n, a, "supplier").where("n % 2 = 0").select("ico", "name", "n"), search.entity_table(n, a, "procurer").select("ico", "name", "n")])


@query(f"SELECT notice_id, publication_date FROM n WHERE notice_type = 'contract_award' AND notice_id IN (SELECT notice_id FROM a WHERE supplier_ico = '{ICO}') ORDER BY publication_date DESC, notice_id LIMIT 10")
def recent_of_supplier(spark, sf_dir):
    found = search.search_notices(notices(spark, sf_dir), supplier=ICO, awards=award_rows(spark, sf_dir, False))
    return profiles.recent_of_company(found).select("notice_id", "publication_date")


@query("SELECT lpad(CAST(c_nationkey AS VARCHAR), 8, '0') AS ico, c_mktsegment AS name, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1) GROUP BY 1, 2", bound=False)
def name_histogram(spark, sf_dir):
    return profiles.name_histogram(table(spark, sf_dir, "customer").select(ico("c_nationkey").alias("ico"), F.col("c_mktsegment").alias("name")))


@query("SELECT 'notice' AS kind, p_name AS label FROM (SELECT DISTINCT p_name FROM part) WHERE len(list_filter(string_split(lower(p_name), ' '), lambda t: (length(t) >= 3 AND levenshtein(substr(t, 1, 3), 'rimg') <= 1) OR (length(t) >= 4 AND levenshtein(substr(t, 1, 4), 'rimg') <= 1) OR (length(t) >= 5 AND levenshtein(substr(t, 1, 5), 'rimg') <= 1))) > 0 ORDER BY p_name LIMIT 20", bound=False)
def autocomplete_fuzzy(spark, sf_dir):
    return search.autocomplete({"notice": table(spark, sf_dir, "part").select(F.col("p_name").alias("label"))}, "Rímg", 20, edits=1)


SIZED = "json_object('source', source, 'source_id', source_id, 'notice_type', notice_type, 'status', status, 'published', CAST(publication_date AS VARCHAR))"


def _sizes(spark, sf_dir):
    return health.bytes_by_source(notices(spark, sf_dir).select("source", "source_id", "notice_type", "status", F.col("publication_date").cast("string").alias("published")))


@query(
    f""", t AS (SELECT max(ingested_at) AS now FROM n), b AS (SELECT source, count(*) AS notices, max(ingested_at) AS last_ingested, any_value(now) AS now FROM n, t GROUP BY 1),
    g AS (SELECT source, count(*) AS entries, sum(skipped_count) AS skips FROM reg GROUP BY 1), z AS (SELECT source, sum(strlen(CAST({SIZED} AS VARCHAR))) AS bytes FROM n GROUP BY 1)
    SELECT s.source, coalesce(notices, 0) AS notices, coalesce(floor(epoch(now - last_ingested) / 86400) > 14, true) AS stale, coalesce(entries, 0) AS entries, CAST(coalesce(skips, 0) AS BIGINT) AS skips, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes
    FROM {SOURCE_ROWS} LEFT JOIN b ON b.source = s.source LEFT JOIN g ON g.source = s.source LEFT JOIN z ON z.source = s.source"""
)
def health_report(spark, sf_dir):
    n = notices(spark, sf_dir)
    now = n.agg(F.max("ingested_at").cast("timestamp_ntz").alias("now")).scalar()
    return profiles.health_report(n, registry(spark, sf_dir), _sizes(spark, sf_dir), now, SOURCES).select("source", "notices", "stale", "entries", "skips", "bytes")


@query("SELECT source || '|' || source_id AS key, notice_type, cpv_code, estimated_value, publication_date, 'later' AS title, 'later' AS status, final_value + 1 AS final_value FROM n")
def graph_notice_properties(spark, sf_dir):
    n = notices(spark, sf_dir, cpv=True).withColumn("seq", F.lit(1))
    later = {"title": F.lit("later"), "notice_type": F.lit("later"), "cpv_code": F.lit("later"), "estimated_value": F.lit(0.0), "publication_date": F.lit("1900-01-01").cast("date"), "status": F.lit("later"), "final_value": F.col("final_value") + 1, "seq": F.lit(2)}
    nodes = graph.merge_notice_nodes(n.unionByName(n.withColumns(later)))
    return nodes.select(F.concat_ws("|", "source", "source_id").alias("key"), "notice_type", "cpv_code", "estimated_value", "publication_date", "title", "status", "final_value")


@query("SELECT count(*) FILTER (notice_id % 5 = 0) AS inserted, count(*) FILTER (notice_id % 5 <> 0 AND notice_id % 7 = 0) AS updated, count(*) FILTER (notice_id % 5 <> 0 AND notice_id % 7 <> 0) AS skipped, CAST((SELECT count(*) FROM events WHERE event_type = 'error') AS BIGINT) AS errors FROM n")
def upsert_report(spark, sf_dir):
    n = notices(spark, sf_dir).withColumn("content_hash", F.sha2("source_id", 256))
    changed = n.withColumn("content_hash", F.when(F.col("notice_id") % 7 == 0, F.lit("new")).otherwise(F.col("content_hash")))
    rejected = table(spark, sf_dir, "events").where("event_type = 'error'")
    return upsert.report(upsert.decide(changed, n.where("notice_id % 5 <> 0")), rejected)


REPAIRED = "CASE WHEN notice_id % 97 = 0 THEN DATE '2999-01-01' WHEN notice_id % 89 = 0 THEN NULL ELSE publication_date END"


def _broken(spark, sf_dir):
    k = F.col("notice_id")
    return notices(spark, sf_dir, names=True).withColumn("publication_date", F.when(k % 97 == 0, F.lit("2999-01-01").cast("date")).when(k % 89 != 0, F.col("publication_date")))


@query(f", x AS (SELECT *, {REPAIRED} AS p FROM n) SELECT source, source_id, CASE WHEN p IS NULL OR p < DATE '2000-01-01' OR p > DATE '2100-01-01' THEN coalesce(CASE WHEN notice_id % 2 = 0 THEN DATE '2019-05-06' END, DATE '2020-07-08') ELSE p END AS publication_date FROM x")
def date_repair(spark, sf_dir):
    broken = _broken(spark, sf_dir)
    signed = F.when(F.col("notice_id") % 2 == 0, "2019-05-06T10:00:00").otherwise("3202-01-01")
    raw = broken.select("source", "source_id", signed.alias("signed_on"), F.lit("not a date").alias("effective_from"), F.lit("2020-07-08").alias("published_at"))
    return repairs.with_repaired_dates(broken, repairs.rederived_dates(broken, raw, 2026)).select("source", "source_id", "publication_date")


@query(
    """, x AS (SELECT CAST(year(publication_date) AS INTEGER) AS year FROM n WHERE source = 'ted' AND notice_type = 'contract_award' AND notice_id % 3 <> 0)
    SELECT year, make_date(year, 1, 1) AS first, make_date(year + 1, 1, 1) AS after, count(*) AS n FROM x GROUP BY 1"""
)
def backfill_years(spark, sf_dir):
    return repairs.years_to_backfill(notices(spark, sf_dir), notices(spark, sf_dir).where("notice_id % 3 = 0").select("notice_id"))


@query("SELECT source_id, CASE WHEN notice_id % 4 = 0 AND notice_id % 8 <> 0 THEN '' WHEN notice_id % 8 = 0 THEN 'found ' || source_id ELSE procurer_name END AS procurer_name, CASE WHEN notice_id % 8 = 0 THEN '99' ELSE procurer_ico END AS procurer_ico FROM n")
def procurer_refill(spark, sf_dir):
    k = F.col("notice_id")
    n = notices(spark, sf_dir, names=True).withColumn("procurer_name", F.when(k % 4 == 0, "").otherwise(F.col("procurer_name")))
    new = n.select("source", "source_id", F.lit("99").alias("procurer_ico"), F.when(k % 8 == 0, F.concat(F.lit("found "), "source_id")).alias("procurer_name"))
    return repairs.refilled_procurers(n, new).select("source_id", "procurer_name", "procurer_ico")

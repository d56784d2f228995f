"""Dashboard and company queries."""

from __future__ import annotations

from ..operators import company, spend
from ..sources.binding import award_rows, notices
from .registry import query

#: A key that every scale factor has, in both roles.
ICO = "00000007"
YEAR = 1997

TOTAL = "CAST(sum(val) AS DOUBLE) AS total, count(*) AS n"
FINAL = "CAST(sum(fin) AS DOUBLE) AS total, count(*) AS n"
WON = f"notice_id IN (SELECT notice_id FROM a WHERE supplier_ico = '{ICO}')"


@query(f"SELECT year, {TOTAL} FROM v WHERE notice_type = 'contract_award' GROUP BY year")
def spend_by_year(spark, sf_dir):
    return spend.spend_by_year(notices(spark, sf_dir))


@query(f"SELECT year, {TOTAL} FROM v WHERE notice_type = 'contract_award' AND {WON} AND CAST(year AS INTEGER) BETWEEN 1993 AND 2100 GROUP BY year")
def spend_by_year_supplier(spark, sf_dir):
    return spend.valid_years(spend.spend_by_year(notices(spark, sf_dir), award_rows(spark, sf_dir, False), ICO, "supplier"))


@query(f"SELECT year, {TOTAL} FROM v WHERE notice_type = 'contract_award' AND procurer_ico = '{ICO}' GROUP BY year")
def spend_by_year_procurer(spark, sf_dir):
    return spend.spend_by_year(notices(spark, sf_dir), None, ICO, "procurer")


@query(f"SELECT cpv_code, {TOTAL} FROM v WHERE notice_type = 'contract_award' GROUP BY cpv_code")
def cpv_breakdown(spark, sf_dir):
    return spend.cpv_breakdown(notices(spark, sf_dir, cpv=True))


@query(f"SELECT cpv_code, {TOTAL} FROM v WHERE notice_type = 'contract_award' AND CAST(year AS INTEGER) BETWEEN 1996 AND 1998 GROUP BY cpv_code")
def cpv_breakdown_years(spark, sf_dir):
    return spend.cpv_breakdown(notices(spark, sf_dir, cpv=True), 1996, 1998)


@query(
    """, b AS (SELECT rpad(substr(replace(replace(coalesce(cpv_code, ''), '-', ''), ' ', ''), 1, 8), 8, '0') AS cpv, sum(val) AS t, count(*) AS n
    FROM v WHERE notice_type = 'contract_award' GROUP BY 1)
    SELECT cpv, CASE cpv WHEN '30000000' THEN 'Transport equipment and auxiliary products to transportation' WHEN '30200000' THEN 'Land vehicles including component and spare parts'
    WHEN '33000000' THEN 'Medical equipments, pharmaceutical products' WHEN '45000000' THEN 'Construction work' WHEN '45100000' THEN 'Building and related construction work'
    WHEN '45200000' THEN 'Civil engineering work' WHEN '45300000' THEN 'Specialized construction works' WHEN '72000000' THEN 'IT services: computer programming, consultancy and related services'
    WHEN '79000000' THEN 'Business and management consultancy services; related services' WHEN '90000000' THEN 'Sewage, waste, water and environmental services' ELSE cpv END AS label,
    CAST(t AS DOUBLE) AS total, CAST(n AS BIGINT) AS n, round(CAST(t AS DOUBLE) / CAST((SELECT sum(t) FROM b) AS DOUBLE) * 100, 1) AS share_pct FROM b"""
)
def by_cpv_share(spark, sf_dir):
    return spend.by_cpv_share(spend.cpv_breakdown(notices(spark, sf_dir, cpv=True)))


@query(
    f""", m AS (SELECT month(d) AS month, {TOTAL} FROM v WHERE notice_type = 'contract_award' AND year = '{YEAR}' GROUP BY 1)
    SELECT CAST(r.i AS INTEGER) AS month, coalesce(m.total, 0.0) AS total, coalesce(m.n, 0) AS n FROM range(1, 13) AS r(i) LEFT JOIN m ON m.month = r.i"""
)
def monthly_buckets_filled(spark, sf_dir):
    return spend.monthly_filled(notices(spark, sf_dir), YEAR)


@query(
    f""", y AS (SELECT year, {TOTAL} FROM v WHERE notice_type = 'contract_award' GROUP BY year),
    w AS (SELECT *, lag(total) OVER (ORDER BY year) AS before, lag(n) OVER (ORDER BY year) AS before_n FROM y WHERE CAST(year AS INTEGER) BETWEEN 1993 AND 2100),
    l AS (SELECT * FROM w ORDER BY year DESC LIMIT 1)
    SELECT (SELECT CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) FROM y) AS total, (SELECT CAST(sum(n) AS BIGINT) FROM y) AS n,
    (SELECT round(CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) / sum(n), 2) FROM y) AS average, year AS last_year, total AS last_total, before AS previous_total,
    CAST(n - before_n AS BIGINT) AS delta_n, round(total - before, 2) AS delta_total, round((total - before) / before * 100, 1) AS delta_pct FROM l"""
)
def dashboard_summary_yoy(spark, sf_dir):
    return spend.summary_with_change(spend.spend_by_year(notices(spark, sf_dir)))


TOP = "SELECT a.supplier_ico AS ico, min(supplier_name) AS name, count(*) AS n, CAST(sum(fin) AS DOUBLE) AS total FROM a JOIN v USING (notice_id) WHERE {} GROUP BY 1"
NAMED = "a.notice_id NOT IN (SELECT notice_id FROM a WHERE supplier_ico IS NULL)"


@query(TOP.format(NAMED) + " ORDER BY total DESC, ico LIMIT 100")
def top_suppliers_strict(spark, sf_dir):
    return spend.top_suppliers(notices(spark, sf_dir), award_rows(spark, sf_dir), 100)


@query(TOP.format("a.supplier_ico IS NOT NULL") + " ORDER BY total DESC, ico LIMIT 100")
def top_suppliers_any(spark, sf_dir):
    return spend.top_suppliers(notices(spark, sf_dir), award_rows(spark, sf_dir), 100, strict=False)


@query("SELECT procurer_ico AS ico, min(procurer_name) AS name, count(*) AS n, CAST(sum(fin) AS DOUBLE) AS total FROM v WHERE procurer_ico IS NOT NULL GROUP BY 1 ORDER BY total DESC, ico LIMIT 20")
def top_procurers(spark, sf_dir):
    return spend.top_procurers(notices(spark, sf_dir, names=True), 20)


@query("SELECT cpv_code, count(*) AS n, CAST(sum(fin) AS DOUBLE) AS total, median(coalesce(final_value, 0)) AS median FROM v WHERE cpv_code IS NOT NULL GROUP BY 1")
def market_cpv_median(spark, sf_dir):
    return spend.market_cpv(notices(spark, sf_dir, cpv=True))


@query("""SELECT cpv_code, count(*) AS n, CAST(sum(fin) AS DOUBLE) AS total, quantile_disc(coalesce(final_value, 0), 0.5) AS median
    FROM v WHERE cpv_code IS NOT NULL GROUP BY 1 ORDER BY n DESC, cpv_code LIMIT 200""")
def market_cpv_approx(spark, sf_dir):
    return spend.market_cpv(notices(spark, sf_dir, cpv=True), 200, exact=False)


BOTH = f", r AS (SELECT *, {WON} AS supplies, coalesce(procurer_ico = '{ICO}', false) AS procures FROM v WHERE {WON} OR coalesce(procurer_ico = '{ICO}', false))"


@query(
    BOTH
    + """ SELECT 'supplier' AS role, count(*) AS n, coalesce(CAST(sum(fin) AS DOUBLE), 0) AS total, max(award_date) AS last_contract_at FROM r WHERE supplies
    UNION ALL SELECT 'procurer', count(*), coalesce(CAST(sum(fin) AS DOUBLE), 0), max(award_date) FROM r WHERE procures"""
)
def core_stats_roles(spark, sf_dir):
    return company.core_stats_roles(notices(spark, sf_dir), award_rows(spark, sf_dir, False), ICO)


@query(BOTH + f" SELECT cpv_code, {FINAL} FROM r GROUP BY 1 ORDER BY total DESC, cpv_code NULLS FIRST LIMIT 5")
def core_stats_cpv(spark, sf_dir):
    return company.core_stats_cpv(notices(spark, sf_dir, cpv=True), award_rows(spark, sf_dir, False), ICO)


@query(BOTH + f" SELECT year, {FINAL} FROM r GROUP BY 1")
def core_stats_year(spark, sf_dir):
    return company.core_stats_year(notices(spark, sf_dir), award_rows(spark, sf_dir, False), ICO)


@query(BOTH + f" SELECT cpv_code, year, CAST(grouping(cpv_code) AS INTEGER) AS no_cpv, CAST(grouping(year) AS INTEGER) AS no_year, {FINAL}, max(award_date) AS last_contract_at FROM r GROUP BY GROUPING SETS ((), (cpv_code), (year))")
def core_stats_facet(spark, sf_dir):
    return company.core_stats_facet(notices(spark, sf_dir, cpv=True), award_rows(spark, sf_dir, False), ICO)


P_SUPPLIER = f"SELECT procurer_ico AS ico, 'procurer' AS role, min(procurer_name) AS name, count(*) AS n, CAST(sum(fin) AS DOUBLE) AS total FROM v WHERE {WON} GROUP BY 1"
P_PROCURER = f"SELECT a.supplier_ico AS ico, 'supplier' AS role, min(supplier_name) AS name, count(*) AS n, CAST(sum(fin) AS DOUBLE) AS total FROM a JOIN v USING (notice_id) WHERE v.procurer_ico = '{ICO}' AND a.supplier_ico IS NOT NULL GROUP BY 1"


@query(f"SELECT * FROM ({P_SUPPLIER} UNION ALL {P_PROCURER})")
def partners_all(spark, sf_dir):
    return company.partners(notices(spark, sf_dir, names=True), award_rows(spark, sf_dir), ICO)


@query(f"SELECT * FROM ({P_SUPPLIER}) ORDER BY total DESC, ico NULLS FIRST LIMIT 20 OFFSET 5")
def partners_supplier(spark, sf_dir):
    return company.partners(notices(spark, sf_dir, names=True), award_rows(spark, sf_dir, False), ICO, "supplier", "value", 20, 5)


@query(f"SELECT * FROM ({P_PROCURER}) ORDER BY n DESC, ico LIMIT 20")
def partners_procurer_by_count(spark, sf_dir):
    return company.partners(notices(spark, sf_dir, names=True), award_rows(spark, sf_dir), ICO, "procurer", "count", 20)


@query(
    f"""SELECT notice_id, 'supplier' AS role, procurer_ico AS counterparty, cpv_code, coalesce(final_value, estimated_value, 0) AS value, d AS date FROM v WHERE {WON}
    UNION ALL SELECT v.notice_id, 'procurer', a.supplier_ico, cpv_code, coalesce(final_value, estimated_value, 0), d FROM v JOIN a USING (notice_id) WHERE v.procurer_ico = '{ICO}' AND a.supplier_ico IS NOT NULL"""
)
def award_timeline(spark, sf_dir):
    return company.award_timeline(notices(spark, sf_dir, cpv=True), award_rows(spark, sf_dir, False), ICO)


E_SUPPLIERS = f"SELECT ico, count(*) AS contract_count, CAST(sum(fin) AS DOUBLE) AS total_value FROM (SELECT DISTINCT notice_id, supplier_ico AS ico FROM a WHERE {NAMED}) JOIN v USING (notice_id) GROUP BY ico"


@query(E_SUPPLIERS)
def entity_stats_suppliers(spark, sf_dir):
    return company.entity_stats_suppliers(notices(spark, sf_dir), award_rows(spark, sf_dir, False))


@query("SELECT procurer_ico AS ico, count(*) AS contract_count, CAST(sum(fin) AS DOUBLE) AS total_value FROM v WHERE procurer_ico IS NOT NULL GROUP BY 1")
def entity_stats_procurers(spark, sf_dir):
    return company.entity_stats_procurers(notices(spark, sf_dir))


@query(f", e AS ({E_SUPPLIERS}) SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS ico, s_name AS name, coalesce(contract_count, -1) AS contract_count, coalesce(total_value, s_acctbal) AS total_value FROM supplier LEFT JOIN e ON ico = lpad(CAST(s_suppkey AS VARCHAR), 8, '0')")
def entity_stats_refresh(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..sources.binding import ico, table

    stored = table(spark, sf_dir, "supplier").select(ico("s_suppkey").alias("ico"), F.col("s_name").alias("name"), F.lit(-1).cast("long").alias("contract_count"), F.col("s_acctbal").alias("total_value"))
    return company.refresh_entity_stats(stored, company.entity_stats_suppliers(notices(spark, sf_dir), award_rows(spark, sf_dir, False)))


@query(f"SELECT count(*) AS n, coalesce(CAST(sum(val) AS DOUBLE), 0) AS total, round(coalesce(CAST(sum(val) AS DOUBLE), 0) / greatest(count(*), 1), 2) AS average, array_to_string(list_sort(list(DISTINCT year)), ',') AS years_active FROM v WHERE procurer_ico = '{ICO}'")
def procurer_summary(spark, sf_dir):
    return company.entity_summary(notices(spark, sf_dir), award_rows(spark, sf_dir, False), ICO, "procurer")


@query(f"SELECT * FROM ({P_SUPPLIER}) ORDER BY total DESC, ico NULLS FIRST LIMIT 10")
def supplier_detail_top10(spark, sf_dir):
    return company.counterparties(notices(spark, sf_dir, names=True), award_rows(spark, sf_dir, False), ICO, "supplier")


FIRST = """, f AS (SELECT notice_id, supplier_ico FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY pos, supplier_ico NULLS FIRST, supplier_name) AS rn FROM a) WHERE rn = 1),
    g AS (SELECT procurer_ico, f.supplier_ico, CAST(sum(val) AS DOUBLE) AS total FROM v JOIN f USING (notice_id) WHERE procurer_ico IS NOT NULL AND f.supplier_ico IS NOT NULL GROUP BY 1, 2),
    h AS (SELECT procurer_ico, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS whole, sum(total * total) AS squares, count(*) AS suppliers FROM g GROUP BY 1)"""


@query(FIRST + " SELECT procurer_ico, suppliers, CASE WHEN whole > 0 THEN round(squares / (whole * whole) * 10000, 2) ELSE 0 END AS hhi FROM h")
def concentration_hhi(spark, sf_dir):
    return company.concentration_index(notices(spark, sf_dir), award_rows(spark, sf_dir))


@query(FIRST + f" SELECT supplier_ico, total, CASE WHEN whole > 0 THEN round(total / whole * 100, 2) ELSE 0 END AS share_pct FROM g JOIN h USING (procurer_ico) WHERE procurer_ico = '{ICO}' ORDER BY total DESC, supplier_ico LIMIT 5")
def concentration_top_shares(spark, sf_dir):
    return company.concentration_top(notices(spark, sf_dir), award_rows(spark, sf_dir), ICO)


@query(
    """, g AS (SELECT procurer_ico, cpv_code, greatest(CAST(sum(fin) AS DOUBLE), 0) AS p FROM v WHERE procurer_ico IS NOT NULL GROUP BY 1, 2)
    SELECT procurer_ico, CASE WHEN sum(p) > 0 THEN round(sum(p * p) / (sum(p) * sum(p)), 4) ELSE 0 END AS hhi FROM g GROUP BY 1"""
)
def cpv_hhi(spark, sf_dir):
    return company.cpv_hhi(notices(spark, sf_dir, cpv=True))


MERGED = """, s AS (SELECT ico, min(name) AS name, count(*) AS n, sum(fin) AS t FROM (SELECT DISTINCT notice_id, supplier_ico AS ico, supplier_name AS name FROM a WHERE supplier_ico IS NOT NULL) JOIN v USING (notice_id) GROUP BY 1),
    p AS (SELECT procurer_ico AS ico, min(procurer_name) AS name, count(*) AS n, sum(fin) AS t FROM v WHERE procurer_ico IS NOT NULL GROUP BY 1)"""


@query(
    MERGED
    + """ SELECT coalesce(s.ico, p.ico) AS ico, coalesce(s.name, p.name) AS name, CASE WHEN s.ico IS NULL THEN 'procurer' WHEN p.ico IS NULL THEN 'supplier' ELSE 'supplier,procurer' END AS roles,
    coalesce(s.n, 0) + coalesce(p.n, 0) AS n, CAST(coalesce(s.t, 0) + coalesce(p.t, 0) AS DOUBLE) AS total, CASE WHEN coalesce(s.n, 0) >= coalesce(p.n, 0) THEN 'supplier' ELSE 'procurer' END AS primary_role
    FROM s FULL JOIN p ON s.ico = p.ico"""
)
def company_merge(spark, sf_dir):
    from ..operators.search import entity_table

    n, a = notices(spark, sf_dir, names=True), award_rows(spark, sf_dir)
    return company.merge_companies(entity_table(n, a, "supplier"), entity_table(n, a, "procurer"))


@query(
    BOTH
    + f""" SELECT '{ICO}' AS ico, count(*) FILTER (supplies) AS supplier_n, coalesce(CAST(sum(fin) FILTER (supplies) AS DOUBLE), 0) AS supplier_total,
    count(*) FILTER (procures) AS procurer_n, coalesce(CAST(sum(fin) FILTER (procures) AS DOUBLE), 0) AS procurer_total, max(award_date) AS last_contract_at,
    CASE WHEN count(*) = 0 THEN NULL WHEN count(*) FILTER (supplies) >= count(*) FILTER (procures) THEN 'supplier' ELSE 'procurer' END AS primary_role FROM r"""
)
def company_profile(spark, sf_dir):
    return company.company_profile(notices(spark, sf_dir), award_rows(spark, sf_dir, False), ICO)


@query(
    BOTH
    + """, o AS (SELECT rpad(substr(coalesce(cpv_code, ''), 1, 8), 8, '0') AS cpv, CAST(sum(fin) AS DOUBLE) AS own FROM r GROUP BY 1),
    m AS (SELECT rpad(substr(coalesce(cpv_code, ''), 1, 8), 8, '0') AS cpv, CAST(sum(fin) AS DOUBLE) AS market FROM v GROUP BY 1),
    j AS (SELECT cpv, own, market FROM o JOIN m USING (cpv))
    SELECT cpv, own, market, round(own / (SELECT CAST(sum(CAST(own AS DECIMAL(18,2))) AS DOUBLE) FROM j) * 100, 1) AS own_pct, round(market / (SELECT CAST(sum(CAST(market AS DECIMAL(18,2))) AS DOUBLE) FROM j) * 100, 1) AS market_pct FROM j"""
)
def company_cpv_profile(spark, sf_dir):
    return company.company_cpv_profile(notices(spark, sf_dir, cpv=True), award_rows(spark, sf_dir, False), ICO)


@query(BOTH + " SELECT notice_id, title, coalesce(final_value, estimated_value, 0) AS value, publication_date, CASE WHEN supplies THEN 'supplier' ELSE 'procurer' END AS role FROM r ORDER BY value DESC, notice_id LIMIT 5")
def company_top_contracts(spark, sf_dir):
    return company.top_contracts(notices(spark, sf_dir, cpv=True), award_rows(spark, sf_dir, False), ICO)

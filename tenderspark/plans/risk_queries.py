"""Risk, resolution, upsert and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_hash, slugify
from ..operators import graph, resolve, risk, upsert
from ..sources.binding import award_rows, notices, table
from . import resolution_sql as sql
from .registry import query
from .spend_queries import ICO

PAIRS = """, k AS (SELECT notice_id, supplier_ico, count(*) AS k FROM a WHERE supplier_ico IS NOT NULL GROUP BY 1, 2),
    q AS (SELECT k.supplier_ico, v.procurer_ico, count(*) AS n, CAST(sum(fin) AS DOUBLE) AS total, CAST(sum(k.k) AS BIGINT) AS ks, CAST(sum(fin * k.k) AS DOUBLE) AS vk FROM k JOIN v USING (notice_id) GROUP BY 1, 2),
    pairs AS (SELECT supplier_ico AS ico, procurer_ico AS counterparty, 'procurer' AS role, n, total FROM q UNION ALL SELECT procurer_ico, supplier_ico, 'supplier', ks, vk FROM q WHERE procurer_ico IS NOT NULL)"""
CONCENTRATION = """, c1 AS (SELECT ico, count(*) FILTER (total > 0) AS suppliers, CAST(sum(CAST(greatest(total, 0) AS DECIMAL(18,2))) AS DOUBLE) AS value, sum(greatest(total, 0) * greatest(total, 0)) AS q, max(greatest(total, 0)) AS top FROM pairs WHERE role = 'supplier' GROUP BY 1),
    c2 AS (SELECT *, CASE WHEN value > 0 THEN round(q / (value * value), 4) ELSE 0 END AS hhi, CASE WHEN value > 0 THEN round(top / value, 4) ELSE 0 END AS top_share, suppliers >= 5 AND value >= 100000 AS material FROM c1),
    concentration AS (SELECT ico, suppliers, value, hhi, top_share, CASE WHEN NOT material THEN 'informational' WHEN hhi >= 0.25 THEN 'high' WHEN hhi >= 0.15 THEN 'moderate' ELSE 'low' END AS severity,
    CASE WHEN material THEN CAST(round(CAST(hhi AS DECIMAL(9,4)) * 100, 1) AS DOUBLE) ELSE 0 END AS score, material AND hhi >= 0.25 AS triggered FROM c2)"""
PAIR = """, p1 AS (SELECT *, row_number() OVER (PARTITION BY ico ORDER BY total DESC, n DESC, coalesce(counterparty, '') DESC, role DESC) AS rn FROM pairs),
    p2 AS (SELECT ico, count(*) AS counterparties, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS value, sum(n) AS contracts, max(total) FILTER (rn = 1) AS t, max(n) FILTER (rn = 1) AS tn, max(coalesce(counterparty, '')) FILTER (rn = 1) AS tc, max(role) FILTER (rn = 1) AS tr FROM p1 GROUP BY 1),
    p3 AS (SELECT *, CASE WHEN value > 0 THEN t / value END AS share, counterparties >= 3 AND value >= 50000 AS material FROM p2),
    pair AS (SELECT ico, counterparties, value, CASE WHEN value > 0 THEN tc END AS top, round(share, 4) AS value_share, round(tn / contracts, 4) AS count_share, CASE WHEN value > 0 THEN CASE WHEN tr = 'procurer' THEN 'supplier' ELSE 'procurer' END END AS subject_role,
    CASE WHEN NOT material THEN 'informational' WHEN share >= 0.75 THEN 'high' WHEN share >= 0.5 THEN 'moderate' ELSE 'low' END AS severity, CASE WHEN material THEN round(share * 100, 1) ELSE 0 END AS score, coalesce(material AND share >= 0.5, false) AS triggered FROM p3)"""
MARKET = """, m1 AS (SELECT cpv_code, count(*) AS n, CAST(sum(fin) AS DOUBLE) AS total, median(coalesce(final_value, 0)) AS med FROM v WHERE cpv_code IS NOT NULL GROUP BY 1),
    m2 AS (SELECT cpv_code, CASE WHEN med > 0 THEN med WHEN total > 0 THEN total / n END AS baseline FROM m1 WHERE n >= 20),
    inv AS (SELECT notice_id, supplier_ico AS ico FROM a WHERE supplier_ico IS NOT NULL UNION SELECT notice_id, procurer_ico FROM n WHERE procurer_ico IS NOT NULL),
    m3 AS (SELECT ico, cpv_code, count(*) AS n, CAST(sum(fin) AS DOUBLE) AS total FROM inv JOIN v USING (notice_id) WHERE cpv_code IS NOT NULL GROUP BY 1, 2),
    m4 AS (SELECT ico, max(round(total / n / baseline, 2)) AS multiple, count(*) AS compared FROM m3 JOIN m2 USING (cpv_code) WHERE baseline IS NOT NULL GROUP BY 1),
    market AS (SELECT ico, multiple, compared, round(least(100.0, multiple / 3.0 * 50.0), 1) AS score, CASE WHEN multiple >= 6 THEN 'high' WHEN multiple >= 3 THEN 'moderate' ELSE 'low' END AS severity, multiple >= 3 AS triggered FROM m4)"""
BURSTS = """b1 AS (SELECT ico, counterparty, date, substr(cpv_code, 1, 2) AS division, CAST(value AS DECIMAL(18,2)) AS value FROM series),
    b2 AS (SELECT ico, counterparty, date, count(*) OVER w AS n, sum(value) OVER w AS value, min(date) OVER w AS first, min(division) OVER w AS low, max(division) OVER w AS top FROM b1
    WINDOW w AS (PARTITION BY ico, counterparty ORDER BY date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)),
    b3 AS (SELECT *, row_number() OVER (PARTITION BY ico, counterparty ORDER BY n DESC, date) AS rn, count(*) OVER (PARTITION BY ico, counterparty) AS awards FROM b2),
    b4 AS (SELECT ico, counterparty, awards, n, CAST(value AS DOUBLE) AS window_value, first, date AS last, low, coalesce(low = top, false) AS shared, n >= 4 AS dense, CASE WHEN low = '45' THEN 300000.0 ELSE 180000.0 END AS ceiling, round(least(100.0, n / 4 * 60.0), 1) AS base FROM b3 WHERE rn = 1),
    b5 AS (SELECT *, dense AND shared AND window_value >= 10000 AND window_value BETWEEN 0.7 * ceiling AND 1.0 * ceiling AS near_ceiling FROM b4),
    bursts AS (SELECT ico, counterparty, awards, n AS burst, window_value, CASE WHEN n > 1 THEN first END AS first_day, CASE WHEN n > 1 THEN last END AS last_day, CASE WHEN shared THEN low END AS division, near_ceiling, dense AND shared AS triggered,
    CASE WHEN dense AND NOT shared THEN round(base * 0.5, 1) ELSE base END AS score, CASE WHEN NOT dense THEN 'low' WHEN NOT shared THEN 'informational' WHEN near_ceiling OR n >= 8 THEN 'high' ELSE 'moderate' END AS severity FROM b5)"""
TIMELINE = """, nf AS (SELECT notice_id, procurer_ico, cpv_code, coalesce(final_value, estimated_value, 0) AS value, d AS date FROM v WHERE procedure_type NOT LIKE '%framework%' AND procurer_ico IS NOT NULL),
    series AS (SELECT k.supplier_ico AS ico, nf.procurer_ico AS counterparty, date, cpv_code, value FROM (SELECT DISTINCT notice_id, supplier_ico FROM a WHERE supplier_ico IS NOT NULL) k JOIN nf USING (notice_id)
    UNION ALL SELECT nf.procurer_ico, a.supplier_ico, date, cpv_code, value FROM a JOIN nf USING (notice_id) WHERE supplier_ico IS NOT NULL), """


@query(PAIRS + CONCENTRATION + " SELECT * FROM concentration")
def risk_concentration(spark, sf_dir):
    a = award_rows(spark, sf_dir, False)
    return risk.concentration_flag(risk.pairs(risk.meetings(notices(spark, sf_dir), a), a.count()))


@query(PAIRS + PAIR + " SELECT * FROM pair")
def risk_pair(spark, sf_dir):
    a = award_rows(spark, sf_dir, False)
    return risk.pair_flag(risk.pairs(risk.meetings(notices(spark, sf_dir), a), a.count()))


@query(MARKET + " SELECT * FROM market")
def risk_market(spark, sf_dir):
    n, a = notices(spark, sf_dir, cpv=True), award_rows(spark, sf_dir, False)
    return risk.market_flag(n, risk.meetings(n, a), a.count() + notices(spark, sf_dir).count())


@query(", series AS (SELECT authority_ico AS ico, a.supplier_ico AS counterparty, d AS date, cpv_code, coalesce(final_value, estimated_value, 0) AS value FROM a JOIN v USING (notice_id) WHERE a.supplier_ico IS NOT NULL AND procedure_type NOT LIKE '%framework%'), " + BURSTS + " SELECT * FROM bursts")
def risk_cluster(spark, sf_dir):
    """Bursts over the coarse role, whose pairs have many awards."""
    n = notices(spark, sf_dir, cpv=True, names=True).where(~risk.is_framework()).select("notice_id", F.col("authority_ico").alias("ico"), F.coalesce("award_date", "publication_date").alias("date"), "cpv_code", risk.value_expr().alias("value"))
    a = award_rows(spark, sf_dir, False).where("supplier_ico IS NOT NULL").select("notice_id", F.col("supplier_ico").alias("counterparty"))
    return risk.bursts(a.join(n, "notice_id"), a.count())


@query(
    PAIRS + CONCENTRATION + PAIR + MARKET + TIMELINE + BURSTS
    + """, cl AS (SELECT ico, score, triggered, row_number() OVER (PARTITION BY ico ORDER BY score DESC, counterparty DESC, burst DESC, severity DESC) AS rn FROM bursts),
    ids AS (SELECT ico FROM concentration UNION SELECT ico FROM pair UNION SELECT ico FROM market UNION SELECT ico FROM cl),
    j AS (SELECT ids.ico, coalesce(c.score, 0) AS concentration, coalesce(p.score, 0) AS pair, coalesce(m.score, 0) AS market, coalesce(l.score, 0) AS cluster, p.subject_role,
    concat_ws(',', CASE WHEN l.triggered THEN 'cluster' END, CASE WHEN c.triggered THEN 'concentration' END, CASE WHEN m.triggered THEN 'market' END, CASE WHEN p.triggered THEN 'pair' END) AS triggered,
    CASE WHEN p.subject_role = 'supplier' THEN 0.125 ELSE 0.25 END AS w
    FROM ids LEFT JOIN concentration c ON c.ico = ids.ico LEFT JOIN pair p ON p.ico = ids.ico LEFT JOIN market m ON m.ico = ids.ico LEFT JOIN cl l ON l.ico = ids.ico AND l.rn = 1),
    t AS (SELECT *, CAST(round(concentration * 10) AS BIGINT) * 300 + CAST(round(pair * 10) AS BIGINT) * CAST(w * 1000 AS BIGINT) + CAST(round(market * 10) AS BIGINT) * 250 + CAST(round(cluster * 10) AS BIGINT) * 200 AS parts, CAST(w * 1000 AS BIGINT) + 750 AS whole FROM j),
    s AS (SELECT *, CAST((2 * parts + whole) // (2 * whole) AS DOUBLE) / 10 AS risk_score FROM t)
    SELECT ico, concentration, pair, market, cluster, subject_role, triggered, risk_score, CASE WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'moderate' ELSE 'low' END AS risk_band FROM s"""
)
def risk_summary(spark, sf_dir):
    return risk.risk_profiles(notices(spark, sf_dir, cpv=True), award_rows(spark, sf_dir, False))


def _resolution_input(spark, sf_dir):
    """Notices of the stable year that passes are run over, without canonical ids."""
    return notices(spark, sf_dir, cpv=True).withColumn("canonical_id", F.lit(None).cast("string"))


@query(
    """, g AS (SELECT procurer_ico, cpv_code FROM n WHERE procurer_ico IS NOT NULL AND cpv_code IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source) >= 2),
    m AS (SELECT n.*, first_value(notice_id) OVER (PARTITION BY procurer_ico, cpv_code ORDER BY publication_date, notice_id) AS canonical FROM n JOIN g USING (procurer_ico, cpv_code))
    SELECT CAST(canonical AS VARCHAR) AS canonical_id, procurer_ico || '|' || cpv_code AS pass_key, array_to_string(list_sort(list(DISTINCT notice_id)), ',') AS notice_ids, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, 'ico_cpv' AS match_type FROM m GROUP BY 1, 2"""
)
def dedup_pass1(spark, sf_dir):
    m = resolve.match_table(resolve.pass_one(_resolution_input(spark, sf_dir)), "ico_cpv")
    return m.withColumns({"notice_ids": F.array_join("notice_ids", ","), "sources": F.array_join("sources", ",")})


@query(f", w AS ({sql.ALL}) SELECT * FROM ({sql.second_pass('w')})")
def dedup_pass2(spark, sf_dir):
    return resolve.pass_two(_resolution_input(spark, sf_dir))


WINDOW_END = "1998-07-01"


def _window(spark, sf_dir):
    return resolve.recent(_resolution_input(spark, sf_dir).where(F.col("ingested_at") < F.lit(WINDOW_END).cast("timestamp_ntz")), F.lit(WINDOW_END).cast("timestamp_ntz"))


WINDOW = f", w AS ({sql.window(WINDOW_END)})"


@query(f"{WINDOW} SELECT * FROM ({sql.third_pass('w')})")
def dedup_pass3(spark, sf_dir):
    return resolve.pass_three(_window(spark, sf_dir), award_rows(spark, sf_dir, False))


@query(
    f"""{WINDOW}, p1 AS ({sql.first_pass('w')}), w1 AS ({sql.stamped('w', 'p1')}), p2 AS ({sql.second_pass('w1')}), w2 AS ({sql.stamped('w1', 'p2')}),
    p3 AS ({sql.third_pass('w2')}), w3 AS ({sql.stamped('w2', 'p3')}) SELECT notice_id, source, CAST(canonical AS VARCHAR) AS canonical_id FROM w3"""
)
def dedup_all(spark, sf_dir):
    stamped, _ = resolve.resolve(_window(spark, sf_dir), award_rows(spark, sf_dir, False))
    return stamped.select("notice_id", "source", "canonical_id")


@query(
    f"""{WINDOW}, p3 AS ({sql.third_pass('w')}), s AS ({sql.suppliers('w')})
    SELECT (SELECT count(*) FROM (SELECT DISTINCT canonical, pass_key FROM p3)) AS groups, (SELECT count(DISTINCT notice_id) FROM p3) AS notices,
    (SELECT count(*) FROM (SELECT supplier_ico FROM s GROUP BY 1 HAVING count(*) > 20)) AS skipped_icos"""
)
def dedup_preview(spark, sf_dir):
    return resolve.preview(_window(spark, sf_dir), award_rows(spark, sf_dir, False))


@query(
    f""", w AS (SELECT * FROM n WHERE ingested_at < TIMESTAMP '{WINDOW_END}' AND ingested_at >= TIMESTAMP '{WINDOW_END}' - INTERVAL 30 DAY),
    k AS (SELECT DISTINCT a.supplier_ico, w.notice_id, w.source, w.publication_date FROM a JOIN w USING (notice_id) WHERE a.supplier_ico IS NOT NULL),
    few AS (SELECT supplier_ico FROM k GROUP BY 1 HAVING count(*) <= 20),
    kk AS (SELECT k.* FROM k JOIN few USING (supplier_ico))
    SELECT x.supplier_ico, x.notice_id AS a, y.notice_id AS b FROM kk x JOIN kk y ON x.supplier_ico = y.supplier_ico AND x.notice_id < y.notice_id AND x.source <> y.source AND abs(date_diff('day', x.publication_date, y.publication_date)) <= 14
    WHERE EXISTS (SELECT 1 FROM a p JOIN a q ON p.notice_id = x.notice_id AND q.notice_id = y.notice_id WHERE p.award_value > 0 AND q.award_value > 0 AND greatest(p.award_value, q.award_value) <= 1.5 * least(p.award_value, q.award_value))"""
)
def dedup_pairs(spark, sf_dir):
    return resolve.candidate_pairs(_window(spark, sf_dir), award_rows(spark, sf_dir, False))


def _batch(spark, sf_dir):
    """A second delivery: every notice but multiples of 11, values of multiples of 6 changed, multiples of 4 sent twice."""
    n = notices(spark, sf_dir).where(F.col("notice_id") % 11 != 0)
    twice = n.withColumn("seq", F.lit(1)).unionByName(n.where(F.col("notice_id") % 4 == 0).withColumn("seq", F.lit(2)))
    value = F.when(F.col("notice_id") % 6 == 0, F.col("final_value") + F.col("seq")).otherwise(F.col("final_value"))
    return twice.withColumn("final_value", value).withColumn("content_hash", _hash())


def _hash():
    return F.sha2(F.concat_ws("|", "source_id", F.coalesce(F.col("final_value").cast("decimal(18,2)").cast("string"), F.lit(""))), 256)


def _stored(spark, sf_dir):
    """Multiples of five are unknown yet."""
    return notices(spark, sf_dir).where(F.col("notice_id") % 5 != 0).withColumns({"content_hash": _hash(), "canonical_id": F.lit("kept")})


SENT = "SELECT *, CASE WHEN notice_id % 6 = 0 THEN final_value + CASE WHEN notice_id % 4 = 0 THEN 2 ELSE 1 END ELSE final_value END AS new_value FROM n WHERE notice_id % 11 <> 0"
CHANGED = "notice_id % 6 = 0 AND final_value IS NOT NULL"


@query(f", s AS ({SENT}) SELECT count(*) FILTER (notice_id % 5 = 0) AS inserted, count(*) FILTER (notice_id % 5 <> 0 AND {CHANGED}) AS updated, count(*) FILTER (notice_id % 5 <> 0 AND NOT ({CHANGED})) AS skipped FROM s")
def upsert_counts(spark, sf_dir):
    return upsert.counts(upsert.decide(upsert.keep_last(_batch(spark, sf_dir)), _stored(spark, sf_dir)))


@query(f", s AS ({SENT}) SELECT n.source, n.source_id, coalesce(s.new_value, n.final_value) AS final_value, CASE WHEN n.notice_id % 5 <> 0 THEN 'kept' END AS canonical_id, n.ingested_at FROM n LEFT JOIN s USING (notice_id) WHERE n.notice_id % 5 <> 0 OR s.notice_id IS NOT NULL")
def upsert_result(spark, sf_dir):
    later = _batch(spark, sf_dir).withColumn("ingested_at", F.when(F.col("notice_id") % 5 == 0, F.col("ingested_at")).otherwise(F.lit("2030-01-01").cast("timestamp_ntz")))
    out = upsert.upsert_notices(_stored(spark, sf_dir), upsert.keep_last(later))
    return out.select("source", "source_id", "final_value", "canonical_id", "ingested_at")


@query("SELECT CASE WHEN procurer_ico IS NOT NULL THEN 'ico:' || procurer_ico ELSE 'slug:' || replace(replace(lower(procurer_name), '#', '-'), ' ', '-') END AS entity, arg_max(procurer_name, notice_id) AS name, max(procurer_ico) AS ico, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM n GROUP BY 1")
def entity_upsert(spark, sf_dir):
    n = notices(spark, sf_dir, names=True)
    rows = n.select(F.col("procurer_ico").alias("ico"), F.col("procurer_name").alias("name"), slugify("procurer_name").alias("name_slug"), "source", F.col("notice_id").alias("seq"))
    return upsert.upsert_entities(rows).withColumn("sources", F.array_join("sources", ","))


@query(
    """, t AS (SELECT notice_id, array_to_string(list_sort(list(coalesce(supplier_ico, '') || ':' || CAST(CAST(award_value AS DECIMAL(30,6)) AS VARCHAR))), ',') AS awards FROM a GROUP BY 1)
    SELECT n.notice_id, 'sha256:' || sha256(concat_ws('|', title, coalesce(procurer_ico, ''), coalesce(cpv_code, ''), coalesce(CAST(CAST(estimated_value AS DECIMAL(30,6)) AS VARCHAR), ''), coalesce(CAST(CAST(final_value AS DECIMAL(30,6)) AS VARCHAR), ''),
    CAST(publication_date AS VARCHAR), status, notice_type, coalesce(awards, ''))) AS content_hash FROM n LEFT JOIN t ON t.notice_id = n.notice_id"""
)
def content_hashes(spark, sf_dir):
    from ..functions.text import amount_text

    text = F.concat(F.coalesce("supplier_ico", F.lit("")), F.lit(":"), amount_text(F.col("award_value")))
    per = award_rows(spark, sf_dir, False).groupBy("notice_id").agg(F.sort_array(F.collect_list(text)).alias("texts"))
    n = notices(spark, sf_dir, cpv=True).join(per, "notice_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    return n.select("notice_id", content_hash(F.col("title"), F.col("procurer_ico"), F.col("cpv_code"), F.col("estimated_value"), F.col("final_value"), F.col("publication_date"), F.col("status"), F.col("notice_type"), F.col("texts")).alias("content_hash"))


EDGES = """, aw2 AS (SELECT notice_id, org, award_value AS value FROM (SELECT notice_id, supplier_ico AS org, award_value, row_number() OVER (PARTITION BY notice_id, supplier_ico ORDER BY pos, award_value) AS rn FROM a WHERE supplier_ico IS NOT NULL) WHERE rn = 1),
    e AS (SELECT notice_id, procurer_ico AS org, 'procurer' AS type, CAST(NULL AS DOUBLE) AS value FROM n WHERE procurer_ico IS NOT NULL UNION ALL SELECT notice_id, org, 'supplier', value FROM aw2)"""


@query(EDGES + f" SELECT y.org, y.type, 2 AS hops, count(*) AS paths, coalesce(CAST(sum(CAST(coalesce(x.value, y.value) AS DECIMAL(18,2))) AS DOUBLE), 0) AS total_value FROM e x JOIN e y ON x.notice_id = y.notice_id WHERE x.org = '{ICO}' AND y.org <> '{ICO}' GROUP BY 1, 2")
def ego_2hop(spark, sf_dir):
    return graph.ego(notices(spark, sf_dir), award_rows(spark, sf_dir, False), ICO)


@query(EDGES + f" SELECT '{ICO}' AS org, count(*) AS degree FROM e WHERE org = '{ICO}'")
def graph_degree(spark, sf_dir):
    return graph.degree(notices(spark, sf_dir), award_rows(spark, sf_dir, False), ICO)


@query(
    EDGES
    + f""", mine AS (SELECT DISTINCT notice_id FROM e WHERE org = '{ICO}'), two AS (SELECT DISTINCT org FROM e WHERE notice_id IN (SELECT notice_id FROM mine) AND org <> '{ICO}'),
    far AS (SELECT notice_id FROM e WHERE org IN (SELECT org FROM two) UNION SELECT notice_id FROM n WHERE cpv_code IN (SELECT cpv_code FROM n WHERE notice_id IN (SELECT notice_id FROM mine) AND cpv_code IS NOT NULL))
    SELECT org, 2 AS hops FROM two UNION ALL SELECT org, 4 FROM (SELECT DISTINCT org FROM e WHERE notice_id IN (SELECT notice_id FROM far) AND org <> '{ICO}' AND org NOT IN (SELECT org FROM two))"""
)
def related_4hop(spark, sf_dir):
    return graph.related(notices(spark, sf_dir, cpv=True), award_rows(spark, sf_dir, False), ICO, None)


NETWORK = EDGES + ", net AS (SELECT procurer_ico, aw2.org AS supplier_ico, count(*) AS contract_count, coalesce(CAST(sum(CAST(aw2.value AS DECIMAL(18,2))) AS DOUBLE), 0) AS total_value FROM n JOIN aw2 USING (notice_id) WHERE cpv_code LIKE '33110000%' AND publication_date >= DATE '1997-01-01' AND publication_date < DATE '1998-01-01' AND procurer_ico IS NOT NULL GROUP BY 1, 2 ORDER BY total_value DESC, 1, 2 LIMIT 100)"


@query(NETWORK + " SELECT * FROM net")
def cpv_network(spark, sf_dir):
    return graph.cpv_network(notices(spark, sf_dir, cpv=True), award_rows(spark, sf_dir, False), "33110000", "1997-01-01", "1998-01-01")


@query(NETWORK + " SELECT DISTINCT procurer_ico AS org, 'procurer' AS type FROM net UNION SELECT DISTINCT supplier_ico, 'supplier' FROM net")
def cpv_network_nodes(spark, sf_dir):
    return graph.network_nodes(cpv_network(spark, sf_dir))


@query(NETWORK + " SELECT *, 'e' || CAST(row_number() OVER (ORDER BY total_value DESC, procurer_ico, supplier_ico) - 1 AS VARCHAR) AS id FROM net")
def cpv_network_numbered(spark, sf_dir):
    return graph.numbered_edges(cpv_network(spark, sf_dir))


@query(EDGES + f" SELECT org AS supplier_ico, count(*) AS contract_count, coalesce(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 0) AS total_value FROM aw2 WHERE notice_id IN (SELECT notice_id FROM n WHERE procurer_ico = '{ICO}') GROUP BY 1 ORDER BY total_value DESC, 1 LIMIT 10")
def graph_concentration(spark, sf_dir):
    return graph.supplier_concentration(notices(spark, sf_dir), award_rows(spark, sf_dir, False), ICO)


@query("SELECT source || '|' || source_id AS key, 'later' AS title, status FROM n")
def graph_notice_nodes(spark, sf_dir):
    n = notices(spark, sf_dir, cpv=True).withColumn("seq", F.lit(1))
    nodes = graph.merge_notice_nodes(n.unionByName(n.withColumns({"seq": F.lit(2), "title": F.lit("later")})))
    return nodes.select(F.concat_ws("|", "source", "source_id").alias("key"), "title", "status")


@query("SELECT 'p' || CAST(c_custkey AS VARCHAR) AS key, c_name || ' old' AS created_name, c_name AS name FROM customer")
def graph_org_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("name"), F.lit(2).alias("seq"))
    return graph.merge_nodes(c.unionByName(c.withColumns({"name": F.concat("name", F.lit(" old")), "seq": F.lit(1)})))



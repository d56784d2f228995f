"""Search, vector, health and repair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import cpv_prefix, date_prefix, status_from_year, year_from_date
from ..functions.text import score, slugify
from ..operators import company, health, search
from ..sources.binding import award_rows, event_log, ico, notices, registry, table
from .registry import query
from .spend_queries import MERGED, TOP

AWARDS = "notice_type = 'contract_award'"
LIST = "notice_id, title, publication_date"
SOURCES = ("vestnik", "crz", "ted", "uvo", "itms")
SOURCE_ROWS = "(VALUES ('vestnik'), ('crz'), ('ted'), ('uvo'), ('itms')) AS s(source)"


def _list(rows):
    return rows.select("notice_id", "title", "publication_date")


@query(f"SELECT {LIST}, val AS value FROM (SELECT notice_id, title, publication_date, coalesce(final_value, estimated_value, 0) AS val FROM v WHERE {AWARDS} AND cpv_code IN ('33110000', '45200000', '30050000') AND publication_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND coalesce(final_value, estimated_value, 0) BETWEEN 50000 AND 400000)")
def search_contracts(spark, sf_dir):
    from ..functions.columns import value_expr

    return search.search_notices(notices(spark, sf_dir, cpv=True), cpv_codes=["33110000", "45200000", "30050000"], date_from="1996-01-01", date_to="1999-12-31", value_min=50000, value_max=400000).select("notice_id", "title", "publication_date", value_expr().alias("value"))


@query(f"SELECT notice_id, publication_date, (SELECT count(*) FROM n WHERE {AWARDS}) AS total_rows FROM n WHERE {AWARDS} ORDER BY publication_date DESC, notice_id LIMIT 20 OFFSET 40")
def search_contracts_page(spark, sf_dir):
    return search.page(search.search_notices(notices(spark, sf_dir)), 20, 40).select("notice_id", "publication_date", "total_rows")


@query(f"SELECT notice_id FROM n WHERE {AWARDS} AND notice_id IN (SELECT notice_id FROM a WHERE supplier_ico = '00000007') AND procurer_ico = '00000007' OR {AWARDS} AND notice_id IN (SELECT notice_id FROM a WHERE supplier_ico = '00000003')")
def search_by_company(spark, sf_dir):
    n, a = notices(spark, sf_dir), award_rows(spark, sf_dir, False)
    both = search.search_notices(n, procurer="00000007", supplier="00000007", awards=a)
    return both.unionByName(search.search_notices(n, supplier="00000003", awards=a)).select("notice_id").distinct()


@query("SELECT notice_id, title, status FROM n WHERE source_id = '42'")
def search_detail(spark, sf_dir):
    return search.notice_detail(notices(spark, sf_dir, cpv=True), "42").select("notice_id", "title", "status")


@query(
    """, f AS (SELECT notice_id, supplier_ico FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY pos, supplier_ico NULLS FIRST, supplier_name) AS rn FROM a) WHERE rn = 1)
    SELECT n.notice_id, title, procurer_ico, supplier_ico, coalesce(final_value, estimated_value, 0) AS value, CAST(year(publication_date) AS INTEGER) AS year, status FROM n LEFT JOIN f ON f.notice_id = n.notice_id"""
)
def contract_rows(spark, sf_dir):
    return search.contract_row(notices(spark, sf_dir, cpv=True), company.first_awards(award_rows(spark, sf_dir)), 2026)


TITLE_WORDS = "' ' || title || ' '"


@query(f"SELECT {LIST} FROM n WHERE {AWARDS} AND {TITLE_WORDS} LIKE '% small ring %'")
def search_phrase(spark, sf_dir):
    return _list(search.search_notices(notices(spark, sf_dir, cpv=True), '"small ring"'))


@query(f"SELECT {LIST} FROM n WHERE {AWARDS} AND len(list_filter(string_split(strip_accents(lower(title)), ' '), lambda t: regexp_full_match(t, 'wid.*t'))) > 0")
def search_wildcard(spark, sf_dir):
    return _list(search.search_notices(notices(spark, sf_dir, cpv=True), "wid*t"))


@query(f"SELECT {LIST} FROM n WHERE {AWARDS} AND (len(list_filter(string_split(strip_accents(lower(title)), ' '), lambda t: levenshtein(t, 'gizma') <= 1)) > 0 OR len(list_filter(string_split(strip_accents(lower(title)), ' '), lambda t: starts_with(t, 'gizma'))) > 0)")
def search_fuzzy(spark, sf_dir):
    return _list(search.search_notices(notices(spark, sf_dir, cpv=True), "Gizmá"))


@query(
    """SELECT p_partkey, (CASE WHEN ' ' || p_name || ' ' LIKE '% red %' THEN 3.0 ELSE 0 END + CASE WHEN len(list_filter(string_split(p_name, ' '), lambda t: levenshtein(t, 'red') <= 1)) > 0 THEN 1.0 ELSE 0 END
    + CASE WHEN len(list_filter(string_split(p_name, ' '), lambda t: starts_with(t, 'red'))) > 0 THEN 1.0 ELSE 0 END) AS score FROM part""",
    bound=False,
)
def search_scores(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", score("red", "p_name").alias("score"))


@query(
    """SELECT * FROM (SELECT 'notice' AS kind, p_name AS label FROM (SELECT DISTINCT p_name FROM part) WHERE len(list_filter(string_split(lower(p_name), ' '), lambda t: starts_with(t, 'bo'))) > 0 ORDER BY p_name LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'supplier' AS kind, s_name AS label FROM (SELECT DISTINCT s_name FROM supplier) WHERE regexp_matches(lower(s_name), '(^|[^a-z0-9])bo') ORDER BY s_name LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'procurer' AS kind, c_name AS label FROM (SELECT DISTINCT c_name FROM customer) WHERE regexp_matches(lower(c_name), '(^|[^a-z0-9])bo') ORDER BY c_name LIMIT 5)""",
    bound=False,
)
def autocomplete(spark, sf_dir):
    parts = {"notice": table(spark, sf_dir, "part").select(F.col("p_name").alias("label")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_name").alias("label")), "procurer": table(spark, sf_dir, "customer").select(F.col("c_name").alias("label"))}
    return search.autocomplete(parts, "bo")


@query(MERGED + " SELECT ico, name, n, CAST(t AS DOUBLE) AS total FROM s ORDER BY n DESC, ico LIMIT 20 OFFSET 5")
def entity_search(spark, sf_dir):
    return search.entity_search(search.entity_table(notices(spark, sf_dir), award_rows(spark, sf_dir), "supplier"), None, None, "count", 20, 5)


@query(MERGED + " SELECT ico, name, n, CASE WHEN lower(name) = 'supplier#000000001' THEN 0 WHEN starts_with(lower(name), 'supplier#000000001') THEN 1 ELSE 2 END AS rank FROM s")
def hit_ranking(spark, sf_dir):
    return search.rank_hits(search.entity_table(notices(spark, sf_dir), award_rows(spark, sf_dir), "supplier"), "Supplier#000000001").select("ico", "name", "n", "rank")


@query(MERGED + " SELECT ico, name, n, 'vector' AS via FROM s WHERE n % 2 = 0 UNION ALL SELECT p.ico, p.name, p.n, 'text' FROM p WHERE p.ico NOT IN (SELECT ico FROM s WHERE n % 2 = 0)")
def hit_merge(spark, sf_dir):
    n, a = notices(spark, sf_dir, names=True), award_rows(spark, sf_dir)
    first = search.entity_table(n, a, "supplier").where("n % 2 = 0").select("ico", "name", "n", F.lit("vector").alias("via"))
    return search.merge_hits(first, search.entity_table(n, a, "procurer").select("ico", "name", "n", F.lit("text").alias("via")))


@query(MERGED + ", u AS (SELECT * FROM s UNION ALL SELECT * FROM p) SELECT 'company' AS kind, ico AS id, name AS label FROM u WHERE ico = '00000007'")
def unified_search_ico(spark, sf_dir):
    n, a = notices(spark, sf_dir, cpv=True, names=True), award_rows(spark, sf_dir)
    entities = search.entity_table(n, a, "supplier").unionByName(search.entity_table(n, a, "procurer"))
    return search.unified(n, entities, "00000007")


VECTOR = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _first_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]


@query(f"WITH {VECTOR} SELECT vec_id, label, round((1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[]))) / 2, 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) DESC, vec_id LIMIT 10", bound=False)
def vector_topk(spark, sf_dir):
    return search.vector_top_k(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {VECTOR}, h AS (SELECT vec_id % 100 AS ico, CASE WHEN vec_id % 2 = 0 THEN 'supplier' ELSE 'procurer' END AS role, max(round((1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[]))) / 2, 6)) AS score FROM embeddings, q GROUP BY 1, 2),
    g AS (SELECT ico // 2 AS ico, role, score FROM h) SELECT ico, coalesce(max(score) FILTER (role = 'supplier'), max(score)) AS score, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM g GROUP BY 1""",
    bound=False,
)
def vector_merge(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _first_vector(spark, sf_dir)])
    hits = v.select(F.col("vec_id") % 100, F.when(F.col("vec_id") % 2 == 0, "supplier").otherwise("procurer").alias("role"), F.round((1 + search.cosine(F.col("embedding"), q)) / 2, 6).alias("score")).toDF("i", "role", "score").groupBy("i", "role").agg(F.max("score").alias("score"))
    return search.merge_roles(hits.select(F.floor(F.col("i") / 2).cast("long").alias("ico"), "role", "score"))


def _now(df, column):
    """The latest time, as a scalar subquery of the plan."""
    return df.agg(F.max(column).cast("timestamp_ntz").alias("now")).scalar()


@query(
    f""", t AS (SELECT max(ingested_at) AS now FROM n), b AS (SELECT source, count(*) AS notices, count(*) FILTER (ingested_at >= now - INTERVAL 1 DAY) AS last_24h, count(*) FILTER (ingested_at >= now - INTERVAL 7 DAY) AS last_7d, max(ingested_at) AS last_ingested, max(publication_date) AS last_published, any_value(now) AS now FROM n, t GROUP BY 1)
    SELECT s.source, coalesce(notices, 0) AS notices, coalesce(last_24h, 0) AS last_24h, coalesce(last_7d, 0) AS last_7d, last_ingested, last_published, CAST(floor(epoch(now - last_ingested) / 86400) AS BIGINT) AS days_since, coalesce(floor(epoch(now - last_ingested) / 86400) > 14, true) AS stale FROM {SOURCE_ROWS} LEFT JOIN b ON b.source = s.source"""
)
def health_by_source(spark, sf_dir):
    n = notices(spark, sf_dir)
    return health.health_by_source(n, _now(n, "ingested_at"), SOURCES)


@query(
    f""", t AS (SELECT max(ingested_at) AS now FROM n), b AS (SELECT source, max(ingested_at) AS l FROM n GROUP BY 1), g AS (SELECT s.source, CAST(epoch(now - l) AS BIGINT) AS age FROM {SOURCE_ROWS} LEFT JOIN b ON b.source = s.source CROSS JOIN t)
    SELECT source, CASE WHEN age <= 86400 THEN 'healthy' WHEN age <= 172800 THEN 'warning' ELSE 'error' END AS status, CASE WHEN age IS NULL THEN 'never' WHEN age >= 86400 THEN CAST(age // 86400 AS VARCHAR) || 'd' WHEN age >= 3600 THEN CAST(age // 3600 AS VARCHAR) || 'h' ELSE CAST(age // 60 AS VARCHAR) || 'm' END AS age FROM g"""
)
def source_status(spark, sf_dir):
    n = notices(spark, sf_dir)
    now = _now(n, "ingested_at")
    return health.source_status(health.health_by_source(n, now, SOURCES), now)


@query("SELECT source, count(*) AS entries, CAST(sum(skipped_count) AS BIGINT) AS skips, max(last_seen_at) AS last_seen FROM reg GROUP BY 1")
def registry_stats(spark, sf_dir):
    return health.registry_stats(registry(spark, sf_dir))


@query(", d AS (SELECT source, (SELECT count(*) FROM reg WHERE reg.source = n.source) - count(*) AS drift FROM n GROUP BY source) SELECT source, drift, CASE WHEN abs(drift) >= 1000 THEN 'error' WHEN abs(drift) >= 100 THEN 'warning' ELSE 'ok' END AS level FROM d")
def registry_drift(spark, sf_dir):
    return health.drift(registry(spark, sf_dir), notices(spark, sf_dir))


@query(
    f""", t AS (SELECT CAST(max(ingested_at) AS DATE) AS last FROM n), g AS (SELECT last - CAST(i AS INTEGER) AS day, s.source FROM t, range(30) AS r(i), {SOURCE_ROWS}),
    c2 AS (SELECT CAST(ingested_at AS DATE) AS day, source, count(*) AS n FROM n GROUP BY 1, 2) SELECT g.day, g.source, coalesce(c2.n, 0) AS n FROM g LEFT JOIN c2 ON c2.day = g.day AND c2.source = g.source"""
)
def daily_grid(spark, sf_dir):
    n = notices(spark, sf_dir)
    return health.daily_grid(n, F.to_date(_now(n, "ingested_at")), SOURCES)


@query("SELECT count(*) AS notices, count(*) FILTER (notice_id % 3 = 0) AS linked, round(count(*) FILTER (notice_id % 3 = 0) / count(*), 4) AS match_rate FROM n")
def health_totals(spark, sf_dir):
    return health.totals(notices(spark, sf_dir).withColumn("canonical_id", F.when(F.col("notice_id") % 3 == 0, "x")))


@query("SELECT 'run-' || CAST(year(ingested_at) AS VARCHAR) AS pipeline_run_id, ingested_at FROM (SELECT max(ingested_at) AS ingested_at FROM n)")
def latest_run(spark, sf_dir):
    return health.latest_run(notices(spark, sf_dir).withColumn("pipeline_run_id", F.concat(F.lit("run-"), F.year("ingested_at").cast("string"))))


#: A notice as JSON without its null fields, as Spark writes it.
AS_JSON = """json_merge_patch('{}', json_object('notice_id', notice_id, 'source', source, 'source_id', source_id, 'notice_type', notice_type, 'status', status,
    'procurer_ico', procurer_ico, 'final_value', final_value, 'estimated_value', estimated_value, 'publication_date', CAST(publication_date AS VARCHAR),
    'award_date', CAST(award_date AS VARCHAR), 'procedure_type', procedure_type, 'ingested_at', strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%g')))"""


@query(f"SELECT source, CAST(sum(strlen(CAST({AS_JSON} AS VARCHAR))) AS BIGINT) AS bytes FROM n GROUP BY 1")
def bytes_by_source(spark, sf_dir):
    return health.bytes_by_source(notices(spark, sf_dir))


@query("SELECT event_id, ts, level, event, component, source, (SELECT count(*) FROM log WHERE level = 'error' AND source = 'ted') AS total_rows FROM log WHERE level = 'error' AND source = 'ted' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10")
def log_page(spark, sf_dir):
    return health.log_page(event_log(spark, sf_dir), level="error", source="ted", offset=10).select("event_id", "ts", "level", "event", "component", "source", "total_rows")


COMPONENTS = health.COMPONENTS


@query(
    f""", t AS (SELECT max(ts) AS now FROM log), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn = 1),
    r AS (SELECT component, count(*) AS s FROM log, t WHERE ts >= now - INTERVAL 1 DAY AND event IN ('cycle_complete', 'batch_written') GROUP BY 1)
    SELECT k.component, CASE WHEN l.event IS NULL THEN 'unknown' WHEN level IN ('error', 'critical') OR l.event IN ('cycle_failed', 'write_failed', 'redis_connect_failed') THEN 'error'
    WHEN l.event = 'worker_stopped' THEN 'stopped' WHEN epoch(now - l.ts) > CASE WHEN k.component IN ('ingestor', 'dedup-worker') THEN 600 ELSE 7200 END THEN 'stale' ELSE 'healthy' END AS status,
    l.event AS last_event, l.ts AS last_ts, coalesce(r.s, 0) AS successes_24h FROM (VALUES {', '.join(f"('{c}')" for c in COMPONENTS)}) AS k(component) LEFT JOIN l ON l.component = k.component LEFT JOIN r ON r.component = k.component CROSS JOIN t"""
)
def worker_status(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return health.worker_status(log, _now(log, "ts"))


@query("SELECT user_id AS key, date_trunc('minute', ts) AS minute, count(*) AS n, count(*) > 1 AS limited FROM log GROUP BY 1, 2")
def rate_window_counts(spark, sf_dir):
    return health.rate_windows(event_log(spark, sf_dir), "user_id", limit=1)


@query("SELECT lpad(CAST(c_nationkey AS VARCHAR), 8, '0') AS ico, count(DISTINCT c_mktsegment) AS names FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1", bound=False)
def ico_collisions(spark, sf_dir):
    return health.ico_collisions(table(spark, sf_dir, "customer").select(ico("c_nationkey").alias("ico"), F.col("c_mktsegment").alias("name")))


@query(
    f""", x AS (SELECT ico FROM ({TOP.format("a.notice_id NOT IN (SELECT notice_id FROM a WHERE supplier_ico IS NULL)")} ORDER BY total DESC, ico LIMIT 20)), y AS (SELECT ico FROM ({TOP.format("a.supplier_ico IS NOT NULL")} ORDER BY total DESC, ico LIMIT 20))
    SELECT ico, 'common' AS side FROM x WHERE ico IN (SELECT ico FROM y) UNION ALL SELECT ico, 'missing' FROM y WHERE ico NOT IN (SELECT ico FROM x) UNION ALL SELECT ico, 'false' FROM x WHERE ico NOT IN (SELECT ico FROM y)"""
)
def topn_overlap(spark, sf_dir):
    from ..operators.spend import top_suppliers

    n, a = notices(spark, sf_dir), award_rows(spark, sf_dir)
    return health.overlap(top_suppliers(n, a, 20), top_suppliers(n, a, 20, strict=False))


@query("SELECT ' ' || k || chr(9) AS ico, k AS clean FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS k, c_custkey AS i FROM customer) WHERE i % 7 = 0 AND i % 2 = 1", bound=False)
def ico_trim_repair(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    dirty = c.where("c_custkey % 7 = 0").select(F.concat(F.lit(" "), ico("c_custkey"), F.lit("\t")).alias("ico"))
    return health.trim_repair(dirty.unionByName(c.where("c_custkey % 2 = 0").select(ico("c_custkey").alias("ico"))))


SHIFTED = "CASE WHEN notice_id % 97 = 0 THEN publication_date + INTERVAL 900 YEAR WHEN notice_id % 89 = 0 THEN publication_date - INTERVAL 90 YEAR ELSE publication_date END"


def _shifted(spark, sf_dir):
    k = F.col("notice_id")
    shift = F.when(k % 97 == 0, 12 * 900).when(k % 89 == 0, -12 * 90).otherwise(0)
    return notices(spark, sf_dir).withColumn("publication_date", F.add_months("publication_date", shift))


@query(f", x AS (SELECT notice_id, CAST({SHIFTED} AS DATE) AS p FROM n) SELECT notice_id, CASE WHEN year(p) BETWEEN 1995 AND 2031 THEN p END AS publication_date FROM x")
def date_clamp(spark, sf_dir):
    return health.clamp_dates(_shifted(spark, sf_dir), 2026).select("notice_id", "publication_date")


@query(f", x AS (SELECT notice_id, CAST({SHIFTED} AS DATE) AS p FROM n) SELECT notice_id, 'publication_date' AS field, CAST(year(p) AS INTEGER) AS year, CASE WHEN year(p) < 1995 THEN 'too_early' ELSE 'too_late' END AS reason FROM x WHERE year(p) NOT BETWEEN 1995 AND 2031")
def date_issues(spark, sf_dir):
    return health.date_issues(_shifted(spark, sf_dir), 2026)


@query(f", x AS (SELECT notice_id, CAST({SHIFTED} AS DATE) AS p FROM n) SELECT notice_id FROM x WHERE p < DATE '2000-01-01' OR p > DATE '2100-01-01'")
def date_repair_candidates(spark, sf_dir):
    return health.implausible(_shifted(spark, sf_dir)).select("notice_id")


@query("SELECT p_partkey, trim(regexp_replace(strip_accents(lower(p_name || ' – Žilina & ' || p_brand)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part", bound=False)
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", slugify(F.concat("p_name", F.lit(" – Žilina & "), "p_brand")).alias("slug"))


@query("SELECT notice_id, rpad(substr(coalesce(cpv_code, ''), 1, 8), 8, '0') AS prefix, CASE WHEN year(publication_date) >= 2024 THEN 'active' ELSE 'closed' END AS status, CAST(year(publication_date) AS INTEGER) AS year FROM n")
def derived_columns(spark, sf_dir):
    n = notices(spark, sf_dir, cpv=True).withColumn("year", year_from_date("publication_date", 2026))
    return n.select("notice_id", cpv_prefix().alias("prefix"), status_from_year("year").alias("status"), "year")


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events", bound=False)
def date_prefixes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", date_prefix(F.col("ts").cast("string")).alias("day"))

"""Canonical tables read from the supplied star schema: notices, awards, event log, resolution batches.

Nothing here is an operator; on real data `sources.transforms` makes the same columns from raw records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify

#: Two-digit divisions by kind of part; fixed values of this binding.
DIVISIONS = {"ECONOMY": "30", "STANDARD": "45", "PROMO": "72", "SMALL": "33", "MEDIUM": "79"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ico(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 8, "0")


def award_rows(spark: SparkSession, sf_dir: str, names: bool = True) -> DataFrame:
    """(notice_id, pos, supplier_ico, supplier_name, award_value, signing_date), one row an award."""
    lines = table(spark, sf_dir, "lineitem")
    if names:
        lines = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return lines.select(
        F.col("l_orderkey").alias("notice_id"),
        (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("pos"),
        F.when(F.col("l_partkey") % 17 != 0, ico("l_suppkey")).alias("supplier_ico"),
        *[F.col("s_name").alias("supplier_name")] * names,
        F.col("l_extendedprice").alias("award_value"),
        F.to_date("l_shipdate").alias("signing_date"),
    )


def first_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(notice_id, title, code) from the part with the smallest key of each order."""
    division = F.create_map(*[F.lit(x) for pair in DIVISIONS.items() for x in pair])
    least = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("notice_id")).agg(F.min("l_partkey").alias("k"))
    code = F.concat(F.coalesce(F.try_element_at(division, F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit("90")), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("0000"))
    return least.join(table(spark, sf_dir, "part"), F.col("k") == F.col("p_partkey")).select("notice_id", F.col("p_name").alias("title"), code.alias("code"))


def notices(spark: SparkSession, sf_dir: str, cpv: bool = False, names: bool = False) -> DataFrame:
    """One row a notice; `cpv` adds title and cpv_code, which need the line items, `names` the procurer's."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    if names:
        o = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if cpv:
        o = o.join(first_parts(spark, sf_dir), k == F.col("notice_id"), "left").drop("notice_id")
    published = F.to_date("o_orderdate")
    out = o.select(
        k.alias("notice_id"),
        F.element_at(F.array(*map(F.lit, ("vestnik", "crz", "ted", "itms"))), (k % 4 + 1).cast("int")).alias("source"),
        k.cast("string").alias("source_id"),
        F.when(F.col("o_orderstatus") == "O", "contract_notice").otherwise("contract_award").alias("notice_type"),
        F.when(F.col("o_orderstatus") == "O", "announced").otherwise("awarded").alias("status"),
        F.when(F.col("o_custkey") % 11 != 0, ico("o_custkey")).alias("procurer_ico"),
        *([F.col("c_name").alias("procurer_name"), ico("c_nationkey").alias("authority_ico")] if names else []),
        *([F.when(k % 13 != 0, F.col("code")).alias("cpv_code"), F.coalesce("title", F.lit("untitled")).alias("title")] if cpv else []),
        F.when(k % 10 != 0, F.col("o_totalprice")).alias("final_value"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("estimated_value"),
        published.alias("publication_date"),
        F.when(k % 3 != 0, F.date_add(published, 5)).alias("award_date"),
        F.when(F.col("o_orderpriority") == "5-LOW", "framework agreement").otherwise("open").alias("procedure_type"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"))).alias("ingested_at"),
    )
    return out.withColumn("title_slug", slugify("title")) if cpv else out


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as an ingestion log: event types by kind, one component for each of five users' remainders."""
    name = {"view": "worker_started", "click": "cycle_complete", "signup": "batch_written", "purchase": "worker_stopped", "error": "cycle_failed"}
    names = F.create_map(*[F.lit(x) for pair in name.items() for x in pair])
    components = F.array(*map(F.lit, ("extractor:crz", "extractor:itms", "extractor:ted", "ingestor", "dedup-worker")))
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        "ts",
        F.when(F.col("event_type") != "error", "info").when(F.col("event_id") % 3 == 0, "critical").when(F.col("event_id") % 3 == 1, "error").otherwise("warning").alias("level"),
        F.try_element_at(names, F.col("event_type")).alias("event"),
        F.element_at(components, (F.col("user_id") % 5 + 1).cast("int")).alias("component"),
        F.element_at(F.array(*map(F.lit, ("vestnik", "crz", "ted", "itms"))), (F.col("event_id") % 4 + 1).cast("int")).alias("source"),
        F.col("value"),
        "user_id",
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, source_id, content_hash, last_seen_at, skipped_count) of every notice whose key is no multiple of five."""
    n = notices(spark, sf_dir)
    return n.where(F.col("notice_id") % 5 != 0).select("source", "source_id", F.sha2(F.concat_ws("|", "source_id", F.col("final_value").cast("decimal(18,2)").cast("string")), 256).alias("content_hash"), F.col("ingested_at").alias("last_seen_at"), (F.col("notice_id") % 3).alias("skipped_count"))


#: The same tables in DuckDB's SQL, for the oracle: a (awards), c (first parts), n (notices), log, reg.
SQL = """
WITH a AS (SELECT l_orderkey AS notice_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS pos,
  CASE WHEN l_partkey % 17 <> 0 THEN lpad(CAST(l_suppkey AS VARCHAR), 8, '0') END AS supplier_ico, s_name AS supplier_name,
  l_extendedprice AS award_value, CAST(l_shipdate AS DATE) AS signing_date
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey),
c AS (SELECT m.notice_id, p_name AS part_title, CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN '30' WHEN 'STANDARD' THEN '45'
  WHEN 'PROMO' THEN '72' WHEN 'SMALL' THEN '33' WHEN 'MEDIUM' THEN '79' ELSE '90' END || lpad(CAST(p_size AS VARCHAR), 2, '0') || '0000' AS code
  FROM (SELECT l_orderkey AS notice_id, min(l_partkey) AS k FROM lineitem GROUP BY 1) m JOIN part ON k = p_partkey),
n AS (SELECT o_orderkey AS notice_id, CASE o_orderkey % 4 WHEN 0 THEN 'vestnik' WHEN 1 THEN 'crz' WHEN 2 THEN 'ted' ELSE 'itms' END AS source,
  CAST(o_orderkey AS VARCHAR) AS source_id, CASE WHEN o_orderstatus = 'O' THEN 'contract_notice' ELSE 'contract_award' END AS notice_type,
  CASE WHEN o_orderstatus = 'O' THEN 'announced' ELSE 'awarded' END AS status,
  CASE WHEN o_custkey % 11 <> 0 THEN lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS procurer_ico, c_name AS procurer_name,
  lpad(CAST(c_nationkey AS VARCHAR), 8, '0') AS authority_ico, CASE WHEN o_orderkey % 13 <> 0 THEN code END AS cpv_code,
  coalesce(part_title, 'untitled') AS title, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS final_value,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS estimated_value, CAST(o_orderdate AS DATE) AS publication_date,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 5 END AS award_date,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'framework agreement' ELSE 'open' END AS procedure_type,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS ingested_at
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN c ON c.notice_id = o_orderkey),
v AS (SELECT *, CAST(coalesce(final_value, 0) AS DECIMAL(18,2)) AS fin, CAST(coalesce(final_value, estimated_value, 0) AS DECIMAL(18,2)) AS val,
  coalesce(award_date, publication_date) AS d, coalesce(substr(CAST(coalesce(award_date, publication_date) AS VARCHAR), 1, 4), '0000') AS year FROM n),
log AS (SELECT event_id, ts, CASE WHEN event_type <> 'error' THEN 'info' WHEN event_id % 3 = 0 THEN 'critical' WHEN event_id % 3 = 1 THEN 'error' ELSE 'warning' END AS level,
  CASE event_type WHEN 'view' THEN 'worker_started' WHEN 'click' THEN 'cycle_complete' WHEN 'signup' THEN 'batch_written' WHEN 'purchase' THEN 'worker_stopped'
  WHEN 'error' THEN 'cycle_failed' END AS event,
  CASE user_id % 5 WHEN 0 THEN 'extractor:crz' WHEN 1 THEN 'extractor:itms' WHEN 2 THEN 'extractor:ted' WHEN 3 THEN 'ingestor' ELSE 'dedup-worker' END AS component,
  CASE event_id % 4 WHEN 0 THEN 'vestnik' WHEN 1 THEN 'crz' WHEN 2 THEN 'ted' ELSE 'itms' END AS source, value, user_id FROM events),
reg AS (SELECT source, source_id, ingested_at AS last_seen_at, notice_id % 3 AS skipped_count FROM n WHERE notice_id % 5 <> 0)
"""

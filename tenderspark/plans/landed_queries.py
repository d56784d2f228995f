"""Queries over landed copies of the tables: paged and capped sources, and the readers of raw files."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import to_iso_z
from ..operators import health, repairs, upsert
from ..sources import capped, readers, scans
from ..sources.binding import event_log, notices, table
from ..streaming import live
from ..streaming.ingest import scratch
from .registry import once, query

ITEM = "o_orderkey BIGINT, o_totalprice DOUBLE"


def _scan_rows(spark, sf_dir):
    """Orders as scans of three sources: one scan a year, items by key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").cast("string").alias("scan"), F.element_at(F.array(*map(F.lit, ("crz", "itms", "ted"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("source"))
    by = o.groupBy("source", "scan", "o_orderkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    bucket = F.pmod(F.xxhash64("o_orderkey"), F.lit(64))
    counted = by.withColumn("bucket", bucket)
    # places within a scan: the bucket's offset and the rank in it, so that no scan is sorted in one task
    sizes = counted.groupBy("source", "scan", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("source", "scan").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("source", "scan", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("source", "scan", "bucket").orderBy("o_orderkey"))
    placed = counted.withColumn("rank", rank).join(offsets, ["source", "scan", "bucket"])
    return placed.select("source", "scan", (F.col("offset") + F.col("rank") - 1).alias("at"), F.to_json(F.struct("o_orderkey", "o_totalprice")).alias("value"))


def _streamed_scans(spark, sf_dir):
    """What a stream over the scans has written after three runs with a restart between them: the scans up to 1995; then those of 1996
    and later, of which the one of 1996 of one source lacks its end; then the same again, with nothing new to read."""
    folder = scratch(spark)
    _scan_rows(spark, sf_dir).write.parquet(f"{folder}/rows")  # placed once, read by every landing
    rows = spark.read.parquet(f"{folder}/rows")
    for part, broken in (("scan <= '1995'", "false"), ("scan > '1995'", "source = 'itms' AND scan = '1996'"), ("false", "false")):
        whole = rows.where(part)
        scans.land(whole.where(f"NOT ({broken})"), f"{folder}/in", 200)
        unfinished = whole.where(broken).groupBy("source", "scan").agg(F.max("value").alias("v"))
        text = F.concat(F.lit('{"items": ['), "v", F.lit('], "next": 1}'))
        unfinished.select("source", "scan", F.lit(0).alias("page"), text.alias("value")).write.mode("append").partitionBy("source", "scan", "page").text(f"{folder}/in")
        stream = scans.read_scans(spark, f"{folder}/in", keep=2)
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(
    """SELECT ['crz', 'itms', 'ted'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS source, CAST(year(o_orderdate) AS VARCHAR) AS scan, o_orderkey, o_totalprice FROM orders
    WHERE o_orderkey % 3 <> 1 OR year(o_orderdate) <= 1995""",
    bound=False,
)
def stream_scans(spark, sf_dir):
    """All items of complete scans once; nothing of a source from its first incomplete scan on."""
    return once(spark, sf_dir, _streamed_scans).select("source", "scan", F.from_json("value", ITEM).alias("v")).select("source", "scan", "v.*")


def _orders_by_day(spark, sf_dir):
    folder = f"{scratch(spark)}/orders"
    capped.land_by_day(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), folder, "o_orderdate", "o_orderkey")
    return folder


def _dated_orders(spark, sf_dir, **options):
    return capped.read_capped(spark, once(spark, sf_dir, _orders_by_day), "o_orderdate", "o_orderkey", "o_orderkey bigint, o_orderdate timestamp, o_totalprice double", **options)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= DATE '1995-06-01' AND o_orderdate < DATE '1997-01-01'", bound=False)
def capped_read(spark, sf_dir):
    """A range that holds more rows than the upstream gives out for one query."""
    o = _dated_orders(spark, sf_dir, cap=500)
    return o.where((F.col("o_orderdate") >= F.lit(datetime.date(1995, 6, 1)).cast("timestamp")) & (F.col("o_orderdate") < F.lit(datetime.date(1997, 1, 1)).cast("timestamp"))).withColumn("o_orderdate", F.to_date("o_orderdate"))


@query(
    """, x AS (SELECT DISTINCT year(publication_date) AS y FROM n WHERE source = 'ted' AND notice_type = 'contract_award' AND notice_id % 3 <> 0 AND publication_date < DATE '1996-01-01')
    SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) IN (SELECT y FROM x)"""
)
def backfill_read(spark, sf_dir):
    """All upstream rows of the years that lack awards."""
    n = notices(spark, sf_dir).where("publication_date < DATE '1996-01-01'")
    years = repairs.years_to_backfill(n, n.where("notice_id % 3 = 0").select("notice_id"))
    return _dated_orders(spark, sf_dir, cap=capped.CAP, spans=repairs.spans_to_read(years)).select("o_orderkey", "o_totalprice")


def _landed_crz(spark, sf_dir):
    folder = f"{scratch(spark)}/crz"
    o = table(spark, sf_dir, "orders")
    o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Zmluva "), "o_orderkey").alias("subject"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"), F.col("o_totalprice").cast("string").alias("contract_price_total_amount")).write.json(folder)
    return folder


@query("SELECT o_orderkey AS id, 'Zmluva ' || o_orderkey AS subject, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS published_at FROM orders WHERE o_orderdate >= DATE '1996-01-01'", bound=False)
def landed_crz(spark, sf_dir):
    return readers.read_crz(spark, once(spark, sf_dir, _landed_crz), "1996-01-01").select("id", "subject", "published_at")


@query("SELECT o_orderkey AS id, 'Zmluva ' || o_orderkey AS subject FROM orders WHERE o_orderkey = 7", bound=False)
def landed_crz_by_id(spark, sf_dir):
    return readers.crz_by_id(spark, once(spark, sf_dir, _landed_crz), 7).select("id", "subject")


def _landed_ted(spark, sf_dir):
    folder = f"{scratch(spark)}/ted"
    o = table(spark, sf_dir, "orders")
    line = F.to_json(F.struct(F.col("o_orderkey").alias("publication-number"), F.col("o_totalprice").alias("total-value")))
    o.select(F.when(F.col("o_orderkey") % 40 == 0, "{broken").otherwise(line).alias("value")).write.text(folder)
    return folder


@query("SELECT o_orderkey AS number, o_totalprice AS total FROM orders WHERE o_orderkey % 40 <> 0", bound=False)
def landed_ted(spark, sf_dir):
    raw = readers.read_ted(spark, once(spark, sf_dir, _landed_ted))
    return raw.select(F.variant_get("raw", "$['publication-number']", "bigint").alias("number"), F.variant_get("raw", "$['total-value']", "double").alias("total"))


@query("SELECT o_custkey, o_orderstatus, count(*) AS count FROM orders GROUP BY ALL HAVING count(*) > 1", bound=False)
def duplicate_order_keys(spark, sf_dir):
    return upsert.duplicate_keys(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query("SELECT event_id, CAST(event_ts AS DATE) AS day FROM (SELECT event_id, ts AS event_ts FROM events) WHERE event_ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY", bound=False)
def retained_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("ts")).scalar()
    return upsert.retained(e, now, 7).select("event_id", F.to_date("ts").alias("day"))


@query("SELECT notice_id, publication_date FROM n WHERE publication_date IS NULL OR publication_date < DATE '2000-01-01' OR publication_date > DATE '2100-01-01'")
def implausible_dates(spark, sf_dir):
    return health.implausible(notices(spark, sf_dir)).select("notice_id", "publication_date")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders", bound=False)
def iso_times(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", to_iso_z("o_orderdate").alias("at"))


def _followed_log(spark, sf_dir):
    """The changes that a stream over the event log has told in two runs: over the first half of its time, then the rest."""
    folder = scratch(spark)
    log = event_log(spark, sf_dir).select("event_id", "ts", "level", "event", "component")
    middle = log.agg(F.timestamp_micros(((F.unix_micros(F.min("ts").cast("timestamp")) + F.unix_micros(F.max("ts").cast("timestamp"))) / 2).cast("long")).cast("timestamp_ntz").alias("middle"))
    halves = log.crossJoin(F.broadcast(middle)).withColumn("early", F.col("ts") < F.col("middle")).drop("middle")  # one row
    for early in (True, False):
        halves.where(F.col("early") == early).drop("early").write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{folder}/log")
        live.follow(stream, f"{folder}/changes", f"{folder}/offsets", 3600).awaitTermination()
    return spark.read.parquet(f"{folder}/changes")


@query(
    f""", t AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS now FROM log), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn = 1),
    r AS (SELECT component, count(*) AS s FROM log, t WHERE ts >= now - INTERVAL 1 DAY AND event IN ('cycle_complete', 'batch_written') GROUP BY 1)
    SELECT k.component, CASE WHEN l.event IS NULL THEN 'unknown' WHEN level IN ('error', 'critical') OR l.event IN ('cycle_failed', 'write_failed', 'redis_connect_failed') THEN 'error'
    WHEN l.event = 'worker_stopped' THEN 'stopped' WHEN epoch(now - l.ts) > CASE WHEN k.component IN ('ingestor', 'dedup-worker') THEN 600 ELSE 7200 END THEN 'stale' ELSE 'healthy' END AS status,
    l.event AS last_event, l.ts AS last_ts, coalesce(r.s, 0) AS successes_24h FROM (VALUES {', '.join(f"('{c}')" for c in health.COMPONENTS)}) AS k(component) LEFT JOIN l ON l.component = k.component LEFT JOIN r ON r.component = k.component CROSS JOIN t"""
)
def stream_worker_status(spark, sf_dir):
    """The live status after a replay of the log equals the batch status at the stream's clock, an hour before its end."""
    return live.current_status(once(spark, sf_dir, _followed_log))

"""Ingestion health, event log, worker status, repairs. Clocks are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clamp_date, human_age

STALE_DAYS = 14
#: Kinds of events and levels in the log, components with the seconds after which each is stale, events that are failures
#: whatever their level, and those that count as success; fixed values.
EVENTS = (
    "worker_started", "worker_stopped", "cycle_complete", "cycle_failed", "batch_written", "decode_failed", "write_failed",
    "redis_connect_failed", "notice_invalid_date", "validation_summary", "index_bootstrap_failed",
)
LEVELS = ("info", "warning", "error", "critical")
STALE_SECONDS = {"extractor:vestnik": 7200, "extractor:crz": 7200, "extractor:ted": 7200, "extractor:itms": 7200, "ingestor": 600, "dedup-worker": 600}
COMPONENTS = tuple(STALE_SECONDS)
FAILURES = ("cycle_failed", "write_failed", "redis_connect_failed")
SUCCESS = ("cycle_complete", "batch_written")
#: Colours of drift between registry and notices.
DRIFT_BANDS = (100, 1000)


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) / 1_000_000 - F.unix_micros(earlier.cast("timestamp")) / 1_000_000


def sources_frame(spark: SparkSession, sources: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(s,) for s in sources], "source string")


def health_by_source(notices: DataFrame, now: Column, sources: tuple[str, ...]) -> DataFrame:
    """Per source, zero rows included: counts, last sight, days since, stale or not."""

    def since(days: int) -> Column:
        return F.col("ingested_at") >= now - F.make_dt_interval(F.lit(days))

    by = notices.groupBy("source").agg(F.count(F.lit(1)).alias("notices"), F.max("ingested_at").alias("last_ingested"), F.max("publication_date").alias("last_published"), F.count_if(since(1)).alias("last_24h"), F.count_if(since(7)).alias("last_7d"))
    days = F.floor(seconds_between(now, F.col("last_ingested")) / 86400)
    return sources_frame(notices.sparkSession, sources).join(by, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("notices", "last_24h", "last_7d")], "last_ingested", "last_published", days.cast("long").alias("days_since"), F.coalesce(days > STALE_DAYS, F.lit(True)).alias("stale"))


def bytes_by_source(notices: DataFrame) -> DataFrame:
    """Bytes of the notices as JSON."""
    return notices.groupBy("source").agg(F.sum(F.octet_length(F.to_json(F.struct(*notices.columns)))).alias("bytes"))


def registry_stats(registry: DataFrame) -> DataFrame:
    return registry.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.sum("skipped_count").alias("skips"), F.max("last_seen_at").alias("last_seen"))


def latest_run(notices: DataFrame) -> DataFrame:
    return notices.agg(F.max_by("pipeline_run_id", "ingested_at").alias("pipeline_run_id"), F.max("ingested_at").alias("ingested_at"))


def totals(notices: DataFrame) -> DataFrame:
    """Counts, canonical links, and the match rate to four digits."""
    return notices.agg(F.count(F.lit(1)).alias("notices"), F.count_if(F.col("canonical_id").isNotNull()).alias("linked")).withColumn("match_rate", F.when(F.col("notices") > 0, F.round(F.col("linked") / F.col("notices"), 4)).otherwise(0.0))


def drift(registry_: DataFrame, notices: DataFrame) -> DataFrame:
    """Registry entries minus notices, by source, with a band; sources without notices too."""
    d = registry_stats(registry_).select("source", "entries").join(notices.groupBy("source").agg(F.count(F.lit(1)).alias("notices")), "source", "full_outer").select("source", (F.coalesce("entries", F.lit(0)) - F.coalesce("notices", F.lit(0))).alias("drift"))
    return d.withColumn("level", F.when(F.abs("drift") >= DRIFT_BANDS[1], "error").when(F.abs("drift") >= DRIFT_BANDS[0], "warning").otherwise("ok"))


def daily_grid(notices: DataFrame, last_day: Column, sources: tuple[str, ...], days: int = 30) -> DataFrame:
    """Counts by day and source, with zeros: a calendar of `days` x sources rows joined with the counts."""
    calendar = notices.sparkSession.range(days).select(F.date_sub(last_day, F.col("id").cast("int")).alias("day"))
    grid = calendar.crossJoin(F.broadcast(sources_frame(notices.sparkSession, sources)))
    counts = notices.where((F.col("ingested_at") >= F.date_sub(last_day, days - 1).cast("timestamp_ntz")) & (F.col("ingested_at") < F.date_add(last_day, 1).cast("timestamp_ntz"))).groupBy(F.to_date("ingested_at").alias("day"), "source").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["day", "source"], "left").select("day", "source", F.coalesce("n", F.lit(0)).alias("n"))


def source_status(health: DataFrame, now: Column) -> DataFrame:
    """healthy under 24 hours, warning under 48, else error; no data is an error. Ages as text."""
    age = seconds_between(now, F.col("last_ingested"))
    return health.select("source", F.when(age <= 24 * 3600, "healthy").when(age <= 48 * 3600, "warning").otherwise("error").alias("status"), human_age(age).alias("age"))


def log_page(log: DataFrame, level: str | None = None, source: str | None = None, event: str | None = None, component: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The newest rows that meet all bounds, with the number of all of them."""
    rows = log
    for name, value in (("level", level), ("source", source), ("event", event), ("component", component)):
        rows = rows.where(F.col(name) == value) if value is not None else rows
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    return rows.orderBy(F.desc("ts"), "event_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def last_events(log: DataFrame) -> DataFrame:
    """The last row of each component, as a maximum that is combined before the shuffle."""
    last = log.groupBy("component").agg(F.max(F.struct("ts", "event_id", "event", "level")).alias("l"))
    return last.select("component", "l.*")


def status_of(event: Column, level: Column, age: Column, component: Column) -> Column:
    """What a component's last event says: error over stopped over stale over healthy, unknown without an event."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in STALE_SECONDS.items() for x in pair]), component), F.lit(7200))
    failed = event.isin(*FAILURES) | level.isin("error", "critical")
    return F.when(event.isNull(), "unknown").when(failed, "error").when(event == "worker_stopped", "stopped").when(age > limit, "stale").otherwise("healthy")


def worker_status(log: DataFrame, now: Column, components: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """The status of each component by its last event, and its successes in the last day."""
    recent = log.where((F.col("ts") >= now - F.make_dt_interval(F.lit(1))) & F.col("event").isin(*SUCCESS)).groupBy("component").agg(F.count(F.lit(1)).alias("successes"))
    known = log.sparkSession.createDataFrame([(c,) for c in components], "component string")
    age = seconds_between(now, F.col("ts"))
    status = status_of(F.col("event"), F.col("level"), age, F.col("component"))
    told = known.join(last_events(log.where(F.col("component").isin(*components))), "component", "left").join(recent, "component", "left")
    return told.select("component", status.alias("status"), F.col("event").alias("last_event"), F.col("ts").alias("last_ts"), F.coalesce("successes", F.lit(0)).alias("successes_24h"))


def rate_windows(requests: DataFrame, key: str, ts: str = "ts", limit: int = 30) -> DataFrame:
    """Requests by key and minute, and whether they exceed the limit."""
    by = requests.groupBy(F.col(key).alias("key"), F.date_trunc("minute", ts).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("limited", F.col("n") > limit)


def ico_collisions(entities: DataFrame) -> DataFrame:
    """ICOs under which several names stand, with their number."""
    return entities.groupBy("ico").agg(F.count_distinct("name").alias("names")).where("names > 1")


def overlap(shown: DataFrame, true: DataFrame) -> DataFrame:
    """Of two lists of ICOs: common, missing and false ones."""
    a, b = shown.select("ico").distinct(), true.select("ico").distinct()
    return a.intersect(b).withColumn("side", F.lit("common")).unionByName(b.subtract(a).withColumn("side", F.lit("missing"))).unionByName(a.subtract(b).withColumn("side", F.lit("false")))


def trim_repair(entities: DataFrame) -> DataFrame:
    """(ico, clean) of ICOs with white space, without those whose clean form exists already."""
    dirty = entities.where(F.col("ico").rlike(r"\s")).select("ico", F.regexp_replace("ico", r"\s", "").alias("clean")).distinct()
    clean = entities.where(~F.col("ico").rlike(r"\s")).select(F.col("ico").alias("clean")).distinct()
    return dirty.join(clean, "clean", "left_anti").select("ico", "clean")


def clamp_dates(notices: DataFrame, now_year: int, fields: tuple[str, ...] = ("publication_date", "deadline_date", "award_date")) -> DataFrame:
    """Dates outside the plausible years become null."""
    return notices.withColumns({f: clamp_date(f, now_year) for f in fields if f in notices.columns})


def date_issues(notices: DataFrame, now_year: int, fields: tuple[str, ...] = ("publication_date", "deadline_date", "award_date"), key: str = "notice_id") -> DataFrame:
    """(key, field, year, reason) of each date that clamping takes away; awards' signing dates with their path."""
    present = [f for f in fields if f in notices.columns]
    issue = [F.when(F.col(f).isNotNull() & clamp_date(f, now_year).isNull(), F.struct(F.lit(f).alias("field"), F.year(f).alias("year"))) for f in present]
    found = F.array(*issue)
    if "awards" in notices.columns:
        dated = F.transform("awards", lambda a, i: F.when(a["signing_date"].isNotNull() & clamp_date(a["signing_date"], now_year).isNull(), F.struct(F.concat(F.lit("awards."), i.cast("string"), F.lit(".signing_date")).alias("field"), F.year(a["signing_date"]).alias("year"))))
        found = F.concat(found, F.coalesce(dated, F.array()))
    return notices.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select(key, "i.field", "i.year", F.when(F.col("i.year") < 1995, "too_early").otherwise("too_late").alias("reason"))


def implausible(notices: DataFrame, field: str = "publication_date") -> DataFrame:
    """Rows whose date is missing, before 2000 or after 2100, for a repair from the raw records."""
    return notices.where(F.col(field).isNull() | (F.col(field) < F.lit("2000-01-01").cast("date")) | (F.col(field) > F.lit("2100-01-01").cast("date")))


def backfill_slug(notices: DataFrame) -> DataFrame:
    from ..functions.text import slugify

    return notices.withColumn("title_slug", F.coalesce("title_slug", slugify("title")))


def collapse_sources(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def report_json(health: DataFrame) -> DataFrame:
    """The health report as one JSON text a source."""
    return health.select("source", F.to_json(F.struct(*health.columns)).alias("report"))

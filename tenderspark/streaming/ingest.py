"""The ingest loop as one streaming query: parse, dead-letter, clamp, upsert notices, registry, entities, edges and the
companies' statistics, each batch idempotent. Statistics and edges follow from what a batch changes in its own notices:
their old versions count with a minus, the new ones with a plus, and nothing else is read."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..operators import health, upsert
from ..schema import NOTICE_TYPES, SOURCES, STATUSES
from .store import VersionedTable

ENTRY = "payload string, hash string, run string, seq bigint"
FIELDS = (
    "notice_type string, status string, title string, final_value double, publication_date date, "
    "procurer struct<ico:string,name:string>, awards array<struct<ico:string,name:string,value:double,signing_date:date>>"
)
PAYLOAD = f"source string, source_id string, {FIELDS}"
STORED = f"{PAYLOAD}, content_hash string, canonical_id string, ingested_at timestamp_ntz"
SEEN = "source string, source_id string, content_hash string, last_seen_at timestamp_ntz, skipped_count bigint"
ENTITIES = "entity string, name string, ico string, sources array<string>"
EDGES = "source string, source_id string, org string, type string, value double"
EDGE_KEY = ["source", "source_id", "org", "type"]
STATISTICS = "role string, ico string, contract_count bigint, total_value decimal(28,2)"
BRIEF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
REPORT = "inserted bigint, updated bigint, skipped bigint, errors bigint"


def parse(entries: DataFrame) -> DataFrame:
    """(n, content_hash, run, seq, reason, payload) of entries: the parsed notice `n`, or why it is none, with its payload."""
    p = entries.withColumn("n", F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE"})).withColumn("ok", F.try_parse_json("payload").isNotNull())
    reason = (
        F.when(~F.col("ok") | F.col("n").isNull(), "not json")
        .when(F.col("n.source_id").isNull() | ~F.coalesce(F.col("n.source").isin(*SOURCES), F.lit(False)), "source")
        .when(~F.coalesce(F.col("n.notice_type").isin(*NOTICE_TYPES), F.lit(False)), "notice_type")
        .when(~F.coalesce(F.col("n.status"), F.lit("unknown")).isin(*STATUSES), "status")
    )
    p = p.withColumn("reason", reason)
    return p.select("n", F.col("hash").alias("content_hash"), "run", "seq", "reason", F.when(F.col("reason").isNotNull(), F.col("payload")).alias("payload"))


def split_poison(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed entries that are canonical notices, and those that are not, with the reason, for the dead letters."""
    return parsed.where("reason IS NULL").select("n.*", "content_hash", "run", "seq"), parsed.where("reason IS NOT NULL").select("payload", "reason", "seq")


def sightings(rows: DataFrame) -> DataFrame:
    """(ico, name, name_slug, source, seq) of the procurers and suppliers of notices, for the entities, each once with its last
    `seq`; the slug only where there is no ICO, as it is the key there."""
    won = F.transform(F.coalesce("awards", F.array()), lambda a: F.struct(a["ico"].alias("ico"), a["name"].alias("name")))
    org = F.explode(F.concat(F.array("procurer"), won)).alias("o")
    seen = rows.select("source", "seq", org).groupBy(F.col("o.ico").alias("ico"), F.col("o.name").alias("name"), "source").agg(F.max("seq").alias("seq"))
    return seen.withColumn("name_slug", F.when(F.coalesce("ico", F.lit("")) == "", slugify("name"))).where("coalesce(ico, '') <> '' OR coalesce(name_slug, '') <> ''")


def graph_edges(rows: DataFrame) -> DataFrame:
    """(source, source_id, org, type, value): the procurer's edge, and one for each supplier with its first award's value."""
    key = upsert.entity_key(F.col("o.ico"), slugify("o.name"))
    own = F.struct(F.col("procurer.ico").alias("ico"), F.col("procurer.name").alias("name"), F.lit(None).cast("double").alias("value"))
    won = F.transform(F.coalesce("awards", F.array()), lambda a: F.struct(*[a[c].alias(c) for c in ("ico", "name", "value")]))
    orgs = F.posexplode(F.concat(F.array(own), won)).alias("pos", "o")
    flat = rows.select("source", "source_id", orgs).where("coalesce(o.ico, '') <> '' OR coalesce(o.name, '') <> ''")
    typed = flat.select("source", "source_id", key.alias("org"), F.when(F.col("pos") == 0, "procurer").otherwise("supplier").alias("type"), "pos", "o.value")
    return typed.groupBy("source", "source_id", "org", "type").agg(F.min_by("value", "pos").alias("value"))


def merge_edges(stored: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Stored edges after `changed` notices (their keys), of which `new` are all edges: an edge keeps the value of its
    creation, and goes when its notice changes and has it no more."""
    known = stored.withColumnRenamed("value", "_old").withColumn("_known", F.lit(True)).join(changed.withColumn("_changed", F.lit(True)), upsert.KEY, "left")
    both = known.join(new.withColumn("_new", F.lit(True)), EDGE_KEY, "full_outer")
    return both.where("_known IS NULL OR _changed IS NULL OR _new").select(*EDGE_KEY, F.when(F.col("_known"), F.col("_old")).otherwise(F.col("value")).alias("value"))


def contributions(rows: DataFrame, sign: int) -> DataFrame:
    """(role, ico, contract_count, total_value): what notices add to their companies' statistics, or with -1 take away. A
    notice counts once for its procurer and once for each supplier, the latter only if all its awards name their ICOs."""
    org = "array<struct<role:string,ico:string>>"
    icos = F.transform(F.coalesce("awards", F.array()), lambda a: F.coalesce(a["ico"], F.lit("")))
    suppliers = F.when(~F.array_contains(icos, ""), F.transform(F.array_distinct(icos), lambda i: F.struct(F.lit("supplier").alias("role"), i.alias("ico"))))
    own = F.when(F.col("procurer.ico") != "", F.array(F.struct(F.lit("procurer").alias("role"), F.col("procurer.ico").alias("ico"))))
    none = F.array().cast(org)
    value = F.coalesce("final_value", F.lit(0.0)).cast("decimal(18,2)")
    counted = rows.select(F.explode(F.concat(F.coalesce(own.cast(org), none), F.coalesce(suppliers.cast(org), none))).alias("o"), value.alias("v"))
    return counted.groupBy("o.role", "o.ico").agg((F.count(F.lit(1)) * sign).alias("contract_count"), (F.sum("v") * sign).cast("decimal(28,2)").alias("total_value"))


def merge_statistics(*parts: DataFrame) -> DataFrame:
    """Statistics with changes added; companies that are left with nothing stay as rows of zero."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("role", "ico").agg(F.sum("contract_count").alias("contract_count"), F.sum("total_value").cast("decimal(28,2)").alias("total_value"))


class NoticeStore:
    """What the loop keeps: notices and the registry of seen hashes, entities, graph edges, companies' statistics, and by
    batch dead letters, date issues and a report of counts. Each batch writes all of them before its offsets are committed, and all of them
    by its number, so a batch that runs again gives the same tables."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, keep: int = 2):
        self.spark, self.folder = spark, folder

        def kept(name: str, schema: str, key: list[str]) -> VersionedTable:
            return VersionedTable(spark, f"{folder}/{name}", schema, key, buckets, keep)

        self.tables = {
            "notices": kept("notices", STORED, upsert.KEY),
            "registry": kept("registry", SEEN, upsert.KEY),
            "entities": kept("entities", ENTITIES, ["entity"]),
            "edges": kept("edges", EDGES, upsert.KEY),
            "statistics": kept("statistics", STATISTICS, ["ico"]),
        }

    def read(self, name: str) -> DataFrame:
        """A table's present rows: notices, registry, entities, edges or statistics."""
        rows = self.tables[name].read()
        return rows.where("contract_count > 0") if name == "statistics" else rows

    def notices(self) -> DataFrame:
        return self.read("notices")

    def write(self, batch: DataFrame, batch_id: int, now: Column, now_year: int) -> None:
        held: list[DataFrame] = []

        def hold(df: DataFrame) -> DataFrame:
            """Keep what is of a batch's size, and read several times, until the batch is written."""
            held.append(df.persist())
            return held[-1]

        with brief_shuffles(self.spark, batch.sparkSession):
            try:
                self._write(batch, batch_id, now, now_year, hold)
            finally:
                for df in held:
                    df.unpersist()
                held.clear()
        for t in self.tables.values():
            t.drop_old()
        self.spark._jvm.System.gc()  # the shuffles behind what was held go with the last reference to it

    def _write(self, batch: DataFrame, batch_id: int, now: Column, now_year: int, hold: Callable[[DataFrame], DataFrame]) -> None:
        parsed = hold(parse(batch))  # parsed once
        good, bad = split_poison(parsed)
        bad.write.mode("overwrite").parquet(f"{self.folder}/dead/v={batch_id}")
        dates = ("publication_date",)
        health.date_issues(good, now_year, dates, "source_id").write.mode("overwrite").parquet(f"{self.folder}/issues/v={batch_id}")
        rows = upsert.keep_last(health.clamp_dates(good, now_year, dates))
        rows = hold(rows.withColumns({"ingested_at": now, "canonical_id": F.lit(None).cast("string")}))
        notices, registry, entities, edges, statistics = self.tables.values()
        touched = notices.touched(rows)
        parsed.unpersist()  # the rows are held by now
        seen = registry.read(batch_id, touched)
        decided = hold(upsert.decide(rows.select(*upsert.KEY, "content_hash"), seen).select(*upsert.KEY, "action"))
        upsert.report(decided, self.dead(batch_id)).write.mode("overwrite").parquet(f"{self.folder}/reports/v={batch_id}")
        before = notices.read(batch_id, touched)
        notices.write(upsert.upsert_notices(before, rows), batch_id, touched)
        new = hold(upsert.upsert_entities(sightings(rows)))
        of_new = entities.touched(new)
        entities.write(upsert.merge_entities(entities.read(batch_id, of_new), new), batch_id, of_new)
        changed = decided.where("action <> 'skipped'").select(*upsert.KEY)
        of_changed = rows.join(changed, upsert.KEY, "left_semi")
        edges.write(merge_edges(edges.read(batch_id, touched), changed, graph_edges(of_changed)), batch_id, touched)
        old = before.join(changed, upsert.KEY, "left_semi")
        delta = hold(merge_statistics(contributions(old, -1), contributions(of_changed, 1)).where("contract_count <> 0 OR total_value <> 0"))
        of_delta = statistics.touched(delta)
        statistics.write(merge_statistics(statistics.read(batch_id, of_delta), delta), batch_id, of_delta)
        registry.write(upsert.upsert_registry(seen, rows, now), batch_id, touched)

    def dead(self, batch_id: int | None = None) -> DataFrame:
        """The dead letters of all batches or of one."""
        return self.spark.read.schema("payload string, reason string, seq bigint").parquet(f"{self.folder}/dead/v={'*' if batch_id is None else batch_id}")

    def reports(self) -> DataFrame:
        """(v, inserted, updated, skipped, errors) of each batch."""
        return self.spark.read.schema(f"{REPORT}, v bigint").option("basePath", f"{self.folder}/reports").parquet(f"{self.folder}/reports")


def ingest(entries: DataFrame, store: NoticeStore, checkpoint: str, now: Column, now_year: int, trigger: dict | None = None):
    """Start the loop; offsets are committed after a batch's tables are written, so entries arrive at least once."""
    return entries.writeStream.foreachBatch(lambda batch, n: store.write(batch, n, now, now_year)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_entries(spark: SparkSession, folder: str, per_batch: int = 100, archive: str | None = None, delete: bool = False) -> DataFrame:
    """A stream of landed entry files. With `archive`, files go there once their batch is done, which keeps the landing
    folder short; with `delete`, they are deleted then."""
    reader = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    elif delete:
        reader = reader.option("cleanSource", "delete")
    return reader.json(folder)


@contextlib.contextmanager
def brief_shuffles(*sessions: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the query that wrote them ends, and not at some collection of the driver's garbage."""
    known = [s.conf.get(BRIEF, "false") for s in sessions]
    for s in sessions:
        s.conf.set(BRIEF, "true")
    try:
        yield
    finally:
        for s, value in zip(sessions, known):
            s.conf.set(BRIEF, value)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="stream-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage, keeping partitions and their order, in the session's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()

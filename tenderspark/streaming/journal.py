"""What workers report: the event log, results of cycles, metrics of batches, notifications, and the resolution cycle."""

from __future__ import annotations

import datetime
import json
import logging
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import company, resolve
from ..operators.health import EVENTS, LEVELS

LOG = (
    "event_id string, ts timestamp_ntz, level string, event string, component string, source string, source_id string, "
    "instance_id string, pipeline_run_id string, message string, details string"
)
_TEXTS = ("source", "source_id", "instance_id", "pipeline_run_id")


def append_events(spark: SparkSession, folder: str, events: Iterable[dict]) -> bool:
    """Append a worker's few events to the log, a folder of Parquet. A log that cannot be written never stops its worker:
    the failure is noted and False comes back. An unknown kind of event or level is a mistake of the caller and raises."""
    rows = []
    for e in events:
        if e["event"] not in EVENTS:
            raise ValueError(f"no such event: {e['event']}")
        if e.get("level", "info") not in LEVELS:
            raise ValueError(f"no such level: {e['level']}")
        details = json.dumps(e["details"], ensure_ascii=False, sort_keys=True) if e.get("details") is not None else None
        known = (uuid.uuid4().hex, e["ts"], e.get("level", "info"), e["event"], e["component"])
        rows.append((*known, *(e.get(c) for c in _TEXTS), e.get("message"), details))
    try:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)
    except Exception:  # the log must not stop a worker
        logging.getLogger(__name__).exception("event log %s", folder)
        return False
    return True


def append_issues(issues: DataFrame, folder: str, component: str, source: str, now: Column) -> None:
    """Date issues (source_id, field, year, reason) of a batch as events, written where they are found."""
    details = F.to_json(F.struct("field", "year", "reason"))
    own = F.md5(F.concat_ws("|", now.cast("string"), F.lit(component), F.lit(source), "source_id", "field").cast("binary"))  # the same if a task runs again
    row = {"event_id": own, "ts": now, "level": F.lit("warning"), "event": F.lit("notice_invalid_date"), "component": F.lit(component), "source": F.lit(source), "source_id": F.col("source_id")}
    row |= {"instance_id": F.lit(None), "pipeline_run_id": F.lit(None), "message": F.lit("date out of range"), "details": details}
    issues.select(*[row[c.split()[0]].cast(c.split()[1]).alias(c.split()[0]) for c in LOG.split(", ")]).write.mode("append").parquet(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(folder)


def run_cycle(spark: SparkSession, folder: str, component: str, cycle: Callable[[], dict], clock: Callable[[], datetime.datetime]) -> dict | None:
    """Run one cycle and log how it went: its counts with the seconds it took, or its error, which is not passed on."""
    began = clock()
    try:
        counts = cycle()
    except Exception as e:  # the next cycle is to run
        append_events(spark, folder, [{"ts": clock(), "level": "error", "event": "cycle_failed", "component": component, "message": f"{type(e).__name__}: {e}"[:500]}])
        return None
    ended = clock()
    append_events(spark, folder, [{"ts": ended, "event": "cycle_complete", "component": component, "details": {**counts, "seconds": (ended - began).total_seconds()}}])
    return counts


def observed(batch: DataFrame, name: str) -> DataFrame:
    """The batch with metrics that Spark gathers as it passes: rows, keys without an id, latest date."""
    return batch.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("source_id").isNull()).alias("without_id"), F.max("publication_date").alias("latest"))


class BatchListener(StreamingQueryListener):
    """Calls back after every batch that wrote rows, with its number, rows and observed metrics: a notification for
    those who wait for new notices, and the workers' metrics."""

    def __init__(self, notify: Callable[[dict], None]):
        self.notify = notify

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows > 0:
            self.notify({"query": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond, "metrics": {k: r.asDict() for k, r in (p.observedMetrics or {}).items()}})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def resolution_cycle(notices: DataFrame, awards: DataFrame, entities: DataFrame, now: Column, write: Callable[[str, DataFrame], None], days: int = 30) -> dict:
    """Resolve the notices of the last days and write their canonical ids and matches, then the entities' fresh
    statistics. Statistics that fail do not undo the resolution; the failure is in the result."""
    window = resolve.recent(notices, now, days)
    stamped, matches = resolve.resolve(window, awards)
    write("canonical", stamped.where("canonical_id IS NOT NULL").select("notice_id", "canonical_id"))
    write("matches", matches)
    try:
        write("entities", company.refresh_entity_stats(entities, company.entity_stats_suppliers(notices, awards)))
    except Exception as e:  # kept apart from the resolution
        return {"resolved": True, "statistics": f"{type(e).__name__}: {e}"[:500]}
    return {"resolved": True, "statistics": "ok"}

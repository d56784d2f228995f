"""Status of workers from the event log as a stream: silence turns a component stale by a timer, without a new event.

State is kept by component: the last event, and how many successes leave the last day at each instant (a map of at most as
many entries as a day and the delay have successes: those of a long replay that the clock passes with their own batch are
not entered). Two kinds of timers in event time: when the last event gets too old, and when a
success gets older than a day. The clock is the stream's watermark, so a replay gives the same changes as the live run, and
the last change of each component equals `health.worker_status` at that clock.

Defined cases: events without a time or of other components are left out; an event that comes more than `delay` seconds
after newer ones is dropped, as its instant is already told; of events at one instant the one with the greatest id counts, as in
the batch query; a component without events has no change and is `unknown`.

A task of the input combines its rows before they go to their component's task: the greatest event, and its successes by
instant but for those that the clock passes with their own batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.health import COMPONENTS, STALE_SECONDS, SUCCESS, status_of
from .journal import LOG

DAY_MS = 86_400_000
_TOLD = "component string, change bigint, event string, level string, us bigint, successes bigint, now_ms bigint"
#: Timers need the state store on RocksDB; a task for each component is all that its state can use.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.shuffle.partitions": str(len(COMPONENTS)),
}


def _rank(event: tuple) -> tuple:
    """Order of structs with nulls first."""
    return tuple((v is not None, v) for v in event)


class _Follow(StatefulProcessor):
    """Rows (component, us, event_id, event, level, successes) of one component into its changes."""

    def __init__(self, id_type: str, delay: int):
        self.id_type, self.delay_ms = id_type, delay * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"us bigint, event_id {self.id_type}, event string, level string")
        self.told = handle.getValueState("told", "change bigint, overdue boolean, successes bigint")
        self.leaving = handle.getMapState("leaving", "ms bigint", "n bigint")

    def _tell(self, component: str, now_ms: int, n: int, anew: bool) -> Iterator[Row]:
        us, _, event, level = self.last.get()
        change, was_overdue, was_n = self.told.get() or (0, None, None)
        overdue = now_ms * 1000 - us > STALE_SECONDS[component] * 1_000_000
        if anew or overdue != was_overdue or n != was_n:
            self.told.update((change + 1, overdue, n))
            yield Row(component=component, change=change + 1, event=event, level=level, us=us, successes=n, now_ms=now_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, told = self.last.get(), self.told.get()
        last, n, more = known, told[2] if told else 0, {}
        for r in rows:
            event = (r.us, r.event_id, r.event, r.level)
            if last is None or _rank(event) > _rank(last):
                last = event
            if r.successes:
                leaves = r.us // 1000 + DAY_MS + 1  # a timer fires once the clock reaches it
                more[leaves] = more.get(leaves, 0) + r.successes
        for leaves, k in more.items():
            if leaves <= last[0] // 1000 - self.delay_ms:  # the clock passes it at the end of this batch
                continue
            before = self.leaving.getValue((leaves,)) if self.leaving.containsKey((leaves,)) else (0,)
            self.leaving.updateValue((leaves,), (before[0] + k,))
            self.handle.registerTimer(leaves)
            n += k
        if last != known:
            self.last.update(last)
            self.handle.registerTimer(last[0] // 1000 + STALE_SECONDS[key[0]] * 1000 + 1)
        yield from self._tell(key[0], timerValues.getCurrentWatermarkInMs(), n, last != known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        instant, n = (expiredTimerInfo.getExpiryTimeInMs(),), self.told.get()[2]
        if self.leaving.containsKey(instant):
            n -= self.leaving.getValue(instant)[0]
            self.leaving.removeKey(instant)
        yield from self._tell(key[0], timerValues.getCurrentWatermarkInMs(), n, False)

    def close(self) -> None:
        pass


def read_log_stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """A stream of the log that `journal.append_events` writes."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", per_batch).parquet(folder)


def _combined(rows: DataFrame, delay: int) -> DataFrame:
    """(component, us, event_id, event, level, successes) from rows (..., success): of each component and task the greatest
    event, and apart from it the number of successes at each instant. All stay at their instants, which keeps the watermark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple] = {}
        counts: dict[str, dict[int, int]] = {}
        for batch in batches:
            for component, *event, success in zip(*(c.to_pylist() for c in batch.columns)):
                known = last.get(component)
                if known is None or event[0] > known[0] or event[0] == known[0] and _rank(event) > _rank(known):
                    last[component] = tuple(event)
                if success:
                    of = counts.setdefault(component, {})
                    of[event[0]] = of.get(event[0], 0) + 1
            for component, of in counts.items():
                passed = last[component][0] // 1000 - delay * 1000
                counts[component] = {us: n for us, n in of.items() if us // 1000 + DAY_MS + 1 > passed}
        told = [(c, *event, 0) for c, event in last.items()] + [(c, us, None, None, None, n) for c, of in counts.items() for us, n in of.items()]
        for i in range(0, len(told), 10_000):
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in told[i : i + 10_000]], schema=pa.schema([pa.field(n, k) for n, k in zip(names, kinds)]))

    id_type = rows.schema["event_id"].dataType
    names = ("component", "us", "event_id", "event", "level", "successes")
    kinds = (pa.string(), pa.int64(), to_arrow_type(id_type), pa.string(), pa.string(), pa.int64())
    return rows.mapInArrow(run, f"component string, us bigint, event_id {id_type.simpleString()}, event string, level string, successes bigint")


def status_changes(log: DataFrame, delay: int = 600) -> DataFrame:
    """(component, change, status, last_event, last_ts, successes_24h, as_of) whenever a component's last event, its
    successes of the last day or its being stale change; `change` counts a component's changes."""
    id_type = log.schema["event_id"].dataType.simpleString()
    known = log.where(F.col("ts").isNotNull() & F.col("component").isin(*COMPONENTS)).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = known.select("component", F.unix_micros("ts").alias("us"), "event_id", "event", "level", F.coalesce(F.col("event").isin(*SUCCESS), F.lit(False)).alias("success"))
    timed = _combined(rows, delay).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", f"{delay} seconds")
    told = timed.groupBy("component").transformWithState(_Follow(id_type, delay), _TOLD, "Append", "EventTime")
    age = (F.col("now_ms") * 1000 - F.col("us")) / 1_000_000
    return told.select(
        "component", "change", status_of(F.col("event"), F.col("level"), age, F.col("component")).alias("status"), F.col("event").alias("last_event"),
        F.timestamp_micros("us").cast("timestamp_ntz").alias("last_ts"), F.col("successes").alias("successes_24h"), F.timestamp_millis(F.nullif("now_ms", F.lit(0))).cast("timestamp_ntz").alias("as_of"),
    )


def follow(log: DataFrame, folder: str, checkpoint: str, delay: int = 600, trigger: dict | None = None):
    """Start the stream, which appends its changes to a folder of Parquet. Its own settings do not stay in the session."""
    conf = log.sparkSession.conf
    before = {name: conf.get(name, None) for name in _SETTINGS}
    try:
        for name, value in _SETTINGS.items():
            conf.set(name, value)
        changes = status_changes(log, delay)
        return changes.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def current_status(changes: DataFrame, components: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """The last change of each component, in the form of `health.worker_status`."""
    fields = ("status", "last_event", "last_ts", "successes_24h")
    last = changes.groupBy("component").agg(F.max_by(F.struct(*fields), "change").alias("l")).select("component", "l.*")
    known = changes.sparkSession.createDataFrame([(c,) for c in components], "component string")
    return known.join(last, "component", "left").select("component", F.coalesce("status", F.lit("unknown")).alias("status"), "last_event", "last_ts", F.coalesce("successes_24h", F.lit(0)).alias("successes_24h"))

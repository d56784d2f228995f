"""Live status of workers against the batch query, after each of several deliveries."""

import datetime
import random

from pyspark.sql import functions as F

from tenderspark.operators import health
from tenderspark.streaming import journal, live

START = datetime.datetime(2026, 1, 2, 3, 4, 5)


def at(seconds: float) -> datetime.datetime:
    return START + datetime.timedelta(seconds=seconds)


def statuses(df) -> dict:
    return {r.component: (r.status, r.last_event, r.last_ts, r.successes_24h) for r in df.collect()}


class Replay:
    """Appends deliveries to a log and follows it, each time with a restarted query."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def deliver(self, rows):
        self.spark.createDataFrame(rows, journal.LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        log = live.read_log_stream(self.spark, f"{self.folder}/log")
        live.follow(log, f"{self.folder}/changes", f"{self.folder}/offsets", 600).awaitTermination()
        return self.spark.read.parquet(f"{self.folder}/changes")


def row(ts, event, component, level="info", own="x"):
    return (own, ts, level, event, component, None, None, None, None, None, None)


def test_silence_turns_stale_and_successes_leave(spark, tmp_path):
    replay = Replay(spark, str(tmp_path))
    changes = replay.deliver([row(at(0), "cycle_complete", "ingestor"), row(at(0), "worker_started", "extractor:crz"), row(None, "cycle_complete", "ingestor"), row(at(0), "cycle_complete", "elsewhere"), row(at(1), None, None)])
    assert statuses(live.current_status(changes))["ingestor"] == ("healthy", "cycle_complete", at(0), 1)
    # only another component speaks; the watermark is 10 minutes behind it: at the limit, then a millisecond beyond
    changes = replay.deliver([row(at(600 + 600), "worker_started", "extractor:crz")])
    assert statuses(live.current_status(changes))["ingestor"][0] == "healthy"
    changes = replay.deliver([row(at(600 + 600.001), "worker_started", "extractor:crz")])
    assert statuses(live.current_status(changes))["ingestor"] == ("stale", "cycle_complete", at(0), 1)
    changes = replay.deliver([row(at(86400 + 600), "worker_started", "extractor:crz")])
    assert statuses(live.current_status(changes))["ingestor"][3] == 1
    changes = replay.deliver([row(at(86400 + 600.001), "worker_started", "extractor:crz")])
    assert statuses(live.current_status(changes))["ingestor"] == ("stale", "cycle_complete", at(0), 0)
    changes = replay.deliver([row(at(86400 + 601), "cycle_failed", "ingestor"), row(at(86400 + 602), "batch_written", "extractor:ted", "critical")])
    now = statuses(live.current_status(changes))
    assert now["ingestor"] == ("error", "cycle_failed", at(86400 + 601), 0) and now["extractor:ted"][0] == "error"
    assert now["extractor:vestnik"] == ("unknown", None, None, 0)
    told = [(r.status, r.successes_24h) for r in changes.where("component = 'ingestor'").orderBy("change").collect()]
    assert told == [("healthy", 1), ("stale", 1), ("stale", 0), ("error", 0)]


def test_replay_equals_the_batch_query(spark, tmp_path):
    """Disordered deliveries with equal instants and repeated rows, some hours apart, checked at each watermark."""
    rng, replay, log, now = random.Random(3), Replay(spark, str(tmp_path)), [], 0.0
    for _ in range(5):
        now += rng.choice((300, 900, 8000, 60_000))
        rows = [row(at(now - rng.randrange(0, 590_000) / 1000), rng.choice(health.EVENTS), rng.choice(health.COMPONENTS[1:]), rng.choice(health.LEVELS[:2]), f"{rng.randrange(5)}") for _ in range(40)]
        rows += [rows[0], (*rows[1][:3], "worker_stopped", *rows[1][4:]), row(at(now), "worker_started", "extractor:ted", own="z")]
        log += rows
        changes = replay.deliver(rows)
        batch = health.worker_status(spark.createDataFrame(log, journal.LOG), F.lit(at(now - 600)).cast("timestamp_ntz"))
        assert statuses(live.current_status(changes)) == statuses(batch)


def test_settings_are_for_the_query_only(spark, tmp_path):
    before = {name: spark.conf.get(name) for name in live._SETTINGS}
    Replay(spark, str(tmp_path)).deliver([row(at(0), "cycle_complete", "ingestor")])
    assert {name: spark.conf.get(name) for name in live._SETTINGS} == before

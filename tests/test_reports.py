"""Event log, cycles, notifications, repairs and the text branch of unified search."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tenderspark.functions import text
from tenderspark.functions.text import near_prefix
from tenderspark.operators import health, profiles, repairs, search
from tenderspark.streaming import ingest, journal, store

NOW = datetime.datetime(2026, 1, 2, 3, 4, 5)


def test_events_are_appended_and_a_broken_log_stops_nothing(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert journal.append_events(spark, folder, [{"ts": NOW, "event": "worker_started", "component": "ingestor"}])
    assert journal.append_events(spark, folder, [{"ts": NOW, "event": "batch_written", "component": "ingestor", "details": {"rows": 3}}])
    assert [(r.event, r.level, r.details) for r in journal.read_log(spark, folder).orderBy("event").collect()] == [("batch_written", "info", '{"rows": 3}'), ("worker_started", "info", None)]
    (tmp_path / "file").write_text("no folder")
    assert not journal.append_events(spark, str(tmp_path / "file"), [{"ts": NOW, "event": "worker_started", "component": "x"}])
    with pytest.raises(ValueError):
        journal.append_events(spark, folder, [{"ts": NOW, "event": "other", "component": "x"}])


def test_cycles_log_their_result_or_their_error(spark, tmp_path):
    folder, clock = str(tmp_path / "log"), iter(NOW + datetime.timedelta(seconds=s) for s in range(9)).__next__
    assert journal.run_cycle(spark, folder, "dedup-worker", lambda: {"groups": 2}, clock) == {"groups": 2}
    assert journal.run_cycle(spark, folder, "dedup-worker", lambda: 1 // 0, clock) is None
    log = journal.read_log(spark, folder)
    rows = [(r.event, r.level, r.message or r.details) for r in log.orderBy("ts").collect()]
    assert rows == [("cycle_complete", "info", '{"groups": 2, "seconds": 1.0}'), ("cycle_failed", "error", "ZeroDivisionError: integer division or modulo by zero")]
    status = {r.component: (r.status, r.successes_24h) for r in health.worker_status(log, F.lit(NOW)).collect()}
    assert status == {c: ("unknown", 0) for c in health.COMPONENTS} | {"dedup-worker": ("error", 1)}
    assert health.log_page(log, event="cycle_failed").collect()[0].total_rows == 1


def test_status_of_every_kind_of_last_event(spark, tmp_path):
    """Failures by event or by level, a stop, silence and success, from the log that workers write."""
    folder, before = str(tmp_path / "log"), lambda s: NOW - datetime.timedelta(seconds=s)
    last = {
        "extractor:vestnik": ("write_failed", "warning", 5, "error"),
        "extractor:crz": ("batch_written", "critical", 5, "error"),
        "extractor:ted": ("worker_stopped", "info", 9000, "stopped"),
        "extractor:itms": ("cycle_complete", "info", 7100, "healthy"),
        "ingestor": ("batch_written", "info", 601, "stale"),
        "dedup-worker": ("cycle_complete", "info", 599, "healthy"),
    }
    for c, (event, level, age, _) in last.items():
        old = {"ts": before(age + 100_000), "event": "cycle_complete", "component": c}
        assert journal.append_events(spark, folder, [old, {"ts": before(age), "event": event, "level": level, "component": c, "pipeline_run_id": "r1"}])
    got = health.worker_status(journal.read_log(spark, folder), F.lit(NOW)).collect()
    assert {r.component: (r.status, r.successes_24h) for r in got} == {c: (s, int(e in health.SUCCESS)) for c, (e, _, _, s) in last.items()}


def test_issues_become_events(spark, tmp_path):
    issues = spark.createDataFrame([("7", "publication_date", 3202, "too_late")], "source_id string, field string, year int, reason string")
    journal.append_issues(issues, str(tmp_path / "log"), "ingestor", "crz", F.lit(NOW))
    assert [(r.event, r.source_id, r.details) for r in journal.read_log(spark, str(tmp_path / "log")).collect()] == [("notice_invalid_date", "7", '{"field":"publication_date","year":3202,"reason":"too_late"}')]


def test_batches_notify_with_their_metrics(spark, tmp_path):
    spark.createDataFrame([("1", "2024-01-01"), (None, "2025-01-01")], "source_id string, publication_date string").write.json(str(tmp_path / "in"))
    said, listener = [], journal.BatchListener(lambda x: said.append(x))
    spark.streams.addListener(listener)
    try:
        rows = journal.observed(spark.readStream.schema("source_id string, publication_date string").json(str(tmp_path / "in")), "batch")
        rows.writeStream.queryName("notices").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
        for _ in range(50):
            if said:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert said[0]["rows"] == 2 and said[0]["query"] == "notices" and said[0]["metrics"]["batch"] == {"rows": 2, "without_id": 1, "latest": "2025-01-01"}


def test_resolution_cycle_survives_failing_statistics(spark):
    n = spark.createDataFrame([(1, "crz", "P", "45", "t", NOW.date(), None, NOW, 1.0), (2, "ted", "P", "45", "t", NOW.date(), None, NOW, 1.0)], "notice_id bigint, source string, procurer_ico string, cpv_code string, title_slug string, publication_date date, canonical_id string, ingested_at timestamp_ntz, final_value double")
    a = spark.createDataFrame([(1, 0, "S", 5.0)], "notice_id bigint, pos bigint, supplier_ico string, award_value double")
    e = spark.createDataFrame([("S", "s", 0, 0.0)], "ico string, name string, contract_count bigint, total_value double")
    written = {}
    assert journal.resolution_cycle(n, a, e, F.lit(NOW), lambda k, df: written.update({k: df.collect()}))["statistics"] == "ok"
    assert {(r.notice_id, r.canonical_id) for r in written["canonical"]} == {(1, "1"), (2, "1")} and written["entities"][0].contract_count == 1

    def write(kind, df):
        if kind == "entities":
            raise OSError("full")

    out = journal.resolution_cycle(n, a, e, F.lit(NOW), write)
    assert out["resolved"] and out["statistics"] == "OSError: full"


def test_repairs_are_idempotent(spark):
    n = spark.createDataFrame([("crz", "1", "", None, datetime.date(3202, 1, 1)), ("crz", "2", "Name", "9", datetime.date(2020, 1, 1)), ("crz", "3", None, "8", None)], "source string, source_id string, procurer_name string, procurer_ico string, publication_date date")
    new = spark.createDataFrame([("crz", "1", "5", "Town"), ("crz", "2", "6", "Other"), ("crz", "3", None, "Village")], "source string, source_id string, procurer_ico string, procurer_name string")
    once = repairs.refilled_procurers(n, new)
    assert {(r.source_id, r.procurer_name, r.procurer_ico) for r in once.collect()} == {("1", "Town", "5"), ("2", "Name", "9"), ("3", "Village", "8")}
    assert sorted(map(tuple, repairs.refilled_procurers(once, new).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    raw = spark.createDataFrame([("crz", "1", "1024-01-01", "2019-02-03", "2020-01-01"), ("crz", "3", None, None, "x")], "source string, source_id string, signed_on string, effective_from string, published_at string")
    found = repairs.rederived_dates(n, raw, 2026)
    assert [(r.source_id, str(r.after)) for r in found.collect()] == [("1", "2019-02-03")]
    fixed = repairs.with_repaired_dates(n, found)
    assert {(r.source_id, str(r.publication_date)) for r in fixed.collect()} == {("1", "2019-02-03"), ("2", "2020-01-01"), ("3", "None")}


def test_near_prefix(spark):
    df = spark.createDataFrame([("Základná škola",), ("Zaklad",), ("z",), (None,)], "name string")
    found = lambda q: {r.name for r in df.where(near_prefix("name", q)).collect()}
    assert found("zakled") == {"Základná škola", "Zaklad"} and found("zaxxad") == set() and found("z") == set() and found("zaklad skol") == {"Základná škola"}


def test_unified_search_puts_similar_companies_first(spark):
    n = spark.createDataFrame([(1, "contract_award", "school roof", datetime.date(2024, 1, 1))], "notice_id bigint, notice_type string, title string, publication_date date")
    e = spark.createDataFrame([("1", "School One", 5), ("2", "School Two", 9), ("3", "Roofs", 1)], "ico string, name string, n bigint")
    near = spark.createDataFrame([("3", "Roofs", 0.9), ("2", "School Two", 0.8)], "ico string, name string, score double")
    assert [(r.kind, r.id) for r in search.unified(n, e, "school", 10, near).collect()] == [("company", "2"), ("company", "3"), ("company", "1"), ("contract", "1")]
    assert search.unified(n, e, "s", 10, near).count() == 0


def test_sources_are_ordered_and_written_as_text(spark):
    s = spark.createDataFrame([("a", "healthy", 5), ("b", "error", None), ("c", "error", 90), ("d", "warning", 40)], "source string, status string, age_seconds bigint")
    assert [r.source for r in profiles.ordered_sources(s).collect()] == ["c", "b", "d", "a"]
    assert [r.source for r in profiles.ordered_sources(s, "age").collect()] == ["c", "d", "a", "b"]
    h = spark.createDataFrame([("crz", 12, 3, NOW, False), ("uvo", 0, 0, None, True)], "source string, notices bigint, last_24h bigint, last_ingested timestamp_ntz, stale boolean")
    lines = {r.source: r.line for r in profiles.report_text(h).collect()}
    assert "12 notices" in lines["crz"] and lines["uvo"].endswith("never STALE")


def test_store_tables(spark, tmp_path):
    """Registry, entities, edges, reports: those of a plain model; a batch that runs again changes nothing; a batch
    rewrites no bucket that its keys do not touch; replaced parts go."""
    def entry(source, sid, value, ico, name, awards, seq):
        awards = [{"ico": i, "name": x, "value": v} for i, x, v in awards]
        body = {"source": source, "source_id": sid, "notice_type": "contract_award", "status": "awarded", "title": "t", "final_value": value, "publication_date": "2024-01-02", "procurer": {"ico": ico, "name": name}, "awards": awards}
        return json.dumps(body), f"h{sid}{value}", "run", seq

    one = [entry("crz", str(i), 1.0, "P1", "Town", [("S1", "Firm", 5.0), ("S1", "Firm", 7.0), (None, "No Number", None)], i) for i in range(40)] + [("{", "x", "run", 99)]
    two = [entry("ted", "1", 1.0, "P1", "Town Hall", [], 1), entry("crz", "2", 2.0, "P1", "Town Hall", [("S2", "Other", 9.0), ("S1", "Firm", 8.0)], 2), entry("crz", "3", 1.0, None, "", [], 3)]
    store = ingest.NoticeStore(spark, str(tmp_path), buckets=8)
    now = F.lit(NOW).cast("timestamp_ntz")
    for n, rows in enumerate((one, two, two, two)):
        df = spark.createDataFrame(rows, ingest.ENTRY)
        for _ in range(2 if n == 1 else 1):
            store.write(df, n, now, 2026)
    assert [tuple(r) for r in store.reports().orderBy("v").select("v", "inserted", "updated", "skipped", "errors").collect()] == [(0, 40, 0, 0, 1), (1, 1, 1, 1, 0), (2, 0, 0, 3, 0), (3, 0, 0, 3, 0)]
    assert store.notices().count() == 41 and store.dead().count() == 1
    skips = {(r.source, r.source_id): r.skipped_count for r in store.read("registry").collect()}
    assert len(skips) == 41 and skips["ted", "1"] == 2 and skips["crz", "2"] == 2 and skips["crz", "3"] == 3 and skips["crz", "7"] == 0
    assert {(r.entity, r.name, tuple(r.sources)) for r in store.read("entities").collect()} == {("ico:P1", "Town Hall", ("crz", "ted")), ("ico:S1", "Firm", ("crz",)), ("ico:S2", "Other", ("crz",)), ("slug:no-number", "No Number", ("crz",))}
    edges = {(r.source, r.source_id, r.org, r.type): r.value for r in store.read("edges").collect()}
    assert len(edges) == 40 * 3 + 1 and ("crz", "2", "slug:no-number", "supplier") not in edges and ("crz", "3", "slug:no-number", "supplier") in edges and edges["crz", "2", "ico:S1", "supplier"] == 5.0 and edges["crz", "2", "ico:S2", "supplier"] == 9.0 and edges["ted", "1", "ico:P1", "procurer"] is None
    parts = store.tables["notices"].parts()
    assert len(parts) == 8 and sum(v == [0] for v in parts.values()) >= 5 and all(v in ([0], [2, 3]) for v in parts.values())


def test_folding_and_slugs(spark):
    cases = {
        "Žltý KÔŇ": ("zlty kon", "zlty-kon"), "Z\u030cilina": ("zilina", "zilina"), "Straße Ærø Þór": ("strasse aero thor", "strasse-aero-thor"), "Ệ Ǆ ﬁ Ⅷ": ("e dz fi viii", "e-dz-fi-viii"),
        "Объект Щука йод": ("объект щука иод", "ob-ekt-shchuka-iod"), "Ёлка": ("елка", "iolka"), "Αθήνα": ("αθηνα", "athena"), "10,500 € & O’Neil": ("10,500 € & o’neil", "10500-eur-oneil"),
        "A &amp; B": ("a &amp; b", "a-b"), "İstanbul": ("istanbul", "istanbul"), "漢字": ("漢字", ""), "": ("", ""), None: (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: (r.f, r.s) for r in df.select("t", text.fold("t").alias("f"), text.slugify("t").alias("s")).collect()}
    assert got == cases
    assert all(text.fold_text(k) == f for k, (f, _) in cases.items() if k)


def test_statistics_and_edges_by_deltas_equal_recomputation(spark, tmp_path):
    """Over random batches with changes, repeats, withdrawn suppliers and batches that run again."""
    rng, store = random.Random(4), ingest.NoticeStore(spark, str(tmp_path), buckets=4)

    def entry(i, seq):
        awards = [{"ico": rng.choice([*"ABCD", None, ""]), "name": rng.choice(["x", "y", None]), "value": rng.randint(1, 9)} for _ in range(rng.randint(0, 3))]
        body = {"source": "crz", "source_id": str(i), "notice_type": "contract_award", "status": "awarded", "title": "t", "final_value": rng.choice([None, 0.1, 0.2, 5.0]), "procurer": rng.choice([None, {"ico": "A", "name": "x"}, {"ico": None, "name": "y"}]), "awards": awards}
        return json.dumps(body), str(hash(json.dumps(body))), "run", seq

    last = {}
    for n in range(5):
        rows = [entry(i, k) for k, i in enumerate(rng.sample(range(30), 12 if n < 3 else 2))]
        rows += [last[k] for k in rng.sample(sorted(last), min(3, len(last)))]  # as delivered before
        last.update({json.loads(r[0])["source_id"]: r for r in rows})
        df = spark.createDataFrame(rows, ingest.ENTRY)
        for _ in range(1 + (n % 3 == 1)):
            store.write(df, n, F.lit(NOW).cast("timestamp_ntz"), 2026)
        stored = store.notices()
        assert sorted(store.read("statistics").collect()) == sorted(ingest.contributions(stored, 1).collect()), n
        assert {tuple(r)[:4] for r in store.read("edges").collect()} == {tuple(r)[:4] for r in ingest.graph_edges(stored).collect()}, n
    assert all(len(t.versions()) <= 8 for t in store.tables.values())
    every = store.tables["notices"]
    everyone = spark.createDataFrame([entry(i, i) for i in range(30)], ingest.ENTRY)
    for n in range(5, 8):
        store.write(everyone, n, F.lit(NOW).cast("timestamp_ntz"), 2026)
    assert every.versions() == [6, 7] and len(list((tmp_path / "notices").glob("v=*"))) == 2


def test_a_bucket_that_lost_its_rows_is_empty(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path), "k bigint, x string", ["k"], buckets=2)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k bigint, x string")
    both = t.touched(rows)
    t.write(rows, 0, both)
    t.write(rows.limit(0), 1, both)
    assert t.read().count() == 0 and t.read(1).count() == 4

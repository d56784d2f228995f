"""Rows of the live status are combined within the tasks of the input."""

from tenderspark.streaming import live


def test_rows_are_combined_before_they_are_shuffled(spark):
    day = 86_400_000_000
    rows = spark.range(0, 2000, 1, 1).selectExpr("IF(id % 2 = 0, 'ingestor', 'dedup-worker') AS component", f"(id div 4) * {day // 100} AS us", "id AS event_id", "'batch_written' AS event", "'info' AS level", "true AS success")
    got = live._combined(rows, 600).collect()
    assert sorted((r.component, r.event_id) for r in got if r.event is not None) == [("dedup-worker", 1999), ("ingestor", 1998)]
    staying = {(r.component, r.us): r.successes for r in got if r.event is None}
    step, last = day // 100, 499 * (day // 100)
    assert staying == {(c, k * step): 2 for c in ("ingestor", "dedup-worker") for k in range(500) if k * step // 1000 + live.DAY_MS + 1 > last // 1000 - 600_000}
    assert len(got) < 250

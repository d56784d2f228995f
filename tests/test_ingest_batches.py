"""Steps of an ingest batch: what is reduced before it is shuffled, and edges merged by one join."""

from tenderspark.streaming import ingest


def test_sightings_are_one_row_a_company_and_source(spark):
    row = '{"ico": "S1", "name": "Firm"}'
    rows = spark.range(50).selectExpr("'crz' AS source", "id AS seq", f"from_json('{row}', 'ico string, name string') AS procurer", "array(named_struct('ico', cast(null as string), 'name', 'No Number')) AS awards")
    assert sorted(tuple(r) for r in ingest.sightings(rows).select("name", "name_slug", "source", "seq").collect()) == [("Firm", None, "crz", 49), ("No Number", "no-number", "crz", 49)]


def test_edges_follow_changed_notices_only(spark):
    edge = lambda i, org, value: ("crz", i, org, "supplier", value)
    stored = spark.createDataFrame([edge("1", "a", 1.0), edge("1", "b", None), edge("2", "a", 3.0)], ingest.EDGES)
    new = spark.createDataFrame([edge("1", "a", 9.0), edge("1", "c", 5.0), edge("3", "a", 6.0)], ingest.EDGES)
    changed = spark.createDataFrame([("crz", "1"), ("crz", "3"), ("crz", "4")], "source string, source_id string")
    got = sorted(tuple(r) for r in ingest.merge_edges(stored, changed, new).collect())
    assert got == [edge("1", "a", 1.0), edge("1", "c", 5.0), edge("2", "a", 3.0), edge("3", "a", 6.0)]


def test_a_batch_is_parsed_once(spark, tmp_path, monkeypatch):
    calls, parse = [], ingest.parse
    monkeypatch.setattr(ingest, "parse", lambda entries: calls.append(1) or parse(entries))
    body = '{"source": "crz", "source_id": "1", "notice_type": "contract_award", "status": "awarded"}'
    store = ingest.NoticeStore(spark, str(tmp_path), buckets=2)
    store.write(spark.createDataFrame([(body, "h", "run", 1), ("{", "h", "run", 2)], ingest.ENTRY), 0, ingest.F.lit("2026-01-01").cast("timestamp_ntz"), 2026)
    assert calls == [1] and store.notices().count() == 1 and [tuple(r) for r in store.dead().collect()] == [("{", "not json", 2)]

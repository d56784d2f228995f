"""Small cases of operators whose results are known by hand or from a plain model."""

import datetime
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tenderspark.functions import text
from tenderspark.functions.columns import human_age, year_from_date
from tenderspark.operators import company, graph, health, resolve, risk, search, spend, upsert
from tenderspark.plans import risk_queries
from tenderspark.sources import readers, transforms
from tenderspark.sources.binding import notices
from tenderspark.streaming import ingest

D = datetime.date
NOTICE = "notice_id bigint, notice_type string, procurer_ico string, procurer_name string, cpv_code string, final_value double, estimated_value double, award_date date, publication_date date, procedure_type string"
AWARD = "notice_id bigint, pos bigint, supplier_ico string, supplier_name string, award_value double"


@pytest.fixture(scope="module")
def dashboard(spark):
    n = spark.createDataFrame([(1, "contract_award", "P1", "p", "72000000", 500000.0, None, D(2024, 3, 1), None, None), (2, "contract_award", "P1", "p", "45000000", 1000000.0, None, D(2023, 6, 15), None, None), (3, "contract_award", "P2", "q", "72000000", None, 250000.0, D(2024, 7, 20), None, None)], NOTICE)
    a = spark.createDataFrame([(1, 0, "S1", "s", None), (2, 0, "S2", "t", None), (3, 0, "S1", "s", None)], AWARD)
    return n, a


def test_dashboard(dashboard):
    n, a = dashboard
    assert {(r.year, r.total, r.n) for r in spend.spend_by_year(n).collect()} == {("2024", 750000.0, 2), ("2023", 1000000.0, 1)}
    months = {r.month: r.total for r in spend.monthly_filled(n, 2024).collect()}
    assert len(months) == 12 and months[3] == 500000.0 and months[7] == 250000.0 and months[1] == 0.0
    assert [r.ico for r in spend.top_suppliers(n, a, 1).collect()] == ["S2"]


def test_strict_leaves_out_notices_with_an_unnamed_award(spark, dashboard):
    n, a = dashboard
    a = a.unionByName(spark.createDataFrame([(2, 1, None, None, None)], AWARD))
    assert {r.ico for r in spend.top_suppliers(n, a).collect()} == {"S1"}
    assert {r.ico for r in spend.top_suppliers(n, a, strict=False).collect()} == {"S1", "S2"}


def test_empty_tables(spark):
    n, a = spark.createDataFrame([], NOTICE), spark.createDataFrame([], AWARD)
    assert spend.spend_by_year(n).count() == 0
    assert [(r.role, r.n, r.total) for r in company.core_stats_roles(n, a, "x").collect()] == [("supplier", 0, 0.0), ("procurer", 0, 0.0)]
    assert risk.risk_profiles(n, a).count() == 0


def test_entity_counts_grains(spark):
    n = spark.createDataFrame([(1, "contract_award", "P", "p", None, 10.0, None, None, None, None)], NOTICE)
    a = spark.createDataFrame([(1, 0, "S", "s", 4.0), (1, 1, "S", "s", 6.0)], AWARD)
    assert company.entity_stats_suppliers(n, a).first().contract_count == 1
    assert company.partners(n, a, "P", "procurer").first().n == 2
    assert [(r.value) for r in graph.awarded_to(a.withColumn("signing_date", F.lit(None).cast("date"))).collect()] == [4.0]


@pytest.mark.parametrize("shares, severity, triggered", [([500000, 25000, 25000, 25000, 25000], "high", True), ([40000] * 5, "moderate", False), ([400000, 50000, 50000], "informational", False)])
def test_concentration_flag(spark, shares, severity, triggered):
    p = spark.createDataFrame([("A", f"S{i}", "supplier", 1, float(v)) for i, v in enumerate(shares)], "ico string, counterparty string, role string, n bigint, total double")
    r = risk.concentration_flag(p).first()
    assert (r.severity, r.triggered) == (severity, triggered)


@pytest.mark.parametrize("shares, role, severity, score, subject", [((60000, 20000, 20000), "supplier", "moderate", 60.0, "procurer"), ((80000, 10000, 10000), "procurer", "high", 80.0, "supplier")])
def test_pair_flag(spark, shares, role, severity, score, subject):
    p = spark.createDataFrame([("A", f"S{i}", role, 1, float(v)) for i, v in enumerate(shares)], "ico string, counterparty string, role string, n bigint, total double")
    r = risk.pair_flag(p).first()
    assert (r.severity, r.score, r.subject_role) == (severity, score, subject)


def test_bursts_against_two_pointers(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for g in range(60):
        series = sorted(((D(2024, 1, 1) + datetime.timedelta(rng.randrange(150)), rng.choice(["45", "72", None]), float(rng.randrange(1000, 90000))) for _ in range(rng.randrange(1, 14))), key=lambda x: x[0])
        best, span = None, 1
        left = 0
        for right in range(len(series)):
            while (series[right][0] - series[left][0]).days > 30:
                left += 1
            if right - left + 1 > span:
                span, best = right - left + 1, (left, right)
        expected[str(g)] = (span, None if best is None else series[best[0]][0], None if best is None else series[best[1]][0])
        rows += [("A", str(g), d, None if c is None else c + "000000", v) for d, c, v in series]
    df = spark.createDataFrame(rows, "ico string, counterparty string, date date, cpv_code string, value double")
    assert {r.counterparty: (r.burst, r.first_day, r.last_day) for r in risk.bursts(df).collect()} == expected


def test_burst_near_the_ceiling(spark):
    df = spark.createDataFrame([("A", "B", D(2024, 1, d), "72000000", 40000.0) for d in (1, 8, 15, 22)], "ico string, counterparty string, date date, cpv_code string, value double")
    r = risk.bursts(df).first()
    assert r.triggered and r.near_ceiling and r.severity == "high" and r.score == 60.0


RES = "notice_id bigint, source string, procurer_ico string, title_slug string, cpv_code string, publication_date date, canonical_id string"


def nested_loop(entries, days, ratio=None):
    """The plain model: anchors in order gather later entries of other sources."""
    used, out = set(), []
    for i, a in enumerate(entries):
        if i in used or a[0] is None:
            continue
        group = [i]
        for j in range(i + 1, len(entries)):
            b = entries[j]
            if j in used or b[0] is None or b[2] == a[2] or (b[0] - a[0]).days > days:
                continue
            if ratio and not all(any(x > 0 and y > 0 and max(x, y) <= ratio * min(x, y) for x in entries[m][3] for y in b[3]) for m in group):
                continue
            group.append(j)
        if len(group) > 1:
            used |= set(group)
            out.append([entries[k][1] for k in group])
    return out


@pytest.mark.parametrize("values", [False, True])
def test_fold_against_nested_loops(spark, values):
    rng = random.Random(11)
    notices, awards, expected, key = [], [], set(), 0
    for g in range(120):
        entries = []
        for _ in range(rng.randrange(2, 9)):
            key += 1
            date = None if rng.random() < 0.1 else D(2024, 1, 1) + datetime.timedelta(rng.randrange(40))
            source, vals = rng.choice(["a", "b", "c"]), sorted(float(rng.choice([0, 10, 14, 20, 100])) for _ in range(rng.randrange(1, 3)))
            entries.append((date, key, source, vals))
            notices.append((key, source, None, f"t{g}", None, date, None))
            awards += [(key, f"s{g}", v) for v in vals]
        entries.sort(key=lambda e: (e[0] is None, e[0], e[1]))
        for ids in nested_loop(entries, 14 if values else 7, 1.5 if values else None):
            expected |= {(i, ids[0]) for i in ids}
    n = spark.createDataFrame(notices, RES)
    a = spark.createDataFrame(awards, "notice_id bigint, supplier_ico string, award_value double")
    found = resolve.pass_three(n, a) if values else resolve.pass_two(n)
    assert {(r.notice_id, r.canonical) for r in found.collect()} == expected


@pytest.mark.parametrize("segments", [1, 8])
def test_a_frequent_title_is_streamed(spark, segments):
    """One title with several notices every day, so no gap ever cuts it, in several tasks: clusters are the model's."""
    rng = random.Random(5)
    entries = sorted((D(2020, 1, 1) + datetime.timedelta(rng.randrange(1500)), i, rng.choice("aaaaaaab"), []) for i in range(6000))
    n = spark.createDataFrame([(i, s, None, "same", None, d, None) for d, i, s, _ in entries], RES)
    found = resolve.pass_two(n, segments=segments)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan
    assert sorted((r.notice_id, r.canonical) for r in found.collect()) == sorted((i, ids[0]) for ids in nested_loop(entries, 7) for i in ids)


def test_states_are_carried_over_segments():
    """Any cut of any titles into segments, some within a day and some without a row of the carried source, gives the fold."""
    rng = random.Random(9)
    batch = lambda rows: [resolve.pa.RecordBatch.from_pylist([dict(zip("gtdis", r)) for r in rows])] if rows else []
    for _ in range(400):
        width, sources = rng.choice([3, 15, 60]), rng.choice(["ab", "abc", "aab"])
        rows = sorted((rng.choice(["t", "t", "t", "u"]), rng.randrange(width), i, rng.choice(sources)) for i in range(rng.randrange(1, 40)))
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(8)))
        parts = [[(g, *r) for r in rows[a:b]] for g, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)]))]
        single = {g: {r[4] for r in p} for g, p in enumerate(parts) if len({r[1] for r in p}) == 1}
        ends = [e for p in parts for b in resolve.segment_ends(7, single)(batch(p)) for e in b.to_pylist()]
        carried = resolve.carried_states(ends, 7)
        found = {tuple(x.values())[:3] for p in parts for b in resolve.segment_members(7, carried)(batch(p)) for x in b.to_pylist()}
        expected = set()
        for title in {r[0] for r in rows}:
            entries = [(D(2020, 1, 1) + datetime.timedelta(d), i, s, []) for t, d, i, s in rows if t == title]
            expected |= {(i, ids[0], title) for ids in nested_loop(entries, 7) for i in ids[1:]}
        assert found == expected


def test_registered_passes_match_equal_titles(spark):
    """The queries against the model over the binding's own titles, 7 days apart at most."""
    sf_dir = "/root/testdata/sf0.01"
    rows = notices(spark, sf_dir, cpv=True).select("notice_id", "source", "procurer_ico", "title_slug", "publication_date", "ingested_at").collect()

    def model(rows):
        titles = {}
        for r in rows:
            if not r.procurer_ico and r.title_slug:
                titles.setdefault(r.title_slug, []).append((r.publication_date, r.notice_id, r.source, []))
        return {(i, ids[0]) for entries in titles.values() for ids in nested_loop(sorted(entries), 7) for i in ids}

    expected = model(rows)
    assert len(expected) > 100 and {(r.notice_id, r.canonical) for r in risk_queries.dedup_pass2(spark, sf_dir).collect()} == expected
    end = datetime.datetime.fromisoformat(risk_queries.WINDOW_END)
    late = model([r for r in rows if end - datetime.timedelta(30) <= r.ingested_at < end])
    stamped = {r.notice_id: r.canonical_id for r in risk_queries.dedup_all(spark, sf_dir).collect()}
    assert late and all(stamped[i] is not None for i, _ in late)


def test_late_third_source_joins_its_settled_group(spark):
    rows = [(1, "vestnik", "P", "x", "45", D(2024, 1, 1), None), (2, "crz", "P", "x", "45", D(2024, 1, 5), None)]
    n = spark.createDataFrame(rows, RES)
    a = spark.createDataFrame([], "notice_id bigint, supplier_ico string, award_value double")
    settled, _ = resolve.resolve(n, a)
    assert {r.canonical_id for r in settled.collect()} == {"1"}
    assert resolve.pass_one(settled).count() == 0
    late = settled.unionByName(spark.createDataFrame([(3, "ted", "P", "x", "45", D(2024, 3, 1), None)], RES))
    again, _ = resolve.resolve(late, a)
    assert {r.canonical_id for r in again.collect()} == {"1"} and resolve.pass_one(again).count() == 0


def test_same_source_never_matches_and_frequent_suppliers_are_left_out(spark):
    same = spark.createDataFrame([(i, "crz", "P", "x", "45", D(2024, 1, i), None) for i in (1, 2)], RES)
    assert resolve.pass_one(same).count() == 0
    many = spark.createDataFrame([(i, "crz" if i % 2 else "ted", None, None, None, D(2024, 1, 1), None) for i in range(1, 22)], RES)
    a = spark.createDataFrame([(i, "S", 10.0) for i in range(1, 22)], "notice_id bigint, supplier_ico string, award_value double")
    assert resolve.pass_three(many, a).count() == 0 and resolve.pass_three(many, a, most=21).count() == 11


def test_upsert_replay(spark):
    schema = "source string, source_id string, title string, content_hash string, canonical_id string, ingested_at string, seq bigint"
    one = spark.createDataFrame([("crz", "1", "a", "h1", None, "t1", 1), ("crz", "2", "b", "h2", None, "t1", 1), ("crz", "2", "c", "h3", None, "t1", 2)], schema)
    last = upsert.keep_last(one)
    empty = spark.createDataFrame([], schema).drop("seq")
    stored = upsert.upsert_notices(empty, last)
    assert {(r.source_id, r.title) for r in stored.collect()} == {("1", "a"), ("2", "c")}
    two = spark.createDataFrame([("crz", "1", "z", "h9", "x", "t2", 1), ("crz", "2", "c", "h3", None, "t2", 1), ("ted", "1", "n", "h1", None, "t2", 1)], schema)
    c = upsert.counts(upsert.decide(two, stored)).first()
    assert (c.inserted, c.updated, c.skipped) == (1, 1, 1)
    after = {(r.source, r.source_id): (r.title, r.canonical_id, r.ingested_at) for r in upsert.upsert_notices(stored.withColumn("canonical_id", F.lit("k")), two).collect()}
    assert after == {("crz", "1"): ("z", "k", "t1"), ("crz", "2"): ("c", "k", "t1"), ("ted", "1"): ("n", None, "t2")}


def test_registry_counts_redeliveries(spark):
    reg = spark.createDataFrame([("crz", "1", "h", None, 0)], "source string, source_id string, content_hash string, last_seen_at timestamp_ntz, skipped_count bigint")
    b = spark.createDataFrame([("crz", "1", "h"), ("crz", "2", "i")], "source string, source_id string, content_hash string")
    out = {r.source_id: r.skipped_count for r in upsert.upsert_registry(reg, b, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert out == {"1": 1, "2": 0}


@pytest.mark.parametrize("query, kind", [("", "exists"), (None, "exists"), ('"a b"', "phrase"), ("fakul*", "wildcard"), ("fak?lta", "wildcard"), ("*ulta", "compound"), ("fa*", "compound"), ("plain", "compound")])
def test_classifier(query, kind):
    assert text.classify(query) == kind


def test_text_search(spark):
    df = spark.createDataFrame([("Fakulta informatiky",), ("Nemocnica",), (None,)], "title string")
    for q, n in (("fakul*", 1), ('"fakulta informatiky"', 1), ("Nemocnicá", 1), ("nemocnyca", 1), ("infor", 1), ("", 2), ("zzzzzz", 0)):
        assert df.where(text.matches(q, "title")).count() == n, q


def test_cursor():
    assert search.decode_cursor(search.encode_cursor(40)) == 40 and search.decode_cursor(None) == search.decode_cursor("") == 0
    for wrong in ("!", "abc", search.encode_cursor(-1), search.encode_cursor(10_001)):
        with pytest.raises(ValueError):
            search.decode_cursor(wrong)
    assert search.next_cursor(9990, 20, 20, 10**6) is None
    assert search.next_cursor(0, 20, 20, 21) is not None and search.next_cursor(0, 20, 20, 20) is None and search.next_cursor(0, 20, 5, 99) is None


def test_vector_search_skips_other_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, round(r.score, 3)) for r in search.vector_top_k(v, [1.0, 0.0], 5).collect()] == [(1, 1.0), (2, 0.5)]


def test_graph_hops(spark):
    n = spark.createDataFrame([(1, "contract_award", "P", "p", "45000000", None, None, None, None, None), (2, "contract_award", "Q", "q", "45000000", None, None, None, None, None), (3, "contract_award", "R", "r", "99", None, None, None, None, None)], NOTICE)
    a = spark.createDataFrame([(1, 0, "S", "s", 5.0), (3, 0, "S", "s", 7.0)], AWARD).withColumn("signing_date", F.lit(None).cast("date"))
    assert {(r.org, r.hops) for r in graph.related(n, a, "P").collect()} == {("S", 2), ("Q", 4), ("R", 4)}
    assert {(r.org, r.total_value) for r in graph.ego(n, a, "P").collect()} == {("S", 5.0)}


def test_crz(spark):
    raw = [
        {"id": 1, "subject": "Road", "contracting_authority_name": "Mesto", "contracting_authority_cin_raw": "00123", "supplier_name": "Firma, s.r.o.", "supplier_cin": 456, "signed_on": "3202-03-02", "published_at": "2023-03-04 10:00", "contract_price_total_amount": "12.5", "attachments": [{"id": 1, "title": "t", "file_name": "a.pdf", "file_size": 3}, {"id": 2, "title": "u"}]},
        {"id": 2, "contract_identifier": "Z-1", "contract_price_total_amount": "x", "signed_on": "1024-01-01"},
    ]
    df = spark.read.schema(transforms.CRZ_RAW).json(spark.sparkContext.parallelize([json.dumps(r) for r in raw]))
    a, b = transforms.crz_notices(df, 2026).orderBy("source_id").collect()
    assert a.publication_date == D(2023, 3, 4) and a.procurer.ico == "00123" and a.awards[0].supplier.ico == "456" and a.awards[0].supplier.name_slug == "firma-s-r-o" and len(a.attachments) == 1
    assert b.title == "Z-1" and b.procurer is None and b.awards == [] and b.final_value is None and b.publication_date is None
    assert a.content_hash.startswith("sha256:") and a.content_hash != b.content_hash


def test_ted_languages_and_values(spark):
    raw = [
        {"publication-number": "1-2026", "notice-type": "can-standard", "publication-date": "2026-03-13+01:00", "notice-title": {"eng": "E", "slk": ["S"]}, "buyer-name": {"deu": ["B"]}, "winner-name": {"slk": ["A", "B"]}, "winner-identifier": ["SK12", "12345678"], "result-value-lot": ["1.5"], "tender-value": ["9"]},
        {"publication-number": "2", "notice-type": ["x"], "organisation-name-tenderer": ["T"], "tender-value": 7},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in raw], "value string").select(F.try_parse_json("value").alias("raw"))
    a, b = transforms.ted_notices(df).orderBy("source_id").collect()
    a, b = (b, a) if a.title == "ted--2" else (a, b)
    assert a.title == "S" and a.procurer.name == "B" and a.publication_date == D(2026, 3, 13) and a.status == "awarded"
    assert [(x.supplier.name, x.supplier.ico, x.value) for x in a.awards] == [("A", "12345678", 1.5), ("B", "12345678", 9.0)]
    assert b.notice_type == "other" and [(x.supplier.name, x.value) for x in b.awards] == [("T", 7.0)] and b.final_value == 7.0


def test_xml(spark):
    files = spark.createDataFrame([("/x/a.xml", b"<N><ID>7</ID><NoticeTypeCode>PIN</NoticeTypeCode><Name>T</Name></N>"), ("/x/b.xml", b"<broken"), ("/x/c.xml", b'<!DOCTYPE x [<!ENTITY e "v">]><N>&e;</N>')], "path string, content binary")
    rows = transforms.xml_notices(transforms.xml_fields(files)).collect()
    assert [(r.source_id, r.notice_type, r.title, r.currency) for r in rows] == [("7", "prior_information", "T", "EUR")]


def test_unzip_and_paged_and_checkpoints(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.xml", "<a/>")
        z.writestr("readme.txt", "x")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    assert readers.unzip(readers.read_xml_files(spark, str(tmp_path / "*.zip"))).count() == 1
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "page-0.json").write_text(json.dumps({"items": [{"id": 1}, {"id": 2}], "next": 1}))
    with pytest.raises(Exception, match="next page"):
        readers.read_paged(spark, str(pages)).count()
    (pages / "page-1.json").write_text(json.dumps({"items": [{"id": 3}], "next": None}))
    assert readers.read_paged(spark, str(pages)).count() == 3
    s = spark.createDataFrame([("crz", "1", "2024")], "source string, cursor string, last_run_at string")
    s = readers.save_checkpoint(readers.save_checkpoint(s, "crz", "2"), "ted", "9", "2025")
    assert {(r.source, r.cursor, r.last_run_at) for r in s.collect()} == {("crz", "2", "2024"), ("ted", "9", "2025")}


def test_discovery_filters(spark):
    p = spark.createDataFrame([("a", [("zip", "u"), ("CSV", "v.csv"), (None, "w.ZIP")])], "id string, resources array<struct<format:string,url:string>>")
    assert {r.url for r in readers.zipped_resources(p).collect()} == {"u", "w.ZIP"}


def test_dates_and_ages(spark):
    n = spark.createDataFrame([(1, D(3202, 1, 1), D(2024, 1, 1), [(D(1890, 1, 1),)]), (2, D(2025, 1, 1), None, [])], "notice_id bigint, publication_date date, award_date date, awards array<struct<signing_date:date>>")
    assert {(r.notice_id, r.field, r.reason) for r in health.date_issues(n, 2026).collect()} == {(1, "publication_date", "too_late"), (1, "awards.0.signing_date", "too_early")}
    assert {r.publication_date for r in health.clamp_dates(n, 2026).collect()} == {None, D(2025, 1, 1)}
    df = spark.createDataFrame([(90061.0,), (7200.0,), (120.0,), (None,)], "s double")
    assert [r.a for r in df.select(human_age(F.col("s")).alias("a")).collect()] == ["1d", "2h", "2m", "never"]
    assert [r.y for r in spark.createDataFrame([("2040-01-01",), ("1992-01-01",), ("2024-05",), (None,)], "d string").select(year_from_date("d", 2026).alias("y")).collect()] == [0, 0, 2024, 0]


def test_worker_status_order(spark):
    t = datetime.datetime(2024, 1, 2)
    rows = [(1, t, "error", "cycle_failed", "dedup-worker"), (2, t, "info", "worker_stopped", "ingestor"), (3, t - datetime.timedelta(hours=3), "info", "cycle_complete", "extractor:crz"), (4, t, "info", "cycle_complete", "extractor:ted")]
    log = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, level string, event string, component string")
    got = {r.component: r.status for r in health.worker_status(log, F.lit(t).cast("timestamp_ntz"), ("dedup-worker", "ingestor", "extractor:crz", "extractor:ted", "extractor:itms")).collect()}
    assert got == {"dedup-worker": "error", "ingestor": "stopped", "extractor:crz": "stale", "extractor:ted": "healthy", "extractor:itms": "unknown"}


def test_stream_restart_poison_and_duplicates(spark, tmp_path):
    def entry(i, **more):
        return json.dumps({"payload": json.dumps({"source": "crz", "source_id": str(i), "notice_type": "contract_award", "status": "awarded", "title": "t", "final_value": 1.0, "publication_date": "3000-01-01" if i == 2 else "2024-01-01"} | more), "hash": f"h{i}", "run": "r", "seq": i})

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join([entry(1), entry(2), json.dumps({"payload": "{", "hash": "x", "run": "r", "seq": 9}), entry(3, source="nowhere"), entry(4, status="odd")]))
    store = ingest.NoticeStore(spark, str(tmp_path / "store"))

    def run():
        ingest.ingest(ingest.read_entries(spark, str(tmp_path / "in")), store, str(tmp_path / "offsets"), F.lit("2026-01-01").cast("timestamp_ntz"), 2026).awaitTermination()

    run()
    (tmp_path / "in/b.json").write_text("\n".join([entry(1), entry(5)]))
    run()
    run()
    assert {(r.source_id, str(r.publication_date)) for r in store.notices().collect()} == {("1", "2024-01-01"), ("2", "None"), ("5", "2024-01-01")}
    assert {r.reason for r in store.dead().collect()} == {"not json", "source", "status"}


def test_entities_and_companies(spark):
    rows = spark.createDataFrame([("1", "Old", "old", "crz", 1), ("1", "New", "new", "ted", 2), (None, "X", "x", "crz", 3)], "ico string, name string, name_slug string, source string, seq bigint")
    assert {(r.entity, r.name, tuple(r.sources)) for r in upsert.upsert_entities(rows).collect()} == {("ico:1", "New", ("crz", "ted")), ("slug:x", "X", ("crz",))}
    e = "ico string, name string, n bigint, total double"
    m = company.merge_companies(spark.createDataFrame([("1", "S", 2, 5.0)], e), spark.createDataFrame([("1", "P", 2, 1.0), ("2", "Q", 1, 1.0)], e))
    assert {(r.ico, r.name, r.n, r.total, r.primary_role) for r in m.collect()} == {("1", "S", 4, 6.0, "supplier"), ("2", "Q", 1, 1.0, "procurer")}

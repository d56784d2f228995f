"""What the ingest loop leaves on disk: landed files and shuffles go, tables are compressed, slices keep to their buckets."""

import json
import os
import time

import pyarrow.parquet as pq

from tenderspark.plans import source_queries
from tenderspark.streaming import ingest, store


def entries(spark, ids):
    bodies = [(json.dumps({"source": "crz", "source_id": str(i), "notice_type": "contract_award", "status": "awarded", "procurer": {"ico": "1", "name": "x"}}), f"h{i}", "run", i) for i in ids]
    return spark.createDataFrame(bodies, ingest.ENTRY)


def test_landed_files_go_once_taken_in(spark, tmp_path):
    kept, now = ingest.NoticeStore(spark, str(tmp_path / "store"), buckets=2), ingest.F.lit("2026-01-01").cast("timestamp_ntz")
    for n in range(2):
        entries(spark, range(5 * n, 5 * n + 6)).write.json(str(tmp_path / f"in/{n}"))
        ingest.ingest(ingest.read_entries(spark, str(tmp_path / "in/*"), delete=True), kept, str(tmp_path / "offsets"), now, 2026).awaitTermination()
    assert kept.notices().count() == 11 and not list((tmp_path / "in/0").glob("*.json"))


def test_a_batch_leaves_no_shuffle_files(spark, tmp_path):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffles():
        return {f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(ingest.BRIEF)
    ingest.NoticeStore(spark, str(tmp_path), buckets=2).write(entries(spark, range(50)), 0, ingest.F.lit("2026-01-01").cast("timestamp_ntz"), 2026)
    until = time.time() + 30
    while shuffles() - before and time.time() < until:
        time.sleep(0.5)
    assert not shuffles() - before and spark.conf.get(ingest.BRIEF) == setting


def test_buckets_are_compressed_and_written_by_several_tasks(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path), "k bigint, x string", ["k"], buckets=1)
    rows = spark.range(20_000).selectExpr("id AS k", "sha2(cast(id AS string), 256) AS x")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so few rows would else be one task's
    try:
        t.write(rows, 0, t.touched(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = [pq.ParquetFile(f) for f in (tmp_path / "v=0/bucket=0").glob("*.parquet")]
    assert len(files) > 1 and t.read().exceptAll(rows).count() == 0 and t.read().count() == 20_000
    for f in files:
        keys = f.read(["k"])["k"].to_pylist()
        assert f.metadata.row_group(0).column(1).compression == "ZSTD" and keys == sorted(keys)


def test_slices_hold_all_notices_by_bucket(spark, sf_dir, tmp_path, monkeypatch):
    kept = ingest.NoticeStore(spark, str(tmp_path / "store"), buckets=4)
    whole, bucket = source_queries.notices(spark, sf_dir), kept.tables["notices"].bucket()
    n = whole.count()
    for rows, slices in ((n, 1), (n // 4, 2), (n // 10, 8)):
        monkeypatch.setattr(source_queries, "LANDED_ROWS", rows)
        assert source_queries._placed(spark, sf_dir, kept, str(tmp_path / f"rows{slices}")) == slices
        placed = spark.read.parquet(str(tmp_path / f"rows{slices}"))
        assert placed.select("notice_id").exceptAll(whole.select("notice_id")).count() == 0 and placed.count() == n
        of = {}
        for r in placed.select("slice", bucket.alias("bucket")).distinct().collect():
            of.setdefault(r["bucket"], set()).add(r["slice"])
        assert set().union(*of.values()) == set(range(slices)) and sum(map(len, of.values())) == max(4, slices)
    awards = source_queries.award_rows(spark, sf_dir, False)
    assert placed.selectExpr("notice_id", "explode(awards) AS a").selectExpr("notice_id", "a.ico", "a.value", "a.signing_date").exceptAll(awards.select("notice_id", "supplier_ico", "award_value", "signing_date")).count() == 0
    assert placed.selectExpr("sum(size(awards))").first()[0] == awards.count()

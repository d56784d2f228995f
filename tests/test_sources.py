"""Scans as a stream, capped searches, and the readers of landed files."""

import datetime
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tenderspark.operators import repairs
from tenderspark.sources import capped, scans

D = datetime.date


def land_page(root, source, scan, page, items, following):
    folder = root / f"source={source}" / f"scan={scan}" / f"page={page}"
    folder.mkdir(parents=True)
    (folder / "p.json").write_text(json.dumps({"items": items, "next": following}))


def run(spark, root, out, keep=0):
    """One bounded run of a new reader over the same offsets, as after a restart."""
    stream = scans.read_scans(spark, str(root), keep)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.source, r.scan, r.page, json.loads(r.value)["id"]) for r in spark.read.schema(scans.SCHEMA).parquet(f"{out}/rows").collect())


@pytest.mark.parametrize("keep", [0, 1])
def test_scans_are_read_once_and_only_whole(spark, tmp_path, keep):
    root, out = tmp_path / "in", tmp_path / "out"
    land_page(root, "crz", "001", 0, [{"id": 1}, {"id": 2}], 1)
    land_page(root, "crz", "001", 1, [{"id": 3}], None)
    land_page(root, "crz", "002", 0, [{"id": 4}], 1)  # breaks off
    land_page(root, "crz", "003", 0, [{"id": 6}], None)
    land_page(root, "ted", "001", 0, [], None)
    land_page(root, "ted", "002", 1, [{"id": 9}], None)  # its first page is missing
    first = [("crz", "001", 0, 1), ("crz", "001", 0, 2), ("crz", "001", 1, 3)]
    assert run(spark, root, out, keep) == first
    assert run(spark, root, out, keep) == first
    land_page(root, "crz", "002", 1, [{"id": 5}], None)
    land_page(root, "ted", "002", 0, [{"id": 8}], 1)
    whole = first + [("crz", "002", 0, 4), ("crz", "002", 1, 5), ("crz", "003", 0, 6), ("ted", "002", 0, 8), ("ted", "002", 1, 9)]
    assert run(spark, root, out, keep) == whole
    land_page(root, "ted", "003", 0, [{"id": 10}], None)
    assert run(spark, root, out, keep) == whole + [("ted", "003", 0, 10)]
    assert keep == 0 or not (root / "source=crz" / "scan=001").exists() and (root / "source=crz" / "scan=003").exists()


def test_landing_numbers_pages(spark, tmp_path):
    rows = spark.range(25).select(F.lit("crz").alias("source"), F.lit("1").alias("scan"), F.col("id").alias("at"), F.to_json(F.struct("id")).alias("value"))
    scans.land(rows, str(tmp_path / "in"), 10)
    assert run(spark, tmp_path / "in", tmp_path / "out") == [("crz", "1", i // 10, i) for i in range(25)]


@pytest.fixture
def landed(tmp_path):
    """900 rows of one year, of which 600 are of one day; three have no day."""
    days = [D(2023, 7, 4)] * 600 + [D(2023, 1, 1) + datetime.timedelta(i) for i in range(300)] + [None] * 3
    path = str(tmp_path / "up.parquet")
    pq.write_table(pa.table({"day": pa.array(days, pa.date32()), "key": list(range(903)), "more": ["x"] * 903}), path)
    return path


def test_an_overfull_year_is_read_whole(spark, landed):
    assert capped.LandedUpstream(landed, "day", "key", 100).count(capped.Span(D(2023, 1, 1), D(2024, 1, 1))) == 900
    assert sum(b.num_rows for b in capped.LandedUpstream(landed, "day", "key", 100).read(capped.Span(D(2023, 1, 1), D(2024, 1, 1)), ["key"])) == 100  # what a read by years gives
    df = capped.read_capped(spark, landed, "day", "key", cap=100)
    assert df.columns == ["day", "key", "more"] and sorted(r.key for r in df.collect()) == list(range(900))
    assert df.rdd.getNumPartitions() >= 9
    years = spark.createDataFrame([(2023, D(2023, 1, 1), D(2024, 1, 1), 5)], "year int, first date, after date, n bigint")
    assert capped.read_capped(spark, landed, "day", "key", "key bigint", 100, repairs.spans_to_read(years)).count() == 900
    assert capped.read_capped(spark, landed, "day", "key", cap=100, spans=[]).count() == 0


def test_filters_reach_the_upstream(spark, landed):
    df = capped.read_capped(spark, landed, "day", "key", cap=1000)
    assert df.where(F.col("day") == D(2023, 7, 4)).count() == 601
    assert df.where((F.col("day") > D(2023, 1, 1)) & (F.col("day") <= D(2023, 1, 3))).count() == 2
    assert df.where((F.col("day") >= D(2023, 1, 1)) & (F.col("day") < D(2023, 1, 3)) & (F.col("key") > 600)).count() == 1
    reader = capped.CappedReader(capped.LandedUpstream(landed, "day", "key", 1000), ["key"], None)
    list(reader.pushFilters([capped.GreaterThanOrEqual(("day",), D(2023, 2, 1)), capped.LessThan(("day",), D(2023, 3, 1))]))
    assert [p.span[:2] for p in reader.partitions()] == [(D(2023, 2, 1), D(2023, 3, 1))]


def test_a_key_over_the_cap_is_an_error(spark, tmp_path):
    path = str(tmp_path / "up.parquet")
    pq.write_table(pa.table({"day": pa.array([D(2023, 1, 1)] * 9, pa.date32()), "key": [1] * 9}), path)
    with pytest.raises(Exception, match="over the limit"):
        capped.read_capped(spark, path, "day", "key", cap=5).count()

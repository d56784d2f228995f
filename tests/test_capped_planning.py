"""Capped searches: the number of partitions does not grow with the number of queries that the cap needs."""

import datetime

from tenderspark.sources import capped


def test_many_queries_need_few_partitions(spark, tmp_path):
    rows = spark.range(1500).selectExpr("id AS key", "date_add(DATE '2023-01-01', cast(id % 40 AS int)) AS day")
    path = str(tmp_path / "up")
    capped.land_by_day(rows, path, "day", "key")
    df = capped.read_capped(spark, path, "day", "key", cap=2)
    reader = capped.CappedReader(capped.LandedUpstream(path, "day", "key", 2), ["key"], None)
    assert len(reader.partitions()) <= 2 * capped.PARTITIONS < 750
    assert sorted((r.key, r.day) for r in df.collect()) == [(i, datetime.date(2023, 1, 1) + datetime.timedelta(i % 40)) for i in range(1500)]

"""Tasks of steps by notice do not grow with the table."""

import pytest
from pyspark.sql import functions as F

from tenderspark.functions import dealing
from tenderspark.operators import company, risk, spend


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 50)


def awards_of(spark, n):
    """Two awards of one supplier and one of another for each notice; every tenth notice has an unnamed one."""
    return spark.range(3 * n).select(F.floor(F.col("id") / 3).alias("notice_id"), F.when((F.col("id") % 3 != 0) | (F.col("id") % 30 != 0), F.concat(F.lit("s"), (F.col("id") % 3 == 2).cast("int"))).alias("supplier_ico"))


def largest(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count").alias("n")).first().n


def test_awards_are_dealt_over_more_tasks_as_they_grow(spark, few):
    for n in (400, 4000):
        assert largest(spend.wholly_identified(awards_of(spark, n))) < 150
    rows = company.entity_stats_suppliers(spark.range(400).selectExpr("id AS notice_id", "1.0D AS final_value"), awards_of(spark, 400)).collect()
    assert sorted(tuple(r) for r in rows) == [("s0", 360, 360.0), ("s1", 360, 360.0)]


def test_flags_are_dealt_over_more_tasks_as_they_grow(spark, few):
    for n in (400, 4000):
        notices = spark.range(n).selectExpr("id AS notice_id", "concat('p', id) AS procurer_ico", "'30000000' AS cpv_code", "'open' AS procedure_type", "1.0D AS final_value", "1.0D AS estimated_value", "DATE '2024-01-01' AS award_date", "DATE '2024-01-01' AS publication_date")
        met = risk.meetings(notices, awards_of(spark, n))
        assert largest(met) < 150
        assert largest(risk.pairs(met).where("role = 'supplier'")) < 150
        assert largest(risk.bursts(risk.timeline(met))) < 150

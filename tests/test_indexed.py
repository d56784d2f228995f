"""Cells of vectors and sketches of categories against exact results."""

import numpy as np
from pyspark.sql import functions as F

from tenderspark.operators import markets, search
from tenderspark.operators.cells import VectorCells


def test_cells_of_grouped_vectors(spark, tmp_path):
    """2000 vectors around 40 directions, a third of them one and the same, and some without a cosine."""
    rng = np.random.default_rng(3)
    directions = rng.normal(size=(40, 16))
    rows = [(i, (directions[i % 40] + 0.1 * rng.normal(size=16)).tolist()) for i in range(2000)]
    rows += [(2000 + i, directions[0].tolist()) for i in range(1000)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [1.0] * 8), (3003, [float("nan")] * 16), (3004, [None] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorCells.build(v, str(tmp_path / "cells"), 16, cells=64)
    assert index.table.count() == 3000 and index.recall >= 0.95
    good = v.where("vec_id < 3000")
    for i in (1, 17, 39):
        q = rows[i][1]
        want = [(r.vec_id, round(r.score, 9)) for r in search.vector_top_k(good, q, 5).collect()]
        read = index.cells_to_read(q, 5)
        assert len(read) <= 6, "a tenth of the cells"
        assert len(set(want) & {(r.vec_id, round(r.score, 9)) for r in index.top_k(q, 5).collect()}) >= 4
        assert [(r.vec_id, round(r.score, 9)) for r in index.top_k(q, 5, exact=True).collect()] == want
    assert index.top_k(rows[0][1], 4000, exact=True).count() == 3000
    plan = index.top_k(rows[1][1], 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan


def test_cells_of_no_vectors(spark, tmp_path):
    v = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert VectorCells.build(v, str(tmp_path / "cells"), 16).top_k([1.0] * 16).count() == 0


def test_sketched_medians(spark):
    """Large categories are within the bound of ranks, small ones exact; a touched bucket is replaced, others stay."""
    n = spark.range(60000).select(
        F.col("id").alias("notice_id"), F.when(F.col("id") % 100 == 1, "small").when(F.col("id") % 100 == 2, None).otherwise("large").alias("cpv_code"), F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(1000003)).cast("double")).alias("final_value")
    )
    bucket = F.pmod("notice_id", F.lit(8))
    stored = markets.market_sketches(n.withColumn("final_value", F.when(bucket == 3, 5.0).otherwise(F.col("final_value"))), bucket)
    touched = spark.createDataFrame([(3,), (3,)], "bucket long")
    got = {r.cpv_code: r for r in markets.market_medians(markets.refreshed(stored, markets.market_sketches(n.where(bucket == 3), bucket), touched)).collect()}
    values = n.withColumn("v", F.coalesce("final_value", F.lit(0.0)))
    for code in ("small", "large"):
        v = np.sort([r.v for r in values.where(F.col("cpv_code") == code).select("v").collect()])
        assert got[code].n == len(v) and got[code].total == v.sum()
        rank = np.searchsorted(v, got[code].median, side="right") / len(v)
        assert abs(rank - 0.5) < (0.01 if code == "large" else 1.01 / len(v))
    assert set(got) == {"small", "large"}
    empty = markets.market_medians(markets.market_sketches(n.limit(0), bucket))
    assert empty.count() == 0

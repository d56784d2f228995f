"""Vector search through a table of cells: vectors stored by their nearest centroid, of which a query reads a few. How few
depends on the data: of vectors that form groups, those of one or two; of vectors without any, most, which the audit finds.

Vectors that are null, zero, of another width or not finite are in no cell, as they have no cosine with any other.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import cosine, vector_top_k

#: Rows a cell that centroids are fitted on, neighbours a query has candidates for, and audited queries.
ROWS_PER_CELL, LEAST_CANDIDATES, AUDITED = 256, 100, 64


def _unit(c: str) -> F.Column:
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x.cast("double") / norm)


def _usable(vectors: DataFrame, vector_col: str, dims: int) -> DataFrame:
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    return vectors.where((F.size(vector_col) == dims) & whole)


class VectorCells:
    """Cells in Parquet, their centroids, sizes and radii (largest angle to the centroid), and how many nearest ones a query
    reads. A cell without rows has neither size nor radius."""

    def __init__(self, table: DataFrame, centroids: np.ndarray, sizes: dict[int, int], radii: dict[int, float], id_col: str, vector_col: str):
        self.table, self.centroids, self.sizes, self.radii, self.id_col, self.vector_col = table, centroids, sizes, radii, id_col, vector_col
        self.probes, self.recall = 1, 1.0

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, dims: int, cells: int = 64, k: int = 10, target: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1) -> VectorCells:
        """Centroids are fitted on about `cells` x 256 rows, taken by a hash of the id; every usable row is stored. The number
        of cells a query reads is the least with which the audited rows find `target` of their exact neighbours."""
        spark: SparkSession = vectors.sparkSession
        rows = _usable(vectors, vector_col, dims).withColumn("_unit", _unit(vector_col))
        n = rows.count()
        keep = max(1, n // (cells * ROWS_PER_CELL))
        sample = rows.where(F.pmod(F.xxhash64(id_col), F.lit(keep)) == 0).select(array_to_vector("_unit").alias("features"))
        if n == 0:
            return cls(rows.withColumn("cell", F.lit(0)).drop("_unit"), np.zeros((1, dims)), {}, {}, id_col, vector_col)
        model = KMeans(k=cells, maxIter=10, seed=seed, predictionCol="cell").fit(sample)
        placed = model.transform(rows.withColumn("features", array_to_vector("_unit"))).drop("features", "_unit")
        # a cell that holds a large part of all rows is written by several tasks
        placed.repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(8))).write.partitionBy("cell").parquet(folder)
        table = spark.read.parquet(folder)
        centroids = np.array(model.clusterCenters())
        centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, _c array<double>")
        angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(F.col(vector_col), F.col("_c")))))
        per = table.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(angle).alias("radius")).collect()
        index = cls(table, centroids, {r["cell"]: r["n"] for r in per}, {r["cell"]: r["radius"] for r in per}, id_col, vector_col)
        index.audit(k, target)
        return index

    def _cosines(self, query: list[float]) -> np.ndarray:
        q, c = np.asarray(query, dtype=float), self.centroids
        return c @ q / np.maximum(np.linalg.norm(c, axis=1) * np.linalg.norm(q), 1e-300)

    def nearest_cells(self, query: list[float]) -> list[int]:
        """Cells by falling cosine of their centroid; ties by number."""
        near, c = self._cosines(query), self.centroids
        return [int(i) for i in np.lexsort((np.arange(len(c)), -near))]

    def cells_to_read(self, query: list[float], k: int) -> list[int]:
        """The nearest cells: at least `probes`, and as many as hold max(10 k, 100) rows."""
        found, held = [], 0
        for cell in self.nearest_cells(query):
            if len(found) >= self.probes and held >= max(10 * k, LEAST_CANDIDATES):
                break
            found.append(cell)
            held += self.sizes.get(cell, 0)
        return found

    def cells_in_reach(self, query: list[float], cosine_bound: float) -> list[int]:
        """Cells that can hold a vector of at least this cosine: those whose centroid's angle less the radius allows it."""
        reach = np.arccos(np.clip(cosine_bound, -1, 1)) + 1e-6
        angles = np.arccos(np.clip(self._cosines(query), -1, 1))
        return [c for c in self.nearest_cells(query) if c in self.radii and angles[c] - self.radii[c] <= reach]

    def _of_cells(self, cells: list[int], query: list[float], k: int) -> DataFrame:
        return vector_top_k(self.table.where(F.col("cell").isin(cells)).drop("cell"), query, k, self.id_col, self.vector_col)

    def top_k(self, query: list[float], k: int = 10, exact: bool = False) -> DataFrame:
        """The nearest of the cells read, as `vector_top_k` gives them. If `exact`, of all rows: the k-th of the cells read
        bounds the score, and every cell in reach of that bound is read."""
        cells = self.cells_to_read(query, k)
        if exact:
            scores = [r["score"] for r in self._of_cells(cells, query, k).select("score").collect()]
            cells = self.cells_in_reach(query, 2 * scores[-1] - 1) if len(scores) == k else sorted(self.sizes)
        return self._of_cells(cells, query, k)

    def audit(self, k: int, target: float) -> None:
        """Set `probes` and `recall`: exact neighbours of 64 rows, taken by a hash of the id, among all rows, in one pass."""
        asked = self.table.orderBy(F.xxhash64(self.id_col), self.id_col).limit(AUDITED).select(F.col(self.id_col).alias("_q"), F.col(self.vector_col).alias("_v"))
        best = Window.partitionBy("_q").orderBy(F.desc("_s"), self.id_col)
        scored = self.table.crossJoin(F.broadcast(asked)).select("_q", self.id_col, "cell", cosine(F.col(self.vector_col), F.col("_v")).alias("_s"))
        exact = scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("_q", "cell").collect()
        order = {r["_q"]: {c: i for i, c in enumerate(self.nearest_cells(r["_v"]))} for r in asked.collect()}
        ranks = np.sort([order[r["_q"]][r["cell"]] for r in exact])
        at = int(np.ceil(target * len(ranks))) - 1
        self.probes = int(ranks[at]) + 1
        self.recall = float((ranks < self.probes).mean())

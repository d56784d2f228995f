"""The procurement graph as edge tables and neighbourhood queries as unrolled joins (notices stand at one end of each edge,
so organisations lie at even distances)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import money


def issued(notices: DataFrame) -> DataFrame:
    return notices.where("procurer_ico IS NOT NULL").select("notice_id", F.col("procurer_ico").alias("org")).distinct()


def awarded_to(awards: DataFrame) -> DataFrame:
    """One edge a (notice, supplier), with the value of its first award."""
    first = F.min(F.struct("pos", "award_value", "signing_date"))
    return awards.where("supplier_ico IS NOT NULL").groupBy("notice_id", F.col("supplier_ico").alias("org")).agg(first.alias("f")).select("notice_id", "org", F.col("f.award_value").alias("value"), F.col("f.signing_date").alias("award_date"))


def classified_by(notices: DataFrame) -> DataFrame:
    return notices.where("cpv_code IS NOT NULL").select("notice_id", "cpv_code").distinct()


def merge_nodes(rows: DataFrame) -> DataFrame:
    """Organisation nodes from rows (key, name, seq): properties of the first sight and of the last."""
    return rows.groupBy("key").agg(F.min_by("name", "seq").alias("created_name"), F.max_by("name", "seq").alias("name"))


def merge_notice_nodes(rows: DataFrame) -> DataFrame:
    """Notice nodes from rows (source, source_id, ..., seq): title, status and value of the last sight, and of the other
    properties those of the first."""
    refreshed = ["title", "status", "final_value"]
    created = [c for c in ("notice_type", "publication_date", "estimated_value", "currency", "cpv_code") if c in rows.columns]
    return merge_nodes_by(rows, ["source", "source_id"], created, refreshed)


def merge_nodes_by(rows: DataFrame, key: list[str], created: list[str], refreshed: list[str]) -> DataFrame:
    """One node a key: properties that its creation sets, by the first `seq`, and those that each sight refreshes."""
    return rows.groupBy(*key).agg(*[F.min_by(c, "seq").alias(c) for c in created], *[F.max_by(c, "seq").alias(c) for c in refreshed])


def edges(notices: DataFrame, awards: DataFrame) -> DataFrame:
    """(notice_id, org, type, value) of both kinds of organisations."""
    return issued(notices).select("notice_id", "org", F.lit("procurer").alias("type"), F.lit(None).cast("double").alias("value")).unionByName(awarded_to(awards).select("notice_id", "org", F.lit("supplier").alias("type"), "value"))


def supplier_concentration(notices: DataFrame, awards: DataFrame, ico: str, k: int = 10) -> DataFrame:
    own = issued(notices).where(F.col("org") == ico).select("notice_id")
    by = awarded_to(awards).join(own, "notice_id", "left_semi").groupBy("org").agg(F.count(F.lit(1)).alias("contract_count"), F.coalesce(money("value"), F.lit(0.0)).alias("total_value"))
    return by.select(F.col("org").alias("supplier_ico"), "contract_count", "total_value").orderBy(F.desc("total_value"), "supplier_ico").limit(k)


def ego(notices: DataFrame, awards: DataFrame, ico: str) -> DataFrame:
    """Organisations two hops from a company: paths, and the sum of the first award value on each path."""
    e = edges(notices, awards)
    start = e.where(F.col("org") == ico).select("notice_id", F.col("type").alias("own_type"), F.col("value").alias("own_value"))
    paths = e.join(start, "notice_id").where(F.col("org") != ico)
    return paths.groupBy("org", "type").agg(F.lit(2).alias("hops"), F.count(F.lit(1)).alias("paths"), F.coalesce(money(F.coalesce("own_value", "value")), F.lit(0.0)).alias("total_value"))


def degree(notices: DataFrame, awards: DataFrame, ico: str) -> DataFrame:
    """The start node and its number of edges, 0 without any."""
    one = notices.sparkSession.range(1).select(F.lit(ico).alias("org"))
    return one.join(edges(notices, awards).where(F.col("org") == ico).groupBy("org").agg(F.count(F.lit(1)).alias("n")), "org", "left").select("org", F.coalesce("n", F.lit(0)).alias("degree"))


def related(notices: DataFrame, awards: DataFrame, ico: str, k: int | None = 50) -> DataFrame:
    """Organisations at two or four hops, the latter also over a shared category; sets are reduced by semi-joins at each
    hop, so no paths are multiplied out."""
    won = awards.where("supplier_ico IS NOT NULL").select("notice_id", F.col("supplier_ico").alias("org"))
    e = issued(notices).unionByName(won).distinct()
    mine = e.where(F.col("org") == ico).select("notice_id").distinct()
    two = e.join(mine, "notice_id", "left_semi").where(F.col("org") != ico).select("org").distinct()
    codes = classified_by(notices)
    by_code = codes.join(codes.join(mine, "notice_id", "left_semi").select("cpv_code").distinct(), "cpv_code", "left_semi").select("notice_id")
    far = e.join(two, "org", "left_semi").select("notice_id").unionByName(by_code).distinct()
    four = e.join(far, "notice_id", "left_semi").where(F.col("org") != ico).select("org").distinct().join(two, "org", "left_anti")
    out = two.withColumn("hops", F.lit(2)).unionByName(four.withColumn("hops", F.lit(4)))
    return out if k is None else out.orderBy("hops", "org").limit(k)


def cpv_network(notices: DataFrame, awards: DataFrame, code: str, first: str, after: str, k: int | None = 100) -> DataFrame:
    """Procurer-supplier edges of a category's notices published from `first` to before `after`."""
    own = notices.where(F.col("cpv_code").startswith(code[:8]) & (F.col("publication_date") >= F.lit(first).cast("date")) & (F.col("publication_date") < F.lit(after).cast("date")) & F.col("procurer_ico").isNotNull()).select("notice_id", "procurer_ico")
    by = awarded_to(awards).join(own, "notice_id").groupBy("procurer_ico", F.col("org").alias("supplier_ico")).agg(F.count(F.lit(1)).alias("contract_count"), F.coalesce(money("value"), F.lit(0.0)).alias("total_value"))
    return by if k is None else by.orderBy(F.desc("total_value"), "procurer_ico", "supplier_ico").limit(k)


def network_nodes(network: DataFrame) -> DataFrame:
    return network.select(F.col("procurer_ico").alias("org"), F.lit("procurer").alias("type")).unionByName(network.select(F.col("supplier_ico").alias("org"), F.lit("supplier").alias("type"))).distinct()


def numbered_edges(network: DataFrame) -> DataFrame:
    """Edge ids e0, e1, ... by value; at most the network's cap of rows meets in the window."""
    w = Window.orderBy(F.desc("total_value"), "procurer_ico", "supplier_ico")
    return network.withColumn("id", F.concat(F.lit("e"), (F.row_number().over(w) - 1).cast("string")))

"""Readers of landed files, catalogue discovery, checkpoints, and a paged Python data source."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from glob import glob

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import parse_timestamp
from .transforms import CRZ_RAW, ITMS_RAW

ENVELOPE = "bulletinPublishDate string, year int, number int, bulletinItemList array<struct<itemData:string>>"


def read_crz(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    rows = spark.read.schema(CRZ_RAW).json(path)
    return rows.where(F.col("published_at") >= since) if since else rows


def crz_by_id(spark: SparkSession, path: str, key: int) -> DataFrame:
    """A contract, or no row."""
    return read_crz(spark, path).where(F.col("id") == key)


def read_itms(spark: SparkSession, path: str, min_id: int | None = None, max_items: int | None = None) -> DataFrame:
    rows = spark.read.schema(ITMS_RAW).json(path)
    rows = rows.where(F.col("id") >= min_id) if min_id is not None else rows
    return rows.orderBy("id").limit(max_items) if max_items else rows


def read_ted(spark: SparkSession, path: str) -> DataFrame:
    """(raw: variant), one JSON object a line; lines that do not parse are left out."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("raw")).where("raw IS NOT NULL")


def bulletin_items(envelopes: DataFrame) -> DataFrame:
    """(item, name, data, publish_date, year, number): the items of bulletins; an item that does not parse is skipped."""
    e = envelopes.select("bulletinPublishDate", "year", "number", F.explode("bulletinItemList.itemData").alias("data"))
    v = e.withColumn("v", F.try_parse_json("data")).where("v IS NOT NULL")
    return v.select(F.try_variant_get("v", "$.id", "string").alias("item"), F.try_variant_get("v", "$.name", "string").alias("name"), "data", F.col("bulletinPublishDate").alias("publish_date"), "year", "number")


def read_bulletins(spark: SparkSession, path: str) -> DataFrame:
    return bulletin_items(spark.read.schema(ENVELOPE).option("multiLine", True).json(path))


def read_xml_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def unzip(files: DataFrame, suffix: str = ".xml") -> DataFrame:
    """(path, content) of the members of zip files; a broken archive has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            if name.lower().endswith(suffix):
                                yield pd.DataFrame({"path": [f"{path}!/{name}"], "content": [z.read(name)]})
                except zipfile.BadZipFile:
                    continue

    return files.select("path", "content").mapInPandas(run, "path string, content binary")


def zipped_resources(packages: DataFrame) -> DataFrame:
    """Resources of packages (id, resources: array of format, url) that are ZIP files by format or name."""
    r = packages.select("id", F.explode("resources").alias("r"))
    return r.where((F.upper("r.format") == "ZIP") | F.lower("r.url").endswith(".zip")).select("id", "r.format", "r.url")


def discover_datasets(datasets: DataFrame, distributions: DataFrame, publisher: str, since: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Titles in Slovak of a publisher's datasets with each access URL, by modification; issued and modified may lack."""
    d = datasets.where((F.col("publisher") == publisher) & (F.col("lang") == "sk"))
    d = d.where(parse_timestamp("modified") >= F.lit(since).cast("timestamp_ntz")) if since else d
    out = d.join(distributions, "dataset").select("dataset", "title", "issued", "modified", "url")
    return out.orderBy(F.asc_nulls_first("modified"), "dataset", "url").offset(offset).limit(limit) if limit else out


def distinct_datasets(found: DataFrame) -> DataFrame:
    """One row a dataset, of the smallest URL."""
    return found.groupBy("dataset").agg(F.min("url").alias("url"), F.min("title").alias("title"))


def read_checkpoint(states: DataFrame, source: str) -> DataFrame:
    return states.where(F.col("source") == source)


def save_checkpoint(states: DataFrame, source: str, cursor: str, last_run_at=None) -> DataFrame:
    """State rows (source, cursor, last_run_at) with one replaced; the time stays where none is passed."""
    spark = states.sparkSession
    new = spark.createDataFrame([(source, cursor, last_run_at)], states.schema)
    old = states.where(F.col("source") == source).select("source", F.col("last_run_at").alias("_t"))
    new = new.join(old, "source", "left").select("source", "cursor", F.coalesce("last_run_at", "_t").alias("last_run_at"))
    return states.where(F.col("source") != source).unionByName(new)


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagedReader(DataSourceReader):
    """Landed pages {"items": [...], "next": n or null} in order. A scan that ends before a page without `next` is
    incomplete and raises, so that it is never taken for a whole one."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Page]:
        pages = sorted(glob(f"{self.folder}/page-*.json"))
        if pages:
            with open(pages[-1]) as f:
                if json.load(f).get("next") is not None:
                    raise ValueError(f"{self.folder}: the scan stops at {pages[-1]}, which names a next page")
        return [_Page(p) for p in pages]

    def read(self, partition: _Page) -> Iterator[tuple]:
        with open(partition.path) as f:
            for item in json.load(f)["items"]:
                yield (json.dumps(item),)


class PagedSource(DataSource):
    """``spark.read.format("paged").load(folder)``: one row an item, as JSON text. The folder must be visible to driver and
    executors."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options["path"])


def read_paged(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").load(folder)

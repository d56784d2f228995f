"""A streaming source of landed scans: pages of an upstream, of which Spark keeps the offsets of each source.

Layout: root/source=S/scan=N/page=K/<one file>, a file being {"items": [...], "next": K + 1 or null}, or page=K-L/<one file>
with the pages K to L, one a line, which `land` writes, so that a large scan is not a folder and a file a page.
Scans of a source follow each other by name. A scan is complete when its pages are 0..K without a gap and the last one
names no next page. Offsets stop before a source's first incomplete scan, so one that breaks off is never taken for a
whole one, and nothing behind it is read before its producer ends or removes it.

Files are reached by pyarrow's file systems (local, HDFS, S3, GCS by the folder's URI), from the driver and the executors.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.dealing import dealt

SCHEMA = "source string, scan string, page int, value string"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if colon and not rest.startswith("//"):  # file:/a/b, as the JVM writes it
        uri = f"{scheme}://{rest}"
    return pafs.FileSystem.from_uri(uri)


def _children(fs: pafs.FileSystem, folder: str, key: str) -> dict[str, str]:
    """{value: path} of the folders `key=value`, by value."""
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    mark = f"{key}="
    return {f.base_name[len(mark) :]: f.path for f in sorted(found, key=lambda f: f.base_name) if f.base_name.startswith(mark)}


def _load(fs: pafs.FileSystem, path: str, first: int, last: int | None) -> Iterator[tuple[int, dict]]:
    """(number, page) of a file: the one page `first`, or with `last` the pages up to it, of which one is held at a time."""
    with fs.open_input_stream(path) as f:
        if last is None:
            yield first, json.loads(f.read())
            return
        page = first - 1
        for page, line in enumerate(io.TextIOWrapper(f, "utf-8", newline="\n"), first):
            yield page, json.loads(line)
        if page != last:
            raise ValueError(f"{path}: its last page is {page}")


def pages_of(fs: pafs.FileSystem, scan: str) -> list[tuple[int, int | None, str]] | None:
    """(first page, last page or None, path) of a scan's files in order, or None while it is incomplete; one listing of the scan."""
    found: dict[tuple[int, int | None], list[str]] = {}
    for f in fs.get_file_info(pafs.FileSelector(scan, recursive=True, allow_not_found=True)):
        folder, _, name = f.path.removeprefix(f"{scan}/").rpartition("/")
        of_page = (folder if f.is_file else name).split("/")[0]
        if not of_page.startswith("page="):
            continue
        first, _, last = of_page.removeprefix("page=").partition("-")
        files = found.setdefault((int(first), int(last) if last else None), [])
        if f.is_file and "/" not in folder and name[0] not in "._":
            files.append(f.path)
    due, out = 0, []
    for (first, last), files in sorted(found.items(), key=lambda x: x[0][0]):
        if len(files) > 1:
            raise ValueError(f"{files[0]}: a page is one file")
        if first != due or not files:
            return None
        due = (first if last is None else last) + 1
        out.append((first, last, files[0]))
    if not out:
        return None
    *_, (_, page) = _load(fs, out[-1][2], *out[-1][:2])
    return out if page.get("next") is None else None


class _Pages(InputPartition):
    def __init__(self, files: list[tuple[str, str, int, int | None, str]]):
        self.files = files


class ScanReader(DataSourceStreamReader):
    def __init__(self, folder: str, pages_per_task: int, keep: int):
        self.folder, self.pages_per_task, self.keep = folder, pages_per_task, keep
        self.reached: dict[str, str] = {}

    def initialOffset(self) -> dict:
        return {}

    def _root(self) -> tuple[pafs.FileSystem, dict[str, str]]:
        fs, root = file_system(self.folder)
        return fs, _children(fs, root, "source")

    def latestOffset(self) -> dict:
        """The last scan of each source before which all are complete."""
        fs, sources = self._root()
        for source, folder in sources.items():
            for scan, path in _children(fs, folder, "scan").items():
                if scan <= self.reached.get(source, ""):
                    continue
                if pages_of(fs, path) is None:
                    break
                self.reached[source] = scan
        return dict(self.reached)

    def partitions(self, start: dict, end: dict) -> list[_Pages]:
        fs, sources = self._root()
        tasks, held = [], self.pages_per_task
        for source, until in end.items():
            for scan, path in _children(fs, sources[source], "scan").items():
                if not start.get(source, "") < scan <= until:
                    continue
                for first, last, file in pages_of(fs, path):
                    n = 1 if last is None else last - first + 1
                    if held + n > self.pages_per_task:
                        tasks.append([])
                        held = 0
                    tasks[-1].append((source, scan, first, last, file))
                    held += n
        return [_Pages(files) for files in tasks]

    def read(self, partition: _Pages | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = file_system(self.folder)
        for source, scan, first, last, path in partition.files:
            for page, content in _load(fs, path, first, last):
                items = [json.dumps(x, ensure_ascii=False) for x in content["items"]]
                n = len(items)
                yield pa.RecordBatch.from_arrays([pa.array([source] * n, pa.string()), pa.array([scan] * n, pa.string()), pa.array([page] * n, pa.int32()), pa.array(items, pa.string())], ["source", "scan", "page", "value"])

    def commit(self, end: dict) -> None:
        """Delete scans that were read, but for the last `keep` of a source; 0 keeps all."""
        if not self.keep:
            return
        fs, sources = self._root()
        for source, last in end.items():
            done = [path for scan, path in _children(fs, sources.get(source, ""), "scan").items() if scan <= last] if source in sources else []
            for path in done[: -self.keep]:
                fs.delete_dir(path)


class ScanSource(DataSource):
    """``readStream.format("scans")``, options: path, pagesPerTask (64), keep (0: all; else how many read scans of a source
    stay in the folder, which bounds what a restart lists)."""

    @classmethod
    def name(cls) -> str:
        return "scans"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ScanReader:
        o = self.options
        return ScanReader(o["path"], int(o.get("pagesPerTask", 64)), int(o.get("keep", 0)))


def read_scans(spark: SparkSession, folder: str, keep: int = 0) -> DataFrame:
    """(source, scan, page, value): a stream with one row an item, as JSON text. Empty pages have no row."""
    spark.dataSource.register(ScanSource)
    return spark.readStream.format("scans").option("path", folder).option("keep", keep).load()


def land(items: DataFrame, folder: str, page_rows: int = 100, file_pages: int = 64) -> None:
    """Write (source, scan, at, value) as complete scans: items numbered by `at` from 0 within a scan, `page_rows` a page,
    `file_pages` pages a file. What is broadcast is one row a scan."""
    page = F.floor(F.col("at") / page_rows).cast("int")
    last = items.groupBy("source", "scan").agg(F.max(page).alias("last"), F.count(F.lit(1)).alias("rows")).persist()
    try:
        line = F.translate("value", "\n", " ")  # in JSON, a bare line break is only space between tokens
        paged = items.select("source", "scan", page.alias("page"), (page - page % file_pages).alias("first"), "at", line.alias("value"))
        of_task = dealt(paged, last.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], "source", "scan", "first")
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), ", ")
        of_page = of_task.groupBy("source", "scan", "first", "page").agg(body.alias("body"))
        of_file = of_page.groupBy("source", "scan", "first").agg(F.array_sort(F.collect_list(F.struct("page", "body"))).alias("pages"))

        def text(p):
            following = F.when(p["page"] < F.col("last"), (p["page"] + 1).cast("string")).otherwise("null")
            return F.concat(F.lit('{"items": ['), p["body"], F.lit('], "next": '), following, F.lit("}"))

        span = F.concat_ws("-", "first", F.least(F.col("first") + file_pages - 1, "last"))
        lines = F.array_join(F.transform("pages", text), "\n")
        of_file.join(F.broadcast(last), ["source", "scan"]).select("source", "scan", span.alias("page"), lines.alias("value")).write.mode("append").partitionBy("source", "scan", "page").text(folder)
    finally:
        last.unpersist()

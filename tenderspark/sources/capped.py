"""A batch source over an upstream that gives out a limited number of rows a query: ranges of days are halved until each
is under the limit, so a read is whole however full a year, a month or a day is. Planning halves only down to some hundred
partitions, by counts of days; each task halves its own range further and asks query by query."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

from .scans import file_system

#: Most rows that the bulletin's search gives out for one query; a fixed value.
CAP = 15000
DAY = datetime.timedelta(days=1)
#: Planning makes about this many partitions at most, however many queries the cap needs.
PARTITIONS = 128


class Span(NamedTuple):
    """Days first <= d < after and, within one day, keys low <= k < high (None: all)."""

    first: datetime.date
    after: datetime.date
    low: int | None = None
    high: int | None = None


class LandedUpstream:
    """Landed Parquet files behind the interface of a capped search: how many rows a span has, and at most `cap` of them.
    Rows without a day are in no span, as in a search by days."""

    def __init__(self, uri: str, day: str, key: str, cap: int):
        self.uri, self.day, self.key, self.cap = uri, day, key, cap
        self._data: ds.Dataset | None = None

    def data(self) -> ds.Dataset:
        """The files, opened once a process; their statistics tell which of them a span needs."""
        if self._data is None:
            fs, path = file_system(self.uri)
            self._data = ds.dataset(path, filesystem=fs, format="parquet")
        return self._data

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_data": None}

    def condition(self, data: ds.Dataset, span: Span) -> pc.Expression:
        kind = data.schema.field(self.day).type
        at = lambda d: pa.scalar(d if pa.types.is_date(kind) else datetime.datetime(d.year, d.month, d.day), kind)
        c = (pc.field(self.day) >= at(span.first)) & (pc.field(self.day) < at(span.after))
        return c if span.low is None else c & (pc.field(self.key) >= span.low) & (pc.field(self.key) < span.high)

    def days(self) -> Span | None:
        """The span of all days."""
        low, high = self._least_and_most(self.day, None)
        return None if low is None else Span(low, high + DAY)

    def keys(self, span: Span) -> tuple[int, int]:
        low, high = self._least_and_most(self.key, span)
        return low, high + 1

    def _least_and_most(self, column: str, span: Span | None):
        data = self.data()
        least = most = None
        for batch in data.to_batches(columns=[column], filter=None if span is None else self.condition(data, span)):
            m = pc.min_max(batch.column(0))
            a, b = m["min"].as_py(), m["max"].as_py()
            if a is not None:
                least, most = a if least is None else min(a, least), b if most is None else max(b, most)
        as_day = lambda x: x.date() if isinstance(x, datetime.datetime) else x
        return as_day(least), as_day(most)

    def count(self, span: Span) -> int:
        data = self.data()
        return data.count_rows(filter=self.condition(data, span))

    def read(self, span: Span, columns: list[str]) -> Iterator[pa.RecordBatch]:
        data, left = self.data(), self.cap
        for batch in data.to_batches(columns=columns, filter=self.condition(data, span)):
            yield batch.slice(0, left)
            left -= min(left, batch.num_rows)


def whole_spans(upstream, span: Span, most: int | None = None) -> Iterator[Span]:
    """Halves of a span that each have at most `most` rows (by default the upstream's cap), but some; days first, then keys
    within a day. A single key with more rows can't be read whole and raises."""
    most = upstream.cap if most is None else most
    n = upstream.count(span)
    if n <= most:
        if n:
            yield span
        return
    days = (span.after - span.first).days
    if days > 1:
        middle = span.first + (days // 2) * DAY
        parts = [span._replace(after=middle), span._replace(first=middle)]
    else:
        low, high = upstream.keys(span) if span.low is None else (span.low, span.high)
        if high - low < 2:
            raise ValueError(f"{span.first}: {n} rows of key {low}, over the limit of {most}")
        middle = (low + high) // 2
        parts = [span._replace(low=low, high=middle), span._replace(low=middle, high=high)]
    for part in parts:
        yield from whole_spans(upstream, part, most)


class _Range(InputPartition):
    def __init__(self, span: Span):
        self.span = span


class CappedReader(DataSourceReader):
    def __init__(self, upstream, columns: list[str], spans: list[Span] | None):
        self.upstream, self.columns, self.spans = upstream, columns, spans
        self.first, self.after = datetime.date.min, datetime.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the day narrow the spans; Spark applies all filters again."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == (self.upstream.day,) and isinstance(value, datetime.date):
                day = value.date() if isinstance(value, datetime.datetime) else value
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, day)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    whole = isinstance(f, LessThan) and day == value
                    midnight = isinstance(f, LessThan) and isinstance(value, datetime.datetime) and value.time() == datetime.time()
                    self.after = min(self.after, day if whole or midnight else day + DAY)
            yield f

    def partitions(self) -> list[_Range]:
        spans = self.spans
        if spans is None:
            every = self.upstream.days()
            spans = [every] if every else []
        cut = [s._replace(first=max(s.first, self.first), after=min(s.after, self.after)) for s in spans]
        cut = [s for s in cut if s.first < s.after]
        most = max(self.upstream.cap, -(-sum(self.upstream.count(s) for s in cut) // PARTITIONS))
        return [_Range(part) for s in cut for part in whole_spans(self.upstream, s, most)]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no spans, for which Spark runs one task without a partition
            return
        for span in whole_spans(self.upstream, partition.span):
            n = 0
            for batch in self.upstream.read(span, self.columns):
                n += batch.num_rows
                yield batch
            if n != self.upstream.count(span):  # rows came in between counting and reading
                raise ValueError(f"{span}: {n} rows were given out, not all")


class CappedSource(DataSource):
    """``spark.read.format("capped")``, options: path, day, key, cap, spans (JSON list of [first, after]; else all days). A
    schema names the columns to read. A subclass for another upstream overrides `upstream`."""

    @classmethod
    def name(cls) -> str:
        return "capped"

    def upstream(self):
        o = self.options
        return LandedUpstream(o["path"], o["day"], o["key"], int(o.get("cap", CAP)))

    def schema(self):
        return from_arrow_schema(self.upstream().data().schema)

    def reader(self, schema) -> CappedReader:
        spans = self.options.get("spans")
        day = datetime.date.fromisoformat
        return CappedReader(self.upstream(), schema.names, None if spans is None else [Span(day(a), day(b)) for a, b in json.loads(spans)])


def read_capped(spark: SparkSession, path: str, day: str, key: str, schema: str | None = None, cap: int = CAP, spans: list[tuple] | None = None) -> DataFrame:
    """All rows of a capped upstream in some spans of days (none: all days). Filters on the day reach the upstream; for
    that this switches on the session's pushdown into Python sources. Planning asks for about two counts a partition, a task
    for two or three a query; a count is cheap where files and row groups hold few days each, as `land_by_day` writes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CappedSource)
    r = spark.read.format("capped").options(path=path, day=day, key=key, cap=str(cap))
    r = r.schema(schema) if schema else r
    return (r if spans is None else r.option("spans", json.dumps([[str(a), str(b)] for a, b in spans]))).load()


def land_by_day(rows: DataFrame, path: str, day: str, key: str, group_bytes: int = 1 << 20) -> None:
    """Write rows in order of day and key over all files, in small row groups, so that a span's query reads only its own."""
    rows.repartitionByRange(day, key).sortWithinPartitions(day, key).write.option("parquet.block.size", group_bytes).parquet(path)

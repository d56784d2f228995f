"""Landed scans whose files hold several pages."""

import json

import pytest
from pyspark.sql import functions as F

from tenderspark.sources import scans


def streamed(spark, root, out):
    stream = scans.read_scans(spark, str(root))
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.source, r.scan, r.page, json.loads(r.value)["id"]) for r in spark.read.schema(scans.SCHEMA).parquet(f"{out}/rows").collect())


def test_landing_writes_a_file_for_many_pages(spark, tmp_path):
    """One scan of 150 pages, the last of one item, and one of a single page; values hold line breaks between and within tokens."""
    key = F.col("id").cast("string")
    value = F.concat(F.lit('{"id":\n '), key, F.lit(', "text": "a\\nb c\u0085d"}'))
    rows = spark.range(300).select(F.lit("crz").alias("source"), F.when(F.col("id") < 299, "1").otherwise("2").alias("scan"), (F.col("id") % 299).alias("at"), value.alias("value"))
    scans.land(rows, str(tmp_path / "in"), 2)
    files = sorted(str(p.parent.relative_to(tmp_path / "in")) for p in tmp_path.glob("in/source=*/**/*.txt"))
    assert files == ["source=crz/scan=1/page=0-63", "source=crz/scan=1/page=128-149", "source=crz/scan=1/page=64-127", "source=crz/scan=2/page=0-0"]
    assert streamed(spark, tmp_path / "in", tmp_path / "out") == [("crz", "1", i // 2, i) for i in range(299)] + [("crz", "2", 0, 299)]
    stored = [json.loads(r.value)["text"] for r in spark.read.schema(scans.SCHEMA).parquet(f"{tmp_path}/out/rows").collect()]
    assert set(stored) == {"a\nb c\u0085d"}


def test_no_rows_land_as_no_files(spark, tmp_path):
    scans.land(spark.createDataFrame([], "source string, scan string, at bigint, value string"), str(tmp_path / "in"))
    assert not list(tmp_path.glob("in/source=*"))


def put(scan, name, numbers, last):
    """A file of pages with an item each; the last one names a next page unless `last`."""
    folder = scan / f"page={name}"
    folder.mkdir(parents=True)
    pages = [json.dumps({"items": [{"id": k}], "next": None if last and k == numbers[-1] else k + 1}) for k in numbers]
    (folder / "p.json").write_text("\n".join(pages) + "\n")


def test_pages_and_files_of_pages_make_a_scan_without_gaps(tmp_path):
    fs, root = scans.file_system(str(tmp_path))

    def first_pages(scan):
        found = scans.pages_of(fs, f"{root}/{scan}")
        return found and [f[:2] for f in found]

    put(tmp_path / "whole", "0-2", [0, 1, 2], False)
    put(tmp_path / "whole", "3", [3], False)
    put(tmp_path / "whole", "4-5", [4, 5], True)
    assert first_pages("whole") == [(0, 2), (3, None), (4, 5)]
    put(tmp_path / "gap", "0-1", [0, 1], False)
    put(tmp_path / "gap", "3-4", [3, 4], True)
    put(tmp_path / "twice", "0-1", [0, 1], False)
    put(tmp_path / "twice", "1-2", [1, 2], True)
    put(tmp_path / "open", "0-1", [0, 1], False)
    put(tmp_path / "empty", "0-1", [0, 1], True)
    (tmp_path / "empty" / "page=2").mkdir()
    assert [first_pages(s) for s in ("gap", "twice", "open", "empty", "absent")] == [None] * 5


def test_a_file_that_lacks_pages_is_an_error(tmp_path):
    fs, root = scans.file_system(str(tmp_path))
    put(tmp_path / "scan", "0-3", [0, 1], True)
    with pytest.raises(ValueError, match="its last page is 1"):
        scans.pages_of(fs, f"{root}/scan")


def test_tasks_take_files_up_to_their_number_of_pages(tmp_path):
    scan = tmp_path / "source=crz" / "scan=1"
    put(scan, "0-2", [0, 1, 2], False)
    for k in (3, 4, 5):
        put(scan, str(k), [k], False)
    put(scan, "6-12", list(range(6, 13)), True)
    tasks = scans.ScanReader(str(tmp_path), 4, 0).partitions({}, {"crz": "1"})
    assert [[f[2] for f in t.files] for t in tasks] == [[0, 3], [4, 5], [6]]
    assert [i for t in tasks for b in scans.ScanReader(str(tmp_path), 4, 0).read(t) for i in b.column("page").to_pylist()] == list(range(13))

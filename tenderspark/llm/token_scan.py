"""Operator 5: document token counts of flat, unindexed token files by scanning for end-of-document ids.

A file is a run of fixed-width little-endian ids in which the end id closes each document. It is read in blocks that may
cut documents anywhere. Numpy finds the end ids of a block; documents inside a block are counted there, and a block
hands on only its number of end ids and the ids before its first and after its last. A prefix scan over these summaries,
in two levels (within spans of blocks, then over spans), stitches the documents that cross blocks and numbers all of a
file's documents. No task holds a file, and of a long file only one row a span meets in one task.

Defined cases: an empty block or file has no documents; ids after a file's last end id make a last, unclosed document
(`closed` false); an end id directly after another closes an empty document of 0 tokens; a null text is an empty
document; files are numbered apart, so equal files count each; an empty table gives an empty result. The end id is not
counted among a document's tokens.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .bpe import worker_encoder
from .common import ensure_checkpoint_dir, materialise, shuffle_partitions, text_or_empty

_SUMMARY = "file string, block long, kind string, at long, tokens long, head long, tail long"


def token_blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """(file, block, offset, size): the byte ranges of flat token files under `path`, listed from their lengths alone."""
    if width not in (2, 4):
        raise ValueError("width: 2 or 4 bytes an id")
    step = width * block_tokens
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / step) - 1, F.lit(0)).cast("long"))
    listed = files.select("file", "length", F.explode(blocks).alias("block"))
    return listed.select("file", "block", (F.col("block") * step).alias("offset"), F.least(F.lit(step).cast("long"), F.col("length") - F.col("block") * step).alias("size"))


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """(file, block, ids): the blocks of flat token files. In a folder that all executors see, a task seeks to its own
    byte ranges and reads these alone, so files may have any length. Files in a store that only Spark reads are read
    whole, 2 GB at most, which is a limit of Spark's reader; longer ones fail."""
    schema = "file string, block long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, offset, size in zip(*(c.to_pylist() for c in batch.columns)):
                with open(local_path(file), "rb") as f:
                    f.seek(offset)
                    raw = f.read(size)
                if len(raw) != size:
                    raise OSError(f"{file}: {len(raw)} of {size} bytes at {offset}")
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([raw], pa.binary())], names=["file", "block", "ids"])

    # a long file's ranges go to many tasks
    ranges = token_blocks(spark, path, width, block_tokens)
    one = ranges.select("file").first()
    if one is not None and urllib.parse.urlsplit(one["file"]).scheme not in ("", "file"):
        whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
        return ranges.join(whole, "file").select("file", "block", F.substring("content", (F.col("offset") + 1).cast("int"), F.col("size").cast("int")).alias("ids"))
    return ranges.repartition(max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism), "file", "block").mapInArrow(run, schema)


def local_path(uri: str) -> str:
    """The path of a file: URI."""
    parts = urllib.parse.urlsplit(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: no folder that all executors see; mount it or set spark.checkpoint.dir to one")
    return urllib.parse.unquote(parts.path) if parts.scheme else uri


def write_token_files(documents: DataFrame, tokenizer: str, end_id: int, folder: str, width: int = 4) -> DataFrame:
    """(file, first, doc_ids): the documents of each partition go to a flat token file in the shared `folder`, `width` bytes
    an id and nothing else; the rows say which documents are in a file, from number `first` on. A file gets its name when it
    is whole, so a task that runs again leaves one."""
    to = local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        task = f"{TaskContext.get().partitionId():08d}"
        attempt = f"{to}/_{task}-{TaskContext.get().taskAttemptId()}"
        first = 0
        with open(attempt, "wb") as f:
            for batch in batches:
                doc_ids = batch.column(0)
                for at, ids, counts in encoder.encode(batch.column(1)):
                    if len(ids) and int(ids.max()) >= 1 << 8 * width:
                        raise ValueError(f"id {int(ids.max())} does not fit {width} bytes")
                    np.insert(ids.astype(f"<u{width}"), np.cumsum(counts), end_id).tofile(f)
                    own = doc_ids.slice(at, len(counts))
                    yield pa.RecordBatch.from_arrays([pa.array([f"part-{task}.bin"]), pa.array([first], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], names=["file", "first", "doc_ids"])
                    first += len(counts)
        if first:
            os.replace(attempt, f"{to}/part-{task}.bin")
        else:
            os.remove(attempt)

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return narrow.mapInArrow(run, "file string, first long, doc_ids array<long>")


def scan_blocks(blocks: DataFrame, end_id: int, width: int = 4) -> DataFrame:
    """Rows of two kinds: `block` with head, tail and number of ends (tokens), `doc` with each end's number in its block
    (at) and, from the second on, its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.frombuffer(raw.as_buffer() or b"", f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                n = len(ends)
                head = int(ends[0]) if n else len(ids)
                tail = len(ids) - 1 - int(ends[-1]) if n else 0
                zero = np.zeros(n + 1, np.int64)
                lengths = np.concatenate([[n], [head] if n else [], np.diff(ends) - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * (n + 1)), pa.array(zero + block), pa.array(["block"] + ["doc"] * n), pa.array(np.arange(-1, n)), pa.array(lengths.astype(np.int64)), pa.array(zero + head), pa.array(zero + tail)],
                    names=["file", "block", "kind", "at", "tokens", "head", "tail"],
                )

    return blocks.select("file", "block", "ids").mapInArrow(run, _SUMMARY)


def prefix_scan(summaries: DataFrame, span: int = 1024) -> DataFrame:
    """(file, block, first, carried): ends before each block, and ids since the last end before it."""
    s = summaries.select("file", "block", F.floor(F.col("block") / span).alias("span"), F.col("tokens").alias("ends"), "head", "tail")
    inner = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def carried(w) -> F.Column:
        """Ids since the last end among the rows before, or all of them."""
        since = F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("total"))).over(w), F.lit(0))
        return F.coalesce(F.sum("size").over(w), F.lit(0)) - since

    # where a block has an end, `total` is what lies before its tail, counted from the span's start
    size = s.withColumn("size", F.col("head") + F.when(F.col("ends") > 0, F.col("tail")).otherwise(0))
    upto = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = size.withColumn("total", F.sum("size").over(upto) - F.col("tail"))
    within = size.select("file", "block", "span", F.coalesce(F.sum("ends").over(inner), F.lit(0)).alias("ends_in"), carried(inner).alias("carry_in"), (F.coalesce(F.sum("ends").over(inner), F.lit(0)) > 0).alias("cut"))
    spans = size.groupBy("file", "span").agg(F.sum("ends").alias("ends"), F.sum("size").alias("size"), (F.sum("size") - F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("total"))), F.lit(0))).alias("tail"))
    outer = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("total", F.sum("size").over(upto) - F.col("tail"))
    over = spans.select("file", "span", F.coalesce(F.sum("ends").over(outer), F.lit(0)).alias("ends_out"), carried(outer).alias("carry_out"))
    return within.join(over, ["file", "span"]).select("file", "block", (F.col("ends_in") + F.col("ends_out")).alias("first"), F.when(F.col("cut"), F.col("carry_in")).otherwise(F.col("carry_in") + F.col("carry_out")).alias("carried"))


def document_counts(blocks: DataFrame, end_id: int, width: int = 4, span: int = 1024) -> DataFrame:
    """One row per document: file, its number there, tokens, and whether an end id closes it."""
    found = materialise(scan_blocks(blocks, end_id, width))
    summary = found.where("kind = 'block'")
    stitched = prefix_scan(summary, span)
    closed = found.where("kind = 'doc'").join(stitched, ["file", "block"]).select("file", (F.col("first") + F.col("at")).alias("doc_no"), (F.col("tokens") + F.when(F.col("at") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed"))
    last = summary.groupBy("file").agg(F.max("block").alias("block"), F.max_by("tokens", "block").alias("ends"), F.max_by("head", "block").alias("head"), F.max_by("tail", "block").alias("tail"))
    rest = last.join(stitched, ["file", "block"]).select("file", (F.col("first") + F.col("ends")).alias("doc_no"), F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("head")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest.where("n_tokens > 0"))


def token_counts(documents: DataFrame, tokenizer: str, end_id: int, block_tokens: int = 1 << 18) -> DataFrame:
    """Tokens of every document, found by scanning the flat files that the documents make in the checkpoint folder. Ids
    are joined by document number after the scan."""
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
    os.makedirs(local_path(folder))
    width = 2 if max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4
    written = materialise(write_token_files(documents, tokenizer, end_id, folder, width))
    named = written.select("file", F.posexplode("doc_ids").alias("i", "doc_id"), "first").select("file", (F.col("first") + F.col("i")).alias("doc_no"), "doc_id")
    counted = document_counts(read_token_files(spark, folder, width, block_tokens), end_id, width)
    return named.join(counted.withColumn("file", F.substring_index("file", "/", -1)), ["file", "doc_no"], "left")

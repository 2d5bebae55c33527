"""Token counts by a separator scan of flat token files.

A token file is nothing but little-endian 16-bit ids, each document closed by the end-of-document
id: no index, no lengths.  The scan cuts files into blocks of a fixed size, searches every block for
the end id with one vectorised comparison, and reports the block's own counts: tokens before its
first separator, between separators, after its last.  A prefix scan over the blocks of a file
(window sums over a few numbers a block) gives each block the documents that ended before it and the
tokens left open by the blocks before, which stitches documents that cross any number of blocks.

``export_tokens`` makes such files from a table: each task writes its own files under names no
other attempt uses and publishes them in a manifest, so a retried task leaves at most files that
nobody lists.  Files are written and read through Arrow's file systems in the shared folder.

Defined results: a null or empty text is a document of 0 tokens; tokens after a file's last
separator are one more document with ``closed`` false; an empty file has no documents; a file of an
odd number of bytes is an error; repeated rows are counted one by one; texts of any length are counted whole; an empty table
gives no rows; an id that is no whole number is an error (null is none, and stays); no column but id and text is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.deploy import ship_code
from .common import materialize, remove, work_dir
from .tokens import encoder, vocabulary

END_OF_DOCUMENT = 49407
FILE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20


def open_fs(uri: str):
    """Arrow's file system for a URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[6:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _write(folder: str, tokenizer: str, end_id: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        end = np.array([end_id], "<u2").tobytes()
        stem, number, out, size, ordinal, name = uuid.uuid4().hex, 0, None, 0, 0, ""
        try:
            for batch in batches:
                names, ordinals = [], []
                for ids in map(encoder(tokenizer, plain_specials=True).encode, batch.column("text").to_pylist()):
                    if out is None:
                        name, size, ordinal = f"{stem}-{number:05d}.bin", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}")
                    ids += end
                    out.write(ids)
                    names.append(name)
                    ordinals.append(ordinal)
                    size, ordinal = size + len(ids), ordinal + 1
                    if size >= file_bytes:
                        out.close()
                        out, number = None, number + 1
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ordinals, pa.int64()), batch.column("key")], ["file", "ordinal", "key"])
        finally:
            if out is not None:
                out.close()

    return run


def export_tokens(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, end_id: int = END_OF_DOCUMENT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` as flat token files below ``folder``; the manifest has ``file``, ``ordinal`` and the document's key."""
    spark = docs.sparkSession
    ship_code(spark)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    sent = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return materialize(sent.mapInArrow(_write(folder, tokenizer or vocabulary(), end_id, file_bytes), "file string, ordinal long, key long"), "manifest")


def _search(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "lo", "hi")), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    raw = f.read_at(hi - lo, lo)
                if len(raw) != hi - lo or (hi - lo) % 2:
                    raise ValueError(f"{path}: {len(raw)} bytes at {lo} are no whole number of ids")
                found = np.flatnonzero(np.frombuffer(raw, "<u2") == end_id)
                n = (hi - lo) // 2
                head, tail = (int(found[0]), n - int(found[-1]) - 1) if len(found) else (n, n)
                yield pa.RecordBatch.from_pydict(
                    {"file": [path.rpartition("/")[2]], "block": [block], "n": [n], "n_ends": [len(found)], "head": [head], "tail": [tail], "inner": [(np.diff(found) - 1).astype(np.int32)]},
                    schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("n_ends", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int32()))]),
                )

    return run


def scan_blocks(spark: SparkSession, files: DataFrame, end_id: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a block of ``files`` (``path``, ``length``), written to the shared folder."""
    ship_code(spark)
    size = F.lit(block_bytes)
    blocks = (
        files.filter("length > 0")
        .select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size).cast("long"))).alias("block"))
        .select("path", "block", (F.col("block") * size).alias("lo"), F.least((F.col("block") + 1) * size, F.col("length")).alias("hi"))
        .repartition("path", "block")
    )
    return materialize(blocks.mapInArrow(_search(end_id), "file string, block long, n long, n_ends long, head long, tail long, inner array<int>"), "blocks")


def stitch(blocks: DataFrame) -> DataFrame:
    """``file``, ``ordinal`` of the document in its file, ``n_tokens``, ``closed``."""
    line = Window.partitionBy("file").orderBy("block")
    before, upto = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    summary = blocks.select("file", "block", "n", "n_ends", "head", "tail").withColumn("end", F.sum("n").over(upto))
    summary = summary.withColumn("last_end", F.when(F.col("n_ends") > 0, F.col("end") - F.col("tail")))
    summary = summary.withColumns(
        {
            "ended": F.coalesce(F.sum("n_ends").over(before), zero),
            "open": F.col("end") - F.col("n") - F.coalesce(F.max("last_end").over(before), zero),
            "is_last": F.lead("block").over(line).isNull(),
        }
    ).select("file", "block", "ended", "open", "is_last")
    whole = blocks.join(summary, ["file", "block"])
    first = F.when(F.col("n_ends") > 0, F.array((F.col("open") + F.col("head")).cast("long"))).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("n"))
    left = F.when(F.col("is_last") & (rest > 0), F.array(rest.cast("long"))).otherwise(F.array().cast("array<long>"))
    counts = F.concat(first, F.transform("inner", lambda x: x.cast("long")), left)
    at = F.col("ended") + F.col("k")
    return whole.select("file", "ended", "n_ends", F.posexplode(counts).alias("k", "n_tokens")).select("file", at.alias("ordinal"), "n_tokens", (F.col("k") < F.col("n_ends")).alias("closed"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "length")


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """``doc_id`` and ``n_tokens`` (without the separator), by way of flat files in the shared folder."""
    spark = docs.sparkSession
    folder = work_dir(spark, "token-files")
    manifest = export_tokens(docs, folder, text, key, tokenizer)
    listed = manifest.select("file").distinct()
    files = list_files(spark, folder).withColumn("file", F.element_at(F.split("path", "/"), -1)).join(listed, "file", "left_semi")
    blocks = scan_blocks(spark, files.select("path", "length"))
    remove(folder, spark)  # the blocks' counts are written by now
    return stitch(blocks).join(manifest, ["file", "ordinal"]).select(F.col("key").alias("doc_id"), "n_tokens")


def op1(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""Readers and writers of corpus artifacts and results, all with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

STEM = r"([^/]+?)(?:_metadata|_summary)?\.(?:json|md)$"


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """Clean Markdown files (those ending in ``_full.md`` are left out): ``stem``, ``markdown``."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))
    return rows.filter(~F.col("path").endswith("_full.md")).select(F.regexp_extract("path", STEM, 1).alias("stem"), "path", "markdown")


def _sidecar(spark: SparkSession, folder: str, suffix: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).json(folder, multiLine=True, pathGlobFilter=f"*_{suffix}.json", recursiveFileLookup=True)
    return rows.withColumn("stem", F.regexp_extract("_metadata.file_path", STEM, 1))


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown with its metadata; files without metadata are skipped."""
    return markdown_files(spark, folder).join(_sidecar(spark, folder, "metadata", schemas.DOCUMENTS_META), "stem")


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    return _sidecar(spark, folder, "summary", "source_file string, document_summary string")


def embeddable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.coalesce("embed_in_qdrant", F.lit(True)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``document_id``, ``include_locations``, ``embed`` (true unless it says no); a bare list is short for the locations."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("document_id", "entry"))
    is_list = F.ltrim("entry").startswith("[")
    entry = F.when(is_list, F.struct(F.from_json("entry", "array<string>").alias("include_locations"), F.lit(None).cast("boolean").alias("embed_in_qdrant"))).otherwise(F.from_json("entry", "include_locations array<string>, embed_in_qdrant boolean"))
    bad = entry.isNull() | (~is_list & ~F.ltrim("entry").startswith("{"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad manifest entry of "), F.col("document_id")))).otherwise(entry["include_locations"])
    return raw.select("document_id", F.coalesce(checked, F.array().cast("array<string>")).alias("include_locations"), F.coalesce(entry["embed_in_qdrant"], F.lit(True)).alias("embed"))


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line; byte order marks and blank lines are passed over, broken lines are errors unless lenient."""
    rows = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("v")).filter(F.trim("v") != "")
    return rows.select(F.from_json("v", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r")).select("r.*")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a dictionary file; a missing file has none."""
    entry = "legal_term string, aliases array<string>, definition string, note string, source_refs array<string>, ambiguity_group string, strong_signals array<string>, negative_signals array<string>"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], entry)
    return spark.read.schema(f"entries array<struct<{entry.replace(' string', ':string').replace(' array', ':array').replace(', ', ',')}>>").json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def checked_snapshot(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A file as ``path``, ``content``, if its digest is the one expected; else an error."""
    rows = spark.read.format("binaryFile").load(path)
    ok = F.sha2("content", 256) == sha256.lower()
    return rows.select("path", F.when(ok, F.col("content")).otherwise(F.raise_error(F.lit(f"{path}: digest differs")).cast("binary")).alias("content"))


def write_snapshot(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_csv(df: DataFrame | list[DataFrame], path: str) -> None:
    """Nested columns as JSON; quotation marks inside a value are doubled.  Several tables are written as one with the columns of all, in the order in which they first come."""
    if isinstance(df, list):
        tables, df = df, df[0]
        for other in tables[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_results(df: DataFrame, summary: DataFrame, path: str) -> None:
    """Per-case results and their summary side by side."""
    write_csv(df, f"{path}/results")
    write_jsonl(summary, f"{path}/summary")


def reviewed(ops: DataFrame, reviews: DataFrame) -> DataFrame:
    """Documents still to review: a stored empty list is a review, no row is none."""
    return ops.join(reviews.select("document_id").distinct(), "document_id", "left_anti")


# ---- documents as Word files ----------------------------------------------------------------------

DOCX = "path string, position int, kind string, text string, rows array<array<string>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_body(content: bytes) -> list[tuple[str, str | None, list[list[str]] | None]]:
    """Paragraphs that aren't blank and tables of a Word file's body, in their order."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in e.iter()).strip()
    out: list[tuple[str, str | None, list[list[str]] | None]] = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p" and said(e):
            out.append(("paragraph", said(e), None))
        elif e.tag == f"{_W}tbl":
            out.append(("table", None, [["\n".join(filter(None, map(said, c.findall(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]))
    return out


def docx_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``position``, ``kind`` (paragraph or table), ``text``, ``rows`` of all Word files below a folder."""
    import pandas as pd

    from ..functions.deploy import ship_code

    ship_code(spark)

    def run(batches):
        for b in batches:
            rows = [(p, k, *x) for p, c in zip(b["path"], b["content"], strict=True) for k, x in enumerate(docx_body(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "position", "kind", "text", "rows"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(folder).select("path", "content").mapInPandas(run, DOCX)


def inventory(docs: DataFrame, issued: str = "issued_date", name: str = "source_file") -> DataFrame:
    """``batch_order`` of files that are worked off together: by date of issue, then by name without case; dateless ones last.

    Files are sorted by ranges; a task numbers its own range, and begins where the counts of the ranges before it end.
    """
    from pyspark.sql import Window

    from ..functions.lineage import settle

    order = [F.asc_nulls_last(issued), F.lower(name), F.col(name)]
    ranged = settle(docs.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row for each range
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return own.join(F.broadcast(firsts), "_part").withColumn("batch_order", (F.col("_before") + F.col("_own")).cast("int")).drop("_part", "_own", "_before")


# ---- collections -----------------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def create_collection(spark: SparkSession, path: str, schema: str, recreate: bool = False) -> bool:
    """An empty collection, unless there is one; says whether it was made."""
    if _exists(spark, path) and not recreate:
        return False
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return True


def collection(spark: SparkSession, path: str, schema: str, document_id: str | None = None) -> DataFrame:
    """A snapshot's points, or those of one document (the filter reaches the scan)."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if document_id is None else rows.filter(F.col("document_id") == document_id)


BUCKETS = 64


def bucket_of(document_id: Column, buckets: int = BUCKETS) -> Column:
    """A document's bucket: the first seven hex digits of its MD5, modulo."""
    return (F.conv(F.substring(F.md5(F.coalesce(document_id, F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long") % buckets).cast("int")


def write_buckets(points: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A collection with a folder for each bucket of documents."""
    rows = points.withColumn("bucket", bucket_of(F.col("document_id"), buckets))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def bucketed(spark: SparkSession, path: str, schema: str, document_id: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The collection, or one document of it: then no other bucket's files are listed or read."""
    rows = spark.read.schema(f"{schema}, bucket int").parquet(path)
    if document_id is not None:
        rows = rows.filter((F.col("bucket") == bucket_of(F.lit(document_id), buckets)) & (F.col("document_id") == document_id))
    return rows.drop("bucket")


def upsert_buckets(new: DataFrame, path: str, schema: str, key: str = "point_id", buckets: int = BUCKETS, removed: DataFrame | None = None) -> list[int]:
    """Rows of ``new`` in place of those of the same key, and without the keys of ``removed`` (``document_id`` and the key); gives the buckets that were written.

    A key's document doesn't change.  Only buckets that rows of either table fall into are read and overwritten (Spark's dynamic
    partition overwrite); the files of all others stay as they are.
    """
    from ..functions.lineage import settle

    spark = new.sparkSession
    own = settle(new.withColumn("bucket", bucket_of(F.col("document_id"), buckets)))
    gone = own.select("bucket", key)
    if removed is not None:
        gone = gone.unionByName(removed.select(bucket_of(F.col("document_id"), buckets).alias("bucket"), key))
    met = sorted(r["bucket"] for r in gone.select("bucket").distinct().collect())  # numbers of buckets
    if met:
        old = spark.read.schema(f"{schema}, bucket int").parquet(path).filter(F.col("bucket").isin(met))
        kept = old.join(gone.distinct(), ["bucket", key], "left_anti").select(*own.columns)
        # an emptied bucket has to be written as well, and dynamic overwrite passes over buckets without rows
        rows = settle(kept.unionByName(own))
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        full = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        for b in met:
            if b not in full:
                where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return met


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``bucket``, ``file`` and when it was written, of a collection."""
    return spark.read.parquet(path).select("bucket", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("written")).distinct()


# ---- digests of large files -------------------------------------------------------------------------

BLOCK_BYTES = 8 << 20


def block_digests(spark: SparkSession, folder: str, block: int = BLOCK_BYTES) -> DataFrame:
    """``path``, ``at``, ``size``, ``sha256`` of every block of ``block`` bytes of the files below a folder.

    A task opens its file at its block and reads no more than that; no file is held in one cell.  An empty file has no block.
    """
    import hashlib

    import pyarrow as pa

    from ..functions.deploy import ship_code

    ship_code(spark)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")  # names and lengths only
    blocks = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("length") - 1), F.lit(block).cast("long"))).alias("at"))

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            found = []
            for path, at in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
                with system.open_input_file(name) as f:
                    f.seek(at)
                    found.append(hashlib.sha256(f.read(block)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), batch.column("at"), pa.array(found, pa.string())], ["path", "length", "at", "sha256"])

    many = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(many, "path", "at").mapInArrow(run, "path string, length long, at long, sha256 string").select("path", "at", F.least(F.lit(block), F.col("length") - F.col("at")).alias("size"), "sha256")


def file_digests(blocks: DataFrame) -> DataFrame:
    """``path``, ``size`` and a file's digest: the SHA-256 of its blocks' digests, in order, a line each."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sha256"))), lambda x: x["sha256"]), "\n")
    return blocks.groupBy("path").agg(F.sum("size").alias("size"), F.sha2(lines, 256).alias("digest"))  # 64 characters for each block of a file


def verified(spark: SparkSession, folder: str, known: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of files that aren't as ``known`` (``path``, ``at``, ``size``, ``sha256``) has them: ``path``, ``at``, ``problem`` (changed, missing, new)."""
    both = block_digests(spark, folder, block).select("path", "at", F.struct("size", "sha256").alias("now")).join(known.select("path", "at", F.struct("size", "sha256").alias("then")), ["path", "at"], "full_outer")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "changed")
    return both.select("path", "at", problem.alias("problem")).filter("problem is not null")


def write_outputs(docs: DataFrame, path: str) -> None:
    """What the first step leaves of its documents: full and clean Markdown, and metadata."""
    docs.select("document_id", "full_markdown").write.mode("overwrite").parquet(f"{path}/full")
    docs.select("document_id", "markdown").write.mode("overwrite").parquet(f"{path}/clean")
    write_jsonl(docs.drop("full_markdown", "markdown"), f"{path}/metadata")


def write_summaries(rows: DataFrame, path: str) -> None:
    write_jsonl(rows.select("source_file", "document_summary"), path)


def save_reviews(reviews: DataFrame, path: str) -> None:
    """Reviews by document; an empty list of operations is a review."""
    reviews.select("document_id", F.coalesce("operations", F.array().cast("array<string>")).alias("operations")).write.mode("overwrite").parquet(path)


def load_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Saved reviews; none where nothing was saved."""
    schema = "document_id string, operations array<string>"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def fingerprint(docs: DataFrame, model: str, key: str, text: str) -> str:
    """20 hex digits for a model and a set of documents, whatever their order."""
    import hashlib

    digest = F.sha2(F.concat_ws("\u0001", F.col(key).cast("string"), F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)
    # sums of parts of the digests, which equal rows add to as well; 15 hex digits are 60 bits, so 10^19 rows fit
    parts = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16, 31, 46)]
    return hashlib.sha256(repr((model, *docs.agg(F.count(F.lit(1)), *parts).first())).encode()).hexdigest()[:20]


def cached_embeddings(docs: DataFrame, embed, model: str, path: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """``key`` and ``embedding`` (``embed`` of the text), kept below ``path`` under the documents' fingerprint; and whether they were there."""
    spark, where = docs.sparkSession, f"{path}/{fingerprint(docs, model, key, text)}"
    hit = _exists(spark, f"{where}/_SUCCESS")
    if not hit:
        docs.select(key, embed(F.col(text)).alias("embedding")).write.mode("overwrite").parquet(where)
    return spark.read.parquet(where), hit

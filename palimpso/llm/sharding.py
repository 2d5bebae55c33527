"""Sharding by a two-pass external shuffle (built-in functions only).

Pass 1 scatters whole records uniformly into buckets of about ``BUCKET_BYTES``, or ``BUCKET_ROWS`` records if that is less, by a seeded hash and writes them, each
with its bucket, to the shared folder.  Pass 2 gathers each bucket, puts its records in the order of their hashes,
Fisher-Yates shuffles their places in that order and writes the records by shard.  Buckets lie behind one another on one global line of positions, found
from the bucket counts by a prefix sum in two levels; position ``p`` goes to shard ``p % n_shards`` and slot
``p // n_shards``.  So shards differ by one row at most (law ``rows``) and slots are gapless from 0, whatever the
sizes of the buckets.

The draws of the Fisher-Yates shuffle are hashes of (seed, bucket, step), and the number of buckets follows from the table's
size alone.  So a record's shard and slot are a function of the seed and the table: tasks that are run again, other
partitions and adaptive execution change nothing.  A swap touches two short rows of the places, which are kept in about sqrt(n) rows; the
records themselves are ranked and sorted as they stream by, and are never held in an array.

Records are told apart by a hash of all their columns, so copies of a text and rows with the same id spread like any
other rows.  Records equal in every column, with more than ``COPIES_BYTES`` of them (they are counted with partial sums), are
not gathered at all: one of them stands for all, is multiplied in two steps, and each copy has a hash of its own.

Defined results
---------------
* null text: size 8 (no text bytes), CRC-32 0 -- as for an empty text;
* null ids are ordinary rows;
* repeated rows each get a slot of their own;
* an empty table gives no rows; extra columns of any name and type travel with the record, in one struct; where a table has a column
  ``shard`` or ``slot`` of its own, the new ones of written records are called ``shard_`` and ``slot_`` (with as many lines as it takes);
* of two different records of a bucket whose 64-bit marks are equal, either may come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

SEED = 20240229
BUCKET_BYTES = 16 << 20
#: a swap walks through about 3 sqrt(n) numbers, so buckets are bounded in rows as well
BUCKET_ROWS = 1_024
TASK_BYTES = 128 << 20
#: buckets that a task of pass 2 works off at most
TASK_BUCKETS = 1_024
COPIES_BYTES = BUCKET_BYTES // 4
#: of zstd: records are written twice, so they are packed tightly
LEVEL = 9
RECORD_OVERHEAD = 8
#: copies that one row is multiplied to in the second step
FAN_OUT = 1_000
#: buckets whose counts are added up in one window
BLOCK = 1_024
BROADCAST_ROWS = 1_000_000


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(RECORD_OVERHEAD)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and give it to ``body``: a one-element array and a lambda."""
    return F.transform(F.array(value), body)[0]


def fisher_yates(n: Column, seed: Column) -> Column:
    """A random order of 0 to n - 1 (n > 0): for i from n - 1 down to 1, swap the places i and ``hash(seed, i) mod (i + 1)``.

    The order is held as rows of about sqrt(n) numbers, of which a swap makes two anew.
    """

    def shuffled(width):
        place = lambda rows, i: F.get(F.get(rows, (i / width).cast("int")), (i % width).cast("int"))

        def swap(rows, i):
            def both(j):
                a, b = place(rows, i), place(rows, j)
                put = lambda x, k: F.when(k == i, b).when(k == j, a).otherwise(x)
                here = lambda r: (r == (i / width).cast("int")) | (r == (j / width).cast("int"))
                return F.transform(rows, lambda row, r: F.when(here(r), F.transform(row, lambda x, c: put(x, r * width + c))).otherwise(row))

            return let(F.pmod(F.xxhash64(seed, i), i + 1).cast("int"), both)

        first = F.transform(F.sequence(F.lit(0), n - 1, width), lambda s: F.sequence(s, F.least(s + width, n) - 1))
        steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.aggregate(steps, first, swap))

    return let(F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int")), shuffled)


def shown(df: DataFrame) -> list[Column]:
    """The columns as Spark can hash and group them: those with maps or variants in them as JSON."""
    odd = lambda f: any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))
    return [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if odd(f) else F.col(f"`{f.name}`") for f in df.schema]


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scatter(df: DataFrame, size: Column, seed: int, bucket_bytes: int, copies_bytes: int, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int, int]:
    """Pass 1, as a table: ``bucket``, ``mark`` (a hash that tells records apart, but for equal ones) and the ``record``; the number of buckets and the bytes of all records."""
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    mark = F.xxhash64(F.lit(seed), *shown(df))
    # a record's mark and size, without the record
    marks = df.select(mark.alias("mark"), size.alias("size")).groupBy("mark").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    totals = marks.agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.sum(F.when((F.col("n") > 1) & (F.col("size") > copies_bytes), 1)).alias("hot")).first()
    n_buckets = max(1, -(-int(totals["size"] or 0) // bucket_bytes), -(-int(totals["n"] or 0) // bucket_rows))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "mark"), F.lit(n_buckets)).cast("long").alias("bucket")
    rows = df.select(mark.alias("mark"), F.struct(*shown(df)).alias("shown"), record.alias("record"))
    if totals["hot"]:
        hot = marks.filter((F.col("n") > 1) & (F.col("size") > copies_bytes)).select("mark")
        hot = F.broadcast(hot) if totals["hot"] <= BROADCAST_ROWS else hot
        kinds = rows.join(hot, "mark", "left_semi").groupBy("mark", "shown").agg(F.first("record").alias("record"), F.count(F.lit(1)).alias("n"))
        chunks = kinds.select("mark", "record", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / FAN_OUT))).alias("chunk")).repartition("mark", "chunk")
        first = F.col("chunk") * FAN_OUT
        copies = chunks.select("mark", "record", F.explode(F.sequence(first, F.least(first + FAN_OUT, F.col("n")) - 1)).alias("copy"))
        rows = rows.join(hot, "mark", "left_anti").select("mark", "record").unionByName(copies.select(F.xxhash64("mark", "copy").alias("mark"), "record"))
    return materialize(rows.select(bucket, "mark", "record"), "scattered", level=LEVEL), n_buckets, int(totals["size"] or 0)


def positions(buckets: DataFrame) -> DataFrame:
    """``bucket`` and ``first``, its place on the line, from ``bucket`` and ``n``."""
    blocks = buckets.withColumn("block", F.floor(F.col("bucket") / BLOCK))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(before(Window.orderBy("block"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(before(Window.partitionBy("block").orderBy("bucket"))), F.lit(0))
    return blocks.withColumn("own", own).join(base, "block").select("bucket", (F.col("base") + F.col("own")).alias("first"))


def external_shuffle(df: DataFrame, size: Column, n_shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, copies_bytes: int = COPIES_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of ``df`` and ``shard int``, ``slot long`` (see above for tables that have such columns); the records in random order over the shards, sorted by both in each partition."""
    scattered, n_buckets, n_bytes = scatter(df, size, seed, bucket_bytes, copies_bytes, bucket_rows)
    shard, slot = free_name(df, "shard"), free_name(df, "slot")
    sizes = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    order = fisher_yates(F.col("n").cast("int"), F.xxhash64(F.lit(seed), "bucket"))
    orders = sizes.join(positions(sizes), "bucket").select("bucket", "first", order.alias("order"))
    # a task gathers a few buckets, as each task writes a file a shard; bucket by bucket, the records stream through two sorts
    tasks = max(1, -(-n_bytes // TASK_BYTES), -(-n_buckets // TASK_BUCKETS))
    gathered = scattered.repartition(tasks, "bucket").withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("mark")))
    position = F.col("first") + F.get("order", F.col("rank") - 1)
    placed = gathered.join(orders.repartition(tasks, "bucket").hint("merge"), "bucket").select("record", position.alias("position"))
    out = placed.select(
        "record.*",
        F.pmod("position", F.lit(n_shards)).cast("int").alias(shard),
        F.floor(F.col("position") / F.lit(n_shards)).cast("long").alias(slot),
    ).sortWithinPartitions(shard, slot)
    out._works_on, out._named = scattered, (shard, slot)
    return out


def shard_records(df: DataFrame, text: str = "text", key: str = "doc_id", n_shards: int = 24, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, copies_bytes: int = COPIES_BYTES) -> DataFrame:
    """Shuffle and write whole records below the shared folder, and digest what was written.

    A row for each record: ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.
    """
    shuffled = external_shuffle(df, record_size(F.col(text)), n_shards, seed, bucket_bytes, copies_bytes)
    shard, slot = shuffled._named
    written = materialize(shuffled, "shards", by=shard, level=LEVEL)
    discard(shuffled._works_on)
    digest = written.select(F.col(key).alias(key), record_size(F.col(text)).alias("size"), text_crc32(F.col(text)).alias("text_crc32"), F.col(shard).alias("shard"), F.col(slot).alias("slot"))
    return digest.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def write_shards(df: DataFrame, path: str, text: str = "text", n_shards: int = 24, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, copies_bytes: int = COPIES_BYTES) -> None:
    """Shuffle whole records and write them as Parquet below ``path``, one folder a shard, each file sorted by slot."""
    shuffled = external_shuffle(df, record_size(F.col(text)), n_shards, seed, bucket_bytes, copies_bytes)
    shuffled.write.partitionBy(shuffled._named[0]).parquet(path)
    discard(shuffled._works_on)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_records(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

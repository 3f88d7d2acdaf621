"""Sharding by longest processing time: groups that must stay together, largest first, to the least-loaded shard."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialize


def schedule(sizes: list[tuple[int, object]], shards: int) -> dict:
    """Item -> shard. Items by size, largest first, ties by item; each to the least-loaded shard, ties to the lowest."""
    heap = [(0, s) for s in range(shards)]
    where = {}
    for size, item in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, s = heap[0]
        where[item] = s
        heapq.heapreplace(heap, (load + size, s))
    return where


def assign_shards(docs: DataFrame, shards: int = 8, bundles: int = 4096, cell_rows: int = 4096) -> DataFrame:
    """Every row gets a shard (law `bytes`: total sizes near equal) and a slot, gapless from 0 within its shard.

    Size is the UTF-8 bytes of the text (NULL: none) plus 1. Equal texts (NULL equals the empty text) form a group and
    share a shard. What the heap schedules is bounded: every group above 1 / `bundles` of all bytes (fewer than
    `bundles`) by itself, and all smaller ones as `bundles` bundles by hash. So at most 2 * `bundles` items reach the
    driver however large the input is, and shards differ by about one bundle unless a single group outweighs a shard.

    Slots come from counts of rows in hashed cells, never from one sorted shard. Repeated rows are rows of their own.
    An empty table gives no rows. Extra columns are dropped,
    whatever their names; of a very long text only its length and checksum travel. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("group"),
    )
    rows = materialize(rows.withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("int")))
    groups = rows.groupBy("group", "bundle").agg(F.sum("size").alias("bytes"))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    split = groups.withColumn("large", F.col("bytes") * bundles > total)
    items = (split.groupBy("large", F.when(F.col("large"), F.hex("group")).otherwise(F.col("bundle").cast("string")).alias("item"))
             .agg(F.sum("bytes").alias("bytes")).collect())
    where = schedule([(r["bytes"], (r["large"], r["item"])) for r in items], shards)
    table = spark.createDataFrame([(large, item, s) for (large, item), s in where.items()], "large boolean, item string, shard int")
    large = table.filter("large").select(F.unhex("item").alias("group"), F.col("shard").alias("large_shard"))
    small = table.filter("not large").select(F.col("item").cast("int").alias("bundle"), F.col("shard").alias("bundle_shard"))
    # both tables hold at most `bundles` rows
    placed = rows.join(F.broadcast(large), "group", "left").join(F.broadcast(small), "bundle", "left").select(
        "doc_id", "size", "text_crc32", F.coalesce("large_shard", "bundle_shard").alias("shard"),
        F.pmod(F.xxhash64("doc_id", "group"), F.lit(max(1, n // cell_rows))).alias("cell"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("within", within).join(before, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir))

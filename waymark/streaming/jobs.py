"""Streaming forms of the reports, append rules and scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import backoff
from ..operators.survival import mass_curve, score_on
from ..session import materialize
from ..sources.sinks import LOG_DDL, read_log, table_digest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, schema: str, delay: str = "1 hour", files_per_batch: int | None = None) -> DataFrame:
    """Event files as a stream with a watermark. Zone-free times become TIMESTAMP (session zone UTC),
    since a watermark needs one; `event_us` keeps the exact microseconds."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(path)
    return (df.withColumn("event_time", F.col("event_datetime").cast("timestamp"))
            .withColumn("event_us", F.unix_micros("event_time")).withWatermark("event_time", delay))


def activity_counts(stream: DataFrame, size: str = "1 day", by: Sequence[str] = ()) -> DataFrame:
    g = stream.groupBy(F.window("event_time", size), *by).agg(F.count(F.lit(1)).alias("events"))
    return g.select(F.col("window.start").alias("window_start"), *by, "events")


def append_once(stream: DataFrame, key: str = "source_row") -> DataFrame:
    """A repeated row key inside the watermark adds nothing."""
    return stream.dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, gap: str, key: str = "application_id") -> DataFrame:
    s = stream.groupBy(F.session_window("event_time", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("events"))
    return s.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def commit_batches(stream: DataFrame, root: str, log: str, checkpoint: str):
    """Each micro-batch is written to its own directory, then its marker. A replayed batch id finds
    its marker and writes nothing; a crash between the two overwrites the same directory."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"batch={batch_id:010d}"
        done = read_log(spark, log)
        if not done.filter(F.col("day") == name).isEmpty():
            return
        path = f"{root}/{name}"
        batch.write.mode("overwrite").option("compression", "zstd").parquet(path)
        last = done.orderBy(F.col("day").desc()).first()
        marker = table_digest(spark.read.parquet(path)).select(
            F.lit(name).alias("day"), F.col("rows").cast("long").alias("rows"), "digest", F.lit(last["commit_hash"] if last else "").alias("previous_hash"))
        marker.withColumn("commit_hash", F.sha2(F.concat_ws("|", "day", F.col("rows").cast("string"), "digest", "previous_hash"), 256)
                          ).write.mode("append").json(log)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_batches(stream: DataFrame, pools: DataFrame, levels: dict[str, Sequence[str]], strata: Sequence[str],
                  sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Backoff lookup of arriving rows against fitted pools."""
    return (stream.writeStream.foreachBatch(lambda df, i: sink(backoff(df, pools, levels, strata), i))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def score_stream(stream: DataFrame, law: DataFrame, levels: dict[str, Sequence[str]], strata: Sequence[str], elapsed: str, stop: str,
                 sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Arriving rows with their pool and, where they have one, survival to `elapsed` and the remaining event mass before
    `stop`. The law's cumulative masses are summed once before the stream starts; each batch resolves its rows and reads
    them as of its own times. A batch that is run again gives the same rows."""
    fields = list(dict.fromkeys(k for keys in levels.values() for k in keys))
    pool = ["model_level", *(f"pool_{f}" for f in fields), *strata]
    curve = mass_curve(law.withColumnsRenamed({f: f"pool_{f}" for f in fields}), pool)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(backoff(batch, law, levels, strata))  # read by the score and by what has no pool
        scored = score_on(rows.filter("model_level IS NOT NULL"), curve, pool, elapsed, stop)
        none = rows.filter("model_level IS NULL")
        sink(scored.unionByName(none, allowMissingColumns=True), batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["LOG_DDL", "activity_counts", "append_once", "commit_batches", "read_events", "score_batches", "score_stream", "sessions"]

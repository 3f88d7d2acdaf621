"""Sinks, append rules and the daily commit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.columns import ntz
from ..spec import EVENT_COLUMNS, PROVENANCE_COLUMNS


def write_days(df: DataFrame, root: str, day: str = "event_datetime") -> None:
    """One zstd Parquet directory per day; only the days present in `df` are replaced. Rows are dealt by
    day and a hash with as many buckets as the day needs: AQE joins small ones and splits heavy ones."""
    (df.withColumn("day", F.to_date(day)).hint("rebalance", "day")
     .sortWithinPartitions("day", day, "application_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy("day").parquet(root))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_csv(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """A fitted table as CSV in key order; part files follow each other in that order."""
    df.orderBy(*keys).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def combine(history: DataFrame, days: DataFrame) -> DataFrame:
    """History and simulated days under one schema: provenance first, then the event contract."""
    def shape(df):
        types = {"event_datetime": "timestamp_ntz", "visitnum": "double", "day_of_week_num": "long",
                 "is_simulated": "boolean", "source_row": "long"}
        have = set(df.columns)
        return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(types.get(c, "string")).alias(c)
                           for c in (*PROVENANCE_COLUMNS, *EVENT_COLUMNS)])
    return shape(history).unionByName(shape(days))


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace target rows of the same key."""
    return new.unionByName(target.join(new.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def append_history(history: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (history included) and rejected rows with a reason.

    DUPLICATE_KEY: the key is already stored or repeats inside the batch. OUT_OF_ORDER: the
    application's first incoming time is before its last stored time.
    """
    repeats = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("__k")).filter("__k > 1").select(key, F.lit(True).alias("__rep"))
    stored = history.join(incoming.select(key), key, "left_semi").select(key).distinct().withColumn("__old", F.lit(True))
    last = history.groupBy("application_id").agg(F.max("event_datetime").alias("__last"))
    late = (incoming.groupBy("application_id").agg(F.min("event_datetime").alias("__first")).join(last, "application_id")
            .filter(F.col("__first") < F.col("__last")).select("application_id", F.lit(True).alias("__late")))
    judged = (incoming.join(stored, key, "left").join(repeats, key, "left").join(late, "application_id", "left")
              .withColumn("reason", F.when(F.col("__old") | F.col("__rep"), "DUPLICATE_KEY").when(F.col("__late"), "OUT_OF_ORDER"))
              .drop("__old", "__rep", "__late"))
    rejected = judged.filter(F.col("reason").isNotNull())
    accepted = history.unionByName(judged.filter(F.col("reason").isNull()).drop("reason"), allowMissingColumns=True)
    return accepted, rejected


def load_table(df: DataFrame, table: str, replace: bool = False) -> int:
    """Load a reporting table: a filled table is refused unless `replace`; the stored count is checked."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table) and not replace and not spark.table(table).isEmpty():
        raise ValueError(f"table is not empty: {table}")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").saveAsTable(table)
    stored, sent = spark.table(table).count(), seen.get["rows"]
    if stored != sent:
        raise ValueError(f"row count mismatch: {stored} stored, {sent} sent")
    return stored


def with_origin(df: DataFrame, simulation_start: str, edges: Sequence[tuple[str, str]], last: str) -> DataFrame:
    """Origin label by time thresholds and the simulated flag."""
    origin = F.lit(last)
    for edge, name in reversed(list(edges)):
        origin = F.when(F.col("event_datetime") < ntz(edge), name).otherwise(origin)
    return df.withColumns({"data_origin": origin, "is_simulated": F.col("event_datetime") >= ntz(simulation_start)})


LOG_DDL = "day string, rows bigint, digest string, previous_hash string, commit_hash string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The markers so far. Only a path that does not exist is an empty log; a damaged marker is an error when read."""
    try:
        return spark.read.schema(LOG_DDL).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_DDL)


def table_digest(df: DataFrame) -> DataFrame:
    """Order-insensitive row count and content digest, combined map-side."""
    h = F.xxhash64(*df.columns).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(30,0)")).cast("string").alias("digest"))


def commit_day(df: DataFrame, day: str, root: str, log: str) -> dict:
    """Write a day's data, then its marker. A repeated day returns the stored marker and writes
    nothing; days cannot be skipped; markers chain by hash. A row outside the day is refused before
    anything is written, and only the day's own partition is ever replaced."""
    spark = df.sparkSession
    done = read_log(spark, log)
    stored = done.filter(F.col("day") == day).first()
    if stored:
        return stored.asDict()
    last = done.orderBy(F.col("day").desc()).first()
    if last:
        expected = spark.range(1).select(F.date_add(F.lit(last["day"]).cast("date"), 1).cast("string").alias("d")).first()["d"]
        if day != expected:
            raise ValueError(f"day {day} skips {expected}")
    stray = ~F.to_date("event_datetime").eqNullSafe(F.lit(day).cast("date"))
    if df.filter(stray).limit(1).count():
        raise ValueError(f"rows outside {day}")
    own = f"{root.rstrip('/')}/day={day}"
    (df.hint("rebalance").sortWithinPartitions("event_datetime", "application_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").parquet(own))
    back = spark.read.parquet(own)
    marker = (table_digest(back.select(*df.columns)).withColumns({
        "day": F.lit(day), "previous_hash": F.lit(last["commit_hash"] if last else "")})
        .withColumn("commit_hash", F.sha2(F.concat_ws("|", "day", F.col("rows").cast("string"), "digest", "previous_hash"), 256)))
    marker = marker.select("day", F.col("rows").cast("long").alias("rows"), "digest", "previous_hash", "commit_hash")
    marker.write.mode("append").json(log)
    return marker.sparkSession.read.schema(LOG_DDL).json(log).filter(F.col("day") == day).first().asDict()

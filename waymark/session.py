"""Session settings the operators count on."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Shuffle partitions before adaptive plans join small ones, and the shuffled bytes up to which they are joined. Rows of a
#: fixed number of partitions would grow with the input, and wide rows take many times their compressed bytes in memory.
FIRST_PARTITIONS = 512
PARTITION_BYTES = "4m"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings only: UTC, adaptive plans, and skew splitting even where the split costs
    one more shuffle (a group-by on the join key would otherwise rule it out)."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def partitions_by_size(spark: SparkSession) -> SparkSession:
    """Runtime settings only: shuffles deal rows to as many tasks as their bytes ask for, instead of to a fixed number."""
    for key, value in {
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(FIRST_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": PARTITION_BYTES,
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; only a local session that names none (a test) gets a
    temporary one, as on a cluster each machine would have its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write once as Parquet, read back: later branches share it, columnar and prunable, and a lost
    executor costs a re-read instead of the whole chain above."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/waymark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

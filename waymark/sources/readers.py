"""Readers: always a stated schema, columns pruned at the scan."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import EVENT_DDL


def scan_parquet(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str] | None = None,
                 schema: str | None = EVENT_DDL, recursive: bool = False, glob: str | None = None,
                 with_source: bool = False) -> DataFrame:
    """Files, directories, globs or object-store URLs, in any number. `with_source` adds the file
    and the row position in it: together the stable tie-break of equal times."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.parquet(*paths)
    cols = [F.col(c) for c in (columns or df.columns)]
    if with_source:
        cols += [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("source_row")]
    return df.select(*cols)


def read_days(spark: SparkSession, root: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Daily partitions `day=YYYY-MM-DD`, pruned to a range of days."""
    df = spark.read.parquet(root)
    if first:
        df = df.filter(F.col("day") >= F.lit(first).cast("date"))
    return df.filter(F.col("day") <= F.lit(last).cast("date")) if last else df


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fitted-table CSV; blank keys stay blank instead of becoming NULL."""
    df = spark.read.schema(schema).option("header", "true").option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return df.na.fill("", [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])


AUDIT_DDL = ("run_id string, explanation_id string, application_id string, context_id string, "
             "explanation_time string, category string, decision_id string, event_key string, "
             "explanation struct<reason:string,selected_outcome:string,model_level:string,support_count:bigint>")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_DDL).json(path)


LIFECYCLE_STRUCT = "application_id string, context_id string, creation_datetime string, deadline string"


def registry_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """Checkpoint documents whose `lifecycle_registry` maps a context to its lifecycles, flattened."""
    schema = f"struct<lifecycle_registry:map<string,array<struct<{LIFECYCLE_STRUCT.replace(' string', ':string')}>>>>"
    parsed = documents.select(F.from_json(column, schema).alias("d"))
    return (parsed.select(F.explode(F.map_values("d.lifecycle_registry")).alias("l")).select(F.inline("l"))
            .withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("creation_datetime", "deadline")}))


#: Files up to this size are read whole for their SHA-256; Spark holds such a file in one row.
WHOLE_BYTES = 128 << 20


def _row_digests(spark: SparkSession, table: str) -> DataFrame | None:
    """path, rows, digest and columns of each Parquet file under `table`, spread over splits. The digest does not depend
    on row order. `columns` are those of the table's merged schema. None if no file can be read."""
    reader = spark.read.options(recursiveFileLookup="true", pathGlobFilter="*.parquet", mergeSchema="true", ignoreCorruptFiles="true")
    try:
        df = reader.parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None
    columns = [F.col(f"`{c}`") for c in df.columns]
    h = F.xxhash64(*columns, *[c.isNull() for c in columns]).cast("decimal(20,0)")  # NULL alone leaves a hash as it is
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return (df.select(path.alias("path"), h.alias("h")).groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.sum("h").cast("string").alias("digest"))
            .withColumn("columns", F.lit(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields))))


def file_inventory(spark: SparkSession, root: str, with_hash: bool = True, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """One row per file: path, file (path below root), length and modification time; with_hash adds sha256 of the bytes
    (NULL above `whole_bytes`: those files are never held in one row) and, of Parquet files of any size, rows, digest and
    columns of their content."""
    root = root.rstrip("/")
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root) + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.expr("substring(path, locate({0}, path) + {1})".format("'" + base.replace("\\", "\\\\").replace("'", "\\'") + "'", len(base)))
    listed = files.select("path", below.alias("file"), "length", "modificationTime")
    if not with_hash:
        return listed
    hashed = files.filter(F.col("length") <= whole_bytes).select("path", F.sha2("content", 256).alias("sha256"))
    tables = [r["t"] for r in listed.filter(F.col("file").endswith(".parquet")).select(F.split("file", "/")[0].alias("t")).distinct().collect()]
    found = [d for t in sorted(tables) if (d := _row_digests(spark, f"{root}/{t}")) is not None]
    rows = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "path string, rows long, digest string, columns string")
    return listed.join(hashed, "path", "left").join(rows, "path", "left")


def verify_manifest(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Violations of a manifest (file, and of sha256, digest, rows and columns those it declares): MISSING, UNDECLARED,
    HASH_MISMATCH, DIGEST_MISMATCH, ROWS_MISMATCH, COLUMNS_MISMATCH; UNVERIFIED if only a SHA-256 is declared and the file
    is too large for it. A declared NULL is not compared."""
    checks = {c: n for c, n in (("sha256", "HASH"), ("digest", "DIGEST"), ("rows", "ROWS"), ("columns", "COLUMNS")) if c in manifest.columns}
    have = inventory.select("file", F.lit(True).alias("present"), *[F.col(c).alias(f"actual_{c}") for c in checks])
    want = manifest.select("file", F.lit(True).alias("declared"), *[F.col(c).alias(f"declared_{c}") for c in checks])
    both = want.join(have, "file", "full")
    differs = [F.when(F.col(f"declared_{c}").isNotNull() & ~F.col(f"declared_{c}").eqNullSafe(F.col(f"actual_{c}"))
                      & (F.col("actual_sha256").isNotNull() if c == "sha256" else F.lit(True)), f"{n}_MISMATCH") for c, n in checks.items()]
    if "sha256" in checks:
        other = F.col("declared_digest").isNotNull() if "digest" in checks else F.lit(False)
        differs.append(F.when(F.col("declared_sha256").isNotNull() & F.col("actual_sha256").isNull() & ~other, "UNVERIFIED"))
    found = (F.when(F.col("present").isNull(), F.array(F.lit("MISSING"))).when(F.col("declared").isNull(), F.array(F.lit("UNDECLARED")))
             .otherwise(F.array_compact(F.array(*differs)) if differs else F.array().cast("array<string>")))
    return both.select("file", F.explode(found).alias("violation"))


def source_drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files of which any column but the path (length, modification time, hash, digest, rows, columns) changed, or that came
    or went."""
    sides = [df.select("path", *[F.col(c).alias(f"{c}_{n}") for c in df.columns if c != "path"])
             for df, n in ((before, "before"), (now, "now"))]
    both = sides[0].join(sides[1], "path", "full")
    changed = F.lit(False)
    for c in (c for c in before.columns if c != "path"):
        changed = changed | ~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_now"))
    return both.filter(changed)

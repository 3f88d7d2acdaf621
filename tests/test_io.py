"""Sinks, append rules, daily commits and readers."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import columns as C
from waymark.operators import checks as K
from waymark.sources import readers, sinks
from waymark.spec import EVENT_COLUMNS, EVENT_DDL, PROVENANCE_COLUMNS


def rows(spark, data):
    df = spark.createDataFrame(data, "application_id string, context_id string, t string, source_row bigint")
    return df.select("application_id", "context_id", F.col("t").cast("timestamp_ntz").alias("event_datetime"), "source_row")


def test_daily_overwrite_touches_only_its_days(spark, folder):
    sinks.write_days(rows(spark, [("a", "c", "2026-05-01 01:00:00", 1), ("a", "c", "2026-05-02 01:00:00", 2)]), folder + "/d")
    sinks.write_days(rows(spark, [("b", "c", "2026-05-02 03:00:00", 3)]), folder + "/d")
    assert sorted(r["source_row"] for r in readers.read_days(spark, folder + "/d").collect()) == [1, 3]
    pruned = readers.read_days(spark, folder + "/d", "2026-05-02", "2026-05-02")
    assert "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().toString()


def test_commit_is_idempotent_ordered_and_chained(spark, folder):
    day = lambda d, n: rows(spark, [("a", "c", f"{d} 01:00:00", n)])
    a = sinks.commit_day(day("2026-05-01", 1), "2026-05-01", folder + "/d", folder + "/log")
    assert sinks.commit_day(day("2026-05-01", 9), "2026-05-01", folder + "/d", folder + "/log") == a
    with pytest.raises(ValueError):
        sinks.commit_day(day("2026-05-03", 3), "2026-05-03", folder + "/d", folder + "/log")
    b = sinks.commit_day(day("2026-05-02", 2), "2026-05-02", folder + "/d", folder + "/log")
    assert b["previous_hash"] == a["commit_hash"] and spark.read.parquet(folder + "/d").count() == 2
    assert K.commit_chain_violations(sinks.read_log(spark, folder + "/log")).count() == 0


def test_commit_refuses_rows_of_another_day(spark, folder):
    day = lambda d, n: rows(spark, [("a", "c", f"{d} 01:00:00", n)])
    sinks.commit_day(day("2026-05-01", 1), "2026-05-01", folder + "/d", folder + "/log")
    with pytest.raises(ValueError):
        sinks.commit_day(day("2026-05-01", 9).unionByName(day("2026-05-02", 2)), "2026-05-02", folder + "/d", folder + "/log")
    assert [r["source_row"] for r in spark.read.parquet(folder + "/d").collect()] == [1]
    assert sinks.read_log(spark, folder + "/log").count() == 1


def test_damaged_marker_is_an_error(spark, folder):
    assert sinks.read_log(spark, folder + "/none").count() == 0
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(folder + "/log")
    with pytest.raises(Exception):
        sinks.read_log(spark, folder + "/log").collect()


def test_time_regressions_of_a_hot_application(spark):
    data = [("a", "c", f"2026-05-{1 + (i * 7) % 28:02d} 01:00:00", i) for i in range(80)] + [("b", "c", "2026-05-01 00:00:00", 100)]
    df = rows(spark, data)
    plain = {r["key"] for r in K.time_regressions(df, hot_rows=10**6).collect()}
    assert plain and plain == {r["key"] for r in K.time_regressions(df, hot_rows=20).collect()}


def test_append_rejects_duplicates_and_earlier_times(spark):
    hist = rows(spark, [("a", "c", "2026-04-01 00:00:00", 1), ("a", "c", "2026-04-05 00:00:00", 2)])
    inc = rows(spark, [("a", "c", "2026-04-05 00:00:00", 2), ("b", "d", "2026-04-01 00:00:00", 3)])
    ok, bad = sinks.append_history(hist, inc, "source_row")
    assert {(r["source_row"], r["reason"]) for r in bad.collect()} == {(2, "DUPLICATE_KEY")} and ok.count() == 3
    ok, bad = sinks.append_history(hist, rows(spark, [("a", "c", "2026-04-02 00:00:00", 4)]), "source_row")
    assert [r["reason"] for r in bad.collect()] == ["OUT_OF_ORDER"]


def test_combined_export_counts_and_columns(spark):
    hist = rows(spark, [("a", "c", "2026-04-01 00:00:00", 1), ("a", "c", "2026-04-05 00:00:00", 2)]).withColumn("is_simulated", F.lit(False))
    days = rows(spark, [("b", "d", "2026-05-01 00:00:00", 3), ("b", "d", "2026-05-02 00:00:00", 4)]).withColumn("is_simulated", F.lit(True))
    out = sinks.combine(hist, days)
    assert out.columns == [*PROVENANCE_COLUMNS, *EVENT_COLUMNS]
    assert K.row_reconciliation(hist, days, out).first()["reconciled"]


def test_origin_boundary_second(spark):
    df = sinks.with_origin(rows(spark, [("a", "c", "2026-04-30 23:59:59", 1), ("a", "c", "2026-05-01 00:00:00", 2)]), "2026-05-01 00:00:00",
                           [("2026-04-01 00:00:00", "HISTORICAL_MARCH"), ("2026-05-01 00:00:00", "HISTORICAL_APRIL")], "SIMULATED_MAY")
    assert [(r["data_origin"], r["is_simulated"]) for r in df.orderBy("source_row").collect()] == [("HISTORICAL_APRIL", False), ("SIMULATED_MAY", True)]


def test_load_table_refuses_filled_table(spark):
    spark.sql("drop table if exists reporting_events")
    df = rows(spark, [("a", "c", "2026-04-01 00:00:00", 1)])
    assert sinks.load_table(df, "reporting_events") == 1
    with pytest.raises(ValueError):
        sinks.load_table(df, "reporting_events")
    assert sinks.load_table(df.union(df), "reporting_events", replace=True) == 2


def test_csv_round_trip_keeps_blank_keys(spark, folder):
    df = spark.createDataFrame([("GLOBAL", "", 3), ("STATE", "x", 2)], "model_level string, state string, n bigint")
    sinks.write_csv(df, folder + "/t", ["model_level", "state"])
    back = readers.read_table_csv(spark, folder + "/t", "model_level string, state string, n bigint")
    assert sorted(map(tuple, back.collect())) == [("GLOBAL", "", 3), ("STATE", "x", 2)]


def test_globs_and_recursion(spark, folder):
    df = spark.createDataFrame([], EVENT_DDL)
    df.write.parquet(folder + "/a/x"); df.write.parquet(folder + "/b")
    assert readers.scan_parquet(spark, [folder + "/a/x", folder + "/b"], ["application_id"]).count() == 0
    assert readers.scan_parquet(spark, folder, recursive=True, glob="*.parquet").columns == list(EVENT_COLUMNS)


def test_manifest_and_drift(spark, tables):
    inv = readers.file_inventory(spark, tables.root)
    manifest = inv.select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256")
    assert readers.verify_manifest(inv, manifest).count() == 0
    bad = manifest.filter("file <> 'part.parquet'").withColumn("sha256", F.when(F.col("file") == "nation.parquet", "0").otherwise(F.col("sha256")))
    assert {tuple(r) for r in readers.verify_manifest(inv, bad).collect()} == {("part.parquet", "UNDECLARED"), ("nation.parquet", "HASH_MISMATCH")}
    assert readers.source_drift(inv, inv).count() == 0


def test_manifest_of_rows_and_columns(spark, folder):
    rows = spark.range(100).selectExpr("id", "if(id % 2 = 0, null, cast(id as string)) as a", "cast(null as string) as b")
    rows.coalesce(1).write.parquet(folder + "/x y+.parquet")
    rows.filter("id < 50").coalesce(1).write.parquet(folder + "/z.parquet")
    inv = readers.file_inventory(spark, folder, whole_bytes=0).filter("file like '%.parquet'")  # no file is read whole
    got = {r["file"].split("/")[0]: r for r in inv.collect()}
    assert {f: (r["rows"], r["columns"], r["sha256"]) for f, r in got.items()} == {f: (n, "id bigint, a string, b string", None) for f, n in (("x y+.parquet", 100), ("z.parquet", 50))}
    good = spark.createDataFrame(inv.collect(), inv.schema).select("file", "digest", "rows", "columns")
    assert readers.verify_manifest(inv, good).count() == 0
    x = F.col("file").startswith("x")
    bad = good.withColumns({"rows": F.when(x, F.lit(7)).otherwise(F.col("rows")), "columns": F.when(~x, F.lit("id bigint")).otherwise(F.col("columns"))})
    assert {(r["file"][0], r["violation"]) for r in readers.verify_manifest(inv, bad).collect()} == {("x", "ROWS_MISMATCH"), ("z", "COLUMNS_MISMATCH")}
    only = good.select("file", F.lit("00").alias("sha256"))
    assert {r["violation"] for r in readers.verify_manifest(inv, only).collect()} == {"UNVERIFIED"}
    rows.filter("id < 50").selectExpr("id", "b as a", "a as b").coalesce(1).write.mode("overwrite").parquet(folder + "/z.parquet")
    now = readers.file_inventory(spark, folder, whole_bytes=0).filter("file like 'z.parquet/%.parquet'")
    assert now.first()["digest"] != got["z.parquet"]["digest"] and now.first()["rows"] == 50


def test_registered_checks_look_at_content(spark, tables):
    from waymark.plans import load_all
    found = load_all()
    assert {tuple(r) for r in found["a15_manifest_check"][0](tables).collect()} == {
        ("region.parquet", "UNDECLARED"), ("nation.parquet", "HASH_MISMATCH"), ("nation.parquet", "DIGEST_MISMATCH"),
        ("customer.parquet", "ROWS_MISMATCH"), ("supplier.parquet", "COLUMNS_MISMATCH")}
    assert {r["key"] for r in found["b25_source_drift"][0](tables).collect()} == {"region.parquet", "nation.parquet"}


def test_jsonl_and_registry(spark, folder):
    df = spark.createDataFrame([("a", "ORGANIC_CONTINUATION", ("EMPIRICAL",))], "application_id string, category string, explanation struct<reason:string>")
    sinks.write_jsonl(df, folder + "/audit")
    assert readers.read_audit(spark, folder + "/audit").select("explanation.reason").first()[0] == "EMPIRICAL"
    doc = spark.createDataFrame([('{"lifecycle_registry":{"c":[{"application_id":"a","context_id":"c","creation_datetime":"2026-04-01T00:00:00","deadline":"2026-05-01T00:00:00"}]}}',)], "value string")
    r = readers.registry_rows(doc).first()
    assert (r["application_id"], str(r["deadline"])) == ("a", "2026-05-01 00:00:00")


def test_terminal_classes(spark):
    from tests.test_golden import SPEC, events
    from waymark.operators.lifecycle import classify_terminals
    P, A = "Push to Partner", "AIP Approved"
    ev = events(spark, [("a", "c", "2026-04-02 00:00:00", 0, A), ("a", "c", "2026-04-03 00:00:00", 1, P), ("a", "c", "2026-04-04 00:00:00", 2, P),
                        ("b", "d", "2026-04-03 00:00:00", 3, P), ("e", "f", "2026-04-02 00:00:00", 4, A), ("e", "f", "2026-05-01 00:00:00", 5, P), ("g", "h", "2026-04-02 00:00:00", 6, A), ("g", "h", "2026-05-01 00:00:01", 7, P),
                        ("i", "j", "2026-03-02 00:00:00", 8, P), ("k", "l", "2026-04-02 00:00:00", 9, A), ("k", "m", "2026-04-03 00:00:00", 10, P)])
    got = {r["source_row"]: r["classification"] for r in classify_terminals(ev, SPEC).collect()}
    assert got == {1: "VALID_PROGRESSION_PTP", 2: "POST_TERMINAL_PTP", 3: "PTP_WITHOUT_PRIOR_AIP", 5: "VALID_PROGRESSION_PTP", 7: "PTP_AFTER_EXPIRY",
                   8: "PTP_AMBIGUOUS_APPLICATION", 10: "PTP_AMBIGUOUS_APPLICATION"}


def test_shuffles_get_partitions_by_size(spark):
    """Not the session's fixed number: tasks of more rows must not hold more rows each."""
    from waymark.session import configure, partitions_by_size
    partitions_by_size(configure(spark))
    rows = spark.range(1_500_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    assert rows.groupBy("k").count().rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_each_commit_reads_its_own_day(spark, tables, monkeypatch):
    from waymark.plans import load_all
    from waymark.sources import sinks
    plans, commit = [], sinks.commit_day

    def seen(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return commit(df, *rest)
    monkeypatch.setattr(sinks, "commit_day", seen)
    assert load_all()["a17_day_commits"][0](tables).count() == len(plans) - 2
    assert all("PartitionFilters: []" not in p and "day#" in p for p in plans)

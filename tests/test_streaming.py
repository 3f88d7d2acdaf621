"""Streams give what their batch twins give."""

from pyspark.sql import functions as F

from waymark.functions import columns as C
from waymark.operators import lifecycle as L
from waymark.sources.adapters import STREAM_SPEC as SPEC
from waymark.streaming import jobs, rules

COLS = ["application_id", "context_id", "event_datetime", "source_row", "journey_substage"]
DDL = "application_id string, context_id string, event_datetime timestamp_ntz, source_row bigint, journey_substage string"


def write_files(df, folder, n=4):
    """Files in event-time order, one per micro-batch."""
    for i, r in enumerate(df.select(F.min("event_datetime").alias("a"), F.max("event_datetime").alias("z")).collect()):
        span = (r["z"] - r["a"]) / n
        for k in range(n):
            lo, hi = r["a"] + k * span, r["a"] + (k + 1) * span
            part = df.filter((F.col("event_datetime") >= F.lit(lo)) & ((F.col("event_datetime") < F.lit(hi)) if k < n - 1 else F.lit(True)))
            part.coalesce(1).write.mode("append").parquet(folder)


def end_rows(spark, like):
    """Two far later rows, so that the watermark passes all others."""
    for day, row in (("2024-06-01", -1), ("2024-06-02", -2)):
        end = spark.range(1).select(*[{
            "application_id": F.lit("end"), "context_id": F.lit("end"), "event_datetime": C.ntz(f"{day} 00:00:00"), "source_row": F.lit(row).cast("long")}.get(
            c, F.array(F.lit("view")) if c == "labels" else F.lit("view") if c == "journey_substage" else F.lit(None)).cast(like.schema[c].dataType).alias(c) for c in like.columns])
        yield end


def write_late(df, folder):
    """Five files dealt by hash, so that about every row has a later one in an earlier batch; then the end."""
    for k in range(5):
        df.filter(F.pmod(F.xxhash64("application_id", "event_datetime", "source_row"), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(folder)
    for end in end_rows(df.sparkSession, df):
        end.coalesce(1).write.mode("append").parquet(folder)


def drain(df, folder, name):
    q = (df.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-cp")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def source(spark, tables, folder, campaign=False):
    ev = tables.stream(campaign).filter("application_id is not null").select(*COLS)
    # One far later row moves the watermark past every deadline.
    end = spark.range(1).select(F.lit("end").alias("application_id"), F.lit("end").alias("context_id"), C.ntz("2024-06-01 00:00:00").alias("event_datetime"),
                                F.lit(-1).cast("long").alias("source_row"), F.lit("view").alias("journey_substage"))
    end2 = end.withColumn("event_datetime", C.ntz("2024-06-02 00:00:00")).withColumn("source_row", F.lit(-2).cast("long"))
    write_files(ev, f"{folder}/in")
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    end2.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return ev, jobs.read_events(spark, f"{folder}/in", DDL, files_per_batch=1)


def test_activity_counts(spark, tables, folder):
    ev, st = source(spark, tables, folder)
    got = drain(jobs.activity_counts(st), folder, "out").filter("window_start < '2024-05-01'")
    want = ev.groupBy(F.date_trunc("day", "event_datetime").cast("timestamp").alias("window_start")).agg(F.count(F.lit(1)).alias("events"))
    assert rows(got) == rows(want)


def test_append_once(spark, tables, folder):
    ev, st = source(spark, tables, folder)
    ev.filter("journey_substage = 'error'").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    st = jobs.read_events(spark, f"{folder}/in", DDL, delay="400 days")
    got = drain(jobs.append_once(st).select("source_row"), folder, "out").filter("source_row >= 0")
    assert rows(got) == rows(ev.select("source_row"))


def test_reject_late(spark, folder):
    make = lambda data: spark.createDataFrame(data, "application_id string, source_row bigint, t string, journey_substage string").select(
        "application_id", F.lit("c").alias("context_id"), F.col("t").cast("timestamp_ntz").alias("event_datetime"), "source_row", "journey_substage")
    make([("a", 1, "2024-01-01 10:00:00", "x"), ("a", 2, "2024-01-01 12:00:00", "x")]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    make([("a", 3, "2024-01-01 11:00:00", "x"), ("a", 4, "2024-01-01 13:00:00", "x"), ("b", 5, "2024-01-01 09:00:00", "x")]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    st = jobs.read_events(spark, f"{folder}/in", DDL, files_per_batch=1)
    got = drain(rules.keyed_rule(st, rules.RejectLate()), folder, "out")
    assert [r["source_row"] for r in got.filter("not accepted").collect()] == [3]
    assert got.filter("accepted").count() == 4


def test_lifecycle_monitor(spark, tables, folder):
    ev, st = source(spark, tables, folder)
    got = drain(rules.lifecycle_monitor(st, SPEC), folder, "out")
    full = tables.stream().filter("application_id is not null").filter(L.in_window(True))
    want = L.outcomes(tables.lifecycles(), full, SPEC, "2024-06-01 00:00:00").select("application_id", "outcome")
    assert rows(got.select("application_id", "outcome")) == rows(want)


def test_terminal_beats_expiry_at_the_deadline(spark, folder):
    spark.createDataFrame([("a", "c", "2024-01-01 00:00:00", 1, "signup"), ("a", "c", "2024-01-04 00:00:00", 2, "purchase"), ("b", "c", "2024-01-01 00:00:00", 3, "signup"),
                           ("b", "c", "2024-01-04 00:00:01", 4, "purchase"), ("z", "z", "2024-05-01 00:00:00", 5, "view")],
                          "application_id string, context_id string, t string, source_row bigint, journey_substage string").select(
        "application_id", "context_id", F.col("t").cast("timestamp_ntz").alias("event_datetime"), "source_row", "journey_substage").coalesce(1).write.parquet(f"{folder}/in")
    st = jobs.read_events(spark, f"{folder}/in", DDL)
    got = drain(rules.lifecycle_monitor(st, SPEC), folder, "out")
    assert rows(got.select("application_id", "outcome")) == [("a", "TERMINAL"), ("b", "EXPIRED")]


def test_competing_send(spark, tables, folder):
    ev, st = source(spark, tables, folder, campaign=True)
    got = drain(rules.keyed_rule(st, rules.CompetingSend(43200 * 10**6), timers=True), folder, "out")
    want = L.attribute_responses(tables.stream(True), SPEC, 43200).select(F.col("source_row").alias("send_row"), "status", "response")
    assert rows(got.select("send_row", "status", "response")) == rows(want)


def test_running_features(spark, tables, folder):
    p = tables.packets().select("application_id", "context_id", "event_datetime", F.lit(0).cast("long").alias("source_row"), "labels", "regime", "prior_depth", "ptp_eligible")
    write_late(p, f"{folder}/in")
    st = jobs.read_events(spark, f"{folder}/in", "application_id string, context_id string, event_datetime timestamp_ntz, source_row bigint, labels array<string>", delay="60 days", files_per_batch=1)
    got = drain(rules.running_features(st, SPEC), folder, "out").filter("application_id <> 'end'")
    want = p.select("application_id", C.micros("event_datetime").alias("event_us"), "regime", "prior_depth", "ptp_eligible")
    assert rows(got) == rows(want)


def test_rules_hold_late_rows(spark, tables, folder):
    """Terminals before their creation, responses before their send: all in other batches than event order says."""
    for name, campaign in (("sends", True), ("lives", False)):
        write_late(tables.stream(campaign).filter("application_id is not null").select(*COLS), f"{folder}/{name}")
    read = lambda name: jobs.read_events(spark, f"{folder}/{name}", DDL, delay="60 days", files_per_batch=1)
    got = drain(rules.keyed_rule(read("sends"), rules.CompetingSend(43200 * 10**6), timers=True), folder, "a")
    want = L.attribute_responses(tables.stream(True), SPEC, 43200).select(F.col("source_row").alias("send_row"), "status", "response")
    assert rows(got.select("send_row", "status", "response")) == rows(want)
    got = drain(rules.lifecycle_monitor(read("lives"), SPEC), folder, "b")
    full = tables.stream().filter("application_id is not null").filter(L.in_window(True))
    want = L.outcomes(tables.lifecycles(), full, SPEC, "2024-06-01 00:00:00").select("application_id", "outcome")
    assert rows(got.select("application_id", "outcome")) == rows(want)


def test_sessions(spark, tables, folder):
    ev, st = source(spark, tables, folder)
    got = drain(jobs.sessions(st, "6 hours"), folder, "out").filter("application_id <> 'end'")
    want = ev.withColumn("event_time", F.col("event_datetime").cast("timestamp"))
    assert rows(got) == rows(jobs.sessions(want, "6 hours"))


def test_commit_batches_retry(spark, tables, folder):
    ev, st = source(spark, tables, folder)
    jobs.commit_batches(st.select(*COLS), f"{folder}/data", f"{folder}/log", f"{folder}/cp1").awaitTermination()
    n = spark.read.parquet(f"{folder}/data").count()
    # A second run from the start replays the same batch ids: nothing is added.
    jobs.commit_batches(jobs.read_events(spark, f"{folder}/in", DDL, files_per_batch=1).select(*COLS), f"{folder}/data", f"{folder}/log", f"{folder}/cp2").awaitTermination()
    assert n == ev.count() + 2 == spark.read.parquet(f"{folder}/data").count()
    from waymark.operators.checks import commit_chain_violations
    from waymark.sources.sinks import read_log
    log = read_log(spark, f"{folder}/log")
    assert commit_chain_violations(log.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.substring("day", 7, 10).cast("int")).cast("string"))).count() == 0


def test_stream_scoring(spark, tables, folder):
    from waymark.operators import lookup, survival
    law = survival.fit_law(tables.episodes(), SPEC).persist()
    levels = {k: keys for k, (keys, _) in SPEC.law_levels.items()}
    p = tables.kinded_packets().select("application_id", "event_datetime", "state", "regime", "journey_stage", *SPEC.law_strata)
    write_files(p, f"{folder}/in", 2)
    st = jobs.read_events(spark, f"{folder}/in", p.schema, files_per_batch=1)
    jobs.score_batches(st.select(*p.columns), law, levels, SPEC.law_strata, lambda df, i: df.write.mode("append").parquet(f"{folder}/scored"), f"{folder}/cp").awaitTermination()
    want = lookup.backoff(p, law, levels, SPEC.law_strata)
    assert rows(spark.read.parquet(f"{folder}/scored").select(want.columns)) == rows(want)


def test_streams_over_a_year(spark, folder):
    """Events of a year, dealt to the deliveries by hash: every stream gives what its SQL gives."""
    import duckdb

    from waymark.plans import load_all
    from waymark.plans.registry import Tables
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stretched = source.withColumn("ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod("user_id", F.lit(11)) * 33 * 86400 * 10**6).cast(source.schema["ts"].dataType))
    stretched.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet/*.parquet')")
    found = load_all()
    for name in ("t1_activity_counts", "t2_append_once", "t3_reject_late", "t4_lifecycle_monitor", "t5_competing_send", "t6_running_features", "t7_sessions"):
        fn, sql = found[name]
        got = fn(Tables(spark, folder))
        names = sorted(got.columns)
        want = con.execute(f"select {', '.join(names)} from ({sql})").fetchall()
        plain = lambda rs: sorted((tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rs))
        assert plain(got.select(names).collect()) == plain(want), name


def test_hot_application_is_applied_slot_by_slot(spark, folder):
    """Rows of one application over many slots in mixed deliveries, with an hour's crowd."""
    data = [("hot", i, 1704067200000000 + (i * 977 % 1500) * 240 * 10**6 + i, "campaign_sent" if i % 7 == 0 else "campaign_clicked") for i in range(3000)]
    df = spark.createDataFrame(data, "application_id string, source_row bigint, us bigint, journey_substage string").select(
        "application_id", F.lit("c").alias("context_id"), F.timestamp_micros("us").cast("timestamp_ntz").alias("event_datetime"), "source_row", "journey_substage")
    write_late(df, f"{folder}/in")
    st = jobs.read_events(spark, f"{folder}/in", DDL, delay="60 days", files_per_batch=1)
    got = drain(rules.keyed_rule(st, rules.CompetingSend(3600 * 10**6), timers=True), folder, "out")
    pending, want = None, []
    for _, row, us, label in sorted(data, key=lambda r: (r[2], r[1])):
        inside = pending is not None and us - pending[1] <= 3600 * 10**6
        if label == "campaign_sent":
            if pending:
                want.append(("hot", pending[0], "CENSORED_BY_COMPETING_SEND" if inside else "NO_RESPONSE", None, None))
            pending = (row, us)
        elif inside:
            want.append(("hot", pending[0], "RESPONDED", label, us - pending[1]))
            pending = None
    if pending:
        want.append(("hot", pending[0], "NO_RESPONSE", None, None))
    assert rows(got) == sorted(want, key=str)


def test_stream_scores_are_those_of_the_batch(spark, tables, folder):
    """Two deliveries against one curve; a row of no pool keeps its place without a score."""
    from waymark.operators import lookup, survival
    law = survival.fit_law(tables.episodes(), SPEC).persist()
    levels = {k: keys for k, (keys, _) in SPEC.law_levels.items()}
    p = tables.kinded_packets().select("application_id", "event_datetime", "state", "regime", "journey_stage", *SPEC.law_strata,
                                       F.pmod(F.xxhash64("application_id"), F.lit(90000)).cast("double").alias("elapsed"), F.lit(200000.0).alias("stop"))
    odd = p.limit(3).withColumn("customer_kind", F.lit("NOBODY"))
    write_files(p.unionByName(odd), f"{folder}/in", 2)
    st = jobs.read_events(spark, f"{folder}/in", p.schema, files_per_batch=1).select(*p.columns)
    jobs.score_stream(st, law, levels, SPEC.law_strata, "elapsed", "stop", lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/scored/batch={i}"), f"{folder}/cp").awaitTermination()
    pool = ["model_level", "pool_state", "pool_regime", "pool_journey_stage", *SPEC.law_strata]
    want = survival.conditional_score(lookup.backoff(p, law, levels, SPEC.law_strata), law.withColumnsRenamed({k: f"pool_{k}" for k in ("state", "regime", "journey_stage")}), pool, "elapsed", "stop")
    got = spark.read.parquet(f"{folder}/scored/batch=*")
    short = lambda df: rows(df.select("application_id", "event_datetime", "model_level", F.round("survival", 9), F.round("remaining_event_mass", 9)))
    assert short(got.filter("customer_kind <> 'NOBODY'")) == short(want)
    assert rows(got.filter("customer_kind = 'NOBODY'").select("model_level", "survival")) == [(None, None)] * 3


def test_state_does_not_grow_calls_with_applications(spark, folder):
    """State is written per bucket: thousands of applications of a batch cost no more writes than buckets."""
    n = 6000
    df = spark.range(n).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("application_id"), F.lit("c").alias("context_id"),
                               F.timestamp_micros(F.col("id") * 10**6 + 1704067200 * 10**6).cast("timestamp_ntz").alias("event_datetime"),
                               F.col("id").alias("source_row"), F.lit("signup").alias("journey_substage"))
    df.coalesce(1).write.parquet(f"{folder}/in")
    for end in end_rows(spark, df):
        end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    for name, make, timers, count in (("late", rules.RejectLate(), False, n + 2), ("lives", rules.LifecycleMonitor("signup", "purchase", 10**9), True, n)):
        st = jobs.read_events(spark, f"{folder}/in", DDL, files_per_batch=1)
        q = (rules.keyed_rule(st, make, timers=timers).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-cp")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        assert spark.read.parquet(f"{folder}/{name}").count() == count
        written = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"]]
        assert 0 < max(written) < n, (name, written)


def test_application_created_again_after_its_deadline(spark, folder):
    """Judged by the rows' times, whatever batches they come in."""
    spark.createDataFrame([("a", "c", "2024-01-01 00:00:00", 1, "signup"), ("a", "c", "2024-01-10 00:00:00", 2, "signup"), ("a", "c", "2024-01-11 00:00:00", 3, "purchase"),
                           ("z", "z", "2024-05-01 00:00:00", 5, "view")], "application_id string, context_id string, t string, source_row bigint, journey_substage string").select(
        "application_id", "context_id", F.col("t").cast("timestamp_ntz").alias("event_datetime"), "source_row", "journey_substage").coalesce(1).write.parquet(f"{folder}/in")
    got = drain(rules.lifecycle_monitor(jobs.read_events(spark, f"{folder}/in", DDL), SPEC), folder, "out")
    assert rows(got.select("application_id", "outcome")) == [("a", "EXPIRED"), ("a", "TERMINAL")]

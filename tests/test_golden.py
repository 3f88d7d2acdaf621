"""Closed-form cases of the operators' rules."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import LifecycleSpec
from waymark.functions import columns as C
from waymark.operators import checks as K
from waymark.operators import lifecycle as L
from waymark.operators import lookup as G
from waymark.operators import models as M
from waymark.operators import sequence as E
from waymark.operators import stats as H
from waymark.operators import survival as S
from waymark.operators.ordered import mark_parts, no_parts, quantiles, ranked, scan, Running, Shift
from waymark.spec import EVENT_DDL

SPEC = LifecycleSpec()


def events(spark, rows, created="2026-04-01 00:00:00"):
    """rows: (application, context, time, order, label)."""
    df = spark.createDataFrame(rows, "application_id string, context_id string, t string, source_row bigint, journey_substage string")
    df = df.select("application_id", "context_id", F.col("t").cast("timestamp_ntz").alias("event_datetime"), "source_row", "journey_substage",
                   F.concat(F.lit("stage "), "journey_substage").alias("journey_stage"), C.ntz(created).alias("application_created_at"))
    return no_parts(df.withColumn("deadline", C.plus_seconds("application_created_at", SPEC.validity_seconds)))


def masses(spark, rows):
    df = spark.createDataFrame(rows, "duration_seconds double, observed boolean").withColumn("labels", F.lit('["x"]')).withColumn("pool", F.lit("p"))
    return [(r["duration_seconds"], round(r["mass"], 9)) for r in S.product_limit(df, ["pool"]).orderBy("duration_seconds").collect()]


def test_product_limit_trailing_and_middle_censoring(spark):
    assert masses(spark, [(5.0, True), (10.0, True), (30.0, False)]) == [(5.0, 0.333333333), (10.0, 0.333333333)]
    assert masses(spark, [(5.0, True), (10.0, False), (20.0, True)]) == [(5.0, 0.333333333), (20.0, 0.666666667)]


def test_events_leave_before_censored_rows_of_equal_time(spark):
    assert masses(spark, [(5.0, True), (5.0, False), (9.0, True)]) == [(5.0, 0.333333333), (9.0, 0.666666667)]


def test_residual_mass(spark):
    rows = [(1.0, False)] * 15 + [(5.0, True)] * 15 + [(10.0, False)] * 15
    assert masses(spark, rows) == [(5.0, 0.5)]


def test_competing_terminal_keeps_mass_and_hides_blocked_label(spark):
    ev = events(spark, [(a, "c" + a, "2026-04-01 00:00:00", i, "Form filled") for i, a in enumerate("xyz")]
                + [("x", "cx", "2026-04-02 00:00:00", 10, "listing"), ("y", "cy", "2026-04-02 00:00:00", 11, "Push to Partner")])
    ep = S.episodes(E.packets(ev, SPEC).withColumn("customer_kind", F.lit("NEW_CUSTOMER")), SPEC, "2026-04-01 00:00:00", "2026-05-20 00:00:00")
    one = ep.filter("state = 'Form filled'").withColumn("labels", F.col("next_labels"))
    law = {r["labels"]: r for r in S.product_limit(one, ["state"]).collect()}
    assert round(law['["listing"]']["raw_mass"], 9) == round(1 / 3, 9)
    assert round(law["[]"]["raw_mass"], 9) == round(1 / 3, 9) and law["[]"]["mass"] == 0


def test_gap_neighbourhood(spark):
    donors = spark.createDataFrame([(str(g), "s", float(g)) for g in (29, 31, 32, 33, 80, 90)], "donor_id string, stratum string, gap double").filter("gap >= 30")
    targets = spark.createDataFrame([("a", "s", 30.0), ("b", "s", 40.0), ("c", "none", 30.0)], "target_id string, stratum string, target double")
    out = {r["target_id"]: r for r in M.gap_neighbourhood(targets, donors, 3).collect()}
    inside = lambda r: {int(d["gap"]) for d in donors.collect() if r["gap_lo"] <= d["gap"] <= r["gap_hi"]}
    assert out["a"]["reason"] == "WITHIN_3_DAYS" and inside(out["a"]) == {31, 32, 33}
    assert out["b"]["reason"] == "NEAREST_SUPPORTED_RANGE" and inside(out["b"]) == {31, 32, 33}
    assert out["c"]["reason"] == "NO_ELIGIBLE_CONTEXT"


def test_piecewise_hazard_scoring(spark):
    edges = (0, 100, 200)
    hz = spark.createDataFrame([("p", 0, .4, 1.0), ("p", 1, .5, .6)], "pool string, k int, hazard double, survival_before double")
    donors = spark.createDataFrame([("p", float(d)) for d in (10, 20, 150, 190)], "pool string, duration_seconds double")
    law = S.piecewise_mass(hz, donors, ["pool"], edges).withColumn("labels", F.lit("[]"))
    m = {r["duration_seconds"]: round(r["mass"], 9) for r in law.collect()}
    assert m == {10.0: .2, 20.0: .2, 150.0: .15, 190.0: .15}
    who = spark.createDataFrame([("p", 15.0, 200.0)], "pool string, elapsed double, stop double")
    s = S.conditional_score(who, law, ["pool"], "elapsed", "stop").first()
    assert round(s["survival"], 9) == .8 and round(1 - s["remaining_event_mass"], 9) == .375


def test_draw_grid(spark):
    edges = (0, 100, 200)
    hz = spark.createDataFrame([("p", 0, .4, 1.0), ("p", 1, .5, .6)], "pool string, k int, hazard double, survival_before double")
    donors = spark.createDataFrame([("p", float(d)) for d in (10, 20, 150, 190)], "pool string, duration_seconds double")
    law = S.piecewise_mass(hz, donors, ["pool"], edges).withColumn("labels", F.lit("x"))
    who = spark.range(1000).select(F.lit("p").alias("pool"), ((F.col("id") + .5) / 1000).alias("u"), F.lit(0.0).alias("elapsed"), F.lit(300.0).alias("stop"))
    n = {r["pick_seconds"]: r["n"] for r in S.draw_next(who, law, ["pool"], "elapsed", "stop", "u").groupBy("pick_seconds").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n[None] == 300 and n[10.0] == 200


def test_opportunity_days(spark):
    s = spark.createDataFrame([("a", "2026-05-01 09:30:00", "2026-05-03 12:00:00")], "application_id string, a string, d string").select(
        "application_id", F.col("a").cast("timestamp_ntz").alias("activation"), F.col("d").cast("timestamp_ntz").alias("deadline"), F.lit(None).cast("timestamp_ntz").alias("terminal_datetime"))
    got = [str(r["opportunity"]) for r in L.active_days(s, "2026-05-01 00:00:00", "2026-06-01 00:00:00").orderBy("opportunity").collect()]
    assert got == ["2026-05-01 09:30:00", "2026-05-02 00:00:00", "2026-05-03 00:00:00"]


def test_state_sees_no_future_and_no_other_application(spark):
    ev = events(spark, [("a", "c", "2026-04-01 00:00:00", 0, "Application Created"), ("a", "c", "2026-04-02 00:00:00", 1, "Form filled"), ("a", "c", "2026-04-05 00:00:00", 2, "AIP Approved"),
                        ("b", "d", "2026-04-02 00:00:00", 3, "listing")])
    cut = spark.createDataFrame([("a", "2026-04-03 00:00:00")], "application_id string, t string").select("application_id", F.col("t").cast("timestamp_ntz").alias("cutoff"))
    r = L.state_at(ev, cut, SPEC).first()
    assert r["journey_substage"] == "Form filled" and not r["aip_approved_seen"] and r["form_filled_seen"]
    assert r["observed_journey_substages"] == ["Application Created", "Form filled"] and r["violation"] is None


def test_rows_after_terminal_are_reported(spark):
    ev = events(spark, [("a", "c", "2026-04-01 00:00:00", 0, "Application Created"), ("a", "c", "2026-04-02 00:00:00", 1, "Push to Partner"), ("a", "c", "2026-04-03 00:00:00", 2, "listing")])
    cut = spark.createDataFrame([("a", "2026-04-09 00:00:00")], "application_id string, t string").select("application_id", F.col("t").cast("timestamp_ntz").alias("cutoff"))
    assert L.state_at(ev, cut, SPEC).first()["violation"] == "ROWS_AFTER_TERMINAL"
    assert [r["key"] for r in K.after_terminal(ev, SPEC).collect()] == ["2"]


def registry(spark, rows):
    df = spark.createDataFrame(rows, "application_id string, context_id string, t string, source_row bigint").select(
        "application_id", "context_id", F.col("t").cast("timestamp_ntz").alias("application_created_at"), "source_row")
    return mark_parts(df, ["context_id"], C.micros("application_created_at"), 10**6).withColumn("deadline", C.plus_seconds("application_created_at", SPEC.validity_seconds))


def test_lifecycle_boundary(spark):
    reg = registry(spark, [("a", "c", "2026-04-01 00:00:00", 1)])
    pts = registry(spark, [("29", "c", "2026-04-30 00:00:00", 1), ("30", "c", "2026-05-01 00:00:00", 2)]).withColumn("at", F.col("application_created_at"))
    got = {r["application_id"]: r["active_application_id"] for r in L.active_at(pts, reg).collect()}
    assert got == {"29": "a", "30": None}
    assert L.overlap_counts(registry(spark, [("n", "c", "2026-05-01 00:00:00", 3)]), reg).count() == 0
    assert L.overlap_counts(registry(spark, [("n", "c", "2026-04-30 23:59:59", 3)]), reg).first()["overlaps"] == 1


def test_inclusive_and_half_open_deadline(spark):
    ev = events(spark, [("a", "c", "2026-05-01 00:00:00", 0, "Push to Partner")])
    r = ev.select(L.in_window().alias("h"), L.in_window(True).alias("i")).first()
    assert (r["h"], r["i"]) == (False, True)


def test_regime(spark):
    ev = events(spark, [("a", "c", "2026-04-02 00:00:00", 0, "Application Resume"), ("a", "c", "2026-04-03 00:00:00", 1, "listing"), ("a", "c", "2026-04-04 00:00:00", 2, "Application Resume")])
    got = [r["regime"] for r in E.packets(ev, SPEC).orderBy("event_datetime").collect()]
    assert got == ["FIRST_PASS", "UNCONDITIONED", "REVISIT"]


def test_competing_send_and_suppression(spark):
    ev = events(spark, [("a", "c", "2026-04-02 00:00:00", 0, "campaign_sent"), ("a", "c", "2026-04-02 01:00:00", 1, "campaign_sent"), ("a", "c", "2026-04-02 02:00:00", 2, "campaign_clicked")])
    got = {r["source_row"]: r["status"] for r in L.attribute_responses(ev, SPEC, 86400).collect()}
    assert got == {0: "CENSORED_BY_COMPETING_SEND", 1: "RESPONDED"}
    sends = ev.filter("source_row = 1").withColumn("scheduled_at", F.col("event_datetime"))
    ends = ev.sparkSession.createDataFrame([("a", "2026-04-02 00:30:00")], "application_id string, t string").select("application_id", F.col("t").cast("timestamp_ntz").alias("terminal_datetime"))
    got = L.suppress_sends(sends, ends).first()
    assert (got["status"], got["suppression_reason"]) == ("SUPPRESSED_BY_TERMINAL", "TERMINAL")


@pytest.mark.parametrize("d, lo, hi, m, want", [
    (0.0, -.5, .5, 1.0, "PASS"), (.5, .2, .8, 1.0, "LIMITATION"), (2.0, 1.5, 2.5, 1.0, "FAIL"), (-2.0, -2.5, -1.5, 1.0, "FAIL"), (.9, .5, 1.5, 1.0, "INCONCLUSIVE"),
    (.5, .6, .8, 1.0, "INVALID"), (0.0, -.5, .5, 0.0, "INVALID"), (float("nan"), -.5, .5, 1.0, "INVALID")])
def test_equivalence(spark, d, lo, hi, m, want):
    df = spark.createDataFrame([(d, lo, hi, m)], "d double, lo double, hi double, m double")
    assert df.select(C.equivalence("d", "lo", "hi", "m").alias("v")).first()["v"] == want


@pytest.mark.parametrize("d, lo, hi, m, want", [(.1, -.1, .3, None, "PASS"), (.2, .1, .3, None, "INCONCLUSIVE"), (.2, .1, .3, 1.0, "LIMITATION"), (2.0, 1.5, 2.5, 1.0, "FAIL")])
def test_inflation(spark, d, lo, hi, m, want):
    df = spark.createDataFrame([(d, lo, hi, m)], "d double, lo double, hi double, m double")
    assert df.select(C.inflation("d", "lo", "hi", "m").alias("v")).first()["v"] == want


def test_draw_value(spark):
    import hashlib
    want = int.from_bytes(hashlib.sha256(b"7|event-name|k").digest()[:8], "big") / 2**64
    assert spark.range(1).select(C.draw(7, "event-name", "k").alias("u")).first()["u"] == want


def test_bands_and_windows(spark):
    df = spark.createDataFrame([(7.0,), (7.1,), (29.5,)], "x double")
    assert [r[0] for r in df.select(C.bound_band("x", SPEC.age_bounds)).collect()] == [0, 1, 11]


def test_cycles_need_positive_time(spark):
    ev = events(spark, [("a", "c", "2026-04-02 00:00:00", 0, "listing"), ("a", "c", "2026-04-02 00:00:00", 1, "listing"), ("a", "c", "2026-04-02 00:00:01", 2, "listing")])
    got = [r["self_transition"] for r in E.cycles(ev, SPEC).orderBy("source_row").collect()]
    assert got == [False, False, True]


def test_unsupported_group_keeps_one_label(spark):
    ev = events(spark, [("a", "c", "2026-04-02 00:00:00", 0, "listing"), ("a", "c", "2026-04-02 00:00:00", 1, "Form filled"), ("b", "d", "2026-04-02 00:00:00", 2, "Form filled"), ("b", "d", "2026-04-02 00:00:00", 3, "Push to Partner")])
    got = {r["application_id"]: r["labels"] for r in E.packets(ev, SPEC).collect()}
    assert got == {"a": ["Form filled"], "b": ["Push to Partner"]}
    ok = spark.createDataFrame([("Form filled|listing",)], "pattern string")
    got = {r["application_id"]: r["labels"] for r in E.packets(ev, SPEC, ok).collect()}
    assert got["a"] == ["Form filled", "listing"]


def test_hot_keys_give_the_same_windows(spark):
    base = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"), F.col("id").alias("row"),
                                    (F.col("id") * 7919 % 100003).alias("at"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("v"))
    want = dict(s=Running("sum", F.col("v")), x=Running("max", F.col("v"), inclusive=False), z=Running("last", F.col("v"), inclusive=False), f=Running("first", F.col("v")),
                a=Shift(F.col("v")), b=Shift(F.col("v"), 3), c=Shift(F.col("row"), -1), d=Shift(F.col("row"), -2))
    for down in (False, True):
        res = []
        for limit in (10**6, 60):
            df = mark_parts(base, ["k"], F.col("at"), limit)
            res.append(sorted(map(str, scan(df, ["k"], ["at", "row"], descending=down, **want).select("row", *want).collect())))
        assert res[0] == res[1]


def test_ranked_and_quantiles(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") % 101).cast("double")).alias("v"), F.col("id").alias("t"))
    r = ranked(df, ["k"], "v", "t")
    assert r.groupBy("k").agg(F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).filter("d <> 500 or m <> 500").count() == 0
    assert r.alias("a").join(r.alias("b"), F.expr("a.k = b.k and a.rank = b.rank + 1")).filter("a.v < b.v").count() == 0
    q = {x["k"]: (x["p10"], x["p50"]) for x in quantiles(df, "v", {"p10": .1, "p50": .5}, ["k"]).collect()}
    w = {x["k"]: tuple(x["q"]) for x in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(.1), F.lit(.5))).alias("q")).collect()}
    assert q == w


def test_backoff_prefers_the_most_specific_level(spark):
    pools = spark.createDataFrame([("STATE", "a"), ("GLOBAL", "")], "model_level string, state string")
    rows = spark.createDataFrame([("a",), ("b",)], "state string")
    got = {r["state"]: (r["model_level"], r["pool_state"]) for r in G.backoff(rows, pools, {"STATE": ("state",), "GLOBAL": ()}).collect()}
    assert got == {"a": ("STATE", "a"), "b": ("GLOBAL", "")}


def test_largest_remainder_adds_up(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double")
    assert [r["allocated"] for r in M.largest_remainder(df, "w", 10, "k").orderBy("k").collect()] == [3, 3, 4]


def test_bootstrap_interval_holds_the_estimate(spark):
    df = spark.range(600).select((F.col("id") % 60).alias("app"), (F.col("id") % 4 == 0).cast("int").alias("hit"), F.lit(1).alias("one"))
    r = H.bootstrap_ratio(df, "app", "hit", "one", 200).first()
    assert r["low"] <= r["estimate"] == 0.25 <= r["high"]


def test_schema_check(spark):
    want = spark.createDataFrame([], EVENT_DDL).schema
    df = spark.createDataFrame([], EVENT_DDL)
    assert K.schema_violations(df, want, exact=True) == []
    assert K.schema_violations(df.drop("channel").withColumn("visitnum", F.lit("x")), want)[0] == "missing column channel"


def test_partition_count_does_not_matter(spark, tables):
    from waymark.plans import load_all
    fn = load_all()["m3_product_limit"][0]
    out = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(str, fn(tables).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]

"""Allocation, bootstraps and extensions against brute force."""

import collections

import pandas as pd
from pyspark.sql import functions as F

from waymark.functions import columns as C
from waymark.operators import extension as X
from waymark.operators import models as M
from waymark.operators import stats as H
from waymark.operators import survival as S


def test_calendar_allocation_keeps_population_and_clock(spark):
    sched = spark.range(997).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("application_id"),
                                    C.plus_seconds(C.ntz("2026-04-01 00:00:00"), 0).alias("t0"), (F.col("id") * 61).alias("s"))
    sched = sched.select("application_id", F.timestamp_micros(C.micros("t0") + F.col("s") * 1000000).cast("timestamp_ntz").alias("activation_datetime"))
    hist = spark.createDataFrame([(f"2026-04-{d:02d}", 10 + d % 7) for d in range(1, 29)], "day string, count int").select(F.col("day").cast("date").alias("day"), "count")
    got = M.allocate_calendar(hist, sched, "2026-05-01", "2026-05-31", 3).collect()
    assert len(got) == 997 and len({r["application_id"] for r in got}) == 997 and sorted(r["position"] for r in got) == list(range(997))
    assert all(r["application_created_at"].time() == r["activation_datetime"].time() and r["application_created_at"].date() == r["target_day"] for r in got)
    per_weekday = collections.Counter(r["target_day"].weekday() for r in got)
    means = collections.defaultdict(list)
    for d in range(1, 29):
        means[pd.Timestamp(2026, 4, d).weekday()].append(10 + d % 7)
    days = collections.Counter(pd.Timestamp(2026, 5, d).weekday() for d in range(1, 32))
    mass = {w: sum(v) / len(v) * days[w] for w, v in means.items()}
    assert all(abs(per_weekday[w] - 997 * mass[w] / sum(mass.values())) < 1 for w in mass)


def test_replicate_weights_are_poisson(spark):
    df = spark.range(20000).select(H.poisson_weight("id", F.lit(3), 1).alias("k"))
    n = {r["k"]: r["count"] / 20000 for r in df.groupBy("k").count().collect()}
    assert abs(n[0] - .3679) < .02 and abs(n[1] - .3679) < .02 and abs(n[2] - .1839) < .02


def test_survival_bootstrap_surrounds_the_curve(spark):
    rows = spark.range(300).select((F.col("id") % 100).alias("app"), (F.col("id") % 17 + 1).cast("double").alias("duration_seconds"), (F.col("id") % 3 > 0).alias("observed"))
    law = S.product_limit(rows.withColumns({"labels": F.lit("x"), "p": F.lit("p")}), ["p"])
    point = {r["threshold_seconds"]: r["cdf"] for r in S.cdf_at(law, ["p"], (5, 10), "raw_mass").collect()}
    pdf = rows.toPandas()
    s, brute = 1.0, {}
    for t in sorted(pdf.duration_seconds.unique()):
        s *= 1 - pdf[(pdf.duration_seconds == t) & pdf.observed].shape[0] / (pdf.duration_seconds >= t).sum()
        brute[t] = 1 - s
    assert abs(point[5] - brute[5.0]) < 1e-9 and abs(point[10] - brute[10.0]) < 1e-9
    for r in H.bootstrap_survival(rows, "app", (5, 10), 100).collect():
        assert r["low"] < point[r["threshold_seconds"]] < r["high"]


def test_paired_bootstrap_point_estimate(spark):
    make = lambda k: spark.range(210).select(F.col("id").alias("app"), (F.col("id") % 7).cast("int").alias("weekday"), (F.col("id") % 5 + k).alias("events"), (F.col("id") % 2 + 1).alias("eventful_days"))
    out = {r["metric"]: r for r in H.bootstrap_difference(make(1), make(2), "app", "weekday", 100).collect()}
    m = out["mean_sequence_length"]
    assert abs(m["difference"] - 1) < 1e-9 and m["low"] < 1 < m["high"] and m["status"] in ("FAIL", "INCONCLUSIVE")


def test_policy_column_and_mask(spark):
    df = spark.createDataFrame([(1, False, True), (2, True, True), (3, False, False)], "id int, terminal boolean, live boolean")
    send = F.struct(F.lit(True).alias("campaign_sent"), F.lit("sms").alias("channel_id"), F.lit(None).cast("string").alias("theme"), F.lit("morning").alias("time_bucket"))
    got = {r["id"]: (r["violation"], r["channel_id"]) for r in X.apply_policy(df, send, "terminal", "live").collect()}
    assert got == {1: (None, "SMS"), 2: ("TERMINAL", "SMS"), 3: ("SEND_AFTER_EXPIRY", "SMS")}


def test_encoder_merges_parts(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 100)).alias("part"))
    out = X.apply_encoder(df, ["k"], lambda s, p: [(s or [0])[0] + len(p)], lambda a, b: [a[0] + b[0]], list, 1, ["o"])
    assert {r["k"]: r["embedding"][0] for r in out.collect()} == {"0": 167.0, "1": 167.0, "2": 166.0}
    assert out.filter("violation is not null").count() == 0


def test_every_statement_has_a_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_thin_strata_are_refused(spark):
    import pytest
    make = lambda n: spark.range(n).select(F.col("id").alias("app"), (F.col("id") % 7).cast("int").alias("weekday"), (F.col("id") % 5).alias("events"), F.lit(1).alias("eventful_days"))
    assert H.bootstrap_difference(make(210), make(217), "app", "weekday", 5).count() == 2
    with pytest.raises(ValueError, match="stratum 2, 3, 4, 5, 6"):
        H.bootstrap_difference(make(212), make(205), "app", "weekday", 5)
    with pytest.raises(ValueError, match="stratum 6"):
        H.bootstrap_difference(make(209), make(217), "app", "weekday", 5)


def test_visible_rows_are_the_newest(spark):
    from waymark.operators import lookup, ordered
    events = spark.createDataFrame([("c", f"2024-01-0{1 + i % 3} 00:00:0{i % 10}", i, f"l{i}") for i in range(9)] + [("e", "2024-01-01 00:00:00", 99, "x")],
                                   "context_id string, t string, source_row long, journey_substage string").withColumn("event_datetime", F.col("t").cast("timestamp_ntz"))
    seen = spark.createDataFrame([("a", "c", "2024-01-02 12:00:00"), ("b", "c", "2023-01-01 00:00:00"), ("d", "none", "2024-01-09 00:00:00")], "application_id string, context_id string, t string").withColumn("now", F.col("t").cast("timestamp_ntz"))
    cold = lambda df: ordered.no_parts(df).withColumns({x: F.lit(None).cast("long") for x in ordered.GEOMETRY})
    got = lookup.visible_rows(cold(seen), cold(events), ["source_row", "journey_substage"], 4)
    assert [(r["application_id"], r["place"], r["source_row"]) for r in got.orderBy("application_id", "place").collect()] == [("a", 1, 7), ("a", 2, 4), ("a", 3, 1), ("a", 4, 6)]


def test_cycle_profile_counts_zeros(spark, tables):
    from waymark.operators import sequence as E
    from waymark.sources.adapters import STREAM_SPEC
    got = {r["kind"]: r for r in E.cycle_profile(tables.windowed(), tables.lifecycles(), STREAM_SPEC, {"median": .5, "p90": .9}).collect()}
    per = E.cycle_counts(tables.windowed(), tables.lifecycles(), STREAM_SPEC).toPandas()
    for kind in E.CYCLES:
        n = per[kind]
        assert (got[kind]["events"], got[kind]["applications"]) == (n.sum(), (n > 0).sum()) and abs(got[kind]["mean_per_app"] - n.mean()) < 1e-9
        assert abs(got[kind]["per_app_p90"] - n.quantile(.9)) < 1e-9 and abs(got[kind]["per_app_median"] - n.median()) < 1e-9


def test_draw_from_a_large_vocabulary(spark):
    """Against the plain cumulative list: many labels, a dominant one, labels of equal first bytes, unknown and NULL keys."""
    import random
    from waymark.operators import lookup
    rng = random.Random(3)
    model = [("big", f"name{i:05d}", 1 + (i % 7)) for i in range(900)] + [("big", "zz", 5000), ("one", "x", 3), ("two", "é", 1), ("two", "a", 1), ("none", "n", 0)]
    asks = [(i, rng.choice(["big", "one", "two", "gone", None, "none"]), rng.random()) for i in range(3000)] + [(5000 + i, "two", u) for i, u in enumerate((0.0, 0.5, 0.49999999, 0.999999999999))]
    got = lookup.categorical_draw(spark.createDataFrame(asks, "id int, k string, u double"), spark.createDataFrame(model, "k string, label string, support_count int"), ["k"], "label", "u")
    lists = collections.defaultdict(list)
    for k, label, n in sorted(model, key=lambda r: (r[0], r[1].encode())):
        lists[k].append((label, n))

    def pick(k, u):
        total, upto = sum(n for _, n in lists.get(k, ())), 0
        for label, n in lists.get(k, ()):
            upto += n
            if u * total < upto:
                return label
    assert sorted((r["id"], r["label"]) for r in got.collect()) == sorted((i, pick(k, u)) for i, k, u in asks)


def test_survival_bootstrap_is_that_of_its_replicates(spark, monkeypatch):
    """Every replicate against a plain product limit of its weighted rows; durations of many rows summed ahead too."""
    import random

    import numpy as np
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(25)}", rng.choice("ab"), float(rng.choice([1, 2, 3, 5, 5, 5, 8, 9])), rng.random() < .6) for _ in range(400)]
    df = spark.createDataFrame(rows, "app string, kind string, duration_seconds double, observed boolean")
    hashes = {r["app"]: r["h"] for r in df.select("app", F.xxhash64("app").alias("h")).distinct().collect()}
    reps = 40
    weight = {a: H.replicate_weights(np.array([h]).view(np.uint64), reps, 20260502)[0] for a, h in hashes.items()}
    want = {}
    for kind in "ab":
        curves = []
        for r in range(reps):
            s, cut = 1.0, {}
            for t in sorted({x[2] for x in rows}):
                own = [(weight[a][r], d, o) for a, k, d, o in rows if k == kind]
                risk, hit = sum(w for w, d, _ in own if d >= t), sum(w for w, d, o in own if d == t and o)
                s *= 1 - hit / risk if risk else 1
                cut[t] = 1 - s
            curves.append([max((v for t, v in cut.items() if t <= x), default=0.0) for x in (0, 2, 5, 100)])
        for i, x in enumerate((0, 2, 5, 100)):
            want[kind, x] = tuple(np.quantile([c[i] for c in curves], [.025, .975]))
    for crowd in (100_000, 5):
        monkeypatch.setattr(H, "CROWD", crowd)
        got = {(r["kind"], r["threshold_seconds"]): (r["low"], r["high"]) for r in H.bootstrap_survival(df, "app", (0, 2, 5, 100), reps, by=["kind"]).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_pair_timing(spark):
    seen = spark.createDataFrame([("a", "x", float(d)) for d in (1, 2, 3, 4)] + [("a", "y", 1.0)] + [("b", "x", 5.0)] * 4, "source string, destination string, duration_seconds double")
    law = spark.createDataFrame([("a", "x", 1.0, .2, 10), ("a", "x", 3.0, .1, 20), ("b", "x", 9.0, 1.0, 1)], "source string, destination string, duration_seconds double, mass double, denominator int")
    base = spark.createDataFrame([("a", 2.0, .5), ("a", 4.0, .5), ("", 5.0, 1.0)], "source string, duration_seconds double, mass double")
    got = {(r["source"], r["threshold_seconds"]): tuple(r)[2:3] + tuple(round(x, 9) for x in (r["observed_cdf"], r["law_cdf"], r["baseline_cdf"], r["law_error"], r["baseline_error"])) for r in S.pair_timing(seen, law, base, (2, 4), 3).collect()}
    assert got == {("a", 2): (4, .5, .5, .5, 0, 0), ("a", 4): (4, 1, 1, 1, 0, 0), ("b", 2): (4, 0, 0, 0, 0, 0), ("b", 4): (4, 0, 0, 0, 0, 0)}

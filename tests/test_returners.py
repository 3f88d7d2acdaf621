"""Donor sets, ranges at the arrival's own time, matching and its audit against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import returners as R

DAY = R.DAY_US
TARGETS = "target_id string, asked_us long, gap_us long, outcome boolean, depth long"
DONORS = "donor_id string, birth_us long, outcome boolean, depth long"


def population(seed, arrivals=60, donors=80, spread=200):
    rng = random.Random(seed)
    pool = [(f"d{i}", rng.randrange(spread) * DAY + rng.randrange(DAY), rng.random() < .6, rng.randrange(12)) for i in range(donors)]
    asks = [(f"t{i}", (spread + 10 + rng.randrange(40)) * DAY + rng.randrange(DAY), (30 + rng.randrange(spread)) * DAY + rng.randrange(DAY), rng.random() < .6, rng.randrange(12)) for i in range(arrivals)]
    return asks, pool


def plain_range(ask, free, minimum):
    """pool, reason, (low, high) of creation times."""
    _, at, gap, outcome, _ = ask
    able = [d for d in free if at - d[1] >= 30 * DAY]
    own = [d for d in able if d[2] == outcome]
    pool, name = (own, "O") if own else (able, "A")
    if not pool:
        return None, "NO_ELIGIBLE_CONTEXT", None
    if sum((at - d[1]) // DAY == gap // DAY for d in pool) >= minimum:
        return name, "EXACT_DAY", (at - (gap // DAY + 1) * DAY + 1, at - gap // DAY * DAY)
    if sum(abs(at - d[1] - gap) <= 3 * DAY for d in pool) >= minimum:
        return name, "WITHIN_3_DAYS", (at - gap - 3 * DAY, min(at - gap + 3 * DAY, at - 30 * DAY))
    radius = sorted(abs(at - d[1] - gap) for d in pool)[min(minimum, len(pool)) - 1]
    return name, "NEAREST_SUPPORTED_RANGE", (at - gap - radius, min(at - gap + radius, at - 30 * DAY))


@pytest.mark.parametrize("seed,minimum,spread", [(1, 30, 200), (2, 3, 40), (3, 1, 300), (4, 5, 8)])
def test_neighbourhood(spark, seed, minimum, spread):
    asks, pool = population(seed, spread=spread)
    pool += [("same", pool[0][1], pool[0][2], 1)]
    order = R.by_birth(spark.createDataFrame(pool, DONORS))
    got = {r["target_id"]: (r["pool"], r["reason"], r["born_lo"] and (r["born_lo"], r["born_hi"])) for r in R.neighbourhood(spark.createDataFrame(asks, TARGETS), order, minimum).collect()}
    assert got == {a[0]: plain_range(a, pool, minimum) for a in asks}


@pytest.mark.parametrize("seed,minimum,arrivals", [(5, 30, 60), (6, 4, 120)])
def test_matching_keeps_the_rules_of_its_round(spark, seed, minimum, arrivals):
    asks, pool = population(seed, arrivals=arrivals)
    got = R.match_histories(spark.createDataFrame(asks, TARGETS), spark.createDataFrame(pool, DONORS), minimum=minimum).collect()
    assert len(got) == len(asks)
    by_ask, by_donor, free = {a[0]: a for a in asks}, {d[0]: d for d in pool}, list(pool)
    used = [r["donor_id"] for r in got if r["donor_id"]]
    assert len(used) == len(set(used)) and len(used) > 10
    for turn in sorted({r["round"] for r in got if r["donor_id"]}):
        mine = [r for r in got if r["round"] == turn]
        for r in mine:
            ask, donor = by_ask[r["target_id"]], by_donor[r["donor_id"]]
            name, reason, (low, high) = plain_range(ask, free, minimum)
            inside = [d for d in free if low <= d[1] <= high]
            own = [d for d in inside if d[2] == ask[3]]
            quartet = [d for d in own if d[3] // 4 == ask[4] // 4]
            level, choice = ("QUARTET", quartet) if name == "O" and len(quartet) >= 10 else ("OUTCOME", own) if name == "O" else ("ALL", inside)
            assert (r["reason"], r["level"]) == (reason, level) and donor in choice
            assert abs(r["gap_days"] - (ask[1] - donor[1]) / DAY) < 1e-9
        free = [d for d in free if d[0] not in {r["donor_id"] for r in mine}]
    for r in got:  # who is left finds nobody old enough
        if not r["donor_id"]:
            assert r["reason"] == "NO_ELIGIBLE_CONTEXT" and plain_range(by_ask[r["target_id"]], free, minimum)[0] is None


def test_no_donors_and_no_targets(spark):
    asks, pool = population(7, 3, 3)
    t, d = spark.createDataFrame(asks, TARGETS), spark.createDataFrame(pool, DONORS)
    assert {r["reason"] for r in R.match_histories(t, d.limit(0)).collect()} == {"NO_ELIGIBLE_CONTEXT"}
    assert R.match_histories(t.limit(0), d).count() == 0


def test_audit_accepts_the_matching_and_finds_what_is_planted(spark):
    asks, pool = population(8)
    targets, donors = spark.createDataFrame(asks, TARGETS), spark.createDataFrame(pool, DONORS)
    got = R.match_histories(targets, donors).filter("donor_id is not null").select("target_id", "donor_id", "round")
    rows = targets.join(got, "target_id").join(donors.select("donor_id", "birth_us", F.col("outcome").alias("donor_outcome")), "donor_id")
    assert R.identity_audit(rows, donors).count() == 0
    far = (2000 * DAY, 1900 * DAY)
    bad = [("x1", far[0], far[1], True, 1, "d0", pool[0][1], pool[0][2], 0), ("x2", pool[1][1] + 5 * DAY, 40 * DAY, pool[1][2], 1, "d1", pool[1][1], pool[1][2], 0),
           ("x3", far[0], far[0] - pool[2][1], not pool[2][2], 1, "d2", pool[2][1], pool[2][2], 0), ("x4", far[0], far[0] - pool[0][1], pool[0][2], 1, "d0", pool[0][1], pool[0][2], 0),
           ("x5", far[0], far[0] - 50 * DAY, True, 1, "nobody", 50 * DAY, True, 0)]
    planted = spark.createDataFrame(bad, TARGETS + ", donor_id string, birth_us long, donor_outcome boolean, round int")
    found = {(r["rule"], r["key"]) for r in R.identity_audit(planted, donors).collect()}
    assert {("GAP_TOO_SHORT", "x2"), ("OUTCOME_MISMATCH", "x3"), ("CONTEXT_REUSED", "d0"), ("UNKNOWN_CONTEXT", "x5")} <= found
    assert ("OUTSIDE_SUPPORTED_RANGE", "x4") not in found and not {k for r, k in found if r == "GAP_TOO_SHORT"} - {"x2"}


def test_sparse_weekdays_use_the_pooled_set(spark):
    rows = [(f"a{i}", f"2024-01-{1 + i % 3:02d} 10:00:00", i % 2 == 0, (30 + i) * DAY, i % 4 == 0, i) for i in range(60)] + [("b", "2024-01-05 10:00:00", True, 99 * DAY, True, 7)]
    entrants = spark.createDataFrame(rows, "application_id string, t string, returning boolean, gap_us long, outcome boolean, depth long").withColumn("application_created_at", F.col("t").cast("timestamp_ntz"))
    rates, donors = R.donor_sets(entrants, 20)
    got = {r["weekday"]: (r["entrants"], r["donor_set"], round(r["rate"], 9)) for r in rates.collect()}
    assert got == {0: (20, 0, .5), 1: (20, 1, .5), 2: (20, 2, .5), **{d: (0, -1, round(31 / 61, 9)) for d in (3, 5, 6)}, 4: (1, -1, round(31 / 61, 9))}
    sets = {}
    for r in donors.collect():
        sets.setdefault(r["donor_set"], []).append((r["donor_index"], r["gap_us"] // DAY))
    assert sorted(sets) == [-1, 0, 1, 2] and all(sorted(i for i, _ in v) == list(range(len(v))) for v in sets.values())
    assert sorted(g for _, g in sets[-1]) == sorted([30 + i for i in range(0, 60, 2)] + [99])


def test_rounds_join_by_shuffle(spark):
    """What grows with the input is not sent through the driver in every round."""
    donors = spark.range(300).select(F.concat(F.lit("d"), F.col("id")).alias("donor_id"), (F.col("id") * R.DAY_US).alias("birth_us"), (F.col("id") % 2 == 0).alias("outcome"), (F.col("id") % 5).alias("depth"))
    targets = spark.range(20).select(F.concat(F.lit("t"), F.col("id")).alias("target_id"), ((F.col("id") + 400) * R.DAY_US).alias("asked_us"), (F.col("id") * 11 * R.DAY_US).alias("gap_us"), (F.col("id") % 3 == 0).alias("outcome"))
    ranged = R.neighbourhood(targets, R.by_birth(donors))
    assert ranged.count() == 20
    assert "BroadcastHashJoin" not in ranged._jdf.queryExecution().executedPlan().toString()

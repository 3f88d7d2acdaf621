"""Identities of returning customers: what an arrival asks of its history, drawn from donor sets of past returners, and
which historical customer that is still free answers it, at the gap the customer has when the arrival takes place."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw, flag, micros, weekday
from ..session import materialize
from .lookup import number_donors
from .ordered import PART, Running, asof, scan

DAY_US = 86400 * 10**6
#: Donors are ordered by creation and cut into slots of this length, so that no cell meets in one task.
SLOT_US = 3600 * 10**6
#: Donors of one depth quartet that make it a cell of its own.
QUARTET_MINIMUM = 10
POOLED = -1


# --- what arrivals ask ------------------------------------------------------------------------------------

def donor_sets(entrants: DataFrame, minimum: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rates, donors). rates: weekday 0 (Monday) to 6, entrants, donor_set, rate; a weekday of fewer entrants than the
    minimum uses the pooled set. donors: donor_set, donor_index (from 0, by hash order), gap_us, outcome, depth of each
    returner. entrants: application_id, application_created_at, returning, gap_us, outcome, depth (the last three of the
    customer's previous application)."""
    spark = entrants.sparkSession
    rows = materialize(entrants.select("application_id", weekday("application_created_at").alias("weekday"), "returning", "gap_us", "outcome", "depth"))
    day = rows.groupBy("weekday").agg(F.count(F.lit(1)).alias("entrants"), F.sum(flag(F.col("returning"))).alias("returners"))
    share = day.agg(F.sum("returners") / F.sum("entrants")).scalar()
    rates = spark.range(7).select(F.col("id").cast("int").alias("weekday")).join(day, "weekday", "left").na.fill(0, ["entrants", "returners"])
    enough = F.col("entrants") >= minimum
    rates = rates.select("weekday", "entrants", F.when(enough, F.col("weekday")).otherwise(POOLED).alias("donor_set"),
                         F.when(enough, F.col("returners") / F.col("entrants")).otherwise(F.coalesce(share, F.lit(0.0))).alias("rate"))
    rates = materialize(rates)
    past = rows.filter("returning").withColumn("donor_set", F.explode(F.array(F.col("weekday"), F.lit(POOLED)))).join(rates.select("donor_set").distinct(), "donor_set", "left_semi")
    return rates, number_donors(past, ["donor_set"], "application_id").select("donor_set", F.col("donor_index").cast("long").alias("donor_index"), "gap_us", "outcome", "depth")


def draw_targets(arrivals: DataFrame, entrants: DataFrame, seed: int = 7, minimum: int = 200) -> DataFrame:
    """target_id, asked_at, weekday, returning, gap_us, outcome, depth per arrival: whether it is of a returning customer,
    by the rate of its weekday, and then the gap, outcome and depth of one past returner of the same set. arrivals:
    application_id, activation_datetime."""
    rates, donors = donor_sets(entrants, minimum)
    donors = materialize(donors)
    sizes = donors.groupBy("donor_set").agg(F.count(F.lit(1)).alias("pool_size"))
    rows = arrivals.select(F.col("application_id").alias("target_id"), F.col("activation_datetime").alias("asked_at"), weekday("activation_datetime").alias("weekday"))
    rows = rows.join(rates.select("weekday", "donor_set", "rate").join(sizes, "donor_set", "left"), "weekday")
    rows = rows.withColumn("returning", F.coalesce((draw(seed, "kind", F.col("target_id")) < F.col("rate")) & (F.col("pool_size") > 0), F.lit(False)))
    rows = rows.withColumn("donor_index", F.when(F.col("returning"), F.floor(draw(seed, "prior", F.col("target_id")) * F.col("pool_size"))))
    return rows.join(donors, ["donor_set", "donor_index"], "left").select("target_id", "asked_at", "weekday", "returning", "gap_us", "outcome", "depth")


def free_histories(lifecycles: DataFrame, outcome: DataFrame, overlap_us: int) -> DataFrame:
    """donor_id (the context), prior_application_id, birth_us, outcome, depth: the last application of every context none of
    whose applications began within overlap_us of the one before. outcome: application_id, outcome, depth."""
    order = ["application_created_at", "source_row"]
    rows = scan(lifecycles, ["context_id"], order, __before=Running("last", F.col("application_created_at"), inclusive=False))
    close = F.coalesce(micros("application_created_at") - micros("__before") < overlap_us, F.lit(False))
    last = rows.groupBy("context_id").agg(F.max_by(F.struct("application_id", "application_created_at"), F.struct(*order)).alias("r"), F.max(flag(close)).alias("overlaps"))
    last = last.filter("overlaps = 0").select(F.col("context_id").alias("donor_id"), F.col("r.application_id").alias("prior_application_id"), micros("r.application_created_at").alias("birth_us"))
    return last.join(outcome.withColumnRenamed("application_id", "prior_application_id"), "prior_application_id").select(
        "donor_id", "prior_application_id", "birth_us", "outcome", "depth")


# --- gaps at the arrival's own time -------------------------------------------------------------------------

def by_shuffle(df: DataFrame) -> DataFrame:
    """A side that grows with the input and is joined in every round: never sent to the driver and from there to all tasks."""
    return df.hint("merge")


def _cell(*parts):
    return F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def everyone():
    return F.lit("A")


def of_outcome():
    return _cell("O", F.col("outcome"))


def of_quartet():
    return _cell("Q", F.col("outcome"), F.floor(F.col("depth") / 4))


def by_birth(donors: DataFrame) -> DataFrame:
    """cell, birth_us, donor_id, pos: every donor in the cells of all, of its outcome and of its depth quartet, numbered
    (from 1) by creation. Slots of an hour are numbered each by itself and carried on."""
    rows = donors.select("donor_id", "birth_us", F.explode(F.array(everyone(), of_outcome(), of_quartet())).alias("cell"))
    rows = rows.withColumn(PART, F.floor(F.col("birth_us") / SLOT_US))
    return materialize(scan(rows, ["cell"], ["birth_us", "donor_id"], pos=Running("sum", F.lit(1))).drop(PART))


def born_by(points: DataFrame, order: DataFrame) -> DataFrame:
    """points (cell, p, ...) with n: donors of the cell born at p or before, read off their numbers in one merge."""
    steps = order.groupBy("cell", "birth_us").agg(F.max("pos").alias("n")).withColumn(PART, F.floor(F.col("birth_us") / SLOT_US))
    read = asof(points.withColumn(PART, F.floor(F.col("p") / SLOT_US)), steps, ["cell"], F.col("p"), F.col("birth_us"), {"n": F.col("n")})
    return read.drop(PART).withColumn("n", F.coalesce("n", F.lit(0)))


def neighbourhood(targets: DataFrame, order: DataFrame, minimum: int = 30, least_us: int = 30 * DAY_US) -> DataFrame:
    """targets (target_id, asked_us, gap_us, outcome, ...) with pool (O: donors of the outcome, A: all, where none of the
    outcome is eligible), reason, born_lo and born_hi: the range of creation times whose donors fit.

    Eligible is who was created least_us before the arrival or earlier. EXACT_DAY: the gap in whole days is that of the
    target, by `minimum` donors or more; else WITHIN_3_DAYS; else as far as the minimum-th nearest. All are counts of
    donors born up to a time, so no pair of target and donor is formed but the 2 * minimum numbers around a target that
    must look outward."""
    at, g = F.col("asked_us"), F.col("gap_us")
    day = F.floor(g / DAY_US) * DAY_US
    cap = at - least_us
    marks = {"cap": cap, "day_lo": at - day - DAY_US, "day_hi": F.least(at - day, cap), "near_lo": at - g - 3 * DAY_US - 1, "near_hi": F.least(at - g + 3 * DAY_US, cap),
             "below": at - g - 1}
    marked = F.inline(F.array(*[F.struct(F.lit(k).alias("mark"), x.cast("long").alias("p")) for k, x in marks.items()]))
    points = targets.select("target_id", F.array(everyone(), of_outcome()).alias("cells"), marked)
    points = points.select("target_id", "mark", "p", F.explode("cells").alias("cell"))
    read = born_by(points, order).groupBy("target_id", "cell").agg(*[F.max(F.when(F.col("mark") == k, F.col("n"))).alias(k) for k in marks])
    own = F.substring("cell", 1, 1)
    best = read.filter("cap > 0").groupBy("target_id").agg(F.max_by(F.struct("cell", *marks), own).alias("b")).select("target_id", "b.*")  # O before A
    rows = materialize(targets.join(by_shuffle(best.withColumnsRenamed({k: f"n_{k}" for k in marks})), "target_id", "left"))
    exact, near = F.col("n_day_hi") - F.col("n_day_lo") >= minimum, F.col("n_near_hi") - F.col("n_near_lo") >= minimum
    radius = nearest(rows.filter(F.col("cell").isNotNull() & ~exact & ~near).select("target_id", "cell", "asked_us", "gap_us", F.col("n_cap").alias("cap"), F.col("n_below").alias("below")), order, minimum)
    rows = rows.join(by_shuffle(radius), "target_id", "left")
    reason = F.when(F.col("cell").isNull(), "NO_ELIGIBLE_CONTEXT").when(exact, "EXACT_DAY").when(near, "WITHIN_3_DAYS").otherwise("NEAREST_SUPPORTED_RANGE")
    lo = F.when(reason == "EXACT_DAY", at - day - DAY_US + 1).when(reason == "WITHIN_3_DAYS", at - g - 3 * DAY_US).otherwise(at - g - F.col("radius"))
    hi = F.when(reason == "EXACT_DAY", at - day).when(reason == "WITHIN_3_DAYS", at - g + 3 * DAY_US).otherwise(at - g + F.col("radius"))
    return rows.select(*targets.columns, F.substring("cell", 1, 1).alias("pool"), reason.alias("reason"), lo.cast("long").alias("born_lo"), F.least(hi, cap).cast("long").alias("born_hi"))


def nearest(rows: DataFrame, order: DataFrame, minimum: int) -> DataFrame:
    """target_id, radius: distance of the minimum-th nearest (the last, if fewer) of the first `cap` donors of rows' cell from
    the asked birth, before which lie `below` of them. It is among the `minimum` numbers to either side."""
    want = rows.select("target_id", "cell", (F.col("asked_us") - F.col("gap_us")).alias("x"), F.least(F.lit(minimum), "cap").alias("k"), F.explode(F.sequence(
        F.greatest(F.lit(1), F.col("below") - minimum + 1), F.least(F.col("cap"), F.col("below") + minimum))).alias("pos"))
    found = want.join(by_shuffle(order.select("cell", "pos", "birth_us")), ["cell", "pos"]).groupBy("target_id", "k").agg(F.sort_array(F.collect_list(F.abs(F.col("birth_us") - F.col("x")))).alias("d"))
    return found.select("target_id", F.element_at("d", F.col("k").cast("int")).alias("radius"))


def match_histories(targets: DataFrame, donors: DataFrame, seed: int = 7, minimum: int = 30, least_us: int = 30 * DAY_US) -> DataFrame:
    """target_id, round, reason, level, donor_id, gap_days per target: one free history each, no history twice.

    targets: target_id, asked_us, gap_us, outcome, depth; donors: donor_id, birth_us, outcome, depth. Inside its range
    (`neighbourhood`) a target picks among histories of its outcome and depth quartet if there are ten or more (QUARTET),
    else of its outcome (OUTCOME), else of any (ALL).

    A sequential pass cannot be spread, so targets pick in rounds: each by hash position among the histories still free,
    a history goes to the earliest asker (by time, then id), the others pick again among what is left, with ranges
    measured anew. Every round with a pick has a winner, so it ends; a target stays without a history only if none that
    is old enough is free any more (NO_ELIGIBLE_CONTEXT)."""
    open_ = materialize(targets.select("target_id", "asked_us", "gap_us", "outcome", "depth"))
    free, won = materialize(donors.select("donor_id", "birth_us", "outcome", "depth")), None
    for turn in count():
        order = by_birth(free)
        ranged = materialize(neighbourhood(open_, order, minimum, least_us).filter(F.col("pool").isNotNull()))
        cells = F.when(F.col("pool") == "O", F.array(F.struct(F.lit(2).alias("fine"), of_quartet().alias("cell")), F.struct(F.lit(1).alias("fine"), of_outcome().alias("cell")))).otherwise(
            F.array(F.struct(F.lit(0).alias("fine"), everyone().alias("cell"))))
        spans = ranged.select("target_id", "born_lo", "born_hi", F.inline(cells))
        ends = spans.select("target_id", "fine", "cell", F.inline(F.array(F.struct(F.lit("lo").alias("mark"), (F.col("born_lo") - 1).alias("p")), F.struct(F.lit("hi").alias("mark"), F.col("born_hi").alias("p")))))
        read = born_by(ends, order).groupBy("target_id", "fine", "cell").agg(*[F.max(F.when(F.col("mark") == m, F.col("n"))).alias(m) for m in ("lo", "hi")])
        held = F.col("hi") - F.col("lo")
        best = read.filter((held >= QUARTET_MINIMUM) | (F.col("fine") < 2) & (held > 0)).groupBy("target_id").agg(F.max(F.struct("fine", "cell", "lo", "hi")).alias("b")).select("target_id", "b.*")
        picks = ranged.join(by_shuffle(best), "target_id").withColumn("pos", F.col("lo") + 1 + F.floor(draw(seed, turn, F.col("target_id")) * (F.col("hi") - F.col("lo"))).cast("long"))
        picks = picks.join(by_shuffle(order.select("cell", "pos", "donor_id", "birth_us")), ["cell", "pos"])
        level = F.element_at(F.array(F.lit("ALL"), F.lit("OUTCOME"), F.lit("QUARTET")), F.col("fine") + 1)
        got = picks.groupBy("donor_id").agg(F.min(F.struct("asked_us", "target_id", "reason", level.alias("level"), "birth_us")).alias("w"))
        got = materialize(got.select("w.target_id", F.lit(turn).alias("round"), "w.reason", "w.level", "donor_id", ((F.col("w.asked_us") - F.col("w.birth_us")) / DAY_US).alias("gap_days")))
        if got.isEmpty():
            break
        won = got if won is None else won.unionByName(got)
        # who had no eligible history will not have one later: what is free only shrinks
        open_ = materialize(ranged.join(by_shuffle(got.select("target_id")), "target_id", "left_anti").select(open_.columns))
        free = materialize(free.join(by_shuffle(got.select("donor_id")), "donor_id", "left_anti"))
    none = F.lit("NO_ELIGIBLE_CONTEXT")
    if won is None:
        return targets.select("target_id", F.lit(None).cast("int").alias("round"), none.alias("reason"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("donor_id"),
                              F.lit(None).cast("double").alias("gap_days"))
    return targets.select("target_id").join(by_shuffle(won), "target_id", "left").withColumn("reason", F.coalesce("reason", none))


# --- audit ----------------------------------------------------------------------------------------------------

def identity_audit(assigned: DataFrame, donors: DataFrame, minimum: int = 30, least_us: int = 30 * DAY_US) -> DataFrame:
    """rule, key: assignments that their risk set does not support. assigned: target_id, asked_us, gap_us, outcome, depth (what
    was asked), donor_id, birth_us, donor_outcome, round (0 where all were made at once). The risk set of a round are the
    donors that no earlier round took; the supported radius is 3 days or the distance of the minimum-th nearest eligible
    donor of the pool, whichever is more.

    UNKNOWN_CONTEXT, GAP_TOO_SHORT, OUTSIDE_SUPPORTED_RANGE, OUTCOME_MISMATCH (a donor of the asked outcome was eligible)
    by target; CONTEXT_REUSED by donor."""
    assigned, donors = materialize(assigned), materialize(donors)
    rows = assigned.join(by_shuffle(donors.select("donor_id", F.lit(True).alias("known"))), "donor_id", "left")
    rounds = [r["round"] for r in assigned.select("round").distinct().orderBy("round").collect()]
    free, wide = donors, None
    for turn in rounds:
        mine = assigned.filter(F.col("round") == turn)
        order = by_birth(free)
        near = outward(mine.select("target_id", "asked_us", "gap_us", "outcome"), order, minimum, least_us)
        wide = near if wide is None else wide.unionByName(near)
        free = materialize(free.join(by_shuffle(mine.select("donor_id")), "donor_id", "left_anti"))
    rule = lambda df, name, key="target_id": df.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))
    if wide is None:
        return rule(assigned.limit(0), "UNKNOWN_CONTEXT")
    rows = materialize(rows.join(by_shuffle(wide), "target_id", "left"))
    gap = F.col("asked_us") - F.col("birth_us")
    out = rule(rows.filter("known is null"), "UNKNOWN_CONTEXT").unionByName(rule(rows.filter(gap < least_us), "GAP_TOO_SHORT"))
    out = out.unionByName(rule(rows.filter(F.abs(gap - F.col("gap_us")) > F.greatest(F.lit(3 * DAY_US), F.coalesce("radius", F.lit(0)))), "OUTSIDE_SUPPORTED_RANGE"))
    out = out.unionByName(rule(rows.filter((F.col("pool") == "O") & (F.col("donor_outcome") != F.col("outcome"))), "OUTCOME_MISMATCH"))
    again = assigned.groupBy("donor_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out.unionByName(rule(again, "CONTEXT_REUSED", "donor_id"))


def outward(targets: DataFrame, order: DataFrame, minimum: int, least_us: int) -> DataFrame:
    """target_id, pool, radius: distance in microseconds of the minimum-th nearest eligible donor (the last, if fewer)."""
    at, g = F.col("asked_us"), F.col("gap_us")
    marks = F.array(F.struct(F.lit("cap").alias("mark"), (at - least_us).cast("long").alias("p")), F.struct(F.lit("below").alias("mark"), F.least(at - g - 1, at - least_us).cast("long").alias("p")))
    points = targets.select("target_id", F.array(everyone(), of_outcome()).alias("cells"), F.inline(marks)).select("target_id", "mark", "p", F.explode("cells").alias("cell"))
    read = born_by(points, order).groupBy("target_id", "cell").agg(*[F.max(F.when(F.col("mark") == m, F.col("n"))).alias(m) for m in ("cap", "below")])
    best = read.filter("cap > 0").groupBy("target_id").agg(F.max_by(F.struct("cell", "cap", "below"), F.substring("cell", 1, 1)).alias("b")).select("target_id", "b.*")
    rows = targets.join(by_shuffle(best), "target_id")
    return rows.select("target_id", F.substring("cell", 1, 1).alias("pool")).join(by_shuffle(nearest(rows, order, minimum)), "target_id")

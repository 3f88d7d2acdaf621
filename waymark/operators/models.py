"""Fitted empirical tables: propensities, motifs, transitions, intensities, allocation, matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (age_bucket, among, draw, flag, micros, motif_send_bucket, ntz, plus_seconds, prior_send_bucket, regime,
                                 seconds_between, send_gap_bucket, weekday)
from ..session import materialize
from ..spec import LifecycleSpec
from .lifecycle import APP, TIMELINE, active_days, attribute_responses, customer_kind, first_terminals, is_label
from .ordered import Running, Shift, asof, quantiles, ranked, repart, scan, value_part
from .survival import explode_levels, piecewise_hazard


def _share(counts: DataFrame, by: Sequence[str], n: str) -> Column:
    return F.col(n) / F.sum(n).over(Window.partitionBy(*by))


def conditional_distribution(df: DataFrame, levels: dict[str, Sequence[str]], target: Sequence[str],
                             extra: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of `target` per level key. Rows are counted at the finest key before the
    levels are formed, so the copies per level are copies of counts."""
    fields = list(dict.fromkeys(k for keys in levels.values() for k in keys))
    fine = df.na.fill("", fields).groupBy(*fields, *target, *extra).agg(F.count(F.lit(1)).alias("n"))
    by = ["model_level", *fields]
    out = explode_levels(fine, levels, fields).groupBy(*by, *target, *extra).agg(F.sum("n").alias("support_count"))
    return out.withColumns({"denominator": F.sum("support_count").over(Window.partitionBy(*by)),
                            "probability": _share(out, by, "support_count")})


def decision_buckets(events: DataFrame) -> DataFrame:
    """Age, prior sends and gap since the last send, as known just before each row."""
    sent = is_label("campaign_sent")
    rows = scan(events, APP, TIMELINE, prior_sends=Running("sum", flag(sent), inclusive=False),
                last_send=Running("max", F.when(sent, F.col("event_datetime")), inclusive=False))
    return rows.withColumns({
        "age_bucket": age_bucket(seconds_between("application_created_at", "event_datetime") / 86400),
        "prior_send_bucket": prior_send_bucket("prior_sends"),
        "recent_send_gap_bucket": send_gap_bucket(seconds_between("last_send", "event_datetime"))})


def opportunity_rows(events: DataFrame, lifecycles: DataFrame, spec: LifecycleSpec, start: str, end: str) -> DataFrame:
    """One row per active application-day with the state visible at its opportunity and `sent`."""
    states = lifecycles.join(first_terminals(events, spec), "application_id", "left").withColumn(
        "activation", F.col("application_created_at"))
    days = active_days(states, start, end)
    sent, journey = is_label("campaign_sent"), ~among("journey_substage", spec.campaign)
    rows = events.filter(F.col("application_id").isNotNull())
    rows = scan(rows, APP, TIMELINE, sends=Running("sum", flag(sent)),
                last_send=Running("max", F.when(sent, F.col("event_datetime"))),
                current_state=Running("last", F.when(journey, F.col("journey_substage"))))
    days = asof(repart(days, micros("opportunity")), rows, APP, micros("opportunity"), micros("event_datetime"),
                {x: F.col(x) for x in ("sends", "last_send", "current_state")}, tie=F.col("source_row"))
    sends = (events.filter(sent & F.col("application_id").isNotNull())
             .groupBy("application_id", F.to_date("event_datetime").alias("day")).agg(F.count(F.lit(1)).alias("day_sends")))
    days = days.join(sends, ["application_id", "day"], "left").na.fill(0, ["day_sends"])
    return days.withColumns({
        "current_state": F.coalesce("current_state", F.lit("")), "sent": F.col("day_sends") > 0,
        "age_bucket": age_bucket(seconds_between("application_created_at", "opportunity") / 86400),
        "prior_send_bucket": prior_send_bucket(F.coalesce("sends", F.lit(0))),
        "recent_send_gap_bucket": send_gap_bucket(seconds_between("last_send", "opportunity"))})


def send_propensity(opportunities: DataFrame, levels: dict[str, Sequence[str]], split: str,
                    supports: tuple[int, int, int] = (500, 100, 50), drift: float = 0.1) -> DataFrame:
    """Send probability per level; a cell needs total and per-half support and a small drift."""
    fields = list(dict.fromkeys(k for keys in levels.values() for k in keys))
    early = F.col("opportunity") < ntz(split)
    fine = opportunities.groupBy(*fields).agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(F.col("sent"))).alias("s"),
        F.sum(flag(early)).alias("n1"), F.sum(flag(early & F.col("sent"))).alias("s1"))
    by = ["model_level", *fields]
    cells = explode_levels(fine, levels, fields).groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("n", "s", "n1", "s1")])
    r1, r2 = F.col("s1") / F.col("n1"), (F.col("s") - F.col("s1")) / (F.col("n") - F.col("n1"))
    whole = F.col("model_level") == "GLOBAL"
    ok = ((F.col("n") >= supports[0]) & (F.col("n1") >= supports[1]) & (F.col("n") - F.col("n1") >= supports[2]))
    cells = cells.filter(ok | whole).filter(whole | (F.abs(r1 - r2) <= drift))
    return cells.select(*by, F.col("n").alias("support_count"), (F.col("s") / F.col("n")).alias("send_probability"))


def motifs(events: DataFrame, spec: LifecycleSpec, horizon_seconds: int, source_end: str) -> DataFrame:
    """Engagement sequence and next journey step of each send, up to the next send or the horizon."""
    rows = events.filter(F.col("application_id").isNotNull())
    sent = is_label("campaign_sent")
    rows = scan(rows, APP, TIMELINE,
                send_at=Running("last", F.when(sent, F.struct("source_row", F.col("event_datetime").alias("at"))), inclusive=False),
                sends=Running("sum", flag(sent), inclusive=False),
                pre_state=Running("last", F.when(~among("journey_substage", spec.campaign), F.col("journey_substage")), inclusive=False),
                pre_stage=Running("last", F.when(~among("journey_substage", spec.campaign), F.col("journey_stage")), inclusive=False))
    delay = seconds_between("send_at.at", "event_datetime")
    hits = rows.filter(~sent & F.col("send_at").isNotNull() & (delay <= horizon_seconds)).withColumn("delay", delay)
    stamp = F.struct("event_datetime", "source_row", "delay")
    first = lambda label: F.min(F.when(is_label(label), stamp))
    journey = ~among("journey_substage", spec.campaign)
    got = hits.groupBy("application_id", F.col("send_at.source_row").alias("source_row")).agg(
        first("campaign_open_read").alias("o"), first("campaign_clicked").alias("c"),
        F.min(F.when(journey, F.struct("event_datetime", "source_row", "delay", "journey_substage"))).alias("j"))
    sends = scan(rows.filter(sent), APP, TIMELINE, next_send=Shift(F.col("event_datetime"), -1))
    m = sends.join(got, ["application_id", "source_row"], "left")
    engaged = F.array_compact(F.array(F.when(F.col("o").isNotNull(), F.struct(F.col("o.event_datetime").alias("t"), F.col("o.source_row").alias("r"), F.lit("campaign_open_read").alias("l"))),
                                      F.when(F.col("c").isNotNull(), F.struct(F.col("c.event_datetime").alias("t"), F.col("c.source_row").alias("r"), F.lit("campaign_clicked").alias("l")))))
    seq = F.array_join(F.transform(F.sort_array(engaged), lambda x: x["l"]), ">")
    nothing = F.col("o").isNull() & F.col("c").isNull() & F.col("j").isNull()
    rival = F.coalesce(seconds_between("event_datetime", "next_send") <= horizon_seconds, F.lit(False))
    late = micros("event_datetime") + horizon_seconds * 10**6 > micros(ntz(source_end))
    live = (F.col("event_datetime") >= F.col("application_created_at")) & (F.col("event_datetime") < F.col("deadline"))
    return m.select(
        "application_id", "source_row", "event_datetime", "channel", "time_bucket",
        F.coalesce("pre_state", F.lit("")).alias("current_journey_substage"), F.coalesce("pre_stage", F.lit("")).alias("current_journey_stage"),
        motif_send_bucket("sends").alias("prior_send_bucket"),
        F.when(F.length(seq) > 0, seq).otherwise("NO_ENGAGEMENT").alias("engagement_sequence"),
        F.coalesce("j.journey_substage", F.lit("NO_JOURNEY_RESPONSE")).alias("next_journey_substage"),
        F.col("o.delay").alias("open_delay_seconds"), F.col("c.delay").alias("click_delay_seconds"), F.col("j.delay").alias("journey_delay_seconds"),
        F.when(~live, "SEND_OUTSIDE_LIVE_LIFECYCLE").when(nothing & rival, "NO_RESPONSE_BEFORE_COMPETING_SEND")
        .when(nothing & late, "RIGHT_CENSORED_AT_SOURCE_END").otherwise("RETAINED_MOTIF").alias("status"))


def motif_model(m: DataFrame, levels: dict[str, Sequence[str]], support: int = 1) -> DataFrame:
    kept = m.filter("status = 'RETAINED_MOTIF'")
    return conditional_distribution(kept, levels, ["engagement_sequence", "next_journey_substage"]).filter(
        F.col("denominator") >= support)


def action_propensity(sends: DataFrame, split: str, supports: tuple[int, int] = (100, 50), tv_limit: float = 0.25) -> DataFrame:
    """Channel and time of sends by state, stage and overall, with the distance between halves."""
    levels = {"STATE": ("current_journey_substage",), "STAGE": ("current_journey_stage",), "GLOBAL": ()}
    fields = ["current_journey_substage", "current_journey_stage"]
    early = F.col("event_datetime") < ntz(split)
    fine = sends.groupBy(*fields, "channel", "time_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(early)).alias("n1"))
    by = ["model_level", *fields]
    cells = explode_levels(fine, levels, fields).groupBy(*by, "channel", "time_bucket").agg(F.sum("n").alias("count"), F.sum("n1").alias("c1"))
    w = Window.partitionBy(*by)
    cells = cells.withColumns({"denominator": F.sum("count").over(w), "first_half": F.sum("c1").over(w)})
    cells = cells.withColumn("second_half", F.col("denominator") - F.col("first_half"))
    cells = cells.withColumn("half_tv", 0.5 * F.sum(F.abs(
        F.col("c1") / F.greatest("first_half", F.lit(1)) - (F.col("count") - F.col("c1")) / F.greatest("second_half", F.lit(1)))).over(w))
    ok = (F.col("first_half") >= supports[0]) & (F.col("second_half") >= supports[1]) & (F.round("half_tv", 9) <= tv_limit)
    return cells.filter(ok | (F.col("model_level") == "GLOBAL")).withColumn("probability", F.col("count") / F.col("denominator")).drop("c1")


def event_intensity(events: DataFrame, spec: LifecycleSpec) -> tuple[DataFrame, DataFrame]:
    """(chance of no later event by label and day ordinal, pool of gaps in microseconds)."""
    from .sequence import day_ordinal
    rows = scan(events, APP, TIMELINE, next_at=Shift(F.col("event_datetime"), -1))
    rows = day_ordinal(rows.filter(~is_label(spec.terminal)))
    nxt = F.col("next_at").isNotNull()
    same = nxt & (F.to_date("next_at") == F.to_date("event_datetime"))
    fine = rows.groupBy("journey_substage", "count_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(nxt)).alias("nx"), F.sum(flag(same)).alias("sd"))
    levels = {"STATE_COUNT": ("journey_substage", "count_bucket"), "STATE": ("journey_substage",), "GLOBAL": ()}
    fields = ["journey_substage", "count_bucket"]
    blank = lambda f: F.lit("") if f == "journey_substage" else F.lit(-1).cast("long")
    fine = fine.withColumn("count_bucket", F.col("count_bucket").cast("long"))
    model = explode_levels(fine, levels, fields, blank).groupBy("model_level", *fields).agg(
        *[F.sum(x).alias(x) for x in ("n", "nx", "sd")])
    model = model.select("model_level", *fields, F.col("n").alias("support_count"),
                         (1 - F.col("nx") / F.col("n")).alias("p_no_later_observed_event"),
                         F.when(F.col("nx") > 0, F.col("sd") / F.col("nx")).alias("p_same_day_given_next"))
    pool = rows.filter(nxt).select("application_id", "source_row", "journey_substage", F.col("count_bucket").cast("long").alias("count_bucket"),
                                   (micros("next_at") - micros("event_datetime")).alias("gap_microseconds"), *(["part"] if "part" in rows.columns else []))
    return model, pool


def regime_transitions(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Next label by state and regime with delay quantiles; successors at the same time are left out
    and the terminal is not a response."""
    rows = scan(events, APP, TIMELINE,
                __down=Running("max", flag(among("journey_substage", spec.downstream)), inclusive=False),
                next_at=Shift(F.col("event_datetime"), -1), response=Shift(F.col("journey_substage"), -1))
    rows = rows.filter((F.col("next_at") > F.col("event_datetime")) & (F.col("response") != spec.terminal)
                       & (F.col("journey_substage") != spec.terminal))
    rows = rows.select("application_id", F.col("journey_substage").alias("state"),
                       regime("journey_substage", F.coalesce(F.col("__down") > 0, F.lit(False)), spec).alias("regime"),
                       "response", seconds_between("event_datetime", "next_at").alias("delay"))
    by = ["state", "regime", "response"]
    n = (rows.groupBy(*by, "application_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*by)
         .agg(F.sum("n").alias("support_count"), F.count(F.lit(1)).alias("unique_applications")))
    n = n.withColumn("outgoing_transition_count", F.sum("support_count").over(Window.partitionBy("state", "regime")))
    n = n.withColumn("probability", F.col("support_count") / F.col("outgoing_transition_count"))
    q = quantiles(rows, "delay", {"median_seconds": .5, "p90_seconds": .9, "p95_seconds": .95, "p99_seconds": .99}, by)
    return n.join(q, by)


def continuation_hazard(episodes: DataFrame, spec: LifecycleSpec, supports: tuple[int, int], edges) -> DataFrame:
    """Piecewise hazard of the next non-terminal packet per state, stage and overall."""
    rows = episodes.select("state", "journey_stage", "duration_seconds",
                           (F.col("observed") & (F.col("next_state") != spec.terminal)).alias("observed"))
    levels = {"STATE": ("state",), "STAGE": ("journey_stage",), "GLOBAL": ()}
    fields = ["state", "journey_stage"]
    by = ["model_level", *fields]
    table = piecewise_hazard(explode_levels(rows, levels, fields), by, edges)
    first = table.filter("k = 0").select(*by, F.col("risk_set").alias("__n"))
    least = F.when(F.col("model_level") == "STATE", supports[0]).when(F.col("model_level") == "STAGE", supports[1]).otherwise(0)
    return table.join(first.filter(F.col("__n") >= least).drop("__n"), by, "left_semi")


# --- allocation -------------------------------------------------------------------------------------

def largest_remainder(df: DataFrame, weight: str, total: Column | int, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Integer `allocated` per row in proportion to `weight`, adding up to `total` per group.
    Left-over units go to the largest fractional parts (then the larger key), ranked in slots."""
    by = list(by)
    total = total if isinstance(total, Column) else F.lit(total)
    sums = df.groupBy(*by).agg(F.sum(weight).alias("__w"))
    if by:
        rows = df.join(sums, by)
    else:
        rows = df.withColumn("__w", sums.scalar())
    rows = rows.withColumn("__raw", F.round(F.col(weight) / F.col("__w") * total, 9))
    rows = rows.withColumns({"__floor": F.floor("__raw").cast("long")})
    rows = rows.withColumn("__frac", F.round(F.col("__raw") - F.col("__floor"), 9)).withColumn("__total", total.cast("long"))
    base = rows.groupBy(*by).agg((F.max("__total") - F.sum("__floor")).alias("__left"))
    rows = rows.join(base, by) if by else rows.withColumn("__left", base.scalar())
    rows = rows.withColumn("part", F.floor(F.col("__frac") * 4096))
    rows = scan(rows, by, ["__frac", key], descending=True, __rank=Running("sum", F.lit(1)))
    return rows.withColumn("allocated", F.col("__floor") + flag(F.col("__rank") <= F.col("__left"))).drop(
        "__w", "__raw", "__floor", "__frac", "__total", "__left", "__rank", "part")


def global_rank(df: DataFrame, key: Column, name: str = "position", slots: int = 4096) -> DataFrame:
    """Zero-based position of every row in the order of a hash of `key`, ranked slot by slot."""
    rows = df.withColumn("__h", F.sha2(key.cast("string"), 256))
    rows = rows.withColumn("part", F.conv(F.substring("__h", 1, 3), 16, 10).cast("long"))
    return scan(rows, [], ["__h"], **{name: Running("sum", F.lit(1))}).withColumn(name, F.col(name) - 1).drop("__h", "part")


def allocate_calendar(history_daily: DataFrame, schedule: DataFrame, first: str, last: str, seed: int) -> DataFrame:
    """Spread a fixed population of arrivals over a target calendar.

    Weekday mass comes from historical means, split by largest remainder; inside a weekday each target
    day draws a positive historical day of that weekday as its weight; arrivals in hash order fill
    the days and keep their time of day. `history_daily`: day, count. `schedule`: application_id,
    activation_datetime.
    """
    days = schedule.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("day")).withColumn("weekday", weekday("day"))
    hist = materialize(history_daily.withColumn("weekday", weekday("day")))
    mean = hist.groupBy("weekday").agg(F.avg("count").alias("mean"))
    mass = materialize(days.groupBy("weekday").agg(F.count(F.lit(1)).alias("targets")).join(mean, "weekday")
            .withColumn("mass", F.col("mean") * F.col("targets")))
    totals = largest_remainder(mass, "mass", schedule.agg(F.count(F.lit(1))).scalar(), "weekday").select(
        "weekday", F.col("allocated").alias("weekday_total"))
    donors = hist.filter("count > 0").withColumn("i", F.row_number().over(Window.partitionBy("weekday").orderBy("day")) - 1)
    pools = donors.groupBy("weekday").agg(F.count(F.lit(1)).alias("pool"))
    picked = (days.join(pools, "weekday").withColumn("i", F.floor(draw(seed, "residual", F.col("day")) * F.col("pool")).cast("int"))
              .join(donors.select("weekday", "i", F.col("count").alias("residual")), ["weekday", "i"]).join(totals, "weekday"))
    per_day = materialize(largest_remainder(materialize(picked), "residual", F.col("weekday_total"), "day", ["weekday"]))
    # One row per target day: a calendar, so ordered in one small window.
    per_day = per_day.withColumn("hi", F.sum("allocated").over(Window.orderBy("day"))).withColumn("lo", F.col("hi") - F.col("allocated"))
    ranges = per_day.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "day"))).alias("r")).scalar()
    rows = global_rank(schedule, F.concat_ws("|", F.lit(seed), "application_id"))
    rows = rows.withColumn("__ranges", ranges)
    rows = rows.withColumn("target_day", F.filter("__ranges", lambda x: (F.col("position") >= x["lo"]) & (F.col("position") < x["hi"]))[0]["day"])
    clock = micros("activation_datetime") - micros(F.date_trunc("day", "activation_datetime").cast("timestamp_ntz"))
    return rows.withColumn("application_created_at", F.timestamp_micros(
        micros(F.col("target_day").cast("timestamp_ntz")) + clock).cast("timestamp_ntz")).drop("__ranges")


def returning_rates(entrants: DataFrame, minimum: int = 200) -> DataFrame:
    """Share of returning customers per weekday; a weekday under the minimum uses the pooled share."""
    day = entrants.groupBy(weekday("application_created_at").alias("weekday")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(F.col("customer_kind") == "RETURNING_CUSTOMER")).alias("r"))
    pooled = day.agg((F.sum("r") / F.sum("n"))).scalar()
    return day.select("weekday", F.col("n").alias("entrants"), F.col("r").cast("long").alias("returners"),
                      F.when(F.col("n") >= minimum, F.col("r") / F.col("n")).otherwise(pooled).alias("rate"))


# --- donor matching ------------------------------------------------------------------------------------

def gap_neighbourhood(targets: DataFrame, donors: DataFrame, minimum: int = 30) -> DataFrame:
    """How wide around each target gap one must look to see `minimum` donors, and the donor count.

    EXACT_DAY, else WITHIN_3_DAYS, else the radius of the minimum-th nearest donor. `targets`:
    target_id, stratum, target. `donors`: stratum, gap. The pool is read as counts: cumulative donor
    counts at the interval ends, so no target-donor pair is formed for the first two rules; only
    targets beyond them look outward, over at most 2 * minimum neighbours each.
    """
    scale = lambda x: F.round(x * 1e6).cast("long")
    steps = donors.groupBy("stratum", "gap").agg(F.count(F.lit(1)).alias("n")).withColumn("part", value_part("gap"))
    steps = materialize(scan(steps, ["stratum"], ["gap"], cum=Running("sum", F.col("n"))))
    t = F.col("target")
    # Five reads of the cumulative count per distinct target in one merge; whole units of 1e-6 make
    # "below x" the same read as "at or below x - 1".
    marks = F.array(*[F.struct(F.lit(n).alias("mark"), x.alias("p")) for n, x in (
        ("lt_day", scale(F.floor(t)) - 1), ("lt_next", scale(F.floor(t) + 1) - 1), ("lt_lo", scale(t - 3) - 1), ("le_hi", scale(t + 3)), ("below", scale(t) - 1))])
    points = targets.select("stratum", "target").distinct().select("stratum", "target", F.inline(marks)).withColumn("part", value_part(F.col("p") / 1e6))
    read = asof(points, steps, ["stratum"], F.col("p"), scale(F.col("gap")), {"cum": F.col("cum")})
    rows = read.groupBy("stratum", "target").agg(*[
        F.coalesce(F.max(F.when(F.col("mark") == n, F.col("cum"))), F.lit(0)).alias(n) for n in ("lt_day", "lt_next", "lt_lo", "le_hi", "below")])
    rows = materialize(rows.withColumns({"exact": F.col("lt_next") - F.col("lt_day"), "near": F.col("le_hi") - F.col("lt_lo")}))
    done = (F.col("exact") >= minimum) | (F.col("near") >= minimum)
    # Outward search: the minimum-th nearest lies among the `minimum` donors on either side, found by
    # their ranks on the cumulative counts.
    sized = steps.groupBy("stratum").agg(F.max("cum").alias("pool"))
    want = rows.filter(~done).join(sized, "stratum").withColumn("rank", F.explode(F.sequence(
        F.greatest(F.lit(1), F.col("below") - minimum + 1), F.least("pool", F.col("below") + minimum))))
    want = want.select("stratum", "target", "pool", "rank").withColumn("part", value_part("rank"))
    near = asof(want, steps.withColumn("part", value_part("cum")), ["stratum"], F.col("rank"), F.col("cum"), {"gap": F.col("gap")}, forward=True)
    k = F.least(F.lit(minimum), F.max("pool"))
    radius = near.groupBy("stratum", "target").agg(F.element_at(F.sort_array(F.collect_list(F.abs(F.col("gap") - t))), k.cast("int")).alias("radius"))
    rows = targets.select("target_id", "stratum", "target").join(rows, ["stratum", "target"])
    out = rows.join(radius, ["stratum", "target"], "left")
    reason = (F.when(F.col("exact") >= minimum, "EXACT_DAY").when(F.col("near") >= minimum, "WITHIN_3_DAYS")
              .when(F.col("radius").isNull(), "NO_ELIGIBLE_CONTEXT").otherwise("NEAREST_SUPPORTED_RANGE"))
    lo = F.when(reason == "EXACT_DAY", F.floor(t).cast("double")).when(reason == "WITHIN_3_DAYS", t - 3).otherwise(t - F.col("radius"))
    hi = F.when(reason == "EXACT_DAY", (F.floor(t) + 1).cast("double")).when(reason == "WITHIN_3_DAYS", t + 3).otherwise(t + F.col("radius"))
    return out.select("target_id", "stratum", "target", reason.alias("reason"), lo.alias("gap_lo"), hi.alias("gap_hi"))

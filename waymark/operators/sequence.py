"""Packets, running features, gaps, cycles, equal-age activity and guard prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import among, flag, micros, ntz, regime, seconds_between, truncated
from ..session import materialize
from ..spec import LifecycleSpec
from .lifecycle import APP, TIMELINE, is_label
from .ordered import Running, Shift, quantiles, scan


def drop_repeat_creations(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    made = is_label(spec.creation)
    rows = scan(events, APP, TIMELINE, __made=Running("sum", flag(made), inclusive=False))
    return rows.filter(~(F.coalesce(made, F.lit(False)) & (F.col("__made") > 0))).drop("__made")


def label_groups(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """One row per (application, time) with its distinct labels in source order; repeated creation
    rows are left out.

    One scan marks repeats and numbers the rows, so the first reduction, to one row per label, keeps
    only numbers in its buffers and hashes instead of sorting. A group never holds more entries than
    there are labels.
    """
    made = is_label(spec.creation)
    rows = scan(events, APP, TIMELINE, __made=Running("sum", flag(made), inclusive=False), __ord=Running("sum", F.lit(1)))
    rows = rows.filter(~(F.coalesce(made, F.lit(False)) & (F.col("__made") > 0))).withColumn("__t", truncated("event_datetime", spec.grain))
    life = ["application_created_at", "deadline"]
    keys = ["application_id", "part", "__t"]
    each = rows.groupBy(*keys, *life, "context_id", "journey_substage", "journey_stage").agg(
        F.count(F.lit(1)).alias("n"), F.min("__ord").alias("first"), F.max("__ord").alias("last"))
    packed = each.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("first", "last", "journey_substage", "journey_stage", "context_id"))).alias("__l"),
        F.sum("n").alias("source_rows"), *[F.min(x).alias(x) for x in life])
    newest = F.array_max(F.transform("__l", lambda x: F.struct(x["last"], x["journey_stage"].alias("journey_stage"), x["context_id"].alias("context_id"))))
    return packed.select(*keys, F.array_distinct(F.transform("__l", lambda x: x["journey_substage"])).alias("seen"), "source_rows",
                         newest.alias("last"), *life)


def pattern_key(labels) -> Column:
    return F.array_join(F.sort_array(labels), "|")


def supported_patterns(groups: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Label sets of two or more, without creation or terminal, seen often enough in both halves."""
    core = [x for x in spec.order if x not in (spec.creation, spec.terminal)]
    early = F.col("__t") < ntz(spec.pattern_split)
    return (groups.filter((F.size("seen") > 1) & (F.size(F.array_except("seen", F.array(*map(F.lit, core)))) == 0))
            .groupBy(pattern_key("seen").alias("pattern"))
            .agg(F.sum(flag(early)).cast("long").alias("first_half"), F.sum(flag(~early)).cast("long").alias("second_half"))
            .filter((F.col("first_half") >= spec.pattern_support[0]) & (F.col("second_half") >= spec.pattern_support[1])))


def packets(events: DataFrame, spec: LifecycleSpec, patterns: DataFrame | None = None) -> DataFrame:
    """Same-time label sets with running features.

    `regime` looks at earlier packets only; `prior_depth` and `ptp_eligible` include the current one.
    The pattern side has at most one row per subset of the core labels, hence the broadcast.
    Pass fitted `patterns` to skip fitting them; else the groups are written once, as patterns and
    packets both read them.
    """
    groups = label_groups(events, spec)
    if patterns is None:
        groups = materialize(groups)
        patterns = supported_patterns(groups, spec)
    rows = (groups.withColumn("pattern", pattern_key("seen"))
            .join(F.broadcast(patterns.select("pattern", F.lit(True).alias("__ok"))), "pattern", "left"))
    rank = F.create_map(*[x for i, l in enumerate(spec.order) for x in (F.lit(l), F.lit(i))])
    ordered = F.transform(F.sort_array(F.transform("seen", lambda x: F.struct(
        F.coalesce(F.try_element_at(rank, x), F.lit(999)).alias("r"), x.alias("l")))), lambda x: x["l"])
    single = (F.when(F.array_contains("seen", spec.terminal), F.lit(spec.terminal))
              .when(F.array_contains("seen", spec.creation), F.lit(spec.creation))
              .otherwise(F.element_at("seen", -1)))
    labels = F.when(F.col("__ok"), ordered).otherwise(F.array(single))
    rows = rows.select(
        "application_id", F.col("last.context_id").alias("context_id"), F.col("__t").alias("event_datetime"),
        "application_created_at", "deadline", labels.alias("labels"), F.element_at(labels, -1).alias("state"),
        F.col("last.journey_stage").alias("journey_stage"), "part",
        (F.size("seen") - F.size(labels)).alias("omitted"), (F.col("source_rows") - F.size("seen")).alias("repeats"))
    return running_features(rows, spec)


def running_features(rows: DataFrame, spec: LifecycleSpec) -> DataFrame:
    has = lambda names: F.arrays_overlap("labels", F.array(*map(F.lit, names))).cast("int")
    rows = scan(rows, APP, ["event_datetime"],
                __down=Running("max", has(spec.downstream), inclusive=False),
                prior_depth=Running("sum", F.size("labels")),
                __details=Running("max", has(spec.prerequisites)),
                __approved=Running("max", has((spec.approval,))))
    return rows.withColumns({
        "regime": regime("state", F.coalesce(F.col("__down") > 0, F.lit(False)), spec),
        "ptp_eligible": (F.col("__details") > 0) & (F.col("__approved") > 0),
        "source_age": F.when(seconds_between("application_created_at", "event_datetime") < spec.young_seconds, "YOUNG")
        .otherwise("LATE")}).drop("__down", "__details", "__approved")


def packet_audit(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """One row: packets, repeats rejected, and labels of unsupported groups left out."""
    p = packets(events, spec)
    return p.agg(F.count(F.lit(1)).alias("group_count"), F.sum("repeats").cast("long").alias("same_label_extras"),
                 F.sum("omitted").cast("long").alias("unsupported_extras"),
                 F.sum(flag(F.size("labels") > 1)).cast("long").alias("multi_label_packets"))


def gaps(events: DataFrame) -> DataFrame:
    """Previous label and time of each event, and the gap in seconds."""
    rows = scan(events, APP, TIMELINE, prev_label=Shift(F.col("journey_substage")),
                prev_at=Shift(F.col("event_datetime")))
    return rows.withColumn("gap_seconds", seconds_between("prev_at", "event_datetime"))


def cycles(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Flags of self transition, two- and three-state cycle, repeated label, return to an earlier
    stage, and focus revisit. Every edge of a cycle must take positive time.

    First times per label and stage form one short list per application, joined on the key the
    events are already spread by.
    """
    label, ts, stage = F.col("journey_substage"), F.col("event_datetime"), F.col("journey_stage")
    each = events.groupBy("application_id", "journey_substage", "journey_stage").agg(F.min("event_datetime").alias("at"))
    firsts = each.groupBy("application_id").agg(F.collect_list(F.struct("journey_substage", "journey_stage", "at")).alias("__f"))
    rows = scan(events, APP, TIMELINE,
                p1=Shift(F.struct("journey_substage", "event_datetime", "journey_stage"), 1),
                p2=Shift(F.struct("journey_substage", "event_datetime"), 2),
                p3=Shift(F.struct("journey_substage", "event_datetime"), 3))
    rows = rows.join(firsts, "application_id", "left")
    earliest = lambda keep: F.array_min(F.transform(F.filter("__f", keep), lambda x: x["at"]))
    rows = rows.withColumns({
        "__first_label": earliest(lambda x: x["journey_substage"] == label),
        "__first_stage": earliest(lambda x: x["journey_stage"] == stage),
        "__down": earliest(lambda x: x["journey_substage"].isin(*spec.downstream))})
    L = lambda k: F.col(f"p{k}.journey_substage")
    T = lambda k: F.col(f"p{k}.event_datetime")
    e1, e2, e3 = ts > T(1), T(1) > T(2), T(2) > T(3)
    yes = lambda x: F.coalesce(x, F.lit(False))
    focus = among("journey_substage", spec.focus)
    return rows.withColumns({
        "self_transition": yes((label == L(1)) & e1),
        "two_state_cycle": yes((label == L(2)) & (label != L(1)) & e1 & e2),
        "three_state_cycle": yes((label == L(3)) & (label != L(1)) & (label != L(2)) & (L(1) != L(2)) & e1 & e2 & e3),
        "repeated_substage": yes(ts > F.col("__first_label")),
        "return_to_earlier_stage": yes((ts > F.col("__first_stage")) & (stage != F.col("p1.journey_stage")) & e1),
        "focus_revisit": yes(focus & (F.col("__down") < ts)),
        "focus_tie": yes(focus & (F.col("__down") == ts)),
        "focus": focus,
        **{f"back_{k}_seconds": seconds_between(T(k), ts) for k in (1, 2, 3)}}).drop("p1", "p2", "p3", "__f", "__first_label", "__first_stage", "__down")


CYCLES = ("self_transition", "two_state_cycle", "three_state_cycle", "repeated_substage",
          "return_to_earlier_stage", "focus_revisit")


def cycle_counts(events: DataFrame, cohort: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Counts per application of the cohort, zeros included."""
    per = cycles(events, spec).groupBy("application_id").agg(
        *[F.sum(flag(F.col(x))).cast("long").alias(x) for x in CYCLES])
    return cohort.select("application_id").join(per, "application_id", "left").na.fill(0, list(CYCLES))


#: Over how many events back a cycle of each kind is timed.
CYCLE_LAGS = {"self_transition": 1, "two_state_cycle": 2, "three_state_cycle": 3, "repeated_substage": 1, "return_to_earlier_stage": 1, "focus_revisit": 1}


def cycle_profile(events: DataFrame, cohort: DataFrame, spec: LifecycleSpec, probs: dict[str, float]) -> DataFrame:
    """One row per kind of cycle: events, applications, mean and quantiles of the count per application of the cohort, zeros
    included (`per_app_*`), and quantiles of the seconds it took (`seconds_*`). Quantiles come from counts of distinct
    values, so zeros are one row however many applications have them."""
    rows = materialize(cycles(events, spec).select("application_id", *CYCLES, *[f"back_{k}_seconds" for k in (1, 2, 3)]))
    per = cohort.select("application_id").join(rows.groupBy("application_id").agg(*[F.sum(flag(F.col(x))).cast("long").alias(x) for x in CYCLES]), "application_id", "left").na.fill(0, list(CYCLES))
    kinds = lambda value: F.inline(F.array(*[F.struct(F.lit(x).alias("kind"), value(x).alias("value")) for x in CYCLES]))
    counts = materialize(per.select(kinds(lambda x: F.col(x))).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))
    sums = counts.groupBy("kind").agg(F.sum(F.col("value") * F.col("n")).alias("events"), F.sum(F.when(F.col("value") > 0, F.col("n")).otherwise(0)).alias("applications"),
                                      (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean_per_app"))
    took = rows.select(kinds(lambda x: F.when(F.col(x), F.col(f"back_{CYCLE_LAGS[x]}_seconds")))).filter("value is not null")
    named = lambda df, prefix: df.withColumnsRenamed({p: f"{prefix}_{p}" for p in probs})
    apps = named(quantiles(counts, "value", probs, ["kind"], count="n"), "per_app")
    return sums.join(apps, "kind").join(named(quantiles(took, "value", probs, ["kind"]), "seconds"), "kind", "left")


def focus_shares(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """First passes, revisits and undecided ties of the focus labels, and the share of revisits among the decided."""
    rows = cycles(events, spec).filter("focus")
    s = rows.agg(F.sum(flag(~F.col("focus_revisit") & ~F.col("focus_tie"))).cast("long").alias("first_pass"), F.sum(flag(F.col("focus_revisit"))).cast("long").alias("revisit"),
                 F.sum(flag(F.col("focus_tie"))).cast("long").alias("ambiguous_ties")).na.fill(0)
    return s.withColumn("revisit_share", F.col("revisit") / F.greatest(F.lit(1), F.col("first_pass") + F.col("revisit")))


def equal_age(events: DataFrame, lifecycles: DataFrame, days: int, start: str, end: str,
              spec: LifecycleSpec) -> DataFrame:
    """Activity in the first `days` of life, only for applications whose horizon fits the window.
    `observable_prerequisite_ptp`: an approval after the first prerequisite and up to the terminal is seen."""
    created = F.col("application_created_at")
    cohort = lifecycles.filter((created >= ntz(start)) & (micros(created) <= micros(ntz(end)) - days * 86400 * 10**6))
    age = seconds_between("application_created_at", "event_datetime")
    early = events.filter(age < days * 86400).withColumn("__d", F.floor(age / 86400))
    steps = early.groupBy("application_id").agg(
        F.min(F.when(among("journey_substage", spec.prerequisites), F.col("event_datetime"))).alias("__pd"),
        F.min(F.when(is_label(spec.terminal), F.col("event_datetime"))).alias("__pt"))
    shown = (early.filter(is_label(spec.approval)).select("application_id", "event_datetime").join(steps, "application_id")
             .filter((F.col("__pd") < F.col("event_datetime")) & (F.col("event_datetime") <= F.col("__pt")))
             .select("application_id", F.lit(1).alias("observable_prerequisite_ptp")).distinct())
    daily = (early.groupBy("application_id", "__d").agg(
                 F.count(F.lit(1)).alias("n"), F.max(flag(is_label(spec.terminal))).alias("t")))
    per = daily.groupBy("application_id").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("eventful_days"),
                                              F.max("t").alias("ptp"))
    rows = (cohort.join(per, "application_id", "left").join(shown, "application_id", "left")
            .na.fill(0, ["events", "eventful_days", "ptp", "observable_prerequisite_ptp"]))
    return rows.withColumns({"transitions": F.greatest(F.col("events") - 1, F.lit(0)),
                             "weekday": F.weekday("application_created_at").cast("int")})


def burst_audit(groups: DataFrame, patterns: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Same-time groups of two or more labels by pattern, and whether the pattern is supported."""
    ties = (groups.filter(F.size("seen") > 1).groupBy(pattern_key("seen").alias("pattern"))
            .agg(F.count(F.lit(1)).alias("groups"), F.sum(F.size("seen") - 1).cast("long").alias("extra_rows")))
    return ties.join(patterns.select("pattern", F.lit(True).alias("__ok")), "pattern", "left").select(
        "pattern", "groups", "extra_rows", F.coalesce("__ok", F.lit(False)).alias("supported"))


def guard_prefix(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Adds `blocked` (the guard stops this row) and `kept` (no row up to here was stopped)."""
    rows = scan(events, APP, TIMELINE,
                __details=Running("max", flag(among("journey_substage", spec.prerequisites)), inclusive=False),
                __approved=Running("max", flag(is_label(spec.approval)), inclusive=False))
    d, a = F.coalesce(F.col("__details") > 0, F.lit(False)), F.coalesce(F.col("__approved") > 0, F.lit(False))
    rows = rows.withColumn("blocked", F.coalesce(
        (is_label(spec.approval) & ~d) | (is_label(spec.terminal) & ~(d & a)), F.lit(False)))
    rows = scan(rows, APP, TIMELINE, __stops=Running("sum", flag(F.col("blocked"))))
    return rows.withColumn("kept", F.col("__stops") == 0).withColumn(
        "first_block", F.col("blocked") & (F.col("__stops") == 1)).drop("__details", "__approved", "__stops")


def context_timeline(events: DataFrame) -> DataFrame:
    """Position in the customer's and in the application's history, previous time and elapsed."""
    one = F.lit(1)
    rows = scan(events, ["context_id"], TIMELINE, context_event_sequence=Running("sum", one),
                previous_event_datetime=Shift(F.col("event_datetime")))
    known = rows.filter(F.col("application_id").isNotNull())
    known = scan(known, ["context_id", "application_id"], TIMELINE, application_event_sequence=Running("sum", one))
    rows = known.unionByName(rows.filter(F.col("application_id").isNull()), allowMissingColumns=True)
    return rows.withColumn("seconds_since_previous_event", seconds_between("previous_event_datetime", "event_datetime"))


def day_ordinal(events: DataFrame, cap: int = 8) -> DataFrame:
    """Bucket of the event's position within its application's day, capped."""
    rows = events.withColumn("event_date", F.to_date("event_datetime"))
    rows = scan(rows, ["application_id", "event_date"], TIMELINE, __n=Running("sum", F.lit(1)))
    return rows.withColumn("count_bucket", F.least(F.col("__n") - 1, F.lit(cap))).drop("__n")


def peak_intensity(events: DataFrame) -> DataFrame:
    """Largest number of events per application-day and per application-10-minutes."""
    per_bin = (events.groupBy("application_id", F.to_date("event_datetime").alias("d"),
                              F.floor(micros("event_datetime") / 600000000).alias("b")).agg(F.count(F.lit(1)).alias("n")))
    per_day = per_bin.groupBy("application_id", "d").agg(F.sum("n").alias("n"), F.max("n").alias("b"))
    return per_day.agg(F.max("n").alias("max_events_per_active_day"), F.max("b").alias("max_events_per_ten_minutes"))


def first_and_last(events: DataFrame) -> DataFrame:
    return events.groupBy("application_id").agg(
        F.min_by("journey_substage", F.struct(*TIMELINE)).alias("first_label"),
        F.max_by("journey_substage", F.struct(*TIMELINE)).alias("last_label"))

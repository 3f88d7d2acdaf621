"""Censored next-event laws: episodes, product-limit masses, residual and piecewise laws, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import among, bound_band, flag, micros, ntz, seconds_between, weekday
from ..session import materialize
from ..spec import LifecycleSpec
from .lifecycle import APP, TIMELINE, is_label
from .ordered import Running, Shift, asof, scan, value_part

BLANK = "[]"


def text(labels) -> Column:
    return F.to_json(labels)


def episodes(packets: DataFrame, spec: LifecycleSpec, start: str, end: str) -> DataFrame:
    """One row per non-terminal packet inside the window: time to the next packet or to censoring.

    The next packet must come strictly before the deadline and the window end. A terminal whose
    prerequisites were not seen keeps its observed time but carries no label.
    """
    rows = scan(packets, APP, ["event_datetime"], next_time=Shift(F.col("event_datetime"), -1),
                next_state=Shift(F.col("state"), -1), next_labels=Shift(text("labels"), -1))
    t = F.col("event_datetime")
    rows = rows.filter((t >= ntz(start)) & (t < ntz(end)) & (F.col("state") != spec.terminal))
    stop = F.least(F.col("deadline"), ntz(end))
    observed = F.coalesce(F.col("next_time") < stop, F.lit(False))
    blocked = (F.col("next_state") == spec.terminal) & ~F.col("ptp_eligible")
    rows = rows.withColumns({
        "observed": observed,
        "duration_seconds": seconds_between("event_datetime", F.when(observed, F.col("next_time")).otherwise(stop)),
        "next_labels": F.when(observed & ~blocked, F.col("next_labels")).otherwise(BLANK)})
    return rows.filter(F.col("duration_seconds") > 0)


def product_limit(rows: DataFrame, by: Sequence[str], n: str | None = None) -> DataFrame:
    """Competing-event masses at exact event times; events leave before censored rows of equal time.

    `rows`: by..., duration_seconds, observed, labels (text), and optionally a multiplicity `n`.
    Rows are counted per (pool, time, label) before anything is ordered. The running risk set and
    the survival product then go slot by slot with carried slot totals, so a pool of any size is
    never in one task. Blank labels use up survival but keep no mass.
    """
    by = list(by)
    amount = F.sum(n) if n else F.count(F.lit(1))
    hit = F.when(F.col("observed"), F.col("labels"))
    # Compact and read by every branch below: written once.
    counted = materialize(rows.groupBy(*by, "duration_seconds", hit.alias("labels")).agg(amount.alias("n"))
                          .withColumn("slot", value_part("duration_seconds")))
    per_time = counted.groupBy(*by, "slot", "duration_seconds").agg(
        F.sum("n").alias("size"), F.coalesce(F.sum(F.when(F.col("labels").isNotNull(), F.col("n"))), F.lit(0)).alias("d"),
        F.collect_list(F.when(F.col("labels").isNotNull(), F.struct("labels", "n"))).alias("hits"))
    order = Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = (counted.groupBy(*by, "slot").agg(F.sum("n").alias("size"), F.count("labels").alias("__k"))
             .select(*by, "slot", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("__gone"),
                     F.sum("size").over(Window.partitionBy(*by)).alias("denominator")))
    inside = Window.partitionBy(*by, "slot").orderBy("duration_seconds").rowsBetween(Window.unboundedPreceding, -1)
    risk = (per_time.join(slots, [*by, "slot"])
            .withColumn("risk_set", F.col("denominator") - F.col("__gone") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .withColumn("__q", 1 - F.col("d") / F.col("risk_set")))
    carry = (risk.groupBy(*by, "slot").agg(F.product("__q").alias("__q"))
             .select(*by, "slot", F.coalesce(F.product("__q").over(order), F.lit(1.0)).alias("__s")))
    law = (risk.join(carry, [*by, "slot"])
           .withColumn("unit", F.col("__s") * F.coalesce(F.product("__q").over(inside), F.lit(1.0)) / F.col("risk_set")))
    law = law.select(*by, "duration_seconds", "risk_set", "denominator", "unit", F.explode("hits").alias("h"))
    return law.select(*by, "duration_seconds", F.col("h.labels").alias("labels"),
                      F.when(F.col("h.labels") == BLANK, 0.0).otherwise(F.col("h.n") * F.col("unit")).alias("mass"),
                      (F.col("h.n") * F.col("unit")).alias("raw_mass"), "risk_set", F.col("h.n").alias("support_count"),
                      "denominator")


def explode_levels(rows: DataFrame, levels: dict[str, Sequence[str]], fields: Sequence[str], blank=lambda f: F.lit("")) -> DataFrame:
    """One copy of each (already counted) row per level, unused key fields blanked."""
    picks = F.array(*[F.struct(F.lit(level).alias("model_level"),
                               *[(F.col(f) if f in keys else blank(f)).alias(f) for f in fields])
                      for level, keys in levels.items()])
    rest = [x for x in rows.columns if x not in fields]
    return rows.withColumn("__l", F.explode(picks)).select("__l.*", *rest)


def fit_law(rows: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Next-event law per level and stratum; levels and minimum occurrences come from the spec.

    Episodes are counted at the finest key first and only the counts are copied per level. A pool
    without any event gets one zero-mass row, so a lookup still finds it.
    """
    strata = [s for s in spec.law_strata]
    rows = materialize(rows.select("application_id", "duration_seconds", "observed", "next_labels",
                                   *{f for keys, _ in spec.law_levels.values() for f in keys}, *spec.law_strata))
    fields = sorted({k for keys, _ in spec.law_levels.values() for k in keys}, key=["state", "regime", "journey_stage"].index)
    levels = {name: keys for name, (keys, _) in spec.law_levels.items()}
    finest = rows.groupBy(*fields, *strata, "duration_seconds", "observed", F.col("next_labels").alias("labels")).agg(
        F.count(F.lit(1)).alias("n"))
    by = ["model_level", *fields, *strata]
    law = product_limit(explode_levels(finest, levels, fields), by, n="n")
    people = explode_levels(rows.select(*fields, *strata, "application_id").groupBy(*fields, *strata, "application_id")
                            .agg(F.count(F.lit(1)).alias("n")), levels, fields)
    pools = people.groupBy(*by, "application_id").agg(F.sum("n").alias("n")).groupBy(*by).agg(
        F.sum("n").alias("denominator"), F.count(F.lit(1)).alias("applications"))
    support = F.lit(0)
    for name, (_, least) in spec.law_levels.items():
        support = F.when(F.col("model_level") == name, least).otherwise(support)
    pools = pools.filter((F.col("denominator") >= support)
                         & ((F.col("model_level") != "STATE_REGIME") | among("state", spec.focus)))
    law = law.drop("denominator", "raw_mass")
    out = pools.join(law, by, "left")
    return out.withColumns({
        "risk_set": F.coalesce("risk_set", "denominator"), "support_count": F.coalesce("support_count", F.lit(0)),
        "duration_seconds": F.coalesce("duration_seconds", F.lit(0.0)), "mass": F.coalesce("mass", F.lit(0.0)),
        "labels": F.coalesce("labels", F.lit(BLANK))})


def holdout_error(train: DataFrame, test: DataFrame, spec: LifecycleSpec, support: int) -> DataFrame:
    """Largest distance between the pooled training law and the product-limit law of the test
    episodes, per state. Training strata are mixed by their occurrence counts."""
    test = materialize(test.select("state", "application_id", "duration_seconds", "observed", "next_labels"))
    model = materialize(fit_law(train, spec).filter(F.col("model_level") == "STATE"))
    weight = model.select("state", *spec.law_strata, "denominator").distinct().groupBy("state").agg(
        F.sum("denominator").alias("__den"))
    a = model.join(weight, "state").select("state", "duration_seconds",
                                           (F.col("mass") * F.col("denominator") / F.col("__den")).alias("a"))
    cohort = test.groupBy("state", "application_id").agg(F.count(F.lit(1)).alias("n")).groupBy("state").agg(
        F.sum("n").alias("validation_occurrences"), F.count(F.lit(1)).alias("validation_applications")
    ).filter(F.col("validation_occurrences") >= support)
    truth = product_limit(test.join(cohort.select("state"), "state", "left_semi").withColumn("labels", F.col("next_labels")), ["state"])
    b = truth.select("state", "duration_seconds", F.col("raw_mass").alias("b"))
    both = (a.unionByName(b, allowMissingColumns=True).groupBy("state", "duration_seconds")
            .agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("b"))
            .withColumn("part", value_part("duration_seconds")))
    run = scan(both, ["state"], ["duration_seconds"], fa=Running("sum", F.col("a")), fb=Running("sum", F.col("b")))
    err = run.groupBy("state").agg(F.max(F.abs(F.col("fa") - F.col("fb"))).alias("cdf_sup_error"),
                                   F.sum("a").alias("train_mass"), F.sum("b").alias("validation_mass"))
    return cohort.join(err, "state").join(weight.select("state"), "state", "left_semi")


def landmarks(packets: DataFrame, spec: LifecycleSpec, first: str, last: str, end: str, step_hours: int = 24) -> DataFrame:
    """Risk rows at regular landmarks, complete lifecycles only.

    A packet is the last one strictly before every landmark in (its time, the next packet's time],
    so each packet emits its own landmarks: no product of landmarks and population is formed.
    """
    step = step_hours * 3600 * 10**6
    rows = scan(packets, APP, ["event_datetime"], next_time=Shift(F.col("event_datetime"), -1),
                next_labels=Shift(text("labels"), -1))
    rows = rows.filter((F.col("state") != spec.terminal) & (F.col("deadline") <= ntz(end)))
    t0 = micros(ntz(first))
    lo = F.greatest(F.lit(0), F.floor((micros("event_datetime") - t0) / step) + 1)
    upto = F.least(micros("next_time"), micros("deadline") - 1, micros(ntz(last)))
    hi = F.floor((upto - t0) / step)
    rows = rows.withColumns({"__lo": lo.cast("long"), "__hi": hi.cast("long")}).filter("__hi >= __lo")
    rows = rows.withColumn("__k", F.explode(F.sequence("__lo", "__hi")))
    rows = rows.withColumn("landmark", F.timestamp_micros(t0 + F.col("__k") * step).cast("timestamp_ntz"))
    seen = F.coalesce(F.col("next_time") < F.col("deadline"), F.lit(False))
    hidden = ~F.col("ptp_eligible") & (F.col("next_labels") == F.lit(f'["{spec.terminal}"]'))
    unit = lambda a, b: seconds_between(a, b) / spec.bound_seconds
    return rows.withColumns({
        "observed": seen,
        "duration_seconds": seconds_between("landmark", F.when(seen, F.col("next_time")).otherwise(F.col("deadline"))),
        "next_labels": F.when(seen & ~F.coalesce(hidden, F.lit(False)), F.col("next_labels")).otherwise(BLANK),
        "age_band": bound_band(unit("application_created_at", "landmark"), spec.age_bounds),
        "silence_band": bound_band(unit("event_datetime", "landmark"), spec.silence_bounds),
        "depth_band": bound_band("prior_depth", spec.depth_bounds),
        "weekday": weekday("landmark")}).drop("__lo", "__hi", "__k")


def fit_residual(rows: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Residual law per weekday and pooled (-1), six levels, minimum distinct applications."""
    fields = ["state", "age_band", "silence_band", "depth_band"]
    blank = lambda f: F.lit("") if f == "state" else F.lit(-1)

    def spread(df):
        df = df.withColumn("weekday", F.explode(F.array("weekday", F.lit(-1))))
        return explode_levels(df, spec.residual_levels, fields, blank)

    rows = materialize(rows.select("weekday", *fields, "application_id", "duration_seconds", "observed", "next_labels"))
    by = ["weekday", "model_level", *fields]
    finest = rows.groupBy("weekday", *fields, "duration_seconds", "observed", F.col("next_labels").alias("labels")).agg(
        F.count(F.lit(1)).alias("n"))
    law = product_limit(spread(finest), by, n="n").filter(F.col("labels") != BLANK).drop("raw_mass", "denominator", "risk_set")
    people = spread(rows.groupBy("weekday", *fields, "application_id").agg(F.count(F.lit(1)).alias("n")))
    pools = (people.groupBy(*by, "application_id").agg(F.sum("n").alias("n")).groupBy(*by)
             .agg(F.sum("n").alias("denominator"), F.count(F.lit(1)).alias("applications"))
             .filter(F.col("applications") >= spec.residual_support))
    return pools.join(law, by, "left").withColumns({
        "duration_seconds": F.coalesce("duration_seconds", F.lit(0.0)), "mass": F.coalesce("mass", F.lit(0.0)),
        "labels": F.coalesce("labels", F.lit(BLANK)), "support_count": F.coalesce("support_count", F.lit(0))})


# --- approval to terminal ---------------------------------------------------------------------------

def risk_episodes(events: DataFrame, spec: LifecycleSpec, end: str) -> DataFrame:
    """Approvals after a strictly earlier prerequisite, each at risk of the terminal until the next
    such approval, the deadline or the window end."""
    ts = F.col("event_datetime")
    details = among("journey_substage", spec.prerequisites)
    per = events.groupBy("application_id").agg(
        F.min(F.when(details, ts)).alias("details_at"), F.min(F.when(is_label(spec.terminal), ts)).alias("terminal_at"))
    a = events.filter(is_label(spec.approval)).groupBy("application_id", "part", "event_datetime").agg(
        F.min("application_created_at").alias("application_created_at"), F.min("deadline").alias("deadline"))
    a = a.join(per, "application_id").filter(
        (F.col("details_at") < ts) & (F.col("terminal_at").isNull() | (ts < F.col("terminal_at"))))
    a = a.repartition("application_id", "part")
    a = scan(a, APP, ["event_datetime"], next_approval=Shift(ts, -1))
    stop = F.least(F.col("next_approval"), F.col("deadline"), ntz(end))
    seen = F.coalesce((F.col("terminal_at") >= ts) & (F.col("terminal_at") < stop), F.lit(False))
    return a.withColumns({
        "observed": seen,
        "duration_seconds": seconds_between("event_datetime", F.when(seen, F.col("terminal_at")).otherwise(stop)),
        "application_age_seconds": seconds_between("application_created_at", "event_datetime")})


def interval_index(x, edges) -> Column:
    """Index of the half-open interval [lo, hi) that holds x."""
    out = F.when(F.lit(False), 0)
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        out = out.when((F.col(x) >= lo) & (F.col(x) < hi), i)
    return out


def piecewise_hazard(rows: DataFrame, by: Sequence[str], edges: Sequence[int]) -> DataFrame:
    """Risk set, events, censored and hazard per elapsed interval and key, with cumulative incidence.

    Durations collapse to a dozen intervals in the first aggregate, so the ordered step is tiny.
    """
    by = list(by)
    last = len(edges) - 2
    k = F.coalesce(interval_index("duration_seconds", edges), F.lit(last))
    counted = rows.groupBy(*by, k.alias("k")).agg(
        F.sum(flag(F.col("observed"))).cast("long").alias("events"),
        F.sum(flag(~F.col("observed"))).cast("long").alias("censored"))
    pools = counted.groupBy(*by).agg(F.sum(F.col("events") + F.col("censored")).alias("__all"))
    grid = pools.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(last))))
    table = grid.join(counted, [*by, "k"], "left").na.fill(0, ["events", "censored"])
    w = Window.partitionBy(*by).orderBy("k")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    edge = F.array(*[F.lit(float(e)) for e in edges])
    table = table.withColumn("risk_set", F.col("__all") - F.coalesce(
        F.sum(F.col("events") + F.col("censored")).over(before), F.lit(0)))
    table = table.withColumn("hazard", F.when(F.col("risk_set") > 0, F.col("events") / F.col("risk_set")).otherwise(0.0))
    return table.select(
        *by, "k", F.element_at(edge, F.col("k") + 1).alias("elapsed_lower_seconds"),
        F.element_at(edge, F.col("k") + 2).alias("elapsed_upper_seconds"), "risk_set", "events", "censored", "hazard",
        F.coalesce(F.product(1 - F.col("hazard")).over(before), F.lit(1.0)).alias("survival_before"),
        (1 - F.product(1 - F.col("hazard")).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("cumulative_incidence"))


def piecewise_mass(hazard: DataFrame, donors: DataFrame, by: Sequence[str], edges: Sequence[int]) -> DataFrame:
    """Spread each interval's hazard evenly over the donor durations inside it."""
    by = list(by)
    d = (donors.withColumn("k", interval_index("duration_seconds", edges)).filter(F.col("k").isNotNull())
         .groupBy(*by, "k", "duration_seconds").agg(F.count(F.lit(1)).alias("n")))
    size = d.groupBy(*by, "k").agg(F.sum("n").alias("__pool"))
    return (d.join(size, [*by, "k"]).join(hazard.select(*by, "k", "hazard", "survival_before"), [*by, "k"])
            .withColumn("mass", F.col("survival_before") * F.col("hazard") * F.col("n") / F.col("__pool"))
            .select(*by, "duration_seconds", "n", "mass"))


def cdf_at(law: DataFrame, by: Sequence[str], thresholds: Sequence[int], mass: str = "mass") -> DataFrame:
    """Cumulative mass at fixed thresholds, one row per (key, threshold)."""
    sums = [F.sum(F.when(F.col("duration_seconds") <= t, F.col(mass)).otherwise(0.0)).alias(f"t{t}") for t in thresholds]
    wide = law.groupBy(*by).agg(*sums)
    pairs = ", ".join(f"{t}, t{t}" for t in thresholds)
    return wide.select(*by, F.expr(f"stack({len(thresholds)}, {pairs}) as (threshold_seconds, cdf)"))


def pair_timing(observed: DataFrame, law: DataFrame, baseline: DataFrame, thresholds: Sequence[int], minimum: int = 100) -> DataFrame:
    """How well two models time each transition: source, destination, threshold_seconds, rows, observed_cdf, law_cdf,
    baseline_cdf and the largest error of each over the thresholds (law_error, baseline_error), for pairs of `minimum`
    observed rows and more that the law knows.

    observed: source, destination, duration_seconds. law: source, destination, duration_seconds, mass, denominator: masses
    of one competing destination, strata mixed by their denominators and scaled to 1. baseline: source ('' for sources it
    has no rows of), duration_seconds, mass: timing of any continuation, scaled to 1.
    """
    pair = ["source", "destination"]
    def at(df, keys, weight):
        sums = [F.sum(F.when(F.col("duration_seconds") <= t, weight).otherwise(0.0)).alias(f"t{i}") for i, t in enumerate(thresholds)]
        return df.groupBy(*keys).agg(F.sum(weight).alias("all"), F.count(F.lit(1)).alias("rows"), *sums).filter(F.col("all") > 0).select(
            *keys, "rows", F.array(*[F.col(f"t{i}") / F.col("all") for i in range(len(thresholds))]).alias("cdf"))
    truth = materialize(at(observed, pair, F.lit(1.0)).filter(F.col("rows") >= minimum))
    new = at(law, pair, F.col("mass") * F.col("denominator")).select(*pair, F.col("cdf").alias("law"))
    old = at(baseline, ["source"], F.col("mass")).select(F.col("source").alias("pool"), F.col("cdf").alias("baseline"))
    known = old.select(F.col("pool").alias("source"), F.col("pool").alias("own")).filter("own <> ''")
    rows = truth.join(new, pair).join(known, "source", "left").withColumn("pool", F.coalesce("own", F.lit(""))).drop("own").join(old, "pool")
    worst = lambda model: F.array_max(F.zip_with("cdf", model, lambda a, b: F.abs(a - b)))
    rows = rows.withColumns({"law_error": worst("law"), "baseline_error": worst("baseline")})
    each = F.arrays_zip(F.array(*[F.lit(t) for t in thresholds]).alias("threshold_seconds"), F.col("cdf").alias("observed_cdf"), F.col("law").alias("law_cdf"), F.col("baseline").alias("baseline_cdf"))
    return rows.select(*pair, "rows", "law_error", "baseline_error", F.inline(each).alias("threshold_seconds", "observed_cdf", "law_cdf", "baseline_cdf"))


# --- scoring -----------------------------------------------------------------------------------------

def conditional_score(cohort: DataFrame, law: DataFrame, pool: Sequence[str], elapsed: str, stop: str) -> DataFrame:
    """Survival to `elapsed`, and remaining event mass before `stop` given that survival.

    Both are as-of reads of the cumulative mass, done by one ordered merge per pool and slot. Pool
    columns must not be NULL.
    """
    return score_on(cohort, mass_curve(law, pool), pool, elapsed, stop)


def mass_curve(law: DataFrame, pool: Sequence[str]) -> DataFrame:
    """Cumulative mass per pool and duration, written once for all that read it."""
    steps = law.groupBy(*pool, "duration_seconds").agg(F.sum("mass").alias("m")).withColumn("part", value_part("duration_seconds"))
    return materialize(scan(steps, list(pool), ["duration_seconds"], cum=Running("sum", F.col("m"))))


def score_on(cohort: DataFrame, curve: DataFrame, pool: Sequence[str], elapsed: str, stop: str) -> DataFrame:
    """`conditional_score` against a curve that `mass_curve` has summed."""
    pool = list(pool)
    us = lambda x: F.round(F.col(x) * 1e6).cast("long")
    # Read the curve once per distinct (pool, time): many rows may share one, and a crowd at one time
    # must not meet in one slot. The answers are joined back.
    asked = materialize(cohort.select(*pool, F.explode(F.array(us(elapsed), us(stop))).alias("at")).distinct()
                        .withColumn("part", value_part(F.col("at") / 1e6)))
    read = materialize(asof(asked, curve, pool, F.col("at"), us("duration_seconds"), {"cum": F.col("cum")}, strict=True)
                       .select(*pool, "at", F.coalesce("cum", F.lit(0.0)).alias("cum")))
    out = cohort.withColumns({"__e": us(elapsed), "__s": us(stop)})
    out = out.join(read.withColumnsRenamed({"at": "__e", "cum": "mass_before"}), [*pool, "__e"])
    out = out.join(read.withColumnsRenamed({"at": "__s", "cum": "__upto"}), [*pool, "__s"])
    survival = F.greatest(F.lit(0.0), 1 - F.col("mass_before"))
    return out.withColumns({
        "survival": survival,
        "remaining_event_mass": F.when(survival > 1e-12, (F.col("__upto") - F.col("mass_before")) / survival).otherwise(0.0)}).drop("__e", "__s", "__upto")


def draw_next(cohort: DataFrame, law: DataFrame, pool: Sequence[str], elapsed: str, stop: str, u: str) -> DataFrame:
    """Inverse-CDF pick of the next event given survival to `elapsed`; the mass of no event stays.

    Cumulative masses are compared after rounding to 1e-12 so that equal laws pick equal rows.
    """
    pool = list(pool)
    scored = conditional_score(cohort, law, pool, elapsed, stop)
    target = F.col("mass_before") + F.col(u) * F.col("survival")
    grid = lambda x: F.floor(x * 1e12).cast("long")
    slot = lambda x: F.floor(x * 4096).cast("long")
    steps = law.filter(F.col("mass") > 0).withColumn("part", value_part("duration_seconds"))
    curve = scan(steps, pool, ["duration_seconds", "labels"], cum=Running("sum", F.col("mass")))
    curve = curve.drop("part").withColumn("part", slot(F.round("cum", 12)))
    left = scored.withColumn("target", target).withColumn("part", slot(F.round("target", 12)))
    hit = asof(left, curve, pool, grid(F.round("target", 12)), grid(F.round("cum", 12)),
               {"pick_seconds": F.col("duration_seconds"), "pick_labels": F.col("labels")},
               tie=F.round(F.col("duration_seconds") * 1e6).cast("long"), forward=True, strict=True)
    ok = (F.col("survival") > 1e-12) & (F.col("pick_seconds") >= F.col(elapsed)) & (F.col("pick_seconds") < F.col(stop))
    return hit.withColumns({
        "picked": F.coalesce(ok, F.lit(False)),
        "pick_seconds": F.when(ok, F.col("pick_seconds")), "pick_labels": F.when(ok, F.col("pick_labels"))}).drop("part")

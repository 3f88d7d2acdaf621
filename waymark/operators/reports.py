"""Reporting views and profiles. All aggregates combine before their shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import among, flag, ntz, seconds_between, weekday
from ..session import materialize
from ..spec import GAP_THRESHOLDS, QUANTILES, LifecycleSpec
from .lifecycle import is_label
from .ordered import quantiles, scan, Running
from .sequence import gaps


def n_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def label_counts(spec: LifecycleSpec) -> list[Column]:
    return [n_if(is_label(spec.approval)).alias("aip_event_count"), n_if(is_label(spec.terminal)).alias("ptp_event_count")]


def campaign_counts() -> list[Column]:
    return [n_if(is_label("campaign_sent")).alias("campaign_send_count"),
            n_if(F.col("journey_substage").isin("campaign_open_read", "campaign_clicked")).alias("campaign_response_count")]


def people() -> list[Column]:
    return [F.count(F.lit(1)).alias("event_count"), F.countDistinct("context_id").alias("context_count"),
            F.countDistinct("application_id").alias("application_count")]


def monthly_summary(df: DataFrame, spec: LifecycleSpec) -> DataFrame:
    month = F.to_date(F.date_trunc("month", "event_datetime")).alias("month_start")
    return df.groupBy(month, "data_origin", "is_simulated").agg(*people(), *label_counts(spec))


def simulated_window(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(F.col("is_simulated") & (F.col("event_datetime") >= ntz(start)) & (F.col("event_datetime") < ntz(end)))


def daily_summary(df: DataFrame, spec: LifecycleSpec, start: str, end: str) -> DataFrame:
    return simulated_window(df, start, end).groupBy(F.to_date("event_datetime").alias("event_date")).agg(
        *people(), *label_counts(spec), *campaign_counts())


def overview(df: DataFrame) -> DataFrame:
    """Whole-table figures. Events are first reduced to one row per (context, application, flag, day), which combines before
    its shuffle; what distinct counts need is then one row per context, application and day, not an expansion of all."""
    at = F.col("event_datetime")
    cells = materialize(df.groupBy("context_id", "application_id", F.col("is_simulated").alias("sim"), F.to_date(at).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last")))
    sim = F.col("sim")
    total = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0))
    plain = cells.agg(total(F.lit(True)).alias("combined_event_count"), total(~sim).alias("historical_event_count"), total(sim).alias("simulated_event_count"),
                      F.min("first").alias("first_event_datetime"), F.max("last").alias("last_event_datetime"),
                      F.min(F.when(sim, F.col("first"))).alias("first_simulated_event_datetime"), F.max(F.when(sim, F.col("last"))).alias("last_simulated_event_datetime"))
    counts = {}
    for key, name in (("context_id", "context"), ("application_id", "application"), ("day", "active_day")):
        each = cells.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(flag(sim)).alias("sim"))
        if name != "active_day":
            counts[f"combined_{name}_count"] = each.agg(F.count(F.lit(1))).scalar()
        counts[f"simulated_{name}_count"] = each.agg(F.coalesce(F.sum("sim"), F.lit(0)).cast("long")).scalar()
    return plain.withColumns(counts)


def journey_summary(df: DataFrame, spec: LifecycleSpec, start: str, end: str) -> DataFrame:
    """Per (context, application); rows without an application form their own group."""
    return simulated_window(df, start, end).groupBy("context_id", "application_id").agg(
        F.min("event_datetime").alias("first_event_datetime"), F.max("event_datetime").alias("last_event_datetime"),
        F.count(F.lit(1)).alias("event_count"), F.countDistinct(F.to_date("event_datetime")).alias("active_day_count"),
        F.bool_or(is_label(spec.approval)).alias("reached_aip"), F.bool_or(is_label(spec.terminal)).alias("reached_push_to_partner"),
        *campaign_counts())


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Share of each category; NULL is a category of its own."""
    c = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<NULL>")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / c.agg(F.sum("n")).scalar())


def transition_distribution(df: DataFrame) -> DataFrame:
    rows = gaps(df).filter("prev_label is not null")
    c = rows.groupBy("prev_label", F.coalesce("journey_substage", F.lit("<NULL>")).alias("journey_substage")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / c.agg(F.sum("n")).scalar())


def arrival_split(df: DataFrame, arrivals: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Applications and rows of an event set by whether the application arrived in the period or was
    carried into it. `arrivals`: application_id."""
    per = df.filter("application_id is not null").groupBy("application_id").agg(
        n_if(is_label(spec.approval)).alias("a"), n_if(is_label(spec.terminal)).alias("t"))
    per = per.join(arrivals.select("application_id", F.lit(True).alias("__new")), "application_id", "left")
    new, a, t = F.coalesce("__new", F.lit(False)), F.col("a") > 0, F.col("t") > 0
    return per.agg(n_if(~new).alias("carried_forward_event_applications"), n_if(~new & a).alias("carried_forward_aip_applications"),
                   F.coalesce(F.sum(F.when(~new, F.col("a"))), F.lit(0)).alias("carried_forward_aip_rows"), n_if(new & a).alias("arrival_aip_applications"),
                   n_if(new & t).alias("arrival_ptp_applications"), n_if(~new & t).alias("carried_forward_ptp_applications"))


def profile(df: DataFrame, spec: LifecycleSpec, arrivals: DataFrame | None = None) -> DataFrame:
    """One-row profile of an event set: one pass per grain, scalars put side by side. With
    `arrivals` the carried and the arrived applications are also counted apart."""
    day = F.dayofmonth("event_datetime")
    share = lambda cond: F.round(F.sum(flag(cond)) / F.count(F.lit(1)), 9)
    uniq = lambda label: F.countDistinct(F.when(is_label(label), F.col("application_id")))
    base = df.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("context_id").alias("event_active_contexts"),
                  n_if(is_label(spec.creation)).alias("created_rows"), uniq(spec.creation).alias("created_unique_applications"),
                  n_if(is_label(spec.approval)).alias("aip_rows"), uniq(spec.approval).alias("aip_unique_applications"),
                  n_if(is_label(spec.terminal)).alias("ptp_rows"), uniq(spec.terminal).alias("ptp_unique_applications"),
                  n_if(F.coalesce("event_name", F.lit("")) == "").alias("missing_event_name"),
                  share(day <= 11).alias("daily_event_share_by_11"), share(day <= 15).alias("daily_event_share_by_15"),
                  share(day >= 24).alias("daily_event_share_24_31"))
    own = df.filter("application_id is not null")
    apps = own.groupBy("application_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_datetime").alias("a"), F.max("event_datetime").alias("z"),
                                             F.min(F.when(is_label(spec.creation), F.col("event_datetime"))).alias("c"))
    per = apps.agg(F.round(F.avg("n"), 9).alias("mean_sequence_length"),
                   F.round(F.avg(flag(F.to_date("z") > F.to_date("a"))), 9).alias("multi_day_application_share"))
    med = quantiles(apps, "n", {"median_sequence_length": .5})
    gap = quantiles(gaps(own), "gap_seconds", {"median_inter_event_seconds": .5, "p90_inter_event_seconds": .9})
    later = own.join(apps.select("application_id", "c"), "application_id").filter(F.col("event_datetime") > F.col("c"))
    first = later.groupBy("application_id", "c").agg(F.min("event_datetime").alias("n")).withColumn("d", seconds_between("c", "n"))
    nxt = quantiles(first, "d", {"median_creation_to_next_seconds": .5, "p90_creation_to_next_seconds": .9})
    one = F.lit(1).alias("__one")
    out = base.select("*", one)
    for part in (per, med, gap, nxt, *([] if arrivals is None else [arrival_split(df, arrivals, spec)])):
        out = out.join(part.select("*", one), "__one", "left")
    return out.drop("__one").withColumns({
        "events_per_event_active_context": F.round(F.col("events") / F.col("event_active_contexts"), 9),
        "aip_repeated_rows": F.col("aip_rows") - F.col("aip_unique_applications")})


def arrival_profile(df: DataFrame, at: str) -> DataFrame:
    day, share = F.dayofmonth(at), lambda cond: F.round(F.avg(flag(cond)), 9)
    return df.agg(F.count(F.lit(1)).alias("arrivals"), F.countDistinct(F.to_date(at)).alias("active_days"), share(day <= 11).alias("share_by_11"),
                  share(day <= 15).alias("share_by_15"), share(day >= 24).alias("share_24_31"), share(F.weekday(at) >= 5).alias("weekend_share"))


def daily_counts(df: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """Counts on a complete calendar, zeros included. The calendar side is one row per day."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("day"))
    n = df.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("count"))
    return days.join(n, "day", "left").na.fill(0, ["count"])


def calendar_profile(daily: DataFrame) -> DataFrame:
    """Counts per weekday and capped week of month with shares, and the ratio of working-day to weekend
    counts of the whole period on every row. `daily`: day, count."""
    rows = daily.select("count", F.explode(F.array(
        F.concat(F.lit("weekday "), weekday("day").cast("string")),
        F.concat(F.lit("week "), F.least(F.floor((F.dayofmonth("day") - 1) / 7) + 1, F.lit(4)).cast("string")),
        F.when(F.weekday("day") >= 5, "weekend").otherwise("working"))).alias("slice"))
    g = rows.groupBy("slice").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("days"))
    late = daily.agg(F.sum(F.when(F.weekday("day") >= 5, F.col("count"))).alias("weekend"), F.sum("count").alias("all"))
    return g.withColumns({"weekday_to_weekend_ratio": F.round(late.select((F.col("all") - F.col("weekend")) / F.col("weekend")).scalar(), 9),
                          "mean_per_day": F.round(F.col("count") / F.col("days"), 9),
                          "share": F.round(F.col("count") / daily.agg(F.sum("count")).scalar(), 9)})


def gap_stats(rows: DataFrame, by: Sequence[str], support: int, value: str = "gap_seconds") -> DataFrame:
    """Size, threshold shares, share beyond the last threshold and quantiles of gaps per group with a
    minimum size; without groups, one row of all."""
    rows = rows.filter(F.col(value).isNotNull()).withColumn("__all", F.lit(1))
    by = list(by) or ["__all"]
    shares = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[
        F.round(F.avg(flag(F.col(value) <= s)), 9).alias(f"within_{s}") for s in GAP_THRESHOLDS],
        F.round(F.avg(flag(F.col(value) > GAP_THRESHOLDS[-1])), 9).alias(f"over_{GAP_THRESHOLDS[-1]}")).filter(F.col("n") >= support)
    return shares.join(quantiles(rows, value, QUANTILES, by), by).drop("__all")


def terminal_table(outcomes: DataFrame, events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Probabilities of the outcomes and counts of terminals with an observed approval chain."""
    ts = F.col("event_datetime")
    details = events.filter(among("journey_substage", spec.prerequisites)).groupBy("application_id").agg(F.min("event_datetime").alias("d"))
    t = outcomes.select("application_id", "terminal_datetime", "outcome")
    chain = (events.filter(is_label(spec.approval)).join(t.filter("terminal_datetime is not null").select("application_id", "terminal_datetime"), "application_id")
             .join(details, "application_id", "left").groupBy("application_id").agg(
                 F.max(flag((F.col("d") < ts) & (ts <= F.col("terminal_datetime")))).alias("strict"),
                 F.max(flag((F.col("d") <= ts) & (ts <= F.col("terminal_datetime")))).alias("weak"), F.lit(1).alias("any")))
    rows = t.join(chain, "application_id", "left")
    is_ = lambda o: n_if(F.col("outcome") == o)
    n = F.count(F.lit(1))
    return rows.agg(n.alias("apps"), is_("TERMINAL").alias("ptp_apps"), is_("EXPIRED").alias("expiry_apps"), is_("CENSORED").alias("censored_apps"),
                    F.round(is_("TERMINAL") / n, 9).alias("ptp_probability"), F.round(is_("EXPIRED") / n, 9).alias("expiry_probability"),
                    F.coalesce(F.sum("strict"), F.lit(0)).alias("strict_chain"), F.coalesce(F.sum("weak"), F.lit(0)).alias("weak_chain"),
                    n_if((F.col("outcome") == "TERMINAL") & F.col("any").isNull()).alias("without_approval"))


def ending_times(outcomes: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Quantiles of the seconds from creation to the terminal, and to expiry."""
    ended = outcomes.filter("outcome in ('TERMINAL', 'EXPIRED')").withColumn(
        "seconds", seconds_between("application_created_at", F.coalesce("terminal_datetime", "deadline")))
    return quantiles(ended, "seconds", QUANTILES, ["outcome"])


def funnel(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Rows, applications and repeats per step, with the conversion from the step before."""
    steps = {"created": (spec.creation,), "prerequisite": spec.prerequisites, "approval": (spec.approval,), "terminal": (spec.terminal,)}
    per = events.groupBy("application_id").agg(*[F.sum(flag(among("journey_substage", v))).alias(k) for k, v in steps.items()])
    wide = per.agg(*[F.sum(k).alias(f"{k}_rows") for k in steps], *[F.sum(flag(F.col(k) > 0)).cast("long").alias(f"{k}_apps") for k in steps])
    names = list(steps)
    items = F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"{k}_rows").cast("long").alias("rows"), F.col(f"{k}_apps").alias("applications"),
                               (F.col(f"{k}_rows") - F.col(f"{k}_apps")).cast("long").alias("repeats"),
                               (F.round(F.col(f"{k}_apps") / F.col(f"{names[i - 1]}_apps"), 9) if i else F.lit(1.0)).alias("conversion")) for i, k in enumerate(names)])
    return wide.select(F.inline(items))


def day_metrics(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Rows, sends and terminals per day with running totals. One row per day reaches the window."""
    d = events.groupBy(F.to_date("event_datetime").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), n_if(is_label("campaign_sent")).alias("sends"), n_if(is_label(spec.terminal)).alias("terminals"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns({f"total_{c}": F.sum(c).over(w) for c in ("rows", "sends", "terminals")})


def reason_counts(audit: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """Reasons of continuation records, overall and inside a cohort."""
    rows = audit.filter("category = 'ORGANIC_CONTINUATION'").withColumn(
        "reason", F.coalesce("explanation.reason", "explanation.selected_outcome", F.lit("UNKNOWN")))
    if cohort is not None:
        rows = rows.join(cohort.select("application_id", F.lit(1).alias("__in")), "application_id", "left")
    inside = F.lit(0) if cohort is None else F.coalesce("__in", F.lit(0))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("all"), F.sum(inside).cast("long").alias("carried"))


def inspect(events: DataFrame, n: int = 3, seed: int = 7) -> DataFrame:
    """Whole journeys of n applications picked by hash, as ordered rows."""
    picks = (events.filter("application_id is not null").select("application_id").distinct()
             .orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "application_id"), 256)).limit(n))
    rows = events.join(picks, "application_id", "left_semi")
    return scan(rows, ["application_id"], ["event_datetime", "source_row"], position=Running("sum", F.lit(1)))

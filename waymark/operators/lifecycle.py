"""Linking events to lifecycles, cleaning, terminal rules, state at a cutoff, customer identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import among, flag, micros, ntz, plus_seconds, seconds_between
from ..spec import EVENT_COLUMNS, LifecycleSpec
from .ordered import GEOMETRY, Running, Shift, arrange, asof, is_cold, like_parts, no_parts, repart, scan

APP = ["application_id"]
TIMELINE = ["event_datetime", "source_row"]


def is_label(label: str) -> Column:
    return F.col("journey_substage") == label


# --- joins with a stated multiplicity ----------------------------------------------------------

def many_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi join that fails at run time when `key` repeats on the right."""
    rest = [x for x in right.columns if x != key]
    single = right.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.first(x).alias(x) for x in rest])
    single = single.filter(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string"))).cast("boolean"))
                           .otherwise(F.lit(True))).drop("__n")
    return left.join(single, key, how)


def link(events: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """Events joined to their lifecycle; rows of another context are dropped."""
    owner = lifecycles.select("application_id", F.col("context_id").alias("owner_context_id"),
                              "application_created_at", "deadline")
    rows = events.drop("application_created_at", "deadline").filter(F.col("application_id").isNotNull())
    rows = many_to_one(rows, owner, "application_id")
    return arrange(rows.filter(F.col("context_id") == F.col("owner_context_id")), APP)


def in_window(inclusive: bool = False) -> Column:
    end = F.col("event_datetime") <= F.col("deadline") if inclusive else F.col("event_datetime") < F.col("deadline")
    return (F.col("event_datetime") >= F.col("application_created_at")) & end


# --- cleaning ------------------------------------------------------------------------------------

def drop_exact_duplicates(events: DataFrame, columns: Sequence[str] = EVENT_COLUMNS) -> DataFrame:
    """One row per distinct content, the earliest in source order; `copies` counts what it stands for.
    Grouping is NULL-safe and combines before the shuffle, so masses of copies stay cheap."""
    carried = [x for x in events.columns if x not in columns and x != "source_row"]
    return (events.groupBy(*columns, *carried)
            .agg(F.min("source_row").alias("source_row"), F.count(F.lit(1)).alias("copies")))


def truncate_at_terminal(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Rows up to and including the first terminal in (time, source order)."""
    rows = scan(events, APP, TIMELINE, __done=Running("sum", flag(is_label(spec.terminal)), inclusive=False))
    return rows.filter(F.col("__done") == 0).drop("__done")


def truncate_at_terminal_time(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Rows up to the first terminal's time; later copies of the terminal at that time are dropped."""
    terminal = is_label(spec.terminal)
    rows = scan(events, APP, TIMELINE, __first=Running(
        "min", F.when(terminal, F.col("event_datetime")), inclusive=False))
    keep = F.col("__first").isNull() | ((F.col("event_datetime") <= F.col("__first")) & ~F.coalesce(terminal, F.lit(False)))
    return rows.filter(keep).drop("__first")


def clean(events: DataFrame, spec: LifecycleSpec, mode: str = "builder") -> DataFrame:
    """Deduplicated, windowed, terminal-safe events; rows must carry their lifecycle columns.

    builder: duplicates first, half-open window, truncation by (time, order).
    evaluator: window first, then duplicates, truncation by time.
    inclusive: the deadline instant counts, duplicates stay, truncation by (time, order).
    """
    rows = events.filter(F.col("application_id").isNotNull())
    if mode == "builder":
        return truncate_at_terminal(drop_exact_duplicates(rows).drop("copies").filter(in_window()), spec)
    if mode == "evaluator":
        return truncate_at_terminal_time(drop_exact_duplicates(rows.filter(in_window())).drop("copies"), spec)
    if mode == "inclusive":
        return truncate_at_terminal(rows, spec).filter(in_window(True))
    raise ValueError(f"unknown cleaning mode: {mode}")


def cleaning_counts(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """One row of stage counts of the builder rule, in a single pass."""
    rows = drop_exact_duplicates(events.filter(F.col("application_id").isNotNull()))
    rows = rows.withColumn("__in", in_window())
    rows = scan(rows, APP, TIMELINE, __done=Running(
        "sum", flag(F.col("__in") & is_label(spec.terminal)), inclusive=False))
    return rows.agg(
        F.sum("copies").alias("linked_rows"),
        F.sum(F.col("copies") - 1).alias("exact_duplicate_rows"),
        F.sum(flag(F.col("__in"))).cast("long").alias("owner_lifecycle_rows"),
        F.sum(flag(F.col("__in") & (F.col("__done") == 0))).cast("long").alias("eligible_events"))


def creation_donors(events: DataFrame, lifecycles: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """First creation row per application that equals the registered time and owner."""
    rows = link(events.filter(is_label(spec.creation)), lifecycles)
    rows = rows.filter(F.col("event_datetime") == F.col("application_created_at"))
    return rows.groupBy("application_id").agg(
        F.min_by(F.struct("context_id", "event_datetime", "event_name", "source_row"),
                 F.col("source_row")).alias("r")).select("application_id", "r.*")


# --- terminal classification ---------------------------------------------------------------------

def classify_terminals(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Every terminal row with its class, the approval it follows, and how directly.

    The deadline instant itself is valid; only the first valid terminal counts, later ones are
    post-terminal whatever else they break.
    """
    ts, created = F.col("event_datetime"), F.col("application_created_at")
    rows = events.filter(F.col("application_id").isNotNull())
    journey = ~among("journey_substage", spec.campaign) & F.col("journey_substage").isNotNull()
    rows = scan(rows, APP, TIMELINE,
                latest_approval=Running("last", F.when(is_label(spec.approval) & (ts >= created), ts), inclusive=False),
                previous_label=Running("last", F.when(journey, F.col("journey_substage")), inclusive=False))
    terminal = is_label(spec.terminal)
    good = (terminal & created.isNotNull() & (ts >= created) & (ts <= F.col("deadline"))
            & F.col("latest_approval").isNotNull())
    rows = scan(rows, APP, TIMELINE, __valid_before=Running("sum", flag(good), inclusive=False))
    shared = (events.filter(F.col("application_id").isNotNull()).groupBy("application_id")
              .agg(F.min("context_id").alias("__a"), F.max("context_id").alias("__b"))
              .filter(F.col("__a") != F.col("__b")).select("application_id", F.lit(True).alias("__shared")))
    rows = rows.filter(terminal).join(shared, "application_id", "left")
    reason = (F.when(F.col("__shared"), "NON_UNIQUE_APPLICATION_OWNERSHIP")
              .when(created.isNull(), "MISSING_OBSERVED_CREATION")
              .when(ts.isNull(), "MISSING_EVENT_TIME")
              .when(ts < created, "PTP_BEFORE_CREATION"))
    return rows.select(
        "application_id", "context_id", "event_datetime", "source_row",
        F.when(reason.isNotNull(), "PTP_AMBIGUOUS_APPLICATION")
        .when(F.col("__valid_before") > 0, "POST_TERMINAL_PTP")
        .when(ts > F.col("deadline"), "PTP_AFTER_EXPIRY")
        .when(F.col("latest_approval").isNull(), "PTP_WITHOUT_PRIOR_AIP")
        .otherwise("VALID_PROGRESSION_PTP").alias("classification"),
        reason.alias("reason"),
        F.col("latest_approval").alias("latest_prior_aip_datetime"),
        seconds_between("latest_approval", "event_datetime").alias("aip_to_ptp_seconds"),
        F.coalesce(F.col("previous_label") == spec.approval, F.lit(False)).alias("directly_after_aip"))


def first_terminals(events: DataFrame, spec: LifecycleSpec) -> DataFrame:
    return (events.filter(is_label(spec.terminal) & F.col("application_id").isNotNull())
            .groupBy("application_id").agg(F.min("event_datetime").alias("terminal_datetime")))


def outcomes(lifecycles: DataFrame, events: DataFrame, spec: LifecycleSpec, window_end: str) -> DataFrame:
    """TERMINAL, EXPIRED or CENSORED per application at the end of the window."""
    rows = lifecycles.join(first_terminals(events, spec), "application_id", "left")
    return rows.withColumn("outcome", F.when(F.col("terminal_datetime").isNotNull(), "TERMINAL")
                           .when(F.col("deadline") <= ntz(window_end), "EXPIRED").otherwise("CENSORED"))


# --- state at a cutoff -----------------------------------------------------------------------------

def state_at(events: DataFrame, cutoffs: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """State of an application from the rows visible at each (application_id, cutoff).

    The state runs along the application's rows once and every cutoff reads it as of its time, so
    many cutoffs on a long history cost their sum, not their product.
    """
    ts, label = F.col("event_datetime"), F.col("journey_substage")
    journey = ~among(label, spec.campaign)
    rows = events.filter(F.col("application_id").isNotNull())
    rows = scan(rows, ["application_id", "journey_substage"], TIMELINE, __before=Running("sum", F.lit(1), inclusive=False))
    when = lambda name: F.when(is_label(name), ts)
    seen = lambda names: Running("max", flag(among(label, names)))
    features = {
        "latest": Running("last", F.when(journey, F.struct("event_datetime", "journey_stage", "journey_substage"))),
        "created": Running("min", when(spec.creation)), "registered": Running("min", F.col("application_created_at")),
        "form": seen(spec.form + spec.prerequisites), "details": seen(spec.prerequisites), "approved": seen((spec.approval,)),
        "closed": seen((spec.close,)), "latest_aip_datetime": Running("max", when(spec.approval)),
        "first_terminal": Running("min", when(spec.terminal)), "last_event": Running("max", ts),
        "campaign_sends_seen": Running("sum", flag(is_label("campaign_sent"))),
        "last_campaign_send_datetime": Running("max", when("campaign_sent")),
        "context_id": Running("min", F.col("context_id")), "ctx_hi": Running("max", F.col("context_id")),
        "observed_journey_substages": Running("collect", F.when(journey & (F.col("__before") == 0), label))}
    rows = scan(rows, APP, TIMELINE, **features)
    points = like_parts(cutoffs, rows, "application_id", micros("cutoff"))
    s = asof(points, rows, APP, micros("cutoff"), micros("event_datetime"), {n: F.col(n) for n in features}, tie=F.col("source_row"))
    s = s.filter(F.col("last_event").isNotNull()).withColumn("creation_datetime", F.coalesce("created", "registered"))
    s = s.withColumn("deadline", plus_seconds("creation_datetime", spec.validity_seconds))
    done = F.col("first_terminal").isNotNull()
    expired = ~done & (F.col("cutoff") >= F.col("deadline"))
    return s.select(
        "application_id", "cutoff", "context_id", "creation_datetime", "deadline", "latest.journey_stage", "latest.journey_substage",
        F.col("latest.event_datetime").alias("last_journey_datetime"),
        *[(F.col(a) > 0).alias(b) for a, b in (("form", "form_filled_seen"), ("details", "professional_details_seen"),
                                               ("approved", "aip_approved_seen"), ("closed", "journey_close_seen"))],
        "latest_aip_datetime", (done | expired).alias("done"), done.alias("success"),
        F.when(done, "PUSH_TO_PARTNER_SUCCESS").when(expired, "APPLICATION_EXPIRED_30_DAYS").alias("termination_reason"),
        F.when(done, F.col("first_terminal")).when(expired, F.col("deadline")).alias("terminal_datetime"),
        "campaign_sends_seen", "last_campaign_send_datetime", "observed_journey_substages",
        F.when(F.col("context_id") != F.col("ctx_hi"), "MANY_CONTEXTS")
        .when(F.col("latest").isNull(), "NO_JOURNEY_STATE")
        .when(F.col("last_event") > F.col("first_terminal"), "ROWS_AFTER_TERMINAL")
        .when(F.col("creation_datetime").isNull(), "MISSING_CREATION")
        .when(F.col("last_event") > F.col("deadline"), "ROWS_AFTER_EXPIRY").alias("violation"))


def active_days(states: DataFrame, start: str, end: str) -> DataFrame:
    """One opportunity per active day: the window start on the first day, midnight afterwards.
    `states`: application_id, activation, deadline, terminal_datetime (nullable)."""
    lo = F.greatest(ntz(start), F.col("activation"))
    hi = F.least(ntz(end), F.col("deadline"), F.col("terminal_datetime"))
    rows = states.withColumns({"__lo": lo, "__hi": hi}).filter(F.col("__lo") < F.col("__hi"))
    last = F.date_trunc("day", plus_seconds("__hi", -0.000001))
    days = F.sequence(F.to_date("__lo"), F.to_date(last), F.expr("interval 1 day"))
    rows = rows.withColumn("day", F.explode(days))
    return rows.withColumn("opportunity", F.greatest(F.col("day").cast("timestamp_ntz"), F.col("__lo"))).drop("__lo", "__hi")


# --- customer identity -------------------------------------------------------------------------------

BY_CREATION = ["application_created_at", "source_row"]


def customer_kind(lifecycles: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Adds the previous creation of the context, the gap, and NEW / RETURNING."""
    rows = scan(lifecycles, ["context_id"], BY_CREATION,
                prior_created_at=Shift(F.col("application_created_at")),
                prior_application_id=Shift(F.col("application_id")),
                prior_deadline=Shift(F.col("deadline")))
    gap = seconds_between("prior_created_at", "application_created_at")
    return rows.withColumn("gap_days", gap / 86400).withColumn(
        "customer_kind", F.when(gap >= spec.returning_seconds, "RETURNING_CUSTOMER").otherwise("NEW_CUSTOMER"))


def any_earlier_creation(lifecycles: DataFrame, spec: LifecycleSpec) -> DataFrame:
    rows = scan(lifecycles, ["context_id"], BY_CREATION,
                first_created_at=Running("min", F.col("application_created_at"), inclusive=False))
    gap = seconds_between("first_created_at", "application_created_at")
    return rows.withColumn("returning", F.coalesce(gap >= spec.returning_seconds, F.lit(False)))


def regroup_contexts(lifecycles: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Counter that rises whenever the next creation of a context comes before the previous expires."""
    rows = scan(lifecycles, ["context_id"], BY_CREATION, __prev=Shift(F.col("application_created_at")))
    close = F.coalesce(seconds_between("__prev", "application_created_at") < spec.validity_seconds, F.lit(False))
    return scan(rows, ["context_id"], BY_CREATION, context_group=Running("sum", flag(close))).drop("__prev")


def business_stage_map(events: DataFrame) -> DataFrame:
    """Most supported stage of each label; ties go to the first stage by name."""
    n = (events.filter(F.col("journey_stage").isNotNull()).groupBy("journey_substage", "journey_stage")
         .agg(F.count(F.lit(1)).alias("support_count")))
    return (n.groupBy("journey_substage")
            .agg(F.min(F.struct((-F.col("support_count")).alias("k"), "journey_stage", "support_count")).alias("b"))
            .select("journey_substage", "b.journey_stage", "b.support_count"))


# --- interval work: linear sweeps instead of pair joins ------------------------------------------------

def one_line(line: DataFrame, *sources: DataFrame) -> DataFrame:
    """Carry the no-hot-keys mark over a union only when every source has it."""
    line = line.drop(*GEOMETRY)
    if all(is_cold(s) for s in sources):
        return no_parts(line)
    return line.withColumn("part", F.col("part").alias("part", metadata={}))


def active_at(points: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """Lifecycle of the same context that is active at each point (of several the one that ends last),
    and how many are: more than one is the caller's to judge.

    Starts count +1 and ends -1 on one ordered line per context, so the cost is linear however many
    lifecycles a context has. `points`: context_id, at, part and its geometry, plus anything.
    """
    def side(df, at, kind, step):
        return repart(df, micros(at)).select("context_id", "part", micros(at).alias("__at"), F.lit(kind).alias("__kind"),
                         F.lit(step).alias("__step"), F.col("source_row").alias("__tie"),
                         F.struct("deadline", "application_created_at", "source_row", "application_id").alias("__life"))
    row = F.struct(*[F.col(x) for x in points.columns])
    line = (side(lifecycles, "application_created_at", 1, 1)
            .unionByName(side(lifecycles, "deadline", 0, -1).withColumn("__life", F.when(F.lit(False), F.col("__life"))))
            .unionByName(repart(points, micros("at")).select("context_id", "part", micros("at").alias("__at"), F.lit(2).alias("__kind"),
                                       F.lit(0).alias("__step"), F.lit(0).cast("long").alias("__tie"), row.alias("__row")),
                         allowMissingColumns=True))
    line = one_line(line, points, lifecycles)
    line = scan(line, ["context_id"], ["__at", "__kind", "__tie"],
                active_count=Running("sum", F.col("__step")), __last=Running("max", F.col("__life")))
    # of all lifecycles started so far the one that ends last is active if any is
    return line.filter(F.col("__row").isNotNull()).select(
        "__row.*", "active_count",
        F.when(F.col("active_count") > 0, F.col("__last.application_id")).alias("active_application_id"))


def overlap_counts(new: DataFrame, registered: DataFrame) -> DataFrame:
    """Number of registered lifecycles of the same context that overlap each new one:
    registered starts before the new end, minus registered ends at or before the new start."""
    def marks(df, at, kind, start=0, end=0):
        return repart(df, micros(at)).select("context_id", "part", micros(at).alias("__at"), F.lit(kind).alias("__kind"),
                         F.lit(start).alias("__s"), F.lit(end).alias("__e"), F.col("source_row").alias("__tie"))
    # order at one instant: registered end, new start, new end, registered start
    q = lambda at, kind: repart(new, micros(at)).select("context_id", "part", micros(at).alias("__at"), F.lit(kind).alias("__kind"),
                                    F.lit(0).alias("__s"), F.lit(0).alias("__e"), F.col("source_row").alias("__tie"),
                                    F.col("application_id").alias("__new"))
    line = (marks(registered, "deadline", 0, end=1).unionByName(marks(registered, "application_created_at", 3, start=1))
            .unionByName(q("application_created_at", 1), allowMissingColumns=True)
            .unionByName(q("deadline", 2), allowMissingColumns=True))
    line = one_line(line, new, registered)
    line = scan(line, ["context_id"], ["__at", "__kind", "__tie"],
                __ends=Running("sum", F.col("__e")), __starts=Running("sum", F.col("__s")))
    return (line.filter(F.col("__new").isNotNull()).groupBy(F.col("__new").alias("application_id"))
            .agg((F.max(F.when(F.col("__kind") == 2, F.col("__starts")))
                  - F.max(F.when(F.col("__kind") == 1, F.col("__ends")))).alias("overlaps"))
            .filter(F.col("overlaps") > 0))


def screen_arrivals(arrivals: DataFrame, registry: DataFrame) -> DataFrame:
    """REUSED when the context already has an active lifecycle, else ACTIVATED.

    `arrivals` is one batch no longer than the validity (the daily job passes a day): within it the
    first free arrival of a context opens a lifecycle that covers every later one of the batch.
    """
    found = active_at(arrivals.withColumn("at", F.col("application_created_at")), registry)
    free = F.col("active_count") == 0
    found = scan(found, ["context_id"], BY_CREATION, __opened=Running("sum", flag(free), inclusive=False))
    return found.withColumn("status", F.when(free & (F.col("__opened") == 0), "ACTIVATED").otherwise("REUSED")).drop("__opened", "at")


# --- campaign rules ---------------------------------------------------------------------------------

def suppress_sends(sends: DataFrame, terminals: DataFrame) -> DataFrame:
    """Status of a scheduled send given the application's end, terminal or expiry, which
    `suppression_reason` tells apart."""
    rows = sends.join(terminals, "application_id", "left")
    at = F.col("scheduled_at")
    reason = F.when(F.col("terminal_datetime") <= at, "TERMINAL").when(at >= F.col("deadline"), "EXPIRY")
    return rows.withColumns({"suppression_reason": reason, "status": F.when(reason.isNotNull(), "SUPPRESSED_BY_TERMINAL").otherwise("SENT")})


def attribute_responses(events: DataFrame, spec: LifecycleSpec, horizon_seconds: int,
                        responses: Column | None = None) -> DataFrame:
    """First response of each send before the next send and within the horizon.

    RESPONDED, CENSORED_BY_COMPETING_SEND (a next send came inside the horizon first), or NO_RESPONSE.
    """
    rows = events.filter(F.col("application_id").isNotNull())
    sent = is_label("campaign_sent")
    rows = scan(rows, APP, TIMELINE,
                __send=Running("last", F.when(sent, F.struct(F.col("source_row").alias("row"), F.col("event_datetime").alias("at"))), inclusive=False))
    responses = ~sent if responses is None else responses
    hits = rows.filter(responses & F.col("__send").isNotNull()
                       & (seconds_between("__send.at", "event_datetime") <= horizon_seconds))
    first = hits.groupBy("application_id", F.col("__send.row").alias("source_row")).agg(
        F.min(F.struct(*TIMELINE, "journey_substage")).alias("__r"))
    sends = scan(rows.filter(sent).drop("__send"), APP, TIMELINE, next_send=Shift(F.col("event_datetime"), -1))
    out = sends.join(first.withColumnRenamed("source_row", "__sr"),
                     (sends["application_id"] == first["application_id"]) & (sends["source_row"] == F.col("__sr")), "left"
                     ).drop(first["application_id"]).drop("__sr")
    gap = seconds_between("event_datetime", "next_send")
    return out.withColumns({
        "response": F.col("__r.journey_substage"),
        "response_delay_seconds": seconds_between("event_datetime", "__r.event_datetime"),
        "status": F.when(F.col("__r").isNotNull(), "RESPONDED")
        .when(gap <= horizon_seconds, "CENSORED_BY_COMPETING_SEND").otherwise("NO_RESPONSE")}).drop("__r")

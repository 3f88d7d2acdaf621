"""Integrity checks. Each returns a DataFrame of violations; empty means the rule holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import among, flag, ntz
from ..spec import LifecycleSpec
from .lifecycle import APP, TIMELINE, first_terminals, is_label
from .ordered import GEOMETRY, PART, Running, Shift, mark_parts, scan


def schema_violations(df: DataFrame, expected: T.StructType, exact: bool = False) -> list[str]:
    """Missing columns and wrong types, and with `exact` also extra columns and order. Runs no job."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = [f"missing column {f.name}" for f in expected.fields if f.name not in have]
    out += [f"column {f.name} is {have[f.name].simpleString()}, expected {f.dataType.simpleString()}"
            for f in expected.fields if f.name in have and have[f.name] != f.dataType]
    if exact and [f.name for f in expected.fields] != df.columns:
        out.append("columns are not in the required order")
    return out


def column_conformity(df: DataFrame, expected: T.StructType) -> DataFrame:
    """column_name, found (type, or missing), rows, nulls, unfit per expected column: how many values are NULL and how many
    the expected type cannot hold. One pass over the columns that are there, a counter each."""
    have = {f.name: f.dataType for f in df.schema.fields}
    sums = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(expected.fields):
        x = F.col(f"`{f.name}`") if f.name in have else F.lit(None)
        unfit = x.isNotNull() & x.try_cast(f.dataType).isNull() if f.name in have else F.lit(False)
        sums += [F.count(F.when(x.isNull(), 1)).alias(f"n{i}"), F.count(F.when(unfit, 1)).alias(f"u{i}")]
    lines = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(have[f.name].simpleString() if f.name in have else "missing").alias("found"), F.col("rows"),
                               F.col(f"n{i}").alias("nulls"), F.col(f"u{i}").alias("unfit")) for i, f in enumerate(expected.fields)])
    return df.agg(*sums).select(F.inline(lines))


def as_rule(df: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    detail = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.alias("detail"))


def null_keys(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return as_rule(df.filter(F.size(bad) > 0), "NULL_KEY", F.col(key), F.array_join(bad, ","))


def invalid_times(df: DataFrame, text: str, key: str) -> DataFrame:
    bad = F.col(text).isNotNull() & F.expr(f"try_to_timestamp({text})").isNull()
    return as_rule(df.filter(bad), "INVALID_TIME", F.col(key), F.col(text))


def shared_applications(df: DataFrame) -> DataFrame:
    """Applications owned by more than one context: min and max differ, so no set is collected."""
    g = df.filter("application_id is not null").groupBy("application_id").agg(
        F.min("context_id").alias("a"), F.max("context_id").alias("b")).filter("a <> b")
    return as_rule(g, "SHARED_APPLICATION", F.col("application_id"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return as_rule(g, "DUPLICATE_KEY", F.col(key), F.col("n"))


def already_present(incoming: DataFrame, history: DataFrame, key: str) -> DataFrame:
    return as_rule(incoming.join(history.select(key), key, "left_semi"), "ALREADY_PRESENT", F.col(key))


def out_of_order_append(incoming: DataFrame, history: DataFrame) -> DataFrame:
    new = incoming.groupBy("application_id").agg(F.min("event_datetime").alias("first_new"))
    old = history.groupBy("application_id").agg(F.max("event_datetime").alias("last_old"))
    return as_rule(new.join(old, "application_id").filter("first_new < last_old"), "OUT_OF_ORDER", F.col("application_id"))


def source_profile(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows, first and last time, and whether all lie in [lo, hi)."""
    p = df.agg(F.count(F.lit(1)).alias("rows"), F.min("event_datetime").alias("first"), F.max("event_datetime").alias("last"))
    return p.withColumn("inside", (F.col("first") >= ntz(lo)) & (F.col("last") < ntz(hi)))


def outside_day(df: DataFrame, day: str, end: str) -> DataFrame:
    bad = (F.to_date("event_datetime") != F.col(day)) | (F.col("event_datetime") >= ntz(end))
    return as_rule(df.filter(bad), "OUTSIDE_DAY", F.col("source_row"), F.col(day))


def time_regressions(df: DataFrame, hot_rows: int = LifecycleSpec.hot_rows) -> DataFrame:
    """Rows earlier than the row stored before them in the same application. Hot applications are cut
    by `source_row`, the order of this scan, whatever they came cut by."""
    rows = mark_parts(df.filter("application_id is not null").drop(PART, *GEOMETRY), APP, F.col("source_row"), hot_rows)
    rows = scan(rows, APP, ["source_row"], __prev=Shift(F.col("event_datetime")))
    return as_rule(rows.filter(F.col("__prev") > F.col("event_datetime")), "TIME_REGRESSION", F.col("source_row"))


def after_terminal(df: DataFrame, spec: LifecycleSpec, same_time: bool = False) -> DataFrame:
    """Rows strictly later than the first terminal, or with `same_time` any row ordered after it."""
    rows = df.filter("application_id is not null")
    if same_time:
        rows = scan(rows, APP, TIMELINE, __done=Running("sum", flag(is_label(spec.terminal)), inclusive=False)).filter("__done > 0")
    else:
        rows = rows.join(first_terminals(df, spec), "application_id").filter("event_datetime > terminal_datetime")
    return as_rule(rows, "AFTER_TERMINAL", F.col("source_row"))


def creation_counts(df: DataFrame, arrivals: DataFrame, carried: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Arrivals need exactly one creation row, carried applications none."""
    made = df.filter(is_label(spec.creation) & F.col("application_id").isNotNull()).groupBy("application_id").agg(F.count(F.lit(1)).alias("n"))
    return (as_rule(made.filter("n > 1"), "REPEATED_CREATION", F.col("application_id"), F.col("n"))
            .unionByName(as_rule(arrivals.join(made, "application_id", "left_anti"), "MISSING_CREATION", F.col("application_id")))
            .unionByName(as_rule(carried.join(made, "application_id", "left_semi"), "CARRIED_CREATION", F.col("application_id"))))


def overlapping_lifecycles(lifecycles: DataFrame) -> DataFrame:
    rows = scan(lifecycles, ["context_id"], ["application_created_at", "source_row"], __prev=Shift(F.col("deadline")))
    return as_rule(rows.filter(F.col("__prev") > F.col("application_created_at")), "OVERLAPPING_LIFECYCLE", F.col("application_id"))


def missing_names(df: DataFrame) -> DataFrame:
    return as_rule(df.filter(F.coalesce(F.col("event_name"), F.lit("")) == ""), "MISSING_EVENT_NAME", F.col("source_row"))


def row_reconciliation(history: DataFrame, days: DataFrame, combined: DataFrame) -> DataFrame:
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    one = history.sparkSession.range(1).select(n(history).alias("history_rows"), n(days).alias("daily_rows"), n(combined).alias("combined_rows"))
    return one.withColumn("reconciled", F.col("history_rows") + F.col("daily_rows") == F.col("combined_rows"))


def outside_lifecycle(df: DataFrame, lifecycles: DataFrame, spec: LifecycleSpec) -> DataFrame:
    """Rows before creation or after the deadline; at the deadline itself only the terminal may happen."""
    own = lifecycles.select("application_id", F.col("application_created_at").alias("__c"), F.col("deadline").alias("__d"))
    rows = df.join(own, "application_id")
    bad = ((F.col("event_datetime") < F.col("__c")) | (F.col("event_datetime") > F.col("__d"))
           | ((F.col("event_datetime") == F.col("__d")) & ~F.coalesce(is_label(spec.terminal), F.lit(False))))
    return as_rule(rows.filter(bad), "OUTSIDE_LIFECYCLE", F.col("source_row"))


def expired_removals(before: DataFrame, after: DataFrame, terminals: DataFrame, boundary: str) -> DataFrame:
    """Applications gone from one snapshot to the next without a terminal and before their deadline."""
    gone = before.join(after.select("application_id"), "application_id", "left_anti").join(terminals, "application_id", "left")
    bad = gone.filter(F.col("terminal_datetime").isNull() & (F.col("deadline") > ntz(boundary)))
    return as_rule(bad, "UNEXPLAINED_REMOVAL", F.col("application_id"))


def origin_flags(df: DataFrame, simulated: Sequence[str]) -> DataFrame:
    return as_rule(df.filter(among("data_origin", simulated) != F.col("is_simulated")), "ORIGIN_FLAG", F.col("source_row"), F.col("data_origin"))


def law_violations(law: DataFrame, by: Sequence[str], spec: LifecycleSpec) -> DataFrame:
    """Bad masses, pools above one, repeated labels, company for the terminal, forbidden labels."""
    mass, labels = F.col("mass"), F.from_json("labels", "array<string>")
    key = F.concat_ws("|", *[F.col(b).cast("string") for b in by])
    rows = law.withColumn("__l", labels)
    bad = lambda cond, rule: as_rule(rows.filter(cond), rule, key, F.col("labels"))
    pools = law.groupBy(*by).agg(F.sum("mass").alias("m")).filter(F.round("m", 9) > 1)
    banned = F.array(*map(F.lit, (spec.creation, *spec.campaign)))
    return (bad(mass.isNull() | F.isnan(mass) | (mass < 0), "BAD_MASS")
            .unionByName(as_rule(pools, "POOL_ABOVE_ONE", key, F.round("m", 6)))
            .unionByName(bad(F.size(F.array_distinct("__l")) < F.size("__l"), "REPEATED_LABEL"))
            .unionByName(bad(F.array_contains("__l", spec.terminal) & (F.size("__l") > 1), "TERMINAL_NOT_ALONE"))
            .unionByName(bad(F.arrays_overlap("__l", banned), "FORBIDDEN_LABEL")))


def row_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Named conditions that mark a bad row; one output row per broken rule."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))
    return df.withColumn("rule", F.explode(hits)).select("rule", F.col(key).cast("string").alias("key"))


# Decision-log vocabulary.
ELIGIBILITY = ("ELIGIBLE", "INELIGIBLE")
DECISION_ACTIONS = ("SEND", "NO_ACTION")
DECISION_STATUSES = ("NO_ACTION", "SCHEDULED", "REALIZED", "SUPPRESSED_TERMINAL", "SUPPRESSED_DELIVERY", "CANCELED")


def decision_log_violations(df: DataFrame, channels: Sequence[str], buckets: Sequence[str]) -> DataFrame:
    """Broken rules of a decision log, one row each. Columns: decision_id, eligibility_status, action,
    channel, time_bucket, opportunity_datetime, scheduled_send_datetime, realized_send_datetime,
    outcome_status, suppression_reason."""
    eligible, send = F.col("eligibility_status") == "ELIGIBLE", F.coalesce(F.col("action") == "SEND", F.lit(False))
    status = F.col("outcome_status")
    stopped = among(status, ("SUPPRESSED_TERMINAL", "SUPPRESSED_DELIVERY", "CANCELED"))
    planned = among(status, ("SCHEDULED", "REALIZED", "SUPPRESSED_TERMINAL", "SUPPRESSED_DELIVERY"))
    realized = F.coalesce(status == "REALIZED", F.lit(False))
    rows = row_rules(df, "decision_id", {
        "ELIGIBILITY_UNKNOWN": ~among("eligibility_status", ELIGIBILITY),
        "ACTION_UNKNOWN": eligible & ~among("action", DECISION_ACTIONS),
        "ACTION_FORBIDDEN": (F.col("eligibility_status") == "INELIGIBLE") & F.col("action").isNotNull(),
        "STATUS_UNKNOWN": ~among(status, DECISION_STATUSES),
        "CHANNEL_REQUIRED": send & ~among("channel", channels),
        "BUCKET_REQUIRED": send & ~among("time_bucket", buckets),
        "FIELDS_FORBIDDEN": ~send & (F.col("channel").isNotNull() | F.col("time_bucket").isNotNull()),
        "SCHEDULE_REQUIRED": planned & F.col("scheduled_send_datetime").isNull(),
        "SEND_BEFORE_DECISION": F.col("scheduled_send_datetime") < F.col("opportunity_datetime"),
        "REALIZED_REQUIRED": realized & F.col("realized_send_datetime").isNull(),
        "REALIZED_FORBIDDEN": ~realized & F.col("realized_send_datetime").isNotNull(),
        "REALIZED_BEFORE_SCHEDULE": F.col("realized_send_datetime") < F.col("scheduled_send_datetime"),
        "REASON_REQUIRED": stopped & F.col("suppression_reason").isNull(),
        "STATUS_MISMATCH": send == F.coalesce(status == "NO_ACTION", F.lit(False))})
    return rows.unionByName(duplicate_keys(df, "decision_id").select("rule", "key"))


def expected_counts(measured: DataFrame, expected: dict[str, int]) -> DataFrame:
    """One-row report: PASS, or FAIL with the list of differing measures."""
    diffs = F.array_compact(F.array(*[F.when(F.col(n) != v, F.concat(F.lit(f"{n}="), F.col(n).cast("string"), F.lit(f" expected {v}")))
                                      for n, v in expected.items()]))
    return measured.select(F.when(F.size(diffs) == 0, "PASS").otherwise("FAIL").alias("status"), F.array_join(diffs, "; ").alias("differences"))


def criteria(measured: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per criterion: measure, comparison, required, actual, passed. Rules: name -> (op, bound)."""
    items = F.array(*[F.struct(F.lit(n).alias("criterion"), F.lit(op).alias("comparison"), F.lit(float(b)).alias("required"),
                               F.col(n).cast("double").alias("actual")) for n, (op, b) in rules.items()])
    rows = measured.select(F.inline(items))
    a, r = F.col("actual"), F.col("required")
    return rows.withColumn("passed", F.coalesce(F.when(F.col("comparison") == "<=", a <= r).when(F.col("comparison") == ">=", a >= r).otherwise(a == r), F.lit(False)))


def gate(rows: DataFrame) -> DataFrame:
    """Overall status of a criteria table with the failing names."""
    g = rows.agg(F.bool_and("passed").alias("ok"), F.count(F.lit(1)).alias("criteria"),
                 F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("criterion")))), ",").alias("failed"))
    return g.select(F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"), "criteria", "failed")


def identity_violations(assigned: DataFrame, lifecycles: DataFrame, min_gap_seconds: int) -> DataFrame:
    """Returning assignments: the prior exists, has the same context, is old enough, is used once, and
    lies inside the supported gap range. `assigned`: application_id, context_id,
    application_created_at, prior_application_id, gap_lo, gap_hi."""
    prior = lifecycles.select(F.col("application_id").alias("prior_application_id"), F.col("context_id").alias("__pc"),
                              F.col("application_created_at").alias("__pt"))
    rows = assigned.join(prior, "prior_application_id", "left")
    gap = (F.unix_micros(F.col("application_created_at").cast("timestamp")) - F.unix_micros(F.col("__pt").cast("timestamp"))) / 1e6
    broken = row_rules(rows, "application_id", {
        "PRIOR_MISSING": F.col("__pt").isNull(), "CONTEXT_MISMATCH": F.col("__pc") != F.col("context_id"),
        "GAP_TOO_SHORT": gap < min_gap_seconds,
        "OUTSIDE_SUPPORTED_RANGE": (gap / 86400 < F.col("gap_lo")) | (gap / 86400 > F.col("gap_hi"))})
    used = assigned.groupBy("prior_application_id").agg(F.count(F.lit(1)).alias("n"), F.min("application_id").alias("k")).filter("n > 1")
    return broken.unionByName(used.select(F.lit("PRIOR_REUSED").alias("rule"), F.col("prior_application_id").cast("string").alias("key")))


def snapshot_violations(df: DataFrame, product: str) -> DataFrame:
    wrong = as_rule(df.filter(~among("product_id", (product,))), "PRODUCT_SCOPE", F.col("context_id")).select("rule", "key")
    twice = df.groupBy("context_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return wrong.unionByName(as_rule(twice, "REPEATED_CONTEXT", F.col("context_id")).select("rule", "key"))


def commit_chain_violations(log: DataFrame) -> DataFrame:
    """Gaps in days and broken hash links of a commit log (one row per day, so one small window)."""
    w = Window.orderBy("day")
    rows = log.withColumns({"__h": F.lag("commit_hash").over(w), "__d": F.lag("day").over(w)})
    return row_rules(rows, "day", {
        "HASH_LINK": F.coalesce("previous_hash", F.lit("")) != F.coalesce("__h", F.lit("")),
        "MISSING_DAY": F.date_add(F.col("__d").cast("date"), 1) != F.col("day").cast("date")})


def end_of_day_violations(states: DataFrame, boundary: str) -> DataFrame:
    """Open states must outlive the boundary and hold pending times inside [boundary, deadline]."""
    b = ntz(boundary)
    return row_rules(states, "application_id", {
        "STATE_CLOSED": F.col("done"), "DEADLINE_PASSED": F.col("deadline") <= b,
        "PENDING_OUTSIDE": F.exists("pending", lambda p: (p["when"] < b) | (p["when"] > F.col("deadline")))})

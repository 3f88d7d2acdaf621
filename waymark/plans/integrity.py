"""Integrity checks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import checks as K
from ..operators import lifecycle as L
from ..operators import survival as S
from ..session import materialize
from ..sources import readers
from ..sources.adapters import STREAM_SPEC as SPEC
from ..spec import CHANNELS
from . import sql as Q
from .registry import Tables, query

CUT = "2024-01-21 00:00:00"


def rule(name: str, key: str, src: str, detail: str = "cast(null as varchar)") -> str:
    return f"select '{name}' as rule, cast({key} as varchar) as key, {detail} as detail {src}"


@query("b2_null_keys", f"with {Q.EV} " + rule("NULL_KEY", "source_row", "from ev where application_id is null", "'application_id'"))
def _(t: Tables):
    return K.null_keys(t.stream(), ["application_id", "context_id", "event_datetime"], "source_row")


@query("b2_invalid_times", rule("INVALID_TIME", "event_id", "from events where event_type = 'error'", "'bad ' || event_type"))
def _(t: Tables):
    rows = t.table("events").select("event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("bad "), "event_type"))
                                                          .otherwise(F.col("ts").cast("string")).alias("when_text"))
    return K.invalid_times(rows, "when_text", "event_id")


@query("b3_shared_applications", "select 'SHARED_APPLICATION' as rule, event_type as key, cast(null as varchar) as detail from events group by event_type having count(distinct user_id) > 1")
def _(t: Tables):
    return K.shared_applications(t.table("events").select(F.col("event_type").alias("application_id"), F.col("user_id").alias("context_id")))


@query("b4_duplicate_keys", f"with {Q.EV}, d as (select source_row from ev union all select source_row from ev where journey_substage = 'error') "
       + rule("DUPLICATE_KEY", "source_row", "from d group by source_row having count(*) > 1", "cast(count(*) as varchar)"))
def _(t: Tables):
    ev = t.stream()
    return K.duplicate_keys(ev.select("source_row").unionByName(ev.filter("journey_substage = 'error'").select("source_row")), "source_row")


@query("b5_already_present", f"with {Q.EV} " + rule("ALREADY_PRESENT", "source_row", f"from ev where event_datetime < timestamp '{CUT}' and journey_substage = 'error'"))
def _(t: Tables):
    ev = t.stream().select("source_row", "event_datetime", "journey_substage")
    hist = ev.filter(F.col("event_datetime") < C.ntz(CUT))
    return K.already_present(ev.filter((F.col("event_datetime") >= C.ntz(CUT)) | F.col("journey_substage").isin("error")), hist, "source_row")


@query("b6_out_of_order", f"""with {Q.EV}, n as (select application_id, min(event_datetime) - interval 1 day as f from ev where event_datetime >= timestamp '{CUT}' and application_id is not null group by 1),
  o as (select application_id, max(event_datetime) as l from ev where event_datetime < timestamp '{CUT}' group by 1) """
       + rule("OUT_OF_ORDER", "application_id", "from n join o using (application_id) where f < l"))
def _(t: Tables):
    ev = t.stream().filter("application_id is not null")
    new = ev.filter(F.col("event_datetime") >= C.ntz(CUT)).withColumn("event_datetime", C.plus_seconds("event_datetime", -86400))
    return K.out_of_order_append(new, ev.filter(F.col("event_datetime") < C.ntz(CUT)))


@query("b7_period_bounds", "select count(*) as rows, min(ts) as first, max(ts) as last, min(ts) >= timestamp '2024-01-01' and max(ts) < timestamp '2024-01-31' as inside from events")
def _(t: Tables):
    return K.source_profile(t.table("events").withColumnRenamed("ts", "event_datetime"), "2024-01-01 00:00:00", "2024-01-31 00:00:00")


@query("b8_outside_day", f"with {Q.EV} " + rule("OUTSIDE_DAY", "source_row", f"""from (select *, cast(event_datetime + interval 1 hour as date) as day from ev)
  where cast(event_datetime as date) <> day or event_datetime >= timestamp '{Q.END}'""", "cast(day as varchar)"))
def _(t: Tables):
    return K.outside_day(t.stream().withColumn("day", F.to_date(C.plus_seconds("event_datetime", 3600))), "day", Q.END)


@query("b9_time_regression", f"""with {Q.EV}, s as (select * replace (case when journey_substage = 'error' then event_datetime - interval 6 hour else event_datetime end as event_datetime) from ev where application_id is not null),
  l as (select *, lag(event_datetime) over (partition by application_id order by source_row) as prev from s) """ + rule("TIME_REGRESSION", "source_row", "from l where prev > event_datetime"))
def _(t: Tables):
    shifted = F.when(F.col("journey_substage") == "error", C.plus_seconds("event_datetime", -6 * 3600)).otherwise(F.col("event_datetime"))
    return K.time_regressions(t.stream().withColumn("event_datetime", shifted))


@query("b10_after_terminal", f"""with {Q.EV}, p as (select application_id, min(event_datetime) as pt from ev where journey_substage = 'purchase' and application_id is not null group by 1) """
       + rule("AFTER_TERMINAL", "source_row", "from ev join p using (application_id) where event_datetime > pt"))
def _(t: Tables):
    return K.after_terminal(t.stream(), SPEC)


@query("b10_after_terminal_same_time", f"""with {Q.EV}, p as (select *, sum((journey_substage = 'purchase')::int) over (partition by application_id order by event_datetime, source_row
  rows between unbounded preceding and 1 preceding) as done from ev where application_id is not null) """ + rule("AFTER_TERMINAL", "source_row", "from p where done > 0"))
def _(t: Tables):
    return K.after_terminal(t.stream(), SPEC, same_time=True)


@query("b11_creation_counts", f"""with {Q.LIFE}, e as (select * from ev where application_id is not null and event_datetime >= timestamp '{CUT}'),
  m as (select application_id, count(*) as n from (select * from e union all select * from e where journey_substage = 'signup' and event_name = 'k3') where journey_substage = 'signup' group by 1),
  arr as (select application_id from life where application_created_at >= timestamp '2024-01-20'), car as (select application_id from life where application_created_at < timestamp '2024-01-22')
  {rule('REPEATED_CREATION', 'application_id', 'from m where n > 1', 'cast(n as varchar)')} union all
  {rule('MISSING_CREATION', 'application_id', 'from arr where application_id not in (select application_id from m)')} union all
  {rule('CARRIED_CREATION', 'application_id', 'from car where application_id in (select application_id from m)')}""")
def _(t: Tables):
    ev = t.stream().filter("application_id is not null").filter(F.col("event_datetime") >= C.ntz(CUT))
    ev = ev.unionByName(ev.filter("journey_substage = 'signup' and event_name = 'k3'"))
    life = t.lifecycles()
    return K.creation_counts(ev, life.filter(F.col("application_created_at") >= C.ntz("2024-01-20 00:00:00")).select("application_id"),
                             life.filter(F.col("application_created_at") < C.ntz("2024-01-22 00:00:00")).select("application_id"), SPEC)


@query("b12_overlapping_lifecycles", f"""with {Q.ORD}, l as (select *, lag(deadline) over (partition by context_id order by application_created_at, source_row) as prev from reg) """
       + rule("OVERLAPPING_LIFECYCLE", "application_id", "from l where prev > application_created_at"))
def _(t: Tables):
    return K.overlapping_lifecycles(t.orders())


@query("b13_new_overlaps_registered", f"""with {Q.ORD}, a as (select * from reg where application_created_at >= timestamp '1998-01-01'), b as (select * from reg where application_created_at < timestamp '1998-01-01')
  select a.application_id, count(*) as overlaps from a join b on a.context_id = b.context_id and b.application_created_at < a.deadline and a.application_created_at < b.deadline group by 1""")
def _(t: Tables):
    reg, at = t.orders(), C.ntz("1998-01-01 00:00:00")
    return L.overlap_counts(reg.filter(F.col("application_created_at") >= at), reg.filter(F.col("application_created_at") < at))


@query("b14_missing_names", f"with {Q.EV} " + rule("MISSING_EVENT_NAME", "source_row", "from ev where event_name in ('k0', 'k1')"))
def _(t: Tables):
    return K.missing_names(t.stream().withColumn("event_name", F.when(F.col("event_name") == "k0", "").when(F.col("event_name") != "k1", F.col("event_name"))))


@query("b15_row_reconciliation", f"""with {Q.EV} select count(*) filter (where not is_simulated) as history_rows, count(*) filter (where is_simulated) as daily_rows, count(*) as combined_rows, count(*) filter (where not is_simulated) + count(*) filter (where is_simulated) = count(*) as reconciled from ev""")
def _(t: Tables):
    from ..sources.sinks import combine
    ev = t.stream()
    hist, days = ev.filter("not is_simulated"), ev.filter("is_simulated")
    return K.row_reconciliation(hist, days, combine(hist, days))


@query("b16_outside_lifecycle", f"with {Q.EV} " + rule("OUTSIDE_LIFECYCLE", "source_row", "from ev where application_id is not null and (event_datetime > deadline or event_datetime < application_created_at or (event_datetime = deadline and journey_substage <> 'purchase'))"))
def _(t: Tables):
    return K.outside_lifecycle(t.stream().drop("application_created_at", "deadline"), t.lifecycles(), SPEC)


@query("b17_expired_removals", f"""with {Q.LIFE}, p as (select application_id, min(event_datetime) as pt from ev where journey_substage = 'purchase' group by 1),
  a as (select * from life where application_created_at < timestamp '2024-01-15' and deadline > timestamp '2024-01-15'),
  gone as (select a.* from a left join p using (application_id) where deadline <= timestamp '2024-01-16' or pt is not null or hour(application_created_at) < 3) """
       + rule("UNEXPLAINED_REMOVAL", "application_id", "from gone left join p using (application_id) where pt is null and deadline > timestamp '2024-01-16'"))
def _(t: Tables):
    p = L.first_terminals(t.stream(), SPEC)
    a = t.lifecycles().filter((F.col("application_created_at") < C.ntz("2024-01-15 00:00:00")) & (F.col("deadline") > C.ntz("2024-01-15 00:00:00")))
    lost = F.hour("application_created_at") < 3
    kept = a.join(p, "application_id", "left").filter((F.col("deadline") > C.ntz("2024-01-16 00:00:00")) & F.col("terminal_datetime").isNull() & ~lost)
    return K.expired_removals(a, kept, p, "2024-01-16 00:00:00")


@query("b18_origin_flags", f"with {Q.EV} " + rule("ORIGIN_FLAG", "source_row", "from ev where (data_origin = 'SIMULATED_MAY') <> (event_datetime >= timestamp '2024-01-22')", "data_origin"))
def _(t: Tables):
    return K.origin_flags(t.stream().withColumn("is_simulated", F.col("event_datetime") >= C.ntz("2024-01-22 00:00:00")), ["SIMULATED_MAY"])


@query("b19_law_sanity", f"""with {Q.LAW}, key as (select *, concat_ws('|', model_level, state, regime, journey_stage, ptp_eligible, source_age, customer_kind) as key from law)
  select 'FORBIDDEN_LABEL' as rule, key, labels as detail from key where labels like '%"signup"%'
  union all select 'TERMINAL_NOT_ALONE', key, labels from key where labels like '%"purchase"%' and labels like '%,%'
  union all select 'POOL_ABOVE_ONE', key, cast(round(sum(mass), 6) as varchar) from key group by key having round(sum(mass), 9) > 1""")
def _(t: Tables):
    by = ["model_level", "state", "regime", "journey_stage", "ptp_eligible", "source_age", "customer_kind"]
    return K.law_violations(S.fit_law(t.episodes(), SPEC), by, SPEC)


@query("b20_decision_log", f"""with {Q.CV}, d as (select 'D' || cast(source_row as varchar) as decision_id,
    case journey_substage when 'error' then 'UNKNOWN' when 'login' then 'INELIGIBLE' else 'ELIGIBLE' end as eligibility, case when journey_substage = 'campaign_sent' then 'SEND' when journey_substage <> 'login' or event_name = 'k1' then 'NO_ACTION' end as action,
    case when journey_substage = 'campaign_sent' and event_name <> 'k0' then channel when journey_substage = 'error' then channel end as channel, event_datetime as opp,
    case when journey_substage = 'campaign_sent' and event_name <> 'k2' then event_datetime + (case when event_name = 'k3' then -1 else 1 end) * interval 1 hour end as due,
    case when journey_substage = 'campaign_sent' and event_name <> 'k4' then event_datetime + (case when event_name = 'k5' then 0 else 2 end) * interval 1 hour end as realized,
    case when journey_substage = 'campaign_sent' then (case when event_name = 'k6' then 'CANCELED' else 'REALIZED' end) when journey_substage = 'purchase' then 'LOST' else 'NO_ACTION' end as status from cv),
  stated as (select decision_id, unnest([
    case when eligibility = 'UNKNOWN' then 'ELIGIBILITY_UNKNOWN' end, case when eligibility = 'ELIGIBLE' and action is null then 'ACTION_UNKNOWN' end, case when eligibility = 'INELIGIBLE' and action is not null then 'ACTION_FORBIDDEN' end,
    case when status = 'LOST' then 'STATUS_UNKNOWN' end, case when action = 'SEND' and channel is null then 'CHANNEL_REQUIRED' end, case when action = 'SEND' then 'BUCKET_REQUIRED' end,
    case when coalesce(action, '') <> 'SEND' and channel is not null then 'FIELDS_FORBIDDEN' end, case when status = 'REALIZED' and due is null then 'SCHEDULE_REQUIRED' end, case when due < opp then 'SEND_BEFORE_DECISION' end,
    case when status = 'REALIZED' and realized is null then 'REALIZED_REQUIRED' end, case when status <> 'REALIZED' and realized is not null then 'REALIZED_FORBIDDEN' end, case when realized < due then 'REALIZED_BEFORE_SCHEDULE' end,
    case when status = 'CANCELED' then 'REASON_REQUIRED' end, case when (coalesce(action, '') = 'SEND') = (status = 'NO_ACTION') then 'STATUS_MISMATCH' end]) as rule from d)
  select rule, decision_id as key from stated where rule is not null""")
def _(t: Tables):
    label, name, at = F.col("journey_substage"), F.col("event_name"), F.col("event_datetime")
    send = label == "campaign_sent"
    d = t.stream(True).select(
        F.concat(F.lit("D"), F.col("source_row").cast("string")).alias("decision_id"), at.alias("opportunity_datetime"),
        F.when(label == "error", "UNKNOWN").when(label == "login", "INELIGIBLE").otherwise("ELIGIBLE").alias("eligibility_status"),
        F.when(send, "SEND").when((label != "login") | (name == "k1"), "NO_ACTION").alias("action"),
        F.when(send & (name != "k0"), F.col("channel")).when(label == "error", F.col("channel")).alias("channel"), F.lit(None).cast("string").alias("time_bucket"),
        F.when(send & (name != "k2"), F.when(name == "k3", C.plus_seconds(at, -3600)).otherwise(C.plus_seconds(at, 3600))).alias("scheduled_send_datetime"),
        F.when(send & (name != "k4"), F.when(name == "k5", at).otherwise(C.plus_seconds(at, 7200))).alias("realized_send_datetime"),
        F.when(send, F.when(name == "k6", "CANCELED").otherwise("REALIZED")).when(label == "purchase", "LOST").otherwise("NO_ACTION").alias("outcome_status"),
        F.lit(None).cast("string").alias("suppression_reason"))
    return K.decision_log_violations(d, CHANNELS, ["morning", "afternoon", "evening", "night"])


@query("b21_expected_counts", f"""with {Q.EV}, m as (select count(distinct journey_substage) as l, count(distinct context_id) as u, count(distinct data_origin) as o from ev),
  d as (select concat_ws('; ', case when l <> 5 then 'labels=' || cast(l as varchar) || ' expected 5' end, case when u <> 1 then 'users=' || cast(u as varchar) || ' expected 1' end, case when o <> 3 then 'origins=' || cast(o as varchar) || ' expected 3' end) as differences from m)
  select case when differences = '' then 'PASS' else 'FAIL' end as status, differences from d""")
def _(t: Tables):
    ev = t.stream()
    m = ev.agg(F.countDistinct("journey_substage").alias("labels"), F.countDistinct("context_id").alias("users"), F.countDistinct("data_origin").alias("origins"))
    return K.expected_counts(m, {"labels": 5, "users": 1, "origins": 3})


_CRIT = {"terminal_share": (">=", 0.1), "error_share": ("<=", 0.1), "labels": ("==", 5)}


@query("b22_acceptance", f"""with {Q.EV}, m as (select avg(case when journey_substage = 'purchase' then 1.0 else 0.0 end) as p, avg(case when journey_substage = 'error' then 1.0 else 0.0 end) as e,
    count(distinct journey_substage) as l from ev)
  select 'terminal_share' as criterion, '>=' as comparison, 0.1::double as required, round(p, 9)::double as actual, p >= 0.1 as passed from m
  union all select 'error_share', '<=', 0.1, round(e, 9)::double, e <= 0.1 from m union all select 'labels', '==', 5.0, l, l = 5 from m""")
def _(t: Tables):
    x = lambda l: F.round(F.avg(C.flag(F.col("journey_substage") == l)), 9)
    m = t.stream().agg(x("purchase").alias("terminal_share"), x("error").alias("error_share"), F.countDistinct("journey_substage").alias("labels"))
    return K.criteria(m, _CRIT)


@query("h16_gate", f"""with {Q.EV}, m as (select avg(case when journey_substage = 'purchase' then 1.0 else 0.0 end) as p, avg(case when journey_substage = 'error' then 1.0 else 0.0 end) as e, count(distinct journey_substage) as l from ev),
  f as (select concat_ws(',', case when e > 0.1 then 'error_share' end, case when l <> 5 then 'labels' end, case when p < 0.1 then 'terminal_share' end) as failed from m)
  select case when failed = '' then 'PASS' else 'FAIL' end as status, 3 as criteria, failed from f""")
def _(t: Tables):
    x = lambda l: F.avg(C.flag(F.col("journey_substage") == l))
    m = t.stream().agg(x("purchase").alias("terminal_share"), x("error").alias("error_share"), F.countDistinct("journey_substage").alias("labels"))
    return K.gate(K.criteria(m, _CRIT))


@query("b24_snapshot", f"""with {Q.LIFE}, s as (select context_id, case when isodow(application_created_at) = 6 then 'OTHER' else 'PERSONAL_LOAN' end as product_id from life where deadline > timestamp '2024-01-15' and application_created_at < timestamp '2024-01-15')
  select 'PRODUCT_SCOPE' as rule, context_id as key from s where product_id = 'OTHER' union all select 'REPEATED_CONTEXT', context_id from s group by context_id having count(*) > 1""")
def _(t: Tables):
    at = C.ntz("2024-01-15 00:00:00")
    s = t.lifecycles().filter((F.col("deadline") > at) & (F.col("application_created_at") < at)).withColumn(
        "product_id", F.when(F.weekday("application_created_at") == 5, "OTHER").otherwise("PERSONAL_LOAN"))
    return K.snapshot_violations(s, "PERSONAL_LOAN")


@query("b25_source_drift", None)
def _(t: Tables):
    """Registered inputs against the files as they are, with one registered size and one content digest made wrong."""
    now = materialize(readers.file_inventory(t.spark, t.root))
    before = now.withColumns({
        "length": F.when(F.col("file") == "region.parquet", F.col("length") + 1).otherwise(F.col("length")),
        "digest": F.when(F.col("file") == "nation.parquet", F.lit("0")).otherwise(F.col("digest"))})
    return K.as_rule(readers.source_drift(before, now), "DRIFT", F.element_at(F.split("path", "/"), -1)).select("rule", "key")


_LOG = """d as (select cast(cast(ts as date) as varchar) as day, count(*) as rows from events group by 1),
  log as (select day, sha256(day || '|' || cast(rows as varchar)) as commit_hash from d where day not in ('2024-01-10', '2024-01-11')),
  l as (select *, lag(commit_hash) over (order by day) as prev, lag(day) over (order by day) as pd from log)"""


@query("b26_commit_chain", f"""with {_LOG} select 'HASH_LINK' as rule, day as key from l where coalesce(case when day = '2024-01-15' then 'broken' else prev end, '') <> coalesce(prev, '')
  union all select 'MISSING_DAY', day from l where cast(pd as date) + 1 <> cast(day as date)""")
def _(t: Tables):
    from pyspark.sql import Window
    d = t.table("events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    log = d.filter("day not in ('2024-01-10', '2024-01-11')").withColumn("commit_hash", F.sha2(F.concat_ws("|", "day", F.col("rows").cast("string")), 256))
    log = log.withColumn("previous_hash", F.when(F.col("day") == "2024-01-15", "broken").otherwise(F.lag("commit_hash").over(Window.orderBy("day"))))
    return K.commit_chain_violations(log)


@query("b27_end_of_day", f"""with {Q.LIFE}, p as (select application_id, min(event_datetime) as pt from ev where journey_substage = 'purchase' group by 1),
  f as (select application_id, count(*) filter (where event_datetime < timestamp '2024-01-15' or event_datetime > deadline) as bad from ev where event_datetime >= timestamp '2024-01-14 12:00:00' and application_id is not null group by 1),
  s as (select l.*, coalesce(pt < timestamp '2024-01-15', false) as done, coalesce(bad, 0) as bad from life l left join p using (application_id) left join f using (application_id) where application_created_at < timestamp '2024-01-15')
  select 'STATE_CLOSED' as rule, application_id as key from s where done union all select 'DEADLINE_PASSED', application_id from s where deadline <= timestamp '2024-01-15'
  union all select 'PENDING_OUTSIDE', application_id from s where bad > 0""")
def _(t: Tables):
    ev, at = t.stream().filter("application_id is not null"), C.ntz("2024-01-15 00:00:00")
    # Pending times matter only through their extremes, so two entries per application are enough.
    pend = ev.filter(F.col("event_datetime") >= C.ntz("2024-01-14 12:00:00")).groupBy("application_id").agg(
        F.array(F.struct(F.min("event_datetime").alias("when")), F.struct(F.max("event_datetime").alias("when"))).alias("pending"))
    s = t.lifecycles().filter(F.col("application_created_at") < at).join(L.first_terminals(ev, SPEC), "application_id", "left").join(pend, "application_id", "left")
    return K.end_of_day_violations(s.withColumn("done", F.col("terminal_datetime") < at), "2024-01-15 00:00:00")

"""Lifecycle construction, identity, interval work and sequence features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import lifecycle as L
from ..operators import ordered as O
from ..operators import sequence as E
from ..sources.adapters import ORDER_SPEC, STREAM_SPEC as SPEC
from ..spec import QUANTILES
from . import sql as Q
from .registry import Tables, query

APP_EV = "application_id is not null"


def keyed(t: Tables, campaign=False):
    return t.stream(campaign).filter(APP_EV)


def lifes(t: Tables, campaign=False):
    """Lifecycles with the tie column the context scans expect."""
    return t.lifecycles(campaign).withColumn("source_row", F.xxhash64("application_id"))


# --- joins -------------------------------------------------------------------------------------------

@query("j1_many_to_one", f"""with {Q.LIFE} select e.source_row, l.application_created_at, l.deadline from ev e join life l using (application_id)""")
def _(t: Tables):
    ev = keyed(t).select("source_row", "application_id")
    return L.many_to_one(ev, t.lifecycles().select("application_id", "application_created_at", "deadline"), "application_id").drop("application_id")


@query("j2_left_one_to_one", f"""with {Q.CLEANLIFE}, last as (select application_id, arg_max(journey_substage, row(event_datetime, source_row)) as last_label,
  count(*) as n from clean group by 1) select life.application_id, context_id, last_label, n from life left join last using (application_id)""")
def _(t: Tables):
    last = t.windowed().groupBy("application_id").agg(
        F.max_by("journey_substage", F.struct("event_datetime", "source_row")).alias("last_label"), F.count(F.lit(1)).alias("n"))
    return L.many_to_one(t.lifecycles().select("application_id", "context_id"), last, "application_id", "left")


@query("j3_map_join", f"""with {Q.EV}, p as (select application_id, min(event_datetime) as terminal_datetime from ev where journey_substage = 'purchase'
  and application_id is not null group by 1) select source_row, terminal_datetime from ev left join p using (application_id)""")
def _(t: Tables):
    ev = t.stream()
    return ev.select("source_row", "application_id").join(L.first_terminals(ev, SPEC), "application_id", "left").drop("application_id")


@query("j4_semi_join", f"with {Q.EV} select source_row from ev where application_id in (select application_id from ev where journey_substage = 'error')")
def _(t: Tables):
    ev = t.stream().select("source_row", "application_id", "journey_substage")
    return ev.join(ev.filter("journey_substage = 'error'"), "application_id", "left_semi").select("source_row")


@query("j5_anti_join", f"""with {Q.LIFE} select application_id from life where application_id not in
  (select application_id from ev where journey_substage = 'purchase' and application_id is not null)""")
def _(t: Tables):
    return t.lifecycles().join(L.first_terminals(t.stream(), SPEC), "application_id", "left_anti").select("application_id")


_BOUNDS = "bounds as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) as bound)"


_PT = f"{_BOUNDS}, pt as (select * from life, bounds where bound > application_created_at and bound < deadline)"


def _points(t: Tables):
    """Each lifecycle at the daily landmarks that fall inside it."""
    lo = F.greatest(F.date_add(F.to_date("application_created_at"), 1), F.lit("2024-01-01").cast("date"))
    hi = F.least(F.to_date(C.plus_seconds("deadline", -0.000001)), F.lit("2024-01-31").cast("date"))
    rows = t.lifecycles().filter(lo <= hi)
    return rows.withColumn("bound", F.explode(F.sequence(lo, hi, F.expr("interval 1 day")))).withColumn(
        "bound", F.col("bound").cast("timestamp_ntz"))


@query("j6_asof_backward_strict", f"""with {Q.LIFE}, {_PT}
  select pt.application_id, bound, arg_max(e.journey_substage, row(e.event_datetime, e.source_row)) as last_label, max(e.event_datetime) as last_at
  from pt left join ev e on e.application_id = pt.application_id and e.event_datetime < bound group by 1, 2""")
def _(t: Tables):
    return O.asof(O.repart(_points(t), C.micros("bound")), keyed(t), ["application_id"], C.micros("bound"), C.micros("event_datetime"),
                  {"last_label": F.col("journey_substage"), "last_at": F.col("event_datetime")}, tie=F.col("source_row"), strict=True
                  ).select("application_id", "bound", "last_label", "last_at")


@query("j7_asof_forward", f"""with {Q.LIFE}, {_PT}
  select pt.application_id, bound, arg_min(e.journey_substage, row(e.event_datetime, e.source_row)) as next_label, min(e.event_datetime) as next_at
  from pt left join ev e on e.application_id = pt.application_id and e.event_datetime >= bound group by 1, 2""")
def _(t: Tables):
    return O.asof(O.repart(_points(t), C.micros("bound")), keyed(t), ["application_id"], C.micros("bound"), C.micros("event_datetime"),
                  {"next_label": F.col("journey_substage"), "next_at": F.col("event_datetime")}, tie=F.col("source_row"), forward=True
                  ).select("application_id", "bound", "next_label", "next_at")


@query("j8_asof_at_cutoff", f"""with {Q.LIFE}, {_PT}
  select pt.application_id, bound, count(e.source_row) as visible, max(e.event_datetime) as last_at
  from pt join ev e on e.application_id = pt.application_id and e.event_datetime <= bound group by 1, 2""")
def _(t: Tables):
    ev = O.scan(keyed(t), L.APP, L.TIMELINE, n=O.Running("sum", F.lit(1)))
    return O.asof(O.repart(_points(t), C.micros("bound")), ev, ["application_id"], C.micros("bound"), C.micros("event_datetime"),
                  {"visible": F.col("n"), "last_at": F.col("event_datetime")}, tie=F.col("source_row")).select("application_id", "bound", "visible", "last_at")


@query("j9_active_lifecycle_at", f"""with {Q.ORD}, p as (select application_id as point_id, context_id, application_created_at + interval 10 day as pt from reg)
  select point_id, count(r.application_id) as active_count, arg_max(r.application_id, row(r.deadline, r.application_created_at, r.source_row)) as active_application_id
  from p left join reg r on r.context_id = p.context_id and r.application_created_at <= p.pt and p.pt < r.deadline group by 1""")
def _(t: Tables):
    reg = t.orders()
    points = reg.select(F.col("application_id").alias("point_id"), "context_id", C.plus_seconds("application_created_at", 864000).alias("at"), "part", *O.GEOMETRY)
    return L.active_at(points, reg).select("point_id", "active_count", "active_application_id")


@query("j10_interval_overlap", f"""with {Q.ORD}, a as (select * from reg where status = 'O'), b as (select * from reg where status <> 'O')
  select a.application_id, count(*) as overlaps from a join b on a.context_id = b.context_id
  and b.application_created_at < a.deadline and a.application_created_at < b.deadline group by 1""")
def _(t: Tables):
    reg = t.orders()
    return L.overlap_counts(reg.filter("status = 'O'"), reg.filter("status <> 'O'"))


@query("j15_landmark_population", f"""with {Q.LIFE}, {_PT} select bound, count(*) as population from pt group by 1""")
def _(t: Tables):
    return _points(t).groupBy("bound").agg(F.count(F.lit(1)).alias("population"))


# --- cleaning --------------------------------------------------------------------------------------------

@query("d1_link_owner", f"with {Q.LIFE} select e.source_row, l.application_id, l.deadline from ev e join life l on e.application_id = l.application_id and e.context_id = l.context_id")
def _(t: Tables):
    return L.link(t.stream(), t.lifecycles()).select("source_row", "application_id", "deadline")


@query("d2_lifecycle_window", f"""with {Q.EV} select source_row, event_datetime < deadline as half_open, event_datetime <= deadline as inclusive
  from ev where application_id is not null and event_datetime >= application_created_at""")
def _(t: Tables):
    return keyed(t).filter("event_datetime >= application_created_at").select(
        "source_row", L.in_window().alias("half_open"), L.in_window(True).alias("inclusive"))


@query("d3_exact_duplicates", f"""with {Q.DUP} select min(source_row) as source_row, count(*) as copies, context_id, event_datetime, journey_substage
  from dup group by context_id, event_datetime, journey_substage, application_id, event_name, journey_stage, channel, visitnum""")
def _(t: Tables):
    return L.drop_exact_duplicates(t.with_copies()).select("source_row", "copies", "context_id", "event_datetime", "journey_substage")


@query("d4_first_terminal_truncation", f"with {Q.CLEAN} select source_row, application_id from clean")
def _(t: Tables):
    return t.windowed().select("source_row", "application_id")


_DUPWIN = Q.DUP + """,
dw as (select * from dup where application_id is not null and event_datetime >= application_created_at and event_datetime < deadline),
dd as (select min(source_row) as source_row, application_id, context_id, event_datetime, journey_substage from dw group by all)"""


@query("d5_time_truncation", f"""with {_DUPWIN}, p as (select application_id, min(event_datetime) as pt from dd where journey_substage = 'purchase' group by 1)
  select source_row, application_id from (select dd.*, pt, row_number() over (partition by application_id, journey_substage order by event_datetime, source_row) as k
    from dd left join p using (application_id)) where (pt is null or event_datetime <= pt) and not (journey_substage = 'purchase' and k > 1)""")
def _(t: Tables):
    return L.clean(t.with_copies(), SPEC, "evaluator").select("source_row", "application_id")


@query("d6_cleaning_counts", f"""with {_DUPWIN}, g as (select application_id, event_datetime, application_created_at, deadline, journey_substage, min(source_row) as source_row, count(*) as copies
    from dup where application_id is not null group by all),
  s as (select *, event_datetime < deadline as ok, coalesce(sum(case when event_datetime < deadline and journey_substage = 'purchase' then 1 else 0 end)
    over (partition by application_id order by event_datetime, source_row rows between unbounded preceding and 1 preceding), 0) as done from g)
  select cast(sum(copies) as bigint) as linked_rows, cast(sum(copies - 1) as bigint) as exact_duplicate_rows,
    count(*) filter (where ok) as owner_lifecycle_rows, count(*) filter (where ok and done = 0) as eligible_events from s""")
def _(t: Tables):
    return L.cleaning_counts(t.with_copies(), SPEC)


@query("d6_builder_events", f"""with {Q.DUP}, g as (select application_id, event_datetime, deadline, application_created_at, journey_substage, min(source_row) as source_row from dup where application_id is not null group by all),
  w as (select * from g where event_datetime >= application_created_at and event_datetime < deadline),
  s as (select *, coalesce(sum((journey_substage = 'purchase')::int) over (partition by application_id order by event_datetime, source_row rows between unbounded preceding and 1 preceding), 0) as done from w)
  select source_row, application_id, journey_substage from s where done = 0""")
def _(t: Tables):
    """The builder's events: linked to the registry, duplicates dropped, inside the half-open window, up to the first terminal."""
    linked = L.link(t.with_copies().drop("application_created_at", "deadline"), t.lifecycles())
    return L.clean(linked, SPEC, "builder").select("source_row", "application_id", "journey_substage")


@query("d7_creation_donor", f"""with {Q.LIFE} select application_id, context_id, event_datetime, source_row from ev
  where journey_substage = 'signup' and application_id is not null and event_datetime = application_created_at""")
def _(t: Tables):
    return L.creation_donors(t.stream(), t.lifecycles(), SPEC).select("application_id", "context_id", "event_datetime", "source_row")


@query("d8_terminal_classes", f"""with {Q.EV}, a as (select *, max(case when journey_substage = 'click' then event_datetime end) over w as ap,
    lag(journey_substage) over (partition by application_id order by event_datetime, source_row) as prev from ev where application_id is not null
    window w as (partition by application_id order by event_datetime, source_row rows between unbounded preceding and 1 preceding)),
  g as (select *, journey_substage = 'purchase' and event_datetime <= deadline and ap is not null as good from a),
  v as (select *, coalesce(sum(good::int) over (partition by application_id order by event_datetime, source_row rows between unbounded preceding and 1 preceding), 0) as vb from g)
  select source_row, case when vb > 0 then 'POST_TERMINAL_PTP' when event_datetime > deadline then 'PTP_AFTER_EXPIRY' when ap is null then 'PTP_WITHOUT_PRIOR_AIP'
    else 'VALID_PROGRESSION_PTP' end as classification, ap as latest_prior_aip_datetime, {Q.secs('ap', 'event_datetime')} as aip_to_ptp_seconds,
    coalesce(prev = 'click', false) as directly_after_aip from v where journey_substage = 'purchase'""")
def _(t: Tables):
    return L.classify_terminals(t.stream(), SPEC).select("source_row", "classification", "latest_prior_aip_datetime", "aip_to_ptp_seconds", "directly_after_aip")


@query("d9_inclusive_lifecycle_rows", f"""with {Q.EV}, a as (select *, coalesce(sum((journey_substage = 'purchase')::int) over (partition by application_id
    order by event_datetime, source_row rows between unbounded preceding and 1 preceding), 0) as done from ev where application_id is not null)
  select source_row from a where done = 0 and event_datetime <= deadline""")
def _(t: Tables):
    return L.clean(t.stream(), SPEC, "inclusive").select("source_row")


_CUT = """cut as (select application_id, application_created_at + interval 1 day as cutoff from life
  union all select application_id, application_created_at + interval 4 day from life),
see as (select c.cutoff, e.* from cv e join cut c on e.application_id = c.application_id and e.event_datetime <= c.cutoff)"""


@query("d10_state_at_cutoff", f"""with {Q.CLIFE.replace('clife', 'life')}, {_CUT}, s as (
  select application_id, cutoff, context_id, min(application_created_at) as creation_datetime,
    arg_max(journey_substage, row(event_datetime, source_row)) filter (where journey_substage not like 'campaign%') as journey_substage,
    bool_or(journey_substage = 'view') as professional_details_seen, bool_or(journey_substage = 'click') as aip_approved_seen,
    max(event_datetime) filter (where journey_substage = 'click') as latest_aip_datetime,
    min(event_datetime) filter (where journey_substage = 'purchase') as ft, max(event_datetime) as le,
    count(*) filter (where journey_substage = 'campaign_sent') as campaign_sends_seen from see group by 1, 2, 3),
  o as (select application_id, cutoff, string_agg(journey_substage, '>' order by f) as observed from (
    select application_id, cutoff, journey_substage, min(row(event_datetime, source_row)) as f from see where journey_substage not like 'campaign%' group by 1, 2, 3) group by 1, 2)
  select application_id, cutoff, context_id, creation_datetime, journey_substage, professional_details_seen, aip_approved_seen, latest_aip_datetime, campaign_sends_seen, observed,
    case when ft is not null then 'PUSH_TO_PARTNER_SUCCESS' when cutoff >= creation_datetime + interval 3 day then 'APPLICATION_EXPIRED_30_DAYS' end as termination_reason,
    case when le > ft then 'ROWS_AFTER_TERMINAL' when le > creation_datetime + interval 3 day then 'ROWS_AFTER_EXPIRY' end as violation
  from s join o using (application_id, cutoff)""")
def _(t: Tables):
    life = t.lifecycles(True).select("application_id", "application_created_at")
    cut = life.select("application_id", F.explode(F.array(C.plus_seconds("application_created_at", 86400), C.plus_seconds("application_created_at", 4 * 86400))).alias("cutoff"))
    return L.state_at(t.stream(True), cut, SPEC).withColumn("observed", F.array_join("observed_journey_substages", ">")).select(
        "application_id", "cutoff", "context_id", "creation_datetime", "journey_substage", "professional_details_seen", "aip_approved_seen",
        "latest_aip_datetime", "campaign_sends_seen", "observed", "termination_reason", "violation")


@query("d11_active_days", f"""with {Q.LIFE}, p as (select application_id, min(event_datetime) as pt from ev where journey_substage = 'purchase' group by 1),
  s as (select life.application_id, greatest(application_created_at, timestamp '2024-01-05') as lo, least(deadline, pt, timestamp '2024-01-25') as hi
    from life left join p using (application_id)),
  d as (select *, unnest(generate_series(date_trunc('day', lo)::timestamp, hi, interval 1 day)) as day from s where lo < hi)
  select application_id, greatest(day, lo) as opportunity from d where day < hi""")
def _(t: Tables):
    s = t.lifecycles().join(L.first_terminals(t.stream(), SPEC), "application_id", "left").withColumn("activation", F.col("application_created_at"))
    return L.active_days(s, "2024-01-05 00:00:00", "2024-01-25 00:00:00").select("application_id", "opportunity")


_KIND = """ck as (select *, lag(application_created_at) over w as prior_created_at, lag(application_id) over w as prior_application_id,
  (epoch_us(application_created_at) - epoch_us(lag(application_created_at) over w)) / 86400000000.0 as gap_days from reg
  window w as (partition by context_id order by application_created_at, source_row))"""


@query("d12_customer_kind", f"""with {Q.ORD}, {_KIND} select application_id, prior_application_id, gap_days,
  case when gap_days >= 30 then 'RETURNING_CUSTOMER' else 'NEW_CUSTOMER' end as customer_kind from ck""")
def _(t: Tables):
    return L.customer_kind(t.orders(), ORDER_SPEC).select("application_id", "prior_application_id", "gap_days", "customer_kind")


@query("d13_any_earlier_creation", f"""with {Q.ORD}, f as (select *, min(application_created_at) over (partition by context_id order by application_created_at, source_row
    rows between unbounded preceding and 1 preceding) as first from reg)
  select application_id, coalesce(application_created_at - first >= interval 30 day, false) as returning from f""")
def _(t: Tables):
    return L.any_earlier_creation(t.orders(), ORDER_SPEC).select("application_id", "returning")


@query("d14_arrival_screen", f"""with {Q.ORD}, m as (select max(o_orderdate) - interval 29 day as cut from orders), old as (select reg.* from reg, m where application_created_at < cut),
  new as (select reg.* from reg, m where application_created_at >= cut),
  f as (select n.*, (select count(*) from old o where o.context_id = n.context_id and o.application_created_at <= n.application_created_at and n.application_created_at < o.deadline) = 0 as free from new n),
  k as (select *, coalesce(sum(free::int) over (partition by context_id order by application_created_at, source_row rows between unbounded preceding and 1 preceding), 0) as opened from f)
  select application_id, case when free and opened = 0 then 'ACTIVATED' else 'REUSED' end as status from k""")
def _(t: Tables):
    reg = t.orders()
    cut = t.table("orders").agg(F.max("o_orderdate").cast("timestamp_ntz") - F.expr("interval 29 day")).scalar()
    out = L.screen_arrivals(reg.filter(F.col("application_created_at") >= cut), reg.filter(F.col("application_created_at") < cut))
    return out.select("application_id", "status")


@query("d15_carried_cohort", f"""with {Q.CLEANLIFE}, s as (select application_id, max(event_datetime) as last_at, count(*) as depth,
    arg_max(journey_substage, row(event_datetime, source_row)) as last_label, bool_or(journey_substage = 'purchase') as done,
    string_agg(distinct journey_substage, '|' order by journey_substage) as seen from clean where event_datetime < timestamp '2024-01-15' group by 1)
  select application_id, last_label, last_at, depth, seen from s join life using (application_id)
  where deadline > timestamp '2024-01-15' and not done""")
def _(t: Tables):
    return carried(t, "2024-01-15 00:00:00").select("application_id", "last_label", "last_at", "depth", F.array_join("seen", "|").alias("seen"))


def carried(t: Tables, bound: str):
    """Applications still active at a boundary with their last state and labels seen."""
    per = t.windowed().filter(F.col("event_datetime") < C.ntz(bound)).groupBy("application_id").agg(
        F.max("event_datetime").alias("last_at"), F.count(F.lit(1)).alias("depth"),
        F.max_by("journey_substage", F.struct("event_datetime", "source_row")).alias("last_label"),
        F.max(C.flag(L.is_label(SPEC.terminal))).alias("done"), F.array_sort(F.collect_set("journey_substage")).alias("seen"))
    return t.lifecycles().filter(F.col("deadline") > C.ntz(bound)).join(per.filter("done = 0"), "application_id")


@query("d16_hash_sample", f"with {Q.LIFE} select application_id from life order by sha256('7|' || context_id || '|' || application_id) limit 25")
def _(t: Tables):
    return t.lifecycles().orderBy(F.sha2(F.concat_ws("|", F.lit(7), "context_id", "application_id"), 256)).limit(25).select("application_id")


_GUARD = f"""with {Q.CLEAN}, g as (select *, coalesce(max((journey_substage = 'view')::int) over w, 0) = 1 as d, coalesce(max((journey_substage = 'click')::int) over w, 0) = 1 as a from clean
    window w as (partition by application_id order by event_datetime, source_row rows between unbounded preceding and 1 preceding)),
  b as (select *, (journey_substage = 'click' and not d) or (journey_substage = 'purchase' and not (d and a)) as blocked from g),
  k as (select *, sum(blocked::int) over (partition by application_id order by event_datetime, source_row) as stops from b)"""


@query("d17_guard_prefix", f"{_GUARD} select source_row, blocked from k where stops = 0 or (blocked and stops = 1)")
def _(t: Tables):
    return E.guard_prefix(t.windowed(), SPEC).filter("kept or first_block").select("source_row", "blocked")


@query("d17_blocked_by_label", f"{_GUARD} select journey_substage, count(*) as blocked_applications from k where blocked and stops = 1 group by 1")
def _(t: Tables):
    return E.guard_prefix(t.windowed(), SPEC).filter("first_block").groupBy("journey_substage").agg(F.count(F.lit(1)).alias("blocked_applications"))


@query("d18_context_regroup", f"""with {Q.ORD}, {_KIND} select application_id, cast(sum(case when gap_days < 30 then 1 else 0 end) over
  (partition by context_id order by application_created_at, source_row) as bigint) as context_group from ck""")
def _(t: Tables):
    return L.regroup_contexts(t.orders(), ORDER_SPEC).select("application_id", "context_group")


@query("d19_stage_mapping", f"""with {Q.EV}, c as (select journey_substage, time_bucket, count(*) as support_count from ev group by 1, 2)
  select journey_substage, arg_min(time_bucket, row(-support_count, time_bucket)) as journey_stage, max(support_count) as support_count from c group by 1""")
def _(t: Tables):
    return L.business_stage_map(t.stream().select("journey_substage", F.col("time_bucket").alias("journey_stage")))


@query("d20_outcomes", f"""with {Q.CLEANLIFE}, p as (select application_id, min(event_datetime) as pt from clean where journey_substage = 'purchase' group by 1)
  select application_id, pt as terminal_datetime, case when pt is not null then 'TERMINAL' when deadline <= timestamp '{Q.END}' then 'EXPIRED' else 'CENSORED' end as outcome
  from life left join p using (application_id)""")
def _(t: Tables):
    return L.outcomes(t.lifecycles(), t.windowed(), SPEC, Q.END).select("application_id", "terminal_datetime", "outcome")


@query("d21_send_suppression", f"""with {Q.CV}, s as (select source_row, application_id, deadline, event_datetime + interval 6 hour as due from cv where journey_substage = 'campaign_sent' and application_id is not null),
  p as (select application_id, min(event_datetime) as pt from cv where journey_substage = 'purchase' group by 1)
  select source_row, case when pt <= due or due >= deadline then 'SUPPRESSED_BY_TERMINAL' else 'SENT' end as status, case when pt <= due then 'TERMINAL' when due >= deadline then 'EXPIRY' end as suppression_reason
  from s left join p using (application_id)""")
def _(t: Tables):
    ev = keyed(t, True)
    sends = ev.filter(L.is_label("campaign_sent")).withColumn("scheduled_at", C.plus_seconds("event_datetime", 6 * 3600))
    return L.suppress_sends(sends, L.first_terminals(ev, SPEC)).select("source_row", "status", "suppression_reason")


_RESP = f"""with {Q.CV}, e as (select *, last_value(case when journey_substage = 'campaign_sent' then source_row end ignore nulls) over w as send_row,
    last_value(case when journey_substage = 'campaign_sent' then event_datetime end ignore nulls) over w as send_at from cv where application_id is not null
    window w as (partition by application_id order by event_datetime, source_row rows between unbounded preceding and 1 preceding)),
  r as (select send_row, arg_min(journey_substage, row(event_datetime, source_row)) as response, min(event_datetime) as response_at from e
    where journey_substage <> 'campaign_sent' and send_at is not null and {Q.secs('send_at', 'event_datetime')} <= 43200 group by 1),
  s as (select *, lead(event_datetime) over (partition by application_id order by event_datetime, source_row) as next_send from cv
    where application_id is not null and journey_substage = 'campaign_sent'),
  resp as (select s.*, response, {Q.secs('event_datetime', 'response_at')} as response_delay_seconds,
    case when response is not null then 'RESPONDED' when {Q.secs('event_datetime', 'next_send')} <= 43200 then 'CENSORED_BY_COMPETING_SEND' else 'NO_RESPONSE' end as status
    from s left join r on r.send_row = s.source_row)"""


@query("d22_competing_send", f"{_RESP} select source_row, response, response_delay_seconds, status from resp")
def _(t: Tables):
    return L.attribute_responses(t.stream(True), SPEC, 43200).select("source_row", "response", "response_delay_seconds", "status")


# --- sequence features ----------------------------------------------------------------------------------

@query("e1_repeat_creation", f"""with {Q.DUP.replace("'error'", "'signup'")} select source_row from (select *, row_number() over (partition by application_id, journey_substage order by event_datetime, source_row) as k
  from dup where application_id is not null) where not (journey_substage = 'signup' and k > 1)""")
def _(t: Tables):
    ev = keyed(t)
    again = ev.filter(L.is_label(SPEC.creation)).withColumn("source_row", F.col("source_row") + 1000000000)
    return E.drop_repeat_creations(ev.unionByName(again), SPEC).select("source_row")


@query("e2_packet_audit", f"""with {Q.PACK} select count(*) as group_count, cast(sum(repeats) as bigint) as same_label_extras, cast(sum(omitted) as bigint) as unsupported_extras,
  count(*) filter (where len(labels) > 1) as multi_label_packets from pk""")
def _(t: Tables):
    return E.packet_audit(t.windowed(), SPEC)


@query("e2_supported_patterns", f"with {Q.PACK} select pattern, first_half, second_half from pat")
def _(t: Tables):
    return E.supported_patterns(E.label_groups(t.windowed(), SPEC), SPEC)


_GAP = f"""with {Q.EV}, gp as (select *, lag(journey_substage) over w as prev_label, lag(event_datetime) over w as prev_at, lead(journey_substage) over w as next_label,
    {Q.secs('lag(event_datetime) over w', 'event_datetime')} as gap_seconds, {Q.secs('application_created_at', 'event_datetime')} as age_seconds from ev where application_id is not null
    window w as (partition by application_id order by event_datetime, source_row))"""


@query("e4_neighbours", f"{_GAP} select source_row, prev_label, prev_at, next_label from gp")
def _(t: Tables):
    return O.scan(keyed(t), L.APP, L.TIMELINE, prev_label=O.Shift(F.col("journey_substage")), prev_at=O.Shift(F.col("event_datetime")),
                  next_label=O.Shift(F.col("journey_substage"), -1)).select("source_row", "prev_label", "prev_at", "next_label")


@query("e5_gaps", f"{_GAP} select source_row, gap_seconds from gp")
def _(t: Tables):
    return E.gaps(keyed(t)).select("source_row", "gap_seconds")


CYC = f"""with {Q.CLEANLIFE}, y0 as (select *, min(event_datetime) over (partition by application_id, journey_substage) as fl,
    min(event_datetime) over (partition by application_id, journey_stage) as fs,
    min(case when journey_substage in ('view','click','purchase') then event_datetime end) over (partition by application_id) as dn,
    lag(journey_substage) over w as l1, lag(journey_substage, 2) over w as l2, lag(journey_substage, 3) over w as l3, lag(journey_stage) over w as s1,
    lag(event_datetime) over w as t1, lag(event_datetime, 2) over w as t2, lag(event_datetime, 3) over w as t3 from clean
    window w as (partition by application_id order by event_datetime, source_row)),
  y as (select *, coalesce(journey_substage = l1 and event_datetime > t1, false) as self_transition,
    coalesce(journey_substage = l2 and journey_substage <> l1 and event_datetime > t1 and t1 > t2, false) as two_state_cycle,
    coalesce(journey_substage = l3 and journey_substage <> l1 and journey_substage <> l2 and l1 <> l2 and event_datetime > t1 and t1 > t2 and t2 > t3, false) as three_state_cycle,
    event_datetime > fl as repeated_substage, coalesce(event_datetime > fs and journey_stage <> s1 and event_datetime > t1, false) as return_to_earlier_stage,
    coalesce(journey_substage = 'error' and dn < event_datetime, false) as focus_revisit, coalesce(journey_substage = 'error' and dn = event_datetime, false) as focus_tie,
    journey_substage = 'error' as focus from y0)"""


@query("e6_cycle_counts", f"""{CYC} select life.application_id, {', '.join(f'count(*) filter (where {x}) as {x}' for x in E.CYCLES)}
  from life left join y using (application_id) group by 1""")
def _(t: Tables):
    return E.cycle_counts(t.windowed(), t.lifecycles(), SPEC)


@query("e6_cycle_summary", f"{CYC} " + " union all ".join(f"select '{x}' as kind, count(*) filter (where {x}) as events, count(distinct application_id) filter (where {x}) as applications from y" for x in E.CYCLES))
def _(t: Tables):
    rows = E.cycles(t.windowed(), SPEC)
    per = rows.groupBy("application_id").agg(*[F.sum(C.flag(F.col(x))).cast("long").alias(x) for x in E.CYCLES])
    wide = per.agg(*[F.sum(x).alias(x) for x in E.CYCLES], *[F.sum(C.flag(F.col(x) > 0)).cast("long").alias(f"{x}_apps") for x in E.CYCLES])
    return wide.selectExpr(f"stack({len(E.CYCLES)}, " + ", ".join(f"'{x}', {x}, {x}_apps" for x in E.CYCLES) + ") as (kind, events, applications)")


_CYCLE_SQL = lambda x: f"""select '{x}' as kind, cast(sum(n) as bigint) as events, count(*) filter (where n > 0) as applications, round(avg(n), 9) as mean_per_app, {', '.join(f"round(quantile_cont(n::double, {q}), 6) as per_app_{p}" for p, q in QUANTILES.items())},
  {', '.join(f"(select round(quantile_cont(s, {q}), 6) from ct where {x}) as seconds_{p}" for p, q in QUANTILES.items())} from (select life.application_id, count(*) filter (where {x}) as n from life left join y using (application_id) group by 1)"""  # noqa: E731
_TIMED = {x: f"(epoch_us(event_datetime) - epoch_us(t{k})) / 1e6" for x, k in E.CYCLE_LAGS.items()}


@query("e6_cycle_profile", CYC + " " + " union all ".join(_CYCLE_SQL(x).replace("select round(quantile_cont(s,", f"select round(quantile_cont({_TIMED[x]},").replace("from ct where", "from y where") for x in E.CYCLES))
def _(t: Tables):
    """Counts per application with zeros and seconds of each kind of cycle, mean and quantiles."""
    got = E.cycle_profile(t.windowed(), t.lifecycles(), SPEC, QUANTILES)
    got = got.withColumns({c: F.round(c, 6) for c in got.columns if c.startswith(("per_app_", "seconds_"))})
    return got.withColumn("mean_per_app", F.round("mean_per_app", 9)).withColumn("events", F.col("events").cast("long"))


@query("e6_focus_shares", f"""{CYC} select count(*) filter (where not focus_revisit and not focus_tie) as first_pass, count(*) filter (where focus_revisit) as revisit, count(*) filter (where focus_tie) as ambiguous_ties,
  count(*) filter (where focus_revisit) / greatest(1, count(*) filter (where not focus_tie)) as revisit_share from y where focus""")
def _(t: Tables):
    return E.focus_shares(t.windowed(), SPEC)


@query("e7_focus_revisits", f"""{CYC} select source_row, case when focus_revisit then 'REVISIT' when focus_tie then 'AMBIGUOUS' else 'FIRST_PASS' end as focus_kind from y where focus""")
def _(t: Tables):
    return E.cycles(t.windowed(), SPEC).filter("focus").select("source_row", F.when(F.col("focus_revisit"), "REVISIT")
        .when(F.col("focus_tie"), "AMBIGUOUS").otherwise("FIRST_PASS").alias("focus_kind"))


def equal_age_sql(days: int) -> str:
    return f"""es{days} as (select c.application_id, min(event_datetime) filter (where journey_substage = 'view') as pd, min(event_datetime) filter (where journey_substage = 'purchase') as pt
    from clean c where event_datetime < application_created_at + interval {days} day group by 1),
  eo{days} as (select distinct application_id from clean c join es{days} using (application_id) where journey_substage = 'click' and pd < event_datetime and event_datetime <= pt and event_datetime < application_created_at + interval {days} day),
  ea{days} as (select l.application_id, l.context_id, l.application_created_at, cast(isodow(l.application_created_at) - 1 as int) as weekday, count(c.source_row) as events,
    count(distinct cast(floor({Q.secs('c.application_created_at', 'c.event_datetime')} / 86400) as int)) filter (where c.source_row is not null) as eventful_days,
    greatest(count(c.source_row) - 1, 0) as transitions, max(coalesce((c.journey_substage = 'purchase')::int, 0)) as ptp, case when l.application_id in (select application_id from eo{days}) then 1 else 0 end as observable_prerequisite_ptp
    from life l left join clean c on c.application_id = l.application_id and c.event_datetime < l.application_created_at + interval {days} day
    where l.application_created_at >= timestamp '{Q.START}' and l.application_created_at <= timestamp '{Q.END}' - interval {days} day group by 1, 2, 3)"""


@query("e8_equal_age_activity", f"with {Q.CLEANLIFE}, {equal_age_sql(1)}, {equal_age_sql(3)} " + " union all ".join(
    f"select {d} as horizon_days, application_id, weekday, events, eventful_days, transitions, ptp, observable_prerequisite_ptp from ea{d}" for d in (1, 3)))
def _(t: Tables):
    ev, life = t.windowed(), t.lifecycles()
    one = lambda d: E.equal_age(ev, life, d, Q.START, Q.END, SPEC).select(
        F.lit(d).alias("horizon_days"), "application_id", "weekday", "events", "eventful_days", "transitions", "ptp", "observable_prerequisite_ptp")
    return one(1).unionByName(one(3))


@query("e8_equal_age_quantiles", f"with {Q.CLEANLIFE}, {equal_age_sql(1)}, {equal_age_sql(3)} " + " union all ".join(
    f"select {d} as horizon_days, '{m}' as measure, round(avg({m}), 9) as mean, " + ", ".join(f"round(quantile_cont({m}, {p}), 6) as {n}" for n, p in QUANTILES.items()) + f" from ea{d}"
    for d in (1, 3) for m in ("events", "eventful_days", "transitions")))
def _(t: Tables):
    """Mean and quantiles per application of equal-age activity, zeros included."""
    ev, life = t.windowed(), t.lifecycles()
    each = lambda d: E.equal_age(ev, life, d, Q.START, Q.END, SPEC).select(F.lit(d).alias("horizon_days"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in ("events", "eventful_days", "transitions")])))
    rows, by = each(1).unionByName(each(3)), ["horizon_days", "measure"]
    q = O.quantiles(rows, "value", QUANTILES, by).withColumns({n: F.round(n, 6) for n in QUANTILES})
    return rows.groupBy(*by).agg(F.round(F.avg("value"), 9).alias("mean")).join(q, by)


@query("e9_burst_audit", f"""with {Q.PACK} select g.pattern, count(*) as groups, cast(sum(len(seen) - 1) as bigint) as extra_rows, any_value(p.pattern) is not null as supported
  from grp g left join pat p using (pattern) where len(seen) > 1 group by 1""")
def _(t: Tables):
    g = E.label_groups(t.windowed(), SPEC)
    return E.burst_audit(g, E.supported_patterns(g, SPEC), SPEC)


@query("e10_creation_to_next", f"""with {Q.EV}, c as (select application_id, min(event_datetime) as c0 from ev where journey_substage = 'signup' and application_id is not null group by 1)
  select application_id, {Q.secs('c0', 'min(event_datetime)')} as delay_seconds from ev join c using (application_id) where event_datetime > c0 group by application_id, c0""")
def _(t: Tables):
    rows = keyed(t).filter(F.col("event_datetime") > F.col("application_created_at"))
    return rows.groupBy("application_id", "application_created_at").agg(F.min("event_datetime").alias("n")).select(
        "application_id", C.seconds_between("application_created_at", "n").alias("delay_seconds"))


@query("e11_spans", f"""with {Q.EV} select application_id, {Q.secs('min(event_datetime)', 'max(event_datetime)')} as span_seconds,
  cast(max(event_datetime) as date) > cast(min(event_datetime) as date) as multi_day from ev where application_id is not null group by 1""")
def _(t: Tables):
    s = keyed(t).groupBy("application_id").agg(F.min("event_datetime").alias("a"), F.max("event_datetime").alias("z"))
    return s.select("application_id", C.seconds_between("a", "z").alias("span_seconds"), (F.to_date("z") > F.to_date("a")).alias("multi_day"))


@query("e12_peak_intensity", f"""with {Q.EV}, d as (select application_id, cast(event_datetime as date), count(*) as n from ev where application_id is not null group by 1, 2),
  b as (select application_id, time_bucket(interval 10 minute, event_datetime), count(*) as n from ev where application_id is not null group by 1, 2)
  select (select max(n) from d) as max_events_per_active_day, (select max(n) from b) as max_events_per_ten_minutes""")
def _(t: Tables):
    return E.peak_intensity(keyed(t))


@query("e13_day_ordinal", f"""with {Q.EV} select source_row, least(row_number() over (partition by application_id, cast(event_datetime as date) order by event_datetime, source_row) - 1, 8) as count_bucket
  from ev where application_id is not null""")
def _(t: Tables):
    return E.day_ordinal(keyed(t)).select("source_row", F.col("count_bucket").cast("long").alias("count_bucket"))


@query("e14_context_timeline", f"""with {Q.EV} select source_row, row_number() over c as context_event_sequence,
    case when application_id is not null then row_number() over (partition by context_id, application_id order by event_datetime, source_row) end as application_event_sequence,
    lag(event_datetime) over c as previous_event_datetime, {Q.secs('lag(event_datetime) over c', 'event_datetime')} as seconds_since_previous_event
  from ev window c as (partition by context_id order by event_datetime, source_row)""")
def _(t: Tables):
    return E.context_timeline(t.stream()).select("source_row", "context_event_sequence", "application_event_sequence",
                                                 "previous_event_datetime", "seconds_since_previous_event")


@query("e15_prior_lifecycle", f"""with {Q.CLEANLIFE}, k as (select *, lag(application_id) over (partition by context_id order by application_created_at) as prior_application_id from life),
  a as (select application_id, max(event_datetime) as prior_last_event, min(event_datetime) filter (where journey_substage = 'purchase') as prior_terminal, count(*) as prior_depth from clean group by 1)
  select k.application_id, prior_application_id, prior_last_event, prior_terminal, prior_depth from k left join a on a.application_id = k.prior_application_id""")
def _(t: Tables):
    k = L.customer_kind(lifes(t), SPEC).select("application_id", "prior_application_id")
    a = t.windowed().groupBy(F.col("application_id").alias("prior_application_id")).agg(
        F.max("event_datetime").alias("prior_last_event"), F.min(F.when(L.is_label(SPEC.terminal), F.col("event_datetime"))).alias("prior_terminal"),
        F.count(F.lit(1)).alias("prior_depth"))
    return k.join(a, "prior_application_id", "left")


@query("e16_first_and_last", f"""with {Q.EV} select application_id, arg_min(journey_substage, row(event_datetime, source_row)) as first_label,
  arg_max(journey_substage, row(event_datetime, source_row)) as last_label from ev where application_id is not null group by 1""")
def _(t: Tables):
    return E.first_and_last(keyed(t))

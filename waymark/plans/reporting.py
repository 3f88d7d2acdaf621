"""Reporting views, profiles and their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import lifecycle as L
from ..operators import models as M
from ..operators import ordered as O
from ..operators import reports as R
from ..operators import sequence as E
from ..operators import stats as H
from ..sources import readers, sinks
from ..sources.adapters import ORDER_SPEC, STREAM_SPEC as SPEC
from ..spec import CHANNELS, GAP_THRESHOLDS, QUANTILES, SEND_LEVELS, TIME_BUCKETS
from . import sql as Q
from .journeys import _GAP, _GUARD, _KIND, _RESP, CYC, carried, equal_age_sql, keyed, lifes
from .registry import Tables, query

SIM0, SIM1 = "2024-01-21 00:00:00", "2024-01-31 00:00:00"
_PEOPLE = "count(*) as event_count, count(distinct context_id) as context_count, count(distinct application_id) as application_count"
_LAB = "count(*) filter (where journey_substage = 'click') as aip_event_count, count(*) filter (where journey_substage = 'purchase') as ptp_event_count"
_CAMP = ("count(*) filter (where journey_substage = 'campaign_sent') as campaign_send_count, "
         "count(*) filter (where journey_substage in ('campaign_open_read', 'campaign_clicked')) as campaign_response_count")
_SIM = f"is_simulated and event_datetime >= timestamp '{SIM0}' and event_datetime < timestamp '{SIM1}'"


def qcols(x: str, probs=QUANTILES) -> str:
    return ", ".join(f"round(quantile_cont({x}, {p}), 6) as {n}" for n, p in probs.items())


def rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("r1_monthly_summary", f"with {Q.CV} select cast(date_trunc('month', event_datetime) as date) as month_start, data_origin, is_simulated, {_PEOPLE}, {_LAB} from cv group by 1, 2, 3")
def _(t: Tables):
    return R.monthly_summary(t.stream(True), SPEC)


@query("r2_daily_summary", f"with {Q.CV} select cast(event_datetime as date) as event_date, {_PEOPLE}, {_LAB}, {_CAMP} from cv where {_SIM} group by 1")
def _(t: Tables):
    return R.daily_summary(t.stream(True), SPEC, SIM0, SIM1)


@query("r3_overview", f"""with {Q.CV} select count(*) as combined_event_count, count(*) filter (where not is_simulated) as historical_event_count, count(*) filter (where is_simulated) as simulated_event_count,
  count(distinct context_id) as combined_context_count, count(distinct context_id) filter (where is_simulated) as simulated_context_count,
  count(distinct application_id) as combined_application_count, count(distinct application_id) filter (where is_simulated) as simulated_application_count,
  min(event_datetime) as first_event_datetime, max(event_datetime) as last_event_datetime, min(event_datetime) filter (where is_simulated) as first_simulated_event_datetime,
  max(event_datetime) filter (where is_simulated) as last_simulated_event_datetime, count(distinct cast(event_datetime as date)) filter (where is_simulated) as simulated_active_day_count from cv""")
def _(t: Tables):
    return R.overview(t.stream(True))


@query("r4_journey_summary", f"""with {Q.CV} select context_id, application_id, min(event_datetime) as first_event_datetime, max(event_datetime) as last_event_datetime, count(*) as event_count,
  count(distinct cast(event_datetime as date)) as active_day_count, bool_or(journey_substage = 'click') as reached_aip, bool_or(journey_substage = 'purchase') as reached_push_to_partner, {_CAMP}
  from cv where {_SIM} group by 1, 2""")
def _(t: Tables):
    return R.journey_summary(t.stream(True), SPEC, SIM0, SIM1)


@query("r5_profile", f"""with {Q.EV}, a as (select application_id, count(*) as n, min(event_datetime) as a, max(event_datetime) as z, min(event_datetime) filter (where journey_substage = 'signup') as c
    from ev where application_id is not null group by 1),
  g as (select {Q.secs('lag(event_datetime) over (partition by application_id order by event_datetime, source_row)', 'event_datetime')} as gap from ev where application_id is not null),
  d as (select {Q.secs('c', 'min(event_datetime)')} as d from ev join a using (application_id) where event_datetime > c group by application_id, c)
  select count(*) as events, count(distinct context_id) as event_active_contexts, round(count(*) / count(distinct context_id), 9) as events_per_event_active_context,
    count(*) filter (where journey_substage = 'signup') as created_rows, count(distinct application_id) filter (where journey_substage = 'signup') as created_unique_applications,
    count(*) filter (where journey_substage = 'click') as aip_rows, count(distinct application_id) filter (where journey_substage = 'click') as aip_unique_applications,
    count(*) filter (where journey_substage = 'click') - count(distinct application_id) filter (where journey_substage = 'click') as aip_repeated_rows,
    count(*) filter (where journey_substage = 'purchase') as ptp_rows, count(distinct application_id) filter (where journey_substage = 'purchase') as ptp_unique_applications,
    count(*) filter (where coalesce(event_name, '') = '') as missing_event_name,
    round(count(*) filter (where day(event_datetime) <= 11) / count(*), 9) as daily_event_share_by_11, round(count(*) filter (where day(event_datetime) <= 15) / count(*), 9) as daily_event_share_by_15,
    round(count(*) filter (where day(event_datetime) >= 24) / count(*), 9) as daily_event_share_24_31,
    (select round(avg(n), 9) from a) as mean_sequence_length, (select round(avg(case when cast(z as date) > cast(a as date) then 1.0 else 0.0 end), 9) from a) as multi_day_application_share,
    (select quantile_cont(n::double, 0.5) from a) as median_sequence_length, (select round(quantile_cont(gap, 0.5), 6) from g) as median_inter_event_seconds, (select round(quantile_cont(gap, 0.9), 6) from g) as p90_inter_event_seconds,
    (select round(quantile_cont(d, 0.5), 6) from d) as median_creation_to_next_seconds, (select round(quantile_cont(d, 0.9), 6) from d) as p90_creation_to_next_seconds from ev""")
def _(t: Tables):
    return rounded(R.profile(t.stream(), SPEC), ["median_inter_event_seconds", "p90_inter_event_seconds", "median_creation_to_next_seconds", "p90_creation_to_next_seconds"])


@query("r5_arrival_split", f"""with {Q.LIFE}, s as (select * from ev where is_simulated and application_id is not null), n as (select application_id from life where application_created_at >= timestamp '{SIM0}'),
  p as (select application_id, count(*) filter (where journey_substage = 'click') as a, count(*) filter (where journey_substage = 'purchase') as t, application_id in (select application_id from n) as fresh from s group by 1)
  select count(*) filter (where not fresh) as carried_forward_event_applications, count(*) filter (where not fresh and a > 0) as carried_forward_aip_applications,
    cast(coalesce(sum(a) filter (where not fresh), 0) as bigint) as carried_forward_aip_rows, count(*) filter (where fresh and a > 0) as arrival_aip_applications,
    count(*) filter (where fresh and t > 0) as arrival_ptp_applications, count(*) filter (where not fresh and t > 0) as carried_forward_ptp_applications from p""")
def _(t: Tables):
    return R.arrival_split(t.stream().filter("is_simulated"), t.lifecycles().filter(F.col("application_created_at") >= C.ntz(SIM0)), SPEC)


@query("r6_arrival_profile", f"""with {Q.LIFE} select count(*) as arrivals, count(distinct cast(application_created_at as date)) as active_days,
  round(count(*) filter (where day(application_created_at) <= 11) / count(*), 9) as share_by_11, round(count(*) filter (where day(application_created_at) <= 15) / count(*), 9) as share_by_15,
  round(count(*) filter (where day(application_created_at) >= 24) / count(*), 9) as share_24_31, round(count(*) filter (where isodow(application_created_at) >= 6) / count(*), 9) as weekend_share from life""")
def _(t: Tables):
    return R.arrival_profile(t.lifecycles(), "application_created_at")


_DAILY = """daily as (select d::date as day, coalesce(n, 0) as count from (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-02-03', interval 1 day)) as d)
  left join (select cast(application_created_at as date) as d2, count(*) as n from life group by 1) on d::date = d2)"""


def _daily(t: Tables):
    return R.daily_counts(t.lifecycles(), "application_created_at", "2024-01-01", "2024-02-03")


@query("r7_calendar_profile", f"""with {Q.LIFE}, {_DAILY}, s as (select *, unnest(['weekday ' || cast(isodow(day) - 1 as varchar), 'week ' || cast(least((day(day) - 1) // 7 + 1, 4) as varchar),
    case when isodow(day) >= 6 then 'weekend' else 'working' end]) as slice from daily)
  select slice, cast(sum(count) as bigint) as count, count(*) as days, round(sum(count) / count(*), 9) as mean_per_day, round(sum(count) / (select sum(count) from daily), 9) as share, (select round(sum(count) filter (where isodow(day) < 6) / sum(count) filter (where isodow(day) >= 6), 9) from daily) as weekday_to_weekend_ratio from s group by 1""")
def _(t: Tables):
    return R.calendar_profile(_daily(t))


@query("r8_daily_counts", f"with {Q.LIFE}, {_DAILY} select day, count from daily")
def _(t: Tables):
    return _daily(t)


@query("r9_distribution", f"""with {Q.EV} select coalesce(application_stage, '<NULL>') as category, count(*) as n, round(count(*) / (select count(*) from ev), 9) as share
  from (select case when application_id is not null then journey_stage end as application_stage from ev) group by 1""")
def _(t: Tables):
    ev = t.stream().select(F.when(F.col("application_id").isNotNull(), F.col("journey_stage")).alias("application_stage"))
    return rounded(R.distribution(ev, "application_stage"), ["share"], 9)


@query("r10_transitions", f"""{_GAP}, c as (select prev_label, journey_substage, count(*) as n from gp where prev_label is not null group by 1, 2)
  select *, round(n / sum(n) over (), 9) as share from c""")
def _(t: Tables):
    return rounded(R.transition_distribution(keyed(t)), ["share"], 9)


_AGEBAND = "case when age_seconds > -86400 and age_seconds <= 86400 then '(-1, 1]' when age_seconds <= 259200 then '(1, 3]' when age_seconds <= 604800 then '(3, 7]' when age_seconds <= 1209600 then '(7, 14]' when age_seconds <= 2592000 then '(14, 30]' end"


def _gapsql(by: str, support: int) -> str:
    return (f"{_GAP}, z as (select *, {_AGEBAND} as age_bucket from gp where gap_seconds is not null) select {by + ', ' if by else ''}count(*) as n, "
            + ", ".join(f"round(avg(case when gap_seconds <= {s} then 1.0 else 0.0 end), 9) as within_{s}" for s in GAP_THRESHOLDS)
            + f", round(avg(case when gap_seconds > {GAP_THRESHOLDS[-1]} then 1.0 else 0.0 end), 9) as over_{GAP_THRESHOLDS[-1]}, {qcols('gap_seconds')} from z "
            + (f"group by {by} having count(*) >= {support}" if by else ""))


def _gaps(t: Tables):
    rows = E.gaps(keyed(t)).filter("gap_seconds is not null")
    return rows.withColumn("age_bucket", C.interval_label(C.seconds_between("application_created_at", "event_datetime") / 86400, (-1, 1, 3, 7, 14, 30)))


@query("r11_gaps_by_transition", _gapsql("prev_label, journey_substage", 200))
def _(t: Tables):
    return rounded(R.gap_stats(_gaps(t), ["prev_label", "journey_substage"], 200), QUANTILES)


@query("r11_gaps_by_destination", _gapsql("journey_substage", 200))
def _(t: Tables):
    return rounded(R.gap_stats(_gaps(t), ["journey_substage"], 200), QUANTILES)


@query("r11_gaps_by_age", _gapsql("age_bucket", 30))
def _(t: Tables):
    return rounded(R.gap_stats(_gaps(t), ["age_bucket"], 30), QUANTILES)


@query("r11_gaps_overall", _gapsql("", 1))
def _(t: Tables):
    return rounded(R.gap_stats(_gaps(t), [], 1), QUANTILES)


@query("r12_terminal_table", f"""with {Q.CLEANLIFE}, p as (select application_id, min(event_datetime) as pt from clean where journey_substage = 'purchase' group by 1),
  v as (select application_id, min(event_datetime) as d from clean where journey_substage = 'view' group by 1),
  c as (select application_id, max((d < event_datetime and event_datetime <= pt)::int) as s, max((d <= event_datetime and event_datetime <= pt)::int) as w from clean join p using (application_id) left join v using (application_id)
    where journey_substage = 'click' group by 1)
  select count(*) as apps, count(pt) as ptp_apps, count(*) filter (where pt is null and deadline <= timestamp '{Q.END}') as expiry_apps, count(*) filter (where pt is null and deadline > timestamp '{Q.END}') as censored_apps,
    round(count(pt) / count(*), 9) as ptp_probability, round(count(*) filter (where pt is null and deadline <= timestamp '{Q.END}') / count(*), 9) as expiry_probability,
    cast(coalesce(sum(s), 0) as bigint) as strict_chain, cast(coalesce(sum(w), 0) as bigint) as weak_chain, count(*) filter (where pt is not null and c.application_id is null) as without_approval
  from life left join p using (application_id) left join c using (application_id)""")
def _(t: Tables):
    ev = t.windowed()
    return R.terminal_table(L.outcomes(t.lifecycles(), ev, SPEC, Q.END), ev, SPEC)


_ENDED = f"""with {Q.CLEANLIFE}, p as (select application_id, min(event_datetime) as pt from clean where journey_substage = 'purchase' group by 1),
  o as (select *, case when pt is not null then 'TERMINAL' when deadline <= timestamp '{Q.END}' then 'EXPIRED' end as outcome, (epoch_us(coalesce(pt, deadline)) - epoch_us(application_created_at)) / 1000000.0 as seconds from life left join p using (application_id))"""


@query("r12_ending_times", f"{_ENDED} select outcome, {qcols('seconds')} from o where outcome is not null group by 1")
def _(t: Tables):
    return rounded(R.ending_times(L.outcomes(t.lifecycles(), t.windowed(), SPEC, Q.END), SPEC), QUANTILES)


@query("r12_terminal_ages", f"{_ENDED}, a as (select *, seconds as age_seconds from o where outcome = 'TERMINAL') select {_AGEBAND} as age_bucket, count(*) as terminals from a group by 1")
def _(t: Tables):
    o = L.outcomes(t.lifecycles(), t.windowed(), SPEC, Q.END).filter("outcome = 'TERMINAL'")
    age = C.interval_label(C.seconds_between("application_created_at", "terminal_datetime") / 86400, (-1, 1, 3, 7, 14, 30))
    return o.groupBy(age.alias("age_bucket")).agg(F.count(F.lit(1)).alias("terminals"))


@query("r12_previous_of_terminal", f"{_GAP} select prev_label, count(*) as n from gp where journey_substage = 'purchase' group by 1")
def _(t: Tables):
    return E.gaps(keyed(t)).filter(L.is_label(SPEC.terminal)).groupBy("prev_label").agg(F.count(F.lit(1)).alias("n"))


@query("r13_returning", f"""with {Q.ORD}, {_KIND}, l as (select o_orderkey, count(*) as lines from orders join lineitem on l_orderkey = o_orderkey group by 1),
  r as (select ck.*, p.status as prior_status, lines from ck join reg p on p.application_id = ck.prior_application_id left join l on cast(l.o_orderkey as varchar) = p.application_id where gap_days >= 30)
  select (select count(*) from reg) as entrants, count(*) as returners, round(count(*) / (select count(*) from reg), 9) as returning_share, {qcols('gap_days')},
    count(*) filter (where prior_status = 'F') as prior_finished, round(avg(lines), 9) as prior_depth_mean from r""")
def _(t: Tables):
    reg = t.orders()
    k = L.customer_kind(reg, ORDER_SPEC)
    depth = t.table("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("prior_application_id")).agg(F.count(F.lit(1)).alias("lines"))
    r = (k.filter("customer_kind = 'RETURNING_CUSTOMER'").select("prior_application_id", "gap_days")
         .join(reg.select(F.col("application_id").alias("prior_application_id"), "status"), "prior_application_id").join(depth, "prior_application_id", "left"))
    one = F.lit(1).alias("__one")
    n = r.agg(F.count(F.lit(1)).alias("returners"), R.n_if(F.col("status") == "F").alias("prior_finished"), F.round(F.avg("lines"), 9).alias("prior_depth_mean"), F.max(F.lit(1)).alias("__one"))
    q = rounded(O.quantiles(r, "gap_days", QUANTILES), QUANTILES)
    out = n.join(q.select("*", one), "__one").drop("__one").withColumn("entrants", reg.agg(F.count(F.lit(1))).scalar())
    return out.withColumn("returning_share", F.round(F.col("returners") / F.col("entrants"), 9))


_CARRY = f"""with {Q.CLEANLIFE}, s as (select application_id, max(event_datetime) as last_at, count(*) as depth,
    arg_max(journey_substage, row(event_datetime, source_row)) as last_label, bool_or(journey_substage = 'purchase') as done from clean where event_datetime < timestamp '2024-01-15' group by 1),
  c as (select *, {Q.secs('application_created_at', "timestamp '2024-01-15'")} / 3600 as age_hours, {Q.secs('last_at', "timestamp '2024-01-15'")} / 3600 as silence_hours
    from s join life using (application_id) where deadline > timestamp '2024-01-15' and not done)"""


def _carry(t: Tables):
    at = C.ntz("2024-01-15 00:00:00")
    return carried(t, "2024-01-15 00:00:00").withColumns({
        "age_hours": C.seconds_between("application_created_at", at) / 3600, "silence_hours": C.seconds_between("last_at", at) / 3600})


@query("r14_carried_cohort", f"""{_CARRY} select last_label, case when age_hours <= 24 then '(0, 24]' when age_hours <= 48 then '(24, 48]' else '(48, 72]' end as age, count(*) as n,
  round(avg(silence_hours), 6) as mean_silence_hours, round(avg(depth), 9) as mean_depth from c group by 1, 2""")
def _(t: Tables):
    return _carry(t).groupBy("last_label", C.interval_label("age_hours", (0, 24, 48, 72)).alias("age")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("silence_hours"), 6).alias("mean_silence_hours"), F.round(F.avg("depth"), 9).alias("mean_depth"))


def _stacked(rows, measures):
    """One row per measure: (measure, value)."""
    return F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))


_PRIOR = ("since_last_days", "since_terminal_days", "prior_depth")


@query("r13_prior_history", f"""with {Q.CLEANLIFE}, k as (select application_id, application_created_at as made, lag(application_id) over w as prior, lag(application_created_at) over w as prior_made from life window w as (partition by context_id order by application_created_at)),
  d as (select application_id, count(*) as prior_depth, max(event_datetime) as last_at, min(event_datetime) filter (where journey_substage = 'purchase') as pt from clean group by 1),
  r as (select prior_depth, {Q.secs('last_at', 'made')} / 86400 as since_last_days, {Q.secs('coalesce(pt, prior_made + interval 3 day)', 'made')} / 86400 as since_terminal_days, pt is null as expired
    from k join d on d.application_id = prior where {Q.secs('prior_made', 'made')} >= 259200) """ + " union all ".join(
    f"select '{m}' as measure, count(*) as returners, count(*) filter (where expired) as inferred_expiries, {qcols(m)} from r" for m in _PRIOR))
def _(t: Tables):
    """What returning customers left behind: gaps since the prior lifecycle's last event and end, and its depth."""
    life, ev = t.lifecycles(), t.windowed()
    kind = L.customer_kind(life.withColumn("source_row", F.lit(0)), SPEC).filter("customer_kind = 'RETURNING_CUSTOMER'")
    prior = ev.groupBy(F.col("application_id").alias("prior_application_id")).agg(
        F.count(F.lit(1)).alias("prior_depth"), F.max("event_datetime").alias("last_at"), F.min(F.when(L.is_label(SPEC.terminal), F.col("event_datetime"))).alias("pt"))
    ends = life.select(F.col("application_id").alias("prior_application_id"), F.col("deadline").alias("prior_deadline"))
    r = kind.select("prior_application_id", F.col("application_created_at").alias("made")).join(prior, "prior_application_id").join(ends, "prior_application_id")
    r = r.withColumns({"since_last_days": C.seconds_between("last_at", "made") / 86400, "since_terminal_days": C.seconds_between(F.coalesce("pt", "prior_deadline"), "made") / 86400})
    rows = r.select(F.col("pt").isNull().alias("expired"), _stacked(r, _PRIOR))
    n = rows.groupBy("measure").agg(F.count(F.lit(1)).alias("returners"), F.sum(C.flag(F.col("expired"))).cast("long").alias("inferred_expiries"))
    return n.join(rounded(O.quantiles(rows, "value", QUANTILES, ["measure"]), QUANTILES), "measure")


_AFTER = f"""{_CARRY}, f as (select application_id, count(*) as later, min(event_datetime) as first_at from clean where event_datetime >= timestamp '2024-01-15' group by 1),
  x as (select c.*, coalesce(later, 0) as later, {Q.secs("timestamp '2024-01-15'", 'first_at')} / 3600 as first_event_hours, {Q.secs("timestamp '2024-01-15'", 'deadline')} / 3600 as remaining_hours from c left join f using (application_id))"""
_CARRIED = ("age_hours", "silence_hours", "remaining_hours", "depth", "later", "first_event_hours")


def _after(t: Tables):
    """The carried cohort with what it did from the boundary on."""
    at = C.ntz("2024-01-15 00:00:00")
    later = t.windowed().filter(F.col("event_datetime") >= at).groupBy("application_id").agg(F.count(F.lit(1)).alias("later"), F.min("event_datetime").alias("first_at"))
    return _carry(t).join(later, "application_id", "left").na.fill(0, ["later"]).withColumns({
        "first_event_hours": C.seconds_between(at, "first_at") / 3600, "remaining_hours": C.seconds_between(at, "deadline") / 3600})


@query("r14_carried_bands", f"""{_AFTER} select case when silence_hours <= 6 then '(-1, 6]' when silence_hours <= 12 then '(6, 12]' when silence_hours <= 24 then '(12, 24]' when silence_hours <= 48 then '(24, 48]' else '(48, 72]' end as silence,
  case when depth <= 1 then '(0, 1]' when depth <= 2 then '(1, 2]' when depth <= 4 then '(2, 4]' else '(4, 1000000000]' end as depth_band, count(*) as n, count(*) filter (where later > 0) as active_apps, round(count(*) filter (where later > 0) / count(*), 9) as active_share,
  cast(sum(later) as bigint) as events, round(sum(later) / nullif(count(*) filter (where later > 0), 0), 9) as events_per_reactivated_app from x group by 1, 2""")
def _(t: Tables):
    active = F.sum(C.flag(F.col("later") > 0)).cast("long")
    return _after(t).groupBy(C.interval_label("silence_hours", (-1, 6, 12, 24, 48, 72)).alias("silence"), C.interval_label("depth", (0, 1, 2, 4, 10**9)).alias("depth_band")).agg(
        F.count(F.lit(1)).alias("n"), active.alias("active_apps"), F.round(active / F.count(F.lit(1)), 9).alias("active_share"), F.sum("later").cast("long").alias("events"),
        F.round(F.sum("later") / F.nullif(active, F.lit(0)), 9).alias("events_per_reactivated_app"))


@query("r14_carried_quantiles", _AFTER + " " + " union all ".join(f"select '{m}' as measure, count({m}) as n, {qcols(m)} from x" for m in _CARRIED))
def _(t: Tables):
    x = _after(t)
    rows = x.select(_stacked(x, _CARRIED)).filter("value is not null")
    return rows.groupBy("measure").agg(F.count(F.lit(1)).alias("n")).join(rounded(O.quantiles(rows, "value", QUANTILES, ["measure"]), QUANTILES), "measure")


@query("r15_reason_counts", f"""{_CARRY}, e as (select * from ev where application_id is not null) select coalesce(nullif(journey_substage, 'error'), 'UNKNOWN') as reason, count(*) as "all",
  count(*) filter (where application_id in (select application_id from c)) as carried from e group by 1""")
def _(t: Tables):
    audit = keyed(t).select("application_id", F.lit("ORGANIC_CONTINUATION").alias("category"), F.struct(
        F.when(F.col("journey_substage") != "error", F.col("journey_substage")).alias("reason"), F.lit(None).cast("string").alias("selected_outcome")).alias("explanation"))
    return R.reason_counts(audit, carried(t, "2024-01-15 00:00:00"))


@query("r16_day_metrics", f"""with {Q.CV}, d as (select cast(event_datetime as date) as day, count(*) as rows, count(*) filter (where journey_substage = 'campaign_sent') as sends,
  count(*) filter (where journey_substage = 'purchase') as terminals from cv group by 1)
  select *, cast(sum(rows) over w as bigint) as total_rows, cast(sum(sends) over w as bigint) as total_sends, cast(sum(terminals) over w as bigint) as total_terminals from d window w as (order by day)""")
def _(t: Tables):
    return R.day_metrics(t.stream(True), SPEC)


@query("r17_inspect", f"""with {Q.EV}, p as (select distinct application_id from ev where application_id is not null order by sha256('7|' || application_id) limit 3)
  select application_id, row_number() over (partition by application_id order by event_datetime, source_row) as position, journey_substage, event_datetime
  from ev where application_id in (select application_id from p)""".replace("select distinct application_id from ev where application_id is not null order by", "select application_id from (select distinct application_id from ev where application_id is not null) order by"))
def _(t: Tables):
    return R.inspect(t.stream()).select("application_id", "position", "journey_substage", "event_datetime")


@query("r18_distinct_counts", f"with {Q.EV} select journey_substage, count(distinct context_id) as contexts, count(distinct application_id) as applications from ev group by 1")
def _(t: Tables):
    return t.stream().groupBy("journey_substage").agg(F.countDistinct("context_id").alias("contexts"), F.countDistinct("application_id").alias("applications"))


@query("r18_approx_distinct", None)
def _(t: Tables):
    return t.stream().groupBy("journey_substage").agg(F.approx_count_distinct("application_id", 0.01).alias("applications"))


@query("r19_rates_per_application", f"""with {Q.CLEANLIFE} select journey_substage, count(*) as events, round(count(*) / (select count(*) from life), 9) as per_application from clean group by 1""")
def _(t: Tables):
    n = t.windowed().groupBy("journey_substage").agg(F.count(F.lit(1)).alias("events"))
    return n.withColumn("per_application", F.round(F.col("events") / t.lifecycles().agg(F.count(F.lit(1))).scalar(), 9))


_M3 = ("events", "eventful_days", "transitions", "ptp", "observable_prerequisite_ptp")


@query("r20_weekday_means", f"with {Q.CLEANLIFE}, {equal_age_sql(1)} select weekday, count(*) as apps, " + ", ".join(f"round(avg({m}), 9) as {m}" for m in _M3) + " from ea1 group by 1")
def _(t: Tables):
    ea = E.equal_age(t.windowed(), t.lifecycles(), 1, Q.START, Q.END, SPEC)
    return ea.groupBy("weekday").agg(F.count(F.lit(1)).alias("apps"), *[F.round(F.avg(m), 9).alias(m) for m in _M3])


_STEPS = {"created": "signup", "prerequisite": "view", "approval": "click", "terminal": "purchase"}


@query("r21_funnel", f"""with {Q.CLEAN}, f as ({' union all '.join(f"select {i} as i, '{k}' as step, count(*) as rows, count(distinct application_id) as applications from clean where journey_substage = '{v}'" for i, (k, v) in enumerate(_STEPS.items()))})
  select step, rows, applications, rows - applications as repeats, case when i = 0 then 1.0::double else round(applications / lag(applications) over (order by i), 9) end as conversion from f""")
def _(t: Tables):
    return R.funnel(t.windowed(), SPEC)


OPP = f"""with {Q.CLIFE}, p as (select application_id, min(event_datetime) as pt from cv where journey_substage = 'purchase' and application_id is not null group by 1),
  s as (select l.application_id, application_created_at, greatest(application_created_at, timestamp '{Q.START}') as lo, least(deadline, pt, timestamp '{Q.END}') as hi from clife l left join p using (application_id)),
  d as (select *, unnest(generate_series(date_trunc('day', lo)::timestamp, hi, interval 1 day)) as day from s where lo < hi),
  o as (select application_id, application_created_at, cast(day as date) as day, greatest(day, lo) as opportunity from d where day < hi),
  ds as (select application_id, cast(event_datetime as date) as day, count(*) as day_sends from cv where journey_substage = 'campaign_sent' and application_id is not null group by 1, 2),
  os as (select o.*, coalesce(day_sends, 0) as day_sends from o left join ds using (application_id, day))"""


def opportunities(t: Tables):
    return M.opportunity_rows(t.stream(True), t.lifecycles(True), SPEC, Q.START, Q.END)


@query("r22_campaign_volume", f"""{OPP} select count(*) as opportunities, count(*) filter (where day_sends > 0) as send_days, cast(sum(day_sends) as bigint) as sends,
  round(sum(day_sends) / count(*) filter (where day_sends > 0), 9) as sends_per_send_day from os""")
def _(t: Tables):
    o = opportunities(t)
    return o.agg(F.count(F.lit(1)).alias("opportunities"), R.n_if(F.col("day_sends") > 0).alias("send_days"), F.sum("day_sends").alias("sends")).withColumn(
        "sends_per_send_day", F.round(F.col("sends") / F.col("send_days"), 9))


@query("r23_response_rates", _RESP.replace("resp as (", "resp0 as (") + """, resp as (select *, case when application_created_at < timestamp '2024-01-16' then 'CARRIED' else 'NEW' end as cohort from resp0)
  select cohort, channel, time_bucket, count(*) as sends, round(avg(case when response = 'campaign_open_read' then 1.0 else 0.0 end), 9) as open_rate,
  round(avg(case when response = 'campaign_clicked' then 1.0 else 0.0 end), 9) as click_rate, round(avg(case when response not like 'campaign%' then 1.0 else 0.0 end), 9) as journey_rate from resp group by 1, 2, 3""")
def _(t: Tables):
    r = L.attribute_responses(t.stream(True), SPEC, 43200).withColumn("cohort", F.when(F.col("application_created_at") < C.ntz(Q.MID), "CARRIED").otherwise("NEW"))
    rate = lambda c: F.round(F.avg(C.flag(F.coalesce(c, F.lit(False)))), 9)
    return r.groupBy("cohort", "channel", "time_bucket").agg(F.count(F.lit(1)).alias("sends"), rate(F.col("response") == "campaign_open_read").alias("open_rate"),
        rate(F.col("response") == "campaign_clicked").alias("click_rate"), rate(~F.col("response").startswith("campaign")).alias("journey_rate"))


# --- sorts, limits, set operations ------------------------------------------------------------------------

@query("s1_stable_sort", f"""with {Q.EV} select application_id, source_row, case when application_id is not null then row_number() over (partition by application_id order by event_datetime, source_row) end as position from ev""")
def _(t: Tables):
    """Range-partitioned sort with an explicit tie column, NULLs last, and the position in the application."""
    ev = t.stream()
    own = O.scan(ev.filter("application_id is not null"), ["application_id"], ["event_datetime", "source_row"], position=O.Running("sum", F.lit(1)))
    rows = own.unionByName(ev.filter("application_id is null"), allowMissingColumns=True)
    return rows.orderBy(F.col("application_id").asc_nulls_last(), "event_datetime", "source_row").select("application_id", "source_row", "position")


@query("s2_day_file_order", f"with {Q.EV} select source_row, row_number() over (partition by cast(event_datetime as date) order by event_datetime, application_id nulls first, source_row) as position from ev")
def _(t: Tables):
    ev = t.stream().withColumn("day", F.to_date("event_datetime")).withColumn("part", (F.hour("event_datetime") * 60 + F.minute("event_datetime")).cast("long"))
    ev = ev.withColumn("a", F.coalesce("application_id", F.lit("")))
    return O.scan(ev, ["day"], ["event_datetime", "a", "source_row"], position=O.Running("sum", F.lit(1))).select("source_row", "position")


@query("s3_top_by_hash", f"with {Q.EV} select source_row from ev order by sha256(cast(source_row as varchar)) limit 40")
def _(t: Tables):
    return t.stream().orderBy(F.sha2(F.col("source_row").cast("string"), 256)).limit(40).select("source_row")


@query("s4_union_all", "select event_id as id, event_type as kind, value from events union all select o_orderkey, o_orderstatus, null from orders")
def _(t: Tables):
    a = t.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    return a.unionByName(t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind")), allowMissingColumns=True)


@query("s5_key_sets", """with a as (select distinct user_id as k from events where event_type = 'purchase'), b as (select distinct user_id as k from events where event_type = 'error')
  select 'ONLY_LEFT' as side, k from a where k not in (select k from b) union all select 'BOTH', k from a where k in (select k from b)""")
def _(t: Tables):
    ev = t.table("events")
    a, b = (ev.filter(F.col("event_type") == x).select(F.col("user_id").alias("k")).distinct() for x in ("purchase", "error"))
    return a.join(b, "k", "left_anti").select(F.lit("ONLY_LEFT").alias("side"), "k").unionByName(a.join(b, "k", "left_semi").select(F.lit("BOTH").alias("side"), "k"))


@query("s6_category_union", f"""with {Q.EV} select coalesce(a.c, b.c) as category, coalesce(a.n, 0) as historical, coalesce(b.n, 0) as simulated from
  (select event_name || '/' || time_bucket as c, count(*) as n from ev where not is_simulated group by 1) a full join (select event_name || '/' || time_bucket as c, count(*) as n from ev where is_simulated group by 1) b on a.c = b.c""")
def _(t: Tables):
    ev = t.stream().withColumn("category", F.concat_ws("/", "event_name", "time_bucket"))
    n = lambda cond, name: ev.filter(cond).groupBy("category").agg(F.count(F.lit(1)).alias(name))
    return n("not is_simulated", "historical").join(n("is_simulated", "simulated"), "category", "full").na.fill(0)

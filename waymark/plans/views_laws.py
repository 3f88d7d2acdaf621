"""Episodes and fitted laws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import models as M
from ..operators import returners as R
from ..operators import survival as S
from ..operators.lifecycle import customer_kind
from ..operators.reports import daily_counts
from ..session import materialize
from ..sources.adapters import ORDER_SPEC, STREAM_SPEC as SPEC
from ..spec import HAZARD_EDGES, MOTIF_LEVELS, NAME_LEVELS, SEND_LEVELS
from . import sql as Q
from .journeys import _KIND
from .registry import Tables, query
from .reporting import OPP, opportunities, rounded

START, MID, END = Q.START, Q.MID, Q.END
LAW_COLUMNS = ["model_level", "state", "regime", "journey_stage", "ptp_eligible", "source_age", "customer_kind",
               "duration_seconds", "labels", "risk_set", "support_count", "denominator", "applications"]


@query("d6_clean_events", f"with {Q.CLEAN} select application_id, context_id, event_datetime, source_row, journey_substage from clean")
def _(t: Tables):
    return t.windowed().select("application_id", "context_id", "event_datetime", "source_row", "journey_substage")


@query("e2_packets", f"""with {Q.PACK} select application_id, context_id, event_datetime, cast(to_json(labels) as varchar) as labels,
  state, journey_stage, cast(omitted as bigint) as omitted, cast(repeats as bigint) as repeats from pk""")
def _(t: Tables):
    return t.packets().select("application_id", "context_id", "event_datetime", F.to_json("labels").alias("labels"), "state",
                              "journey_stage", F.col("omitted").cast("long").alias("omitted"), F.col("repeats").cast("long").alias("repeats"))


@query("e3_running_features", f"""with {Q.PACK} select application_id, event_datetime, state, regime, cast(prior_depth as bigint) as prior_depth,
  ptp_eligible, source_age from pk""")
def _(t: Tables):
    return t.packets().select("application_id", "event_datetime", "state", "regime", F.col("prior_depth").cast("long").alias("prior_depth"),
                              "ptp_eligible", "source_age")


@query("m2_episodes", f"""with {Q.EPI} select application_id, event_datetime, state, observed, duration_seconds, next_labels, customer_kind from epi""")
def _(t: Tables):
    return t.episodes().select("application_id", "event_datetime", "state", "observed", "duration_seconds", "next_labels", "customer_kind")


@query("m3_product_limit", f"""with {Q.EPI},{Q.product_limit('epi', 'pl', 'state')}
  select state, duration_seconds, labels, round(raw_mass, 9) as mass, cast(risk_set as bigint) as risk_set, support_count from pl""")
def _(t: Tables):
    law = S.product_limit(t.episodes().withColumn("labels", F.col("next_labels")), ["state"])
    return law.select("state", "duration_seconds", "labels", F.round("raw_mass", 9).alias("mass"), "risk_set", "support_count")


@query("m4_next_event_law", f"""with {Q.LAW} select {', '.join('cast(risk_set as bigint) as risk_set' if c == 'risk_set' else c for c in LAW_COLUMNS)},
  round(mass, 9) as mass from law""")
def _(t: Tables):
    return S.fit_law(t.episodes(), SPEC).select(*LAW_COLUMNS, F.round("mass", 9).alias("mass"))


# --- hold-out, landmarks, residual law -----------------------------------------------------------------

@query("m5_holdout_error", f"""with {Q.TRAIN},{Q.law('tr', 'law')},
  z as (select * from law where model_level = 'STATE'), den as (select state, sum(denominator) as den from (select distinct state, ptp_eligible, source_age, customer_kind, denominator from z) group by 1),
  a as (select state, duration_seconds, sum(mass * denominator / den) as m from z join den using (state) group by 1, 2),
  coh as (select state, count(*) as validation_occurrences, count(distinct application_id) as validation_applications from te group by 1 having count(*) >= 100),
  tes as (select te.* from te join coh using (state)),{Q.product_limit('tes', 'tpl', 'state')},
  b as (select state, duration_seconds, sum(raw_mass) as m from tpl group by 1, 2),
  u as (select state, duration_seconds, coalesce(a.m, 0) as am, coalesce(b.m, 0) as bm from a full join b using (state, duration_seconds)),
  c as (select *, sum(am) over w as fa, sum(bm) over w as fb from u window w as (partition by state order by duration_seconds))
  select state, validation_occurrences, validation_applications, round(max(abs(fa - fb)), 9) as cdf_sup_error, round(sum(am), 9) as train_mass, round(sum(bm), 9) as validation_mass
  from c join coh using (state) join den using (state) group by 1, 2, 3""")
def _(t: Tables):
    e = S.holdout_error(t.episodes(START, MID), t.episodes(MID, END), SPEC, 100)
    return rounded(e, ["cdf_sup_error", "train_mass", "validation_mass"], 9)


LM = ("2024-01-01 00:00:00", "2024-01-31 00:00:00")


def lm(t: Tables):
    return S.landmarks(t.packets(), SPEC, *LM, END)


@query("m6_landmarks", f"with {Q.PACK},{Q.landmarks(*LM)} select application_id, bound as landmark, state, observed, duration_seconds, next_labels, age_band, silence_band, depth_band, weekday from lm")
def _(t: Tables):
    return lm(t).select("application_id", "landmark", "state", "observed", "duration_seconds", "next_labels", "age_band", "silence_band", "depth_band", "weekday")


@query("m7_residual_law", f"""with {Q.PACK},{Q.landmarks(*LM)},{Q.residual('lm', 'res')} select {Q.RES_BY}, duration_seconds, labels, round(mass, 9) as mass, support_count, denominator, applications from res""")
def _(t: Tables):
    return S.fit_residual(lm(t), SPEC).select("weekday", "model_level", "state", "age_band", "silence_band", "depth_band", "duration_seconds", "labels",
                                              F.round("mass", 9).alias("mass"), "support_count", "denominator", "applications")


# --- approval to terminal -----------------------------------------------------------------------------------

@query("m8_risk_episodes", f"with {Q.RISK} select application_id, event_datetime, observed, duration_seconds from rk")
def _(t: Tables):
    return S.risk_episodes(t.windowed(), SPEC, END).select("application_id", "event_datetime", "observed", "duration_seconds")


@query("m8_risk_counts", f"with {Q.RISK} select count(*) as episodes, count(distinct application_id) as applications, count(*) filter (where observed) as terminal_episodes, count(*) filter (where not observed) as censored from rk")
def _(t: Tables):
    r = S.risk_episodes(t.windowed(), SPEC, END)
    return r.agg(F.count(F.lit(1)).alias("episodes"), F.countDistinct("application_id").alias("applications"),
                 F.count_if("observed").alias("terminal_episodes"), F.count_if(~F.col("observed")).alias("censored"))


def hazard_rows(t: Tables):
    r = S.risk_episodes(t.windowed(), SPEC, END).withColumn("bucket", C.approval_age_bucket("application_age_seconds"))
    return S.explode_levels(r.select("bucket", "duration_seconds", "observed"), {"AGE": ("bucket",), "GLOBAL": ()}, ["bucket"])


_HZX = "hx as (" + Q.level_union("rk", {"AGE": ("bucket",), "GLOBAL": ()}, ["bucket"], "duration_seconds, observed") + ")"
_HZ = f"with {Q.RISK}, {_HZX},{Q.piecewise('hx', 'hz', 'model_level, bucket')}"


@query("m9_piecewise_hazard", f"{_HZ} select model_level, bucket, cast(k as int) as k, cast(risk_set as bigint) as risk_set, events, censored, round(hazard, 9) as hazard, round(cumulative_incidence, 9) as cumulative_incidence from hz")
def _(t: Tables):
    h = S.piecewise_hazard(hazard_rows(t), ["model_level", "bucket"], HAZARD_EDGES)
    return h.select("model_level", "bucket", "k", "risk_set", "events", "censored", F.round("hazard", 9).alias("hazard"), F.round("cumulative_incidence", 9).alias("cumulative_incidence"))


_CONT = f"""with {Q.EPI}, ce as (select state, journey_stage, duration_seconds, observed and next_state <> 'purchase' as observed from epi),
  cx as ({Q.level_union('ce', {'STATE': ('state',), 'STAGE': ('journey_stage',), 'GLOBAL': ()}, ['state', 'journey_stage'], 'duration_seconds, observed')}),{Q.piecewise('cx', 'ch', 'model_level, state, journey_stage')}"""


@query("m10_continuation_hazard", f"""{_CONT} select model_level, state, journey_stage, cast(k as int) as k, cast(risk_set as bigint) as risk_set, events, round(hazard, 9) as hazard from ch
  where alln >= case model_level when 'STATE' then 200 when 'STAGE' then 500 else 0 end""")
def _(t: Tables):
    h = M.continuation_hazard(t.episodes(), SPEC, (200, 500), HAZARD_EDGES)
    return h.select("model_level", "state", "journey_stage", "k", "risk_set", "events", F.round("hazard", 9).alias("hazard"))


@query("m10_continuation_metrics", f"""{_CONT} select count(*) as support_count, round(avg(case when observed then 1.0 else 0.0 end), 9) as continuation,
  round(avg(case when observed and duration_seconds <= 86400 then 1.0 else 0.0 end), 9) as one_day, round(avg(case when observed and duration_seconds <= 604800 then 1.0 else 0.0 end), 9) as seven_day from ce""")
def _(t: Tables):
    go = F.col("observed") & (F.col("next_state") != SPEC.terminal)
    rate = lambda c: F.round(F.avg(C.flag(c)), 9)
    return t.episodes().agg(F.count(F.lit(1)).alias("support_count"), rate(go).alias("continuation"), rate(go & (F.col("duration_seconds") <= 86400)).alias("one_day"),
                            rate(go & (F.col("duration_seconds") <= 604800)).alias("seven_day"))


# --- fitted tables -----------------------------------------------------------------------------------------------

_N = "journey_stage, journey_substage, source_type, event_name"
_NAMES = f"""with {Q.EV}, nx as ({Q.level_union('ev', NAME_LEVELS, ['journey_stage', 'journey_substage', 'source_type'], 'event_name')}),
  nm as (select model_level, {_N}, count(*) as support_count, sum(count(*)) over (partition by model_level, journey_stage, journey_substage, source_type) as denominator from nx group by model_level, {_N})"""


def names(t: Tables):
    return M.conditional_distribution(t.stream().select("journey_stage", "journey_substage", "source_type", "event_name"), NAME_LEVELS, ["event_name"])


@query("m1_conditional_names", f"{_NAMES} select model_level, {_N}, support_count, round(support_count / denominator, 9) as probability from nm")
def _(t: Tables):
    return names(t).select("model_level", "journey_stage", "journey_substage", "source_type", "event_name", "support_count", F.round("probability", 9).alias("probability"))


_SF = ["current_state", "age_bucket", "prior_send_bucket", "recent_send_gap_bucket", "population_origin"]
_SEND = OPP + f""", vis as (select o.application_id, o.day, count(*) filter (where c.journey_substage = 'campaign_sent') as sends, max(c.event_datetime) filter (where c.journey_substage = 'campaign_sent') as ls,
    arg_max(c.journey_substage, row(c.event_datetime, c.source_row)) filter (where c.journey_substage not like 'campaign%') as cs
    from os o left join cv c on c.application_id = o.application_id and c.event_datetime <= o.opportunity group by 1, 2),
  so as (select os.application_id, os.opportunity, day_sends > 0 as sent, coalesce(cs, '') as current_state, {Q.secs('application_created_at', 'opportunity')} / 86400 as days, {Q.secs('ls', 'opportunity')} as gap, coalesce(sends, 0) as sends,
    case when application_created_at < timestamp '2024-01-16' then 'CARRIED_FORWARD' else 'NEW_ARRIVAL' end as population_origin from os join vis using (application_id, day)),
  sb as (select *, case when days < 1 then 'LT_1D' when days < 3 then '1D_3D' when days < 7 then '3D_7D' when days < 14 then '7D_14D' when days < 21 then '14D_21D' else '21D_30D' end as age_bucket,
    case when sends = 0 then '0' when sends = 1 then '1' when sends <= 3 then '2_3' else '4_PLUS' end as prior_send_bucket,
    case when gap is null then 'NO_PRIOR_SEND' when gap < 86400 then 'LT_1D' when gap < 259200 then '1D_3D' when gap < 604800 then '3D_7D' else '7D_PLUS' end as recent_send_gap_bucket from so)"""


@query("m11_send_propensity", _SEND + f""", sx as ({Q.level_union('sb', SEND_LEVELS, _SF, 'sent, opportunity')}),
  sc as (select model_level, {', '.join(_SF)}, count(*) as n, count(*) filter (where sent) as s, count(*) filter (where opportunity < timestamp '{MID}') as n1, count(*) filter (where sent and opportunity < timestamp '{MID}') as s1 from sx group by all)
  select model_level, {', '.join(_SF)}, n as support_count, round(s / n, 9) as send_probability from sc
  where model_level = 'GLOBAL' or (n >= 50 and n1 >= 20 and n - n1 >= 20 and abs(s1 / n1 - (s - s1) / (n - n1)) <= 0.1)""")
def _(t: Tables):
    o = opportunities(t).withColumn("population_origin", F.when(F.col("application_created_at") < C.ntz(MID), "CARRIED_FORWARD").otherwise("NEW_ARRIVAL"))
    return rounded(M.send_propensity(o, SEND_LEVELS, MID, (50, 20, 20)), ["send_probability"], 9)


_MO = f"""with {Q.CV}, e as (select *, last_value(case when journey_substage = 'campaign_sent' then source_row end ignore nulls) over w as sr, last_value(case when journey_substage = 'campaign_sent' then event_datetime end ignore nulls) over w as sa,
    coalesce(sum((journey_substage = 'campaign_sent')::int) over w, 0) as sends, last_value(case when journey_substage not like 'campaign%' then journey_substage end ignore nulls) over w as ps,
    last_value(case when journey_substage not like 'campaign%' then journey_stage end ignore nulls) over w as pg from cv where application_id is not null
    window w as (partition by application_id order by event_datetime, source_row rows between unbounded preceding and 1 preceding)),
  h as (select sr, min(row(event_datetime, source_row)) filter (where journey_substage = 'campaign_open_read') as o, min(row(event_datetime, source_row)) filter (where journey_substage = 'campaign_clicked') as c,
    arg_min(journey_substage, row(event_datetime, source_row)) filter (where journey_substage not like 'campaign%') as j, min(event_datetime) filter (where journey_substage not like 'campaign%') as jt,
    min(event_datetime) filter (where journey_substage = 'campaign_open_read') as ot from e
    where journey_substage <> 'campaign_sent' and sa is not null and {Q.secs('sa', 'event_datetime')} <= 43200 group by 1),
  s as (select *, lead(event_datetime) over (partition by application_id order by event_datetime, source_row) as ns from e where journey_substage = 'campaign_sent'),
  mo as (select s.application_id, s.source_row, s.event_datetime, channel, time_bucket, coalesce(ps, '') as current_journey_substage, coalesce(pg, '') as current_journey_stage,
    case when sends = 0 then '0' when sends = 1 then '1' else '2_PLUS' end as prior_send_bucket,
    case when o is null and c is null then 'NO_ENGAGEMENT' when c is null then 'campaign_open_read' when o is null then 'campaign_clicked' when o < c then 'campaign_open_read>campaign_clicked' else 'campaign_clicked>campaign_open_read' end as engagement_sequence,
    coalesce(j, 'NO_JOURNEY_RESPONSE') as next_journey_substage, {Q.secs('s.event_datetime', 'ot')} as open_delay_seconds, {Q.secs('s.event_datetime', 'jt')} as journey_delay_seconds,
    case when not (s.event_datetime >= application_created_at and s.event_datetime < deadline) then 'SEND_OUTSIDE_LIVE_LIFECYCLE'
      when o is null and c is null and j is null and {Q.secs('s.event_datetime', 'ns')} <= 43200 then 'NO_RESPONSE_BEFORE_COMPETING_SEND'
      when o is null and c is null and j is null and s.event_datetime + interval 12 hour > timestamp '{END}' then 'RIGHT_CENSORED_AT_SOURCE_END' else 'RETAINED_MOTIF' end as status from s left join h on h.sr = s.source_row)"""


def motif_rows(t: Tables):
    return M.motifs(t.stream(True), SPEC, 43200, END)


@query("m12_motifs", f"{_MO} select source_row, current_journey_substage, prior_send_bucket, engagement_sequence, next_journey_substage, open_delay_seconds, journey_delay_seconds, status from mo")
def _(t: Tables):
    return motif_rows(t).select("source_row", "current_journey_substage", "prior_send_bucket", "engagement_sequence", "next_journey_substage", "open_delay_seconds", "journey_delay_seconds", "status")


@query("m12_motif_exclusions", f"{_MO} select status, count(*) as sends from mo group by 1")
def _(t: Tables):
    return motif_rows(t).groupBy("status").agg(F.count(F.lit(1)).alias("sends"))


_MF = ["current_journey_substage", "channel", "time_bucket", "prior_send_bucket", "current_journey_stage"]


@query("m12_motif_model", f"""{_MO}, mx as ({Q.level_union("(select * from mo where status = 'RETAINED_MOTIF')", MOTIF_LEVELS, _MF, 'engagement_sequence, next_journey_substage')}),
  mc as (select model_level, {', '.join(_MF)}, engagement_sequence, next_journey_substage, count(*) as support_count, sum(count(*)) over (partition by model_level, {', '.join(_MF)}) as denominator from mx group by model_level, {', '.join(_MF)}, engagement_sequence, next_journey_substage)
  select * exclude(denominator), cast(denominator as bigint) as denominator, round(support_count / denominator, 9) as probability from mc where denominator >= 20""")
def _(t: Tables):
    return rounded(M.motif_model(motif_rows(t), MOTIF_LEVELS, 20), ["probability"], 9)


@query("m13_action_propensity", f"""{_MO}, ax as ({Q.level_union('mo', {'STATE': ('current_journey_substage',), 'STAGE': ('current_journey_stage',), 'GLOBAL': ()}, ['current_journey_substage', 'current_journey_stage'], 'channel, time_bucket, event_datetime')}),
  ac as (select model_level, current_journey_substage, current_journey_stage, channel, time_bucket, count(*) as count, count(*) filter (where event_datetime < timestamp '{MID}') as c1 from ax group by all),
  ad as (select *, cast(sum(count) over w as bigint) as denominator, cast(sum(c1) over w as bigint) as first_half, cast(sum(count - c1) over w as bigint) as second_half from ac window w as (partition by model_level, current_journey_substage, current_journey_stage)),
  at_ as (select *, 0.5 * sum(abs(c1 / greatest(first_half, 1) - (count - c1) / greatest(second_half, 1))) over (partition by model_level, current_journey_substage, current_journey_stage) as tv from ad)
  select * exclude(c1, tv), round(tv, 9) as half_tv, round(count / denominator, 9) as probability from at_ where model_level = 'GLOBAL' or (first_half >= 50 and second_half >= 50 and round(tv, 9) <= 0.25)""")
def _(t: Tables):
    return rounded(M.action_propensity(motif_rows(t), MID, (50, 50)), ["half_tv", "probability"], 9)


_INT = f"""with {Q.CLEAN}, i0 as (select *, lead(event_datetime) over (partition by application_id order by event_datetime, source_row) as nx from clean),
  i1 as (select *, least(row_number() over (partition by application_id, cast(event_datetime as date) order by event_datetime, source_row) - 1, 8) as cb from i0 where journey_substage <> 'purchase')"""


@query("m14_event_intensity", f"""{_INT}, ix as (select 'STATE_COUNT' as model_level, journey_substage, cb as count_bucket, event_datetime, nx from i1 union all select 'STATE', journey_substage, -1, event_datetime, nx from i1 union all select 'GLOBAL', '', -1, event_datetime, nx from i1)
  select model_level, journey_substage, cast(count_bucket as bigint) as count_bucket, count(*) as support_count, round(1 - count(nx) / count(*), 9) as p_no_later_observed_event,
  case when count(nx) > 0 then round(count(*) filter (where cast(nx as date) = cast(event_datetime as date)) / count(nx), 9) end as p_same_day_given_next from ix group by 1, 2, 3""")
def _(t: Tables):
    return rounded(M.event_intensity(t.windowed(), SPEC)[0], ["p_no_later_observed_event", "p_same_day_given_next"], 9)


@query("m14_gap_pool", f"{_INT} select source_row, journey_substage, cast(cb as bigint) as count_bucket, epoch_us(nx) - epoch_us(event_datetime) as gap_microseconds from i1 where nx is not null")
def _(t: Tables):
    return M.event_intensity(t.windowed(), SPEC)[1].select("source_row", "journey_substage", "count_bucket", "gap_microseconds")


_RT = f"""with {Q.CLEAN}, r0 as (select *, coalesce(max((journey_substage in ('view','click','purchase'))::int) over (partition by application_id order by event_datetime, source_row rows between unbounded preceding and 1 preceding), 0) as dn,
    lead(event_datetime) over w as na, lead(journey_substage) over w as response from clean window w as (partition by application_id order by event_datetime, source_row)),
  r1 as (select application_id, journey_substage as state, case when journey_substage = 'error' then case when dn > 0 then 'REVISIT' else 'FIRST_PASS' end else 'UNCONDITIONED' end as regime, response, {Q.secs('event_datetime', 'na')} as delay
    from r0 where na > event_datetime and response <> 'purchase' and journey_substage <> 'purchase'),
  rt as (select state, regime, response, count(*) as support_count, count(distinct application_id) as unique_applications, sum(count(*)) over (partition by state, regime) as outgoing, quantile_cont(delay, 0.5) as q50, quantile_cont(delay, 0.9) as q90,
    quantile_cont(delay, 0.95) as q95, quantile_cont(delay, 0.99) as q99 from r1 group by 1, 2, 3)"""


@query("m15_regime_transitions", f"""{_RT} select state, regime, response, support_count, unique_applications, cast(outgoing as bigint) as outgoing_transition_count, round(support_count / outgoing, 9) as probability,
  round(q50, 6) as median_seconds, round(q90, 6) as p90_seconds, round(q95, 6) as p95_seconds, round(q99, 6) as p99_seconds from rt""")
def _(t: Tables):
    r = rounded(M.regime_transitions(t.windowed(), SPEC), ["median_seconds", "p90_seconds", "p95_seconds", "p99_seconds"])
    return rounded(r, ["probability"], 9)


@query("m16_largest_remainder", f"""with {Q.EV}, w as (select context_id, count(*) as weight from ev group by 1), r as (select *, round(weight / (select sum(weight) from w) * 777, 9) as raw from w),
  f as (select *, floor(raw) as fl, round(raw - floor(raw), 9) as fr from r)
  select context_id, weight, cast(fl + case when row_number() over (order by fr desc, context_id desc) <= 777 - (select sum(fl) from f) then 1 else 0 end as bigint) as allocated from f""")
def _(t: Tables):
    w = t.stream().groupBy("context_id").agg(F.count(F.lit(1)).alias("weight"))
    return M.largest_remainder(w, "weight", 777, "context_id").select("context_id", "weight", F.col("allocated").cast("long").alias("allocated"))


@query("m17_calendar_allocation", None)
def _(t: Tables):
    life = t.lifecycles().select("application_id", F.col("application_created_at").alias("activation_datetime"))
    hist = daily_counts(life, "activation_datetime", "2024-01-01", "2024-01-30")
    return M.allocate_calendar(hist, life, "2024-02-01", "2024-02-29", 7).select("application_id", "position", "target_day", "application_created_at")


@query("m18_returning_rates", f"""with {Q.ORD}, {_KIND}, d as (select cast(isodow(application_created_at) - 1 as int) as weekday, count(*) as entrants, count(*) filter (where gap_days >= 30) as returners from ck group by 1)
  select weekday, entrants, returners, round(case when entrants >= 2130 then returners / entrants else (select sum(returners) / sum(entrants) from d) end, 9) as rate from d""")
def _(t: Tables):
    return rounded(M.returning_rates(customer_kind(t.orders(), ORDER_SPEC), 2130), ["rate"], 9)


def order_targets(t: Tables):
    """Arrivals: orders of the last 60 days with the gap they ask for; donors: each customer's last earlier order."""
    reg = t.orders()
    last = t.table("orders").agg(F.max("o_orderdate").cast("timestamp_ntz") - F.expr("interval 60 day")).scalar()
    kind = customer_kind(reg, ORDER_SPEC)
    targets = kind.filter((F.col("application_created_at") >= last) & (F.col("gap_days") >= 30)).select(
        F.col("application_id").alias("target_id"), F.col("status").alias("stratum"), F.col("gap_days").alias("target"), F.col("application_created_at").alias("asked_at"))
    old = reg.filter(F.col("application_created_at") < last).groupBy("context_id").agg(
        F.max_by(F.struct("application_created_at", "status"), F.struct("application_created_at", "source_row")).alias("r"))
    donors = old.select(F.col("context_id").alias("donor_id"), F.col("r.status").alias("stratum"), C.seconds_between("r.application_created_at", last).alias("s")
                        ).select("donor_id", "stratum", (F.col("s") / 86400).alias("gap"))
    return targets, donors


_J14 = f"""with {Q.ORD}, {_KIND}, m as (select max(o_orderdate) - interval 60 day as cut from orders), tg as (select application_id as target_id, status as stratum, gap_days as target from ck, m where application_created_at >= cut and gap_days >= 30),
  dn as (select context_id as donor_id, arg_max(status, row(application_created_at, source_row)) as stratum, (epoch_us(any_value(cut)) - epoch_us(max(application_created_at))) / 86400000000.0 as gap from reg, m where application_created_at < cut group by 1),
  p as (select target_id, tg.stratum, target, abs(gap - target) as d, floor(gap) = floor(target) as ex from tg join dn using (stratum)),
  q as (select target_id, stratum, target, count(*) filter (where ex) as exact, count(*) filter (where d <= 3) as near, list_sort(list(d)) as ds from p group by 1, 2, 3)"""


@query("j14_gap_neighbourhood", f"""{_J14} select target_id, stratum, round(target, 6) as target, case when exact >= 30 then 'EXACT_DAY' when near >= 30 then 'WITHIN_3_DAYS' else 'NEAREST_SUPPORTED_RANGE' end as reason,
  round(case when exact >= 30 then floor(target) when near >= 30 then target - 3 else target - ds[least(30, len(ds))] end, 6) as gap_lo,
  round(case when exact >= 30 then floor(target) + 1 when near >= 30 then target + 3 else target + ds[least(30, len(ds))] end, 6) as gap_hi from q""")
def _(t: Tables):
    targets, donors = order_targets(t)
    return rounded(M.gap_neighbourhood(targets.drop("asked_at"), donors, 30), ["target", "gap_lo", "gap_hi"])


# --- returning customers: orders before the last 60 days are the history, those after it the arrivals ------------

#: Entrants of a weekday that make a donor set, and the gap between orders of one customer that counts as an overlap.
SET_MINIMUM, OVERLAP_DAYS = 50, 3


def _cut(t: Tables):
    return t.table("orders").agg(F.max("o_orderdate").cast("timestamp_ntz") - F.expr("interval 60 day")).scalar()


def order_outcomes(t: Tables):
    """application_id, outcome (fulfilled), depth (lines) of every order."""
    lines = t.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("depth"))
    orders = t.table("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("outcome"))
    return orders.join(lines, "k", "left").select(F.col("k").cast("string").alias("application_id"), "outcome", F.coalesce("depth", F.lit(0)).alias("depth"))


def drawn_targets(t: Tables):
    """What each arrival asks, and its own customer kind."""
    def build():
        kind = customer_kind(t.orders(), ORDER_SPEC)
        gap = C.micros("application_created_at") - C.micros("prior_created_at")
        kind = materialize(kind.select("application_id", "context_id", "application_created_at", "prior_application_id", "prior_created_at", gap.alias("gap_us"), F.coalesce(gap >= 30 * R.DAY_US, F.lit(False)).alias("returning")))
        cut = _cut(t)
        past = kind.filter((F.col("application_created_at") >= cut - F.expr("interval 60 day")) & (F.col("application_created_at") < cut))
        past = past.join(order_outcomes(t).withColumnRenamed("application_id", "prior_application_id"), "prior_application_id", "left")
        arrivals = kind.filter(F.col("application_created_at") >= cut)
        return materialize(R.draw_targets(arrivals.select("application_id", F.col("application_created_at").alias("activation_datetime")), past, 7, SET_MINIMUM)), arrivals
    return t.once("drawn_targets", build)


def asked(t: Tables):
    """Targets of returning arrivals, and the free histories before them."""
    targets = drawn_targets(t)[0].filter("returning").select("target_id", C.micros("asked_at").alias("asked_us"), "gap_us", "outcome", "depth")
    old = t.orders().filter(F.col("application_created_at") < _cut(t))
    return targets, t.once("histories", lambda: materialize(R.free_histories(old, order_outcomes(t), OVERLAP_DAYS * R.DAY_US)))


_U = "('0x' || substr(sha256('7|{}|' || application_id), 1, 16))::ubigint::double / 18446744073709551616.0"
_DRAWN = f"""with {Q.ORD}, {_KIND}, cutoff as (select max(o_orderdate) - interval 60 day as cut from orders),
  oc as (select cast(o_orderkey as varchar) as application_id, o_orderstatus = 'F' as outcome, (select count(*) from lineitem where l_orderkey = o_orderkey) as depth from orders),
  en as (select ck.application_id, cast(isodow(application_created_at) - 1 as int) as weekday, coalesce(gap_days >= 30, false) as ret, epoch_us(application_created_at) - epoch_us(prior_created_at) as gap_us, oc.outcome, oc.depth
    from ck left join oc on oc.application_id = prior_application_id, cutoff where application_created_at >= cut - interval 60 day and application_created_at < cut),
  dw as (select w.weekday, count(en.application_id) as entrants, count(*) filter (where ret) as returners from (select cast(range as int) as weekday from range(7)) w left join en using (weekday) group by 1),
  rt as (select weekday, case when entrants >= {SET_MINIMUM} then weekday else -1 end as donor_set, case when entrants >= {SET_MINIMUM} then returners / entrants else (select sum(returners) / sum(entrants) from dw) end as rate from dw),
  ps as (select *, row_number() over (partition by donor_set order by sha256(application_id)) - 1 as i, count(*) over (partition by donor_set) as n from (select *, unnest([weekday, -1]) as donor_set from en where ret)),
  ar as (select application_id, context_id, application_created_at as asked_at, prior_application_id, prior_created_at, cast(isodow(application_created_at) - 1 as int) as weekday from ck, cutoff where application_created_at >= cut),
  tg as (select ar.*, {_U.format("kind").replace("application_id", "ar.application_id")} < rate and exists (select 1 from ps where ps.donor_set = rt.donor_set) as ret, rt.donor_set, {_U.format("prior").replace("application_id", "ar.application_id")} as u from ar join rt using (weekday)),
  dr as (select tg.application_id as target_id, tg.context_id, tg.prior_application_id, tg.prior_created_at, asked_at, tg.weekday, tg.ret, ps.gap_us, ps.outcome, ps.depth from tg left join ps on tg.ret and ps.donor_set = tg.donor_set and ps.i = floor(u * n))"""
_HIST = """, hs as (select *, coalesce(epoch_us(application_created_at) - epoch_us(lag(application_created_at) over w) < 259200000000, false) as close from reg, cutoff where application_created_at < cut window w as (partition by context_id order by application_created_at, source_row)),
  hl as (select context_id as donor_id, arg_max(application_id, row(application_created_at, source_row)) as prior_application_id, epoch_us(max(application_created_at)) as birth_us from hs group by 1 having not bool_or(close)),
  dn as (select donor_id, birth_us, outcome, depth from hl join oc on oc.application_id = hl.prior_application_id),
  el as (select target_id, epoch_us(asked_at) as a, gap_us as g, dr.outcome, birth_us as b, dn.outcome = dr.outcome as same from dr join dn on epoch_us(asked_at) - birth_us >= 2592000000000 where ret),
  pl as (select * from el qualify same or not bool_or(same) over (partition by target_id)),
  nb as (select target_id, any_value(a) as a, any_value(g) as g, bool_or(same) as own, count(*) filter (where (a - b) // 86400000000 = g // 86400000000) as exact, count(*) filter (where abs(a - b - g) <= 259200000000) as near,
    list_sort(list(abs(a - b - g)))[least(30, count(*))] as radius from pl group by 1)"""


@query("m18_donor_draws", f"{_DRAWN} select target_id, weekday, ret as is_returning, gap_us, outcome, depth from dr")
def _(t: Tables):
    """What every arrival asks of its history: returning or not, and a past returner's gap, outcome and depth."""
    return drawn_targets(t)[0].select("target_id", "weekday", F.col("returning").alias("is_returning"), "gap_us", "outcome", "depth")


@query("j14_moving_gaps", f"""{_DRAWN}{_HIST} select target_id, case when own then 'O' when own is not null then 'A' end as pool,
  case when own is null then 'NO_ELIGIBLE_CONTEXT' when exact >= 30 then 'EXACT_DAY' when near >= 30 then 'WITHIN_3_DAYS' else 'NEAREST_SUPPORTED_RANGE' end as reason,
  cast(case when own is null then null when exact >= 30 then a - (g // 86400000000 + 1) * 86400000000 + 1 when near >= 30 then a - g - 259200000000 else a - g - radius end as bigint) as born_lo,
  cast(least(case when own is null then null when exact >= 30 then a - g // 86400000000 * 86400000000 when near >= 30 then a - g + 259200000000 else a - g + radius end, a - 2592000000000) as bigint) as born_hi
  from dr left join nb using (target_id) where ret""")
def _(t: Tables):
    """Around each asked gap, the creation times of histories that fit at the arrival's own time."""
    targets, donors = asked(t)
    return R.neighbourhood(targets, R.by_birth(donors)).select("target_id", "pool", "reason", "born_lo", "born_hi")


def matched(t: Tables):
    targets, donors = asked(t)
    return t.once("matched", lambda: materialize(R.match_histories(targets, donors)))


@query("m19_donor_matching", None)
def _(t: Tables):
    """One free history per returning arrival, none twice."""
    targets, donors = asked(t)
    return targets.join(matched(t), "target_id").join(donors.select("donor_id", "prior_application_id"), "donor_id", "left").select(
        "target_id", "round", "reason", "level", "donor_id", "prior_application_id", "gap_days", "gap_us", F.col("outcome").alias("asked_outcome"), F.col("depth").alias("asked_depth"))


@query("b23_returning_identity", f"""{_DRAWN}{_HIST}, asg as (select dr.*, epoch_us(asked_at) as a, epoch_us(prior_created_at) as b, p.outcome as own_outcome, nb.own, nb.radius, dn.donor_id is not null as known
    from dr left join nb using (target_id) left join dn on dn.donor_id = context_id left join oc p on p.application_id = dr.prior_application_id where ret and dr.prior_application_id is not null)
  select 'UNKNOWN_CONTEXT' as rule, target_id as key from asg where not known union all select 'GAP_TOO_SHORT', target_id from asg where a - b < 2592000000000
  union all select 'OUTSIDE_SUPPORTED_RANGE', target_id from asg where abs(a - b - gap_us) > greatest(259200000000, coalesce(radius, 0))
  union all select 'OUTCOME_MISMATCH', target_id from asg where own and own_outcome <> outcome
  union all select 'CONTEXT_REUSED', context_id from asg group by context_id having count(*) > 1""")
def _(t: Tables):
    """The histories that arrivals really had, against what was drawn for them: which the risk set does not support."""
    targets, donors = asked(t)
    own = drawn_targets(t)[1].filter("prior_application_id is not null").join(order_outcomes(t).select(F.col("application_id").alias("prior_application_id"), F.col("outcome").alias("donor_outcome")), "prior_application_id")
    own = own.select(F.col("application_id").alias("target_id"), F.col("context_id").alias("donor_id"), C.micros("prior_created_at").alias("birth_us"), "donor_outcome", F.lit(0).alias("round"))
    return R.identity_audit(targets.join(own, "target_id"), donors)


@query("b23_matched_identity", None)
def _(t: Tables):
    """The histories that were matched, against the risk set of their round: no row if the matching keeps its rules."""
    targets, donors = asked(t)
    got = matched(t).filter("donor_id is not null").select("target_id", "donor_id", "round")
    got = got.join(donors.select("donor_id", "birth_us", F.col("outcome").alias("donor_outcome")), "donor_id")
    return R.identity_audit(targets.join(got, "target_id"), donors)


@query("m20_table_manifest", f"""{_NAMES} select count(*) as rows, count(distinct event_name) as names, min(support_count) as min_support, max(support_count) as max_support,
  cast(sum(('0x' || substr(sha256(concat_ws('|', model_level, {_N.replace('journey_stage, ', 'journey_stage, ', 1)}, support_count)), 1, 8))::bigint) as bigint) as digest from nm""")
def _(t: Tables):
    n = names(t)
    text = F.concat_ws("|", "model_level", "journey_stage", "journey_substage", "source_type", "event_name", F.col("support_count").cast("string"))
    return n.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("event_name").alias("names"), F.min("support_count").alias("min_support"), F.max("support_count").alias("max_support"),
                 F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")).alias("digest"))

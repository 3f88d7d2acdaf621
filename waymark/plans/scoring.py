"""Lookups against fitted tables, statistics and verdicts, caller extensions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import checks as K
from ..operators import extension as X
from ..operators import lifecycle as L
from ..operators import lookup as G
from ..operators import models as M
from ..operators import ordered as O
from ..operators import reports as R
from ..operators import sequence as E
from ..operators import stats as H
from ..operators import survival as S
from ..session import materialize
from ..sources.adapters import ORDER_SPEC, STREAM_SPEC as SPEC
from ..spec import HAZARD_EDGES, LAW_STRATA, MOTIF_LEVELS, NAME_LEVELS, QUANTILES, RESIDUAL_LEVELS, THRESHOLDS
from . import sql as Q
from .journeys import _GAP, _GUARD, _KIND, _RESP, equal_age_sql, keyed
from .registry import Tables, query
from .reporting import _CARRY, _carry, qcols, rounded
from .views_laws import _HZ, _INT, _MO, _NAMES, _RT, hazard_rows, lm, names

START, MID, END = Q.START, Q.MID, Q.END
LEVELS = {k: keys for k, (keys, _) in SPEC.law_levels.items()}
POOL = ["model_level", "pool_state", "pool_regime", "pool_journey_stage", *LAW_STRATA]


def pooled_law(t: Tables):
    """Law fitted on the first half, pool columns named as the lookup names them."""
    law = S.fit_law(t.episodes(START, MID), SPEC)
    return materialize(law)


def cohort(t: Tables, law):
    """Second-half packets resolved to a pool, with elapsed time, time left and a draw."""
    rows = t.episodes(MID, END).select("application_id", "event_datetime", "state", "regime", "journey_stage", *LAW_STRATA, "deadline")
    rows = G.backoff(rows, law, LEVELS, LAW_STRATA)
    return materialize(rows.withColumns({"elapsed": F.lit(40000.0), "stop": C.seconds_between("event_datetime", "deadline"),
                             "u": C.draw(7, F.col("application_id"), F.date_format("event_datetime", "yyyy-MM-dd"))}))


def renamed(law):
    for c in ("state", "regime", "journey_stage"):
        law = law.withColumnRenamed(c, f"pool_{c}")
    return law


_STR = "ptp_eligible, source_age, customer_kind"
_LV = [("STATE_REGIME", "state", "regime", "''"), ("STATE", "state", "''", "''"), ("STAGE", "''", "''", "journey_stage"), ("GLOBAL", "''", "''", "''")]
_BACK = f"""with {Q.TRAIN},{Q.law('tr', 'law')}, pools as (select distinct {Q.LAW_BY} from law),
  cand as ({' union all '.join(f"select {i} as r, '{l}' as model_level, {a} as ps, {b} as pr, {c} as pj, te.* from te" for i, (l, a, b, c) in enumerate(_LV))}),
  hit as (select c.*, row_number() over (partition by application_id, event_datetime order by r) as k from cand c join pools p on p.model_level = c.model_level and p.state = ps and p.regime = pr and p.journey_stage = pj
    and p.ptp_eligible = c.ptp_eligible and p.source_age = c.source_age and p.customer_kind = c.customer_kind),
  res as (select te.application_id, te.event_datetime, te.deadline, te.ptp_eligible, te.source_age, te.customer_kind, model_level, ps, pr, pj, 40000.0 as elapsed, {Q.secs('te.event_datetime', 'te.deadline')} as stop,
    ('0x' || substr(sha256('7|' || te.application_id || '|' || strftime(te.event_datetime, '%Y-%m-%d')), 1, 16))::ubigint::double / 18446744073709551616.0 as u
    from te left join (select * from hit where k = 1) h using (application_id, event_datetime))"""


@query("g1_backoff_lookup", f"{_BACK} select application_id, event_datetime, model_level, ps as pool_state, pr as pool_regime, pj as pool_journey_stage from res")
def _(t: Tables):
    return cohort(t, pooled_law(t)).select("application_id", "event_datetime", "model_level", "pool_state", "pool_regime", "pool_journey_stage")


@query("g1_backoff_levels", f"{_BACK} select coalesce(model_level, 'MISS') as model_level, count(*) as n from res group by 1")
def _(t: Tables):
    return cohort(t, pooled_law(t)).groupBy(F.coalesce("model_level", F.lit("MISS")).alias("model_level")).agg(F.count(F.lit(1)).alias("n"))


_MB = [(l, keys) for l, keys in MOTIF_LEVELS.items()]
_MFL = "current_journey_substage, channel, time_bucket, prior_send_bucket, current_journey_stage".split(", ")


@query("j13_backoff_join", f"""{_MO}, tr as (select * from mo where status = 'RETAINED_MOTIF' and event_datetime < timestamp '{MID}'),
  mx as ({Q.level_union('tr', MOTIF_LEVELS, _MFL, '1 as one')}), pl as (select model_level, {', '.join(_MFL)} from mx group by all having count(*) >= 20),
  cand as ({' union all '.join(f"select {i} as r, '{l}' as model_level, source_row, " + ', '.join(f if f in keys else f"'' as {f}" for f in _MFL) + f" from mo where event_datetime >= timestamp '{MID}'" for i, (l, keys) in enumerate(_MB))})
  select source_row, arg_min(model_level, r) as model_level from cand join pl using (model_level, {', '.join(_MFL)}) group by 1""")
def _(t: Tables):
    m = materialize(M.motifs(t.stream(True), SPEC, 43200, END))
    early = F.col("event_datetime") < C.ntz(MID)
    return G.backoff(m.filter(~early), M.motif_model(m.filter(early), MOTIF_LEVELS, 20), MOTIF_LEVELS).select("source_row", "model_level")


@query("g2_categorical_draw", f"""{_NAMES}, c as (select journey_substage, event_name, sum(support_count) over (partition by journey_substage order by event_name) as cum, denominator from nm where model_level = 'SUBSTAGE'),
  d as (select source_row, journey_substage, ('0x' || substr(sha256('7|event-name|' || cast(source_row as varchar)), 1, 16))::ubigint::double / 18446744073709551616.0 as u from ev)
  select source_row, min(event_name) as event_name from d join c using (journey_substage) where u * denominator < cum group by 1""")
def _(t: Tables):
    model = names(t).filter("model_level = 'SUBSTAGE'").select("journey_substage", "event_name", "support_count")
    rows = t.stream().select("source_row", "journey_substage").withColumn("u", C.draw(7, "event-name", F.col("source_row")))
    return G.categorical_draw(rows, model, ["journey_substage"], "event_name", "u").select("source_row", "event_name")


_JOIN = """l.model_level = r.model_level and l.state = ps and l.regime = pr and l.journey_stage = pj and l.ptp_eligible = r.ptp_eligible and l.source_age = r.source_age and l.customer_kind = r.customer_kind"""
_SCORE = f"""{_BACK}, lt as (select {Q.LAW_BY}, duration_seconds, labels, mass, sum(mass) over (partition by {Q.LAW_BY} order by duration_seconds, labels) as cum from law where mass > 0),
  sc as (select r.*, coalesce((select sum(mass) from lt l where {_JOIN} and l.duration_seconds < r.elapsed), 0) as before_, coalesce((select sum(mass) from lt l where {_JOIN} and l.duration_seconds < r.stop), 0) as upto from res r where r.model_level is not null)"""


@query("g3_conditional_score", f"""{_SCORE} select application_id, event_datetime, round(greatest(0, 1 - before_), 9) as survival,
  round(case when 1 - before_ > 1e-12 then (upto - before_) / (1 - before_) else 0 end, 9) as remaining_event_mass from sc""")
def _(t: Tables):
    law = pooled_law(t)
    rows = cohort(t, law).filter("model_level is not null")
    return rounded(S.conditional_score(rows, renamed(law), POOL, "elapsed", "stop"), ["survival", "remaining_event_mass"], 9).select(
        "application_id", "event_datetime", "survival", "remaining_event_mass")


@query("g4_next_event_draw", f"""{_SCORE}, pk_ as (select s.application_id, s.event_datetime, arg_min(row(l.duration_seconds, l.labels), l.cum) as hit, any_value(elapsed) as elapsed, any_value(stop) as stop
    from sc s join lt l on l.model_level = s.model_level and l.state = ps and l.regime = pr and l.journey_stage = pj and l.ptp_eligible = s.ptp_eligible and l.source_age = s.source_age and l.customer_kind = s.customer_kind
    where l.cum > s.before_ + s.u * greatest(0, 1 - s.before_) group by 1, 2)
  select s.application_id, s.event_datetime, coalesce(hit[1] >= p.elapsed and hit[1] < p.stop, false) as picked, case when hit[1] >= p.elapsed and hit[1] < p.stop then hit[1] end as pick_seconds,
    case when hit[1] >= p.elapsed and hit[1] < p.stop then hit[2] end as pick_labels from sc s left join pk_ p using (application_id, event_datetime)""")
def _(t: Tables):
    law = pooled_law(t)
    rows = cohort(t, law).filter("model_level is not null")
    return S.draw_next(rows, renamed(law), POOL, "elapsed", "stop", "u").select("application_id", "event_datetime", "picked", "pick_seconds", "pick_labels")


_PM = f"""{_HZ}, dk as (select model_level, bucket, {Q.hazard_interval('duration_seconds')} as k, duration_seconds, count(*) as n from hx where observed group by all),
  dp as (select *, sum(n) over (partition by model_level, bucket, k) as pool from dk where k is not null),
  pm as (select d.model_level, d.bucket, duration_seconds, n, survival_before * hazard * n / pool as mass from dp d join hz h on h.model_level = d.model_level and h.bucket = d.bucket and h.k = d.k)"""


def pm(t: Tables):
    rows, by = materialize(hazard_rows(t)), ["model_level", "bucket"]
    return S.piecewise_mass(S.piecewise_hazard(rows, by, HAZARD_EDGES), rows.filter("observed"), by, HAZARD_EDGES)


@query("g5_piecewise_mass", f"{_PM} select model_level, bucket, duration_seconds, n, round(mass, 9) as mass from pm")
def _(t: Tables):
    return rounded(pm(t), ["mass"], 9)


@query("j11_hazard_interval_join", f"with {Q.RISK} select application_id, event_datetime, {Q.hazard_interval('duration_seconds')} as k from rk")
def _(t: Tables):
    return S.risk_episodes(t.windowed(), SPEC, END).select("application_id", "event_datetime", S.interval_index("duration_seconds", HAZARD_EDGES).alias("k"))


@query("g6_partial_probability", f"{_HZ} select model_level, bucket, cast(k as int) as k, round(case when hazard <= 0 then 0 when hazard >= 1 then 1 else 1 - pow(1 - hazard, 0.25) end, 9) as quarter_probability from hz")
def _(t: Tables):
    h = S.piecewise_hazard(hazard_rows(t), ["model_level", "bucket"], HAZARD_EDGES)
    return h.select("model_level", "bucket", "k", F.round(C.partial_probability("hazard", F.lit(0.25)), 9).alias("quarter_probability"))


_TH = (3600, 21600, 86400, 172800)


@query("g7_cdf_at_thresholds", f"{_PM} select model_level, bucket, threshold_seconds, round(coalesce(sum(mass) filter (where duration_seconds <= threshold_seconds), 0), 9) as cdf from pm, (select unnest({list(_TH)}) as threshold_seconds) group by 1, 2, 3")
def _(t: Tables):
    return rounded(S.cdf_at(pm(t), ["model_level", "bucket"], _TH), ["cdf"], 9)


_SPLIT = "2024-01-16 00:00:00"
_RB = ["pool_state", "pool_age_band", "pool_silence_band", "pool_depth_band"]
_RLV = [("SOURCE_AGE_SILENCE_DEPTH", "state, age_band, silence_band, depth_band"), ("SOURCE_AGE_SILENCE", "state, age_band, silence_band, -1"), ("SOURCE_AGE", "state, age_band, -1, -1"),
        ("SOURCE", "state, -1, -1, -1"), ("AGE_SILENCE", "'', age_band, silence_band, -1"), ("GLOBAL", "'', -1, -1, -1")]


@query("g8_residual_calibration", f"""with {Q.PACK},{Q.landmarks('2024-01-01 00:00:00', '2024-01-31 00:00:00')}, lt as (select * from lm where bound < timestamp '{_SPLIT}'), lv as (select *, row_number() over () as id from lm where bound >= timestamp '{_SPLIT}'),{Q.residual('lt', 'res')},
  cand(r, id, weekday, model_level, state, age_band, silence_band, depth_band) as ({' union all '.join(f"select {i + 10 * (d == '-1')}, id, {d}, '{l}', {c} from lv" for d in ('weekday', '-1') for i, (l, c) in enumerate(_RLV))}),
  pl as (select distinct {Q.RES_BY} from res), hit as (select id, arg_min(row(weekday, model_level, state, age_band, silence_band, depth_band), r) as h from cand join pl using ({Q.RES_BY}) group by 1),
  pr as (select lv.*, coalesce((select sum(mass) from res where row(weekday, model_level, state, age_band, silence_band, depth_band) = h and res.duration_seconds < {Q.secs('bound', 'deadline')}), 0) as prediction from lv join hit using (id))
  select count(*) as landmarks, count(distinct application_id) as applications, round(avg(case when observed and next_labels <> '[]' then 1.0 else 0.0 end), 9) as observed_incidence, round(avg(prediction), 9) as predicted_incidence from pr""")
def _(t: Tables):
    return calibration(t).agg(F.count(F.lit(1)).alias("landmarks"), F.countDistinct("application_id").alias("applications"),
                              F.round(F.avg("visible"), 9).alias("observed_incidence"), F.round(F.avg("prediction"), 9).alias("predicted_incidence"))


def calibration(t: Tables):
    """Validation landmarks with the visible outcome and the probability the training law gives."""
    rows = materialize(lm(t))
    at = C.ntz(_SPLIT)
    law = materialize(S.fit_residual(rows.filter(F.col("landmark") < at), SPEC))
    test = rows.filter(F.col("landmark") >= at).select("application_id", "landmark", "deadline", "observed", "next_labels", "weekday", "state", "age_band", "silence_band", "depth_band")
    blank = lambda f: F.lit("") if f == "state" else F.lit(-1)
    own = G.backoff(test, law, RESIDUAL_LEVELS, ["weekday"], blank).withColumn("pool_weekday", F.col("weekday"))
    miss = own.filter("model_level is null").select(test.columns)
    pooled = G.backoff(miss, law.filter("weekday = -1"), RESIDUAL_LEVELS, [], blank).withColumn("pool_weekday", F.lit(-1))
    found = own.filter("model_level is not null").unionByName(pooled)
    pool = ["pool_weekday", "model_level", *_RB]
    for c in ("weekday", "state", "age_band", "silence_band", "depth_band"):
        law = law.withColumnRenamed(c, f"pool_{c}")
    found = found.filter("model_level is not null").withColumns({"zero": F.lit(0.0), "left": C.seconds_between("landmark", "deadline")})
    out = S.conditional_score(found, law, pool, "zero", "left")
    return out.withColumns({"prediction": F.col("remaining_event_mass"), "visible": C.flag(F.col("observed") & (F.col("next_labels") != S.BLANK))})


_STRATA = """select application_id, last_label, case when age_hours <= 24 then 'a' when age_hours <= 48 then 'b' else 'c' end as age,
    application_id in (select application_id from ev where event_datetime >= bound and application_id is not null) as active from"""


def _carried_sql(bound: str, name: str) -> str:
    return f"""{name}s as (select application_id, max(event_datetime) as last_at, arg_max(journey_substage, row(event_datetime, source_row)) as last_label, bool_or(journey_substage = 'purchase') as done from clean where event_datetime < timestamp '{bound}' group by 1),
  {name} as (select application_id, last_label, case when {Q.secs('application_created_at', f"timestamp '{bound}'")} <= 86400 then 'a' else 'b' end as age,
    application_id in (select application_id from clean where event_datetime >= timestamp '{bound}') as active from {name}s join life using (application_id) where deadline > timestamp '{bound}' and not done)"""


_HB = ("2024-01-06 00:00:00", "2024-01-09 00:00:00", "2024-01-12 00:00:00", "2024-01-15 00:00:00")
_MATCH = f"""with {Q.CLEANLIFE}, {', '.join(_carried_sql(b, f'h{i}') for i, b in enumerate(_HB))}, {_carried_sql('2024-01-24 00:00:00', 'tg')},
  hs as ({' union all '.join(f'select * from h{i}' for i in range(len(_HB)))}), pu as (select last_label, age, application_id, count(*) as n, count(*) filter (where active) as a from hs group by 1, 2, 3),
  ce as (select last_label, age, sum(n) as opp, count(*) as units, sum(a) / sum(n) as rate from pu group by 1, 2 having count(*) >= 20),
  am as (select last_label, age, count(*) as m, count(*) filter (where active) as hit from tg group by 1, 2), j as (select * from am join ce using (last_label, age)),
  inf as (select application_id, sum(m / opp * (a - n * rate)) as i from pu join j using (last_label, age) group by 1)"""


def matched(t: Tables):
    from .journeys import carried
    ev = t.windowed()

    def one(bound):
        at = C.ntz(bound)
        later = ev.filter(F.col("event_datetime") >= at).select("application_id", F.lit(True).alias("active")).distinct()
        c = carried(t, bound).join(later, "application_id", "left").withColumn("active", F.coalesce("active", F.lit(False)))
        return c.select("application_id", "last_label", F.when(C.seconds_between("application_created_at", at) <= 86400, "a").otherwise("b").alias("age"), "active")

    hist = one(_HB[0])
    for b in _HB[1:]:
        hist = hist.unionByName(one(b))
    return H.matched_expectation(materialize(one("2024-01-24 00:00:00")), materialize(hist), ["last_label", "age"], "active", "application_id", 20)


@query("g9_expected_active", f"{_MATCH} select cast(sum(m) as bigint) as supported, cast(sum(hit) as bigint) as observed_active, round(sum(m * rate), 9) as expected_active, round(1 - sum(hit) / sum(m * rate), 9) as relative_deficit from j")
def _(t: Tables):
    return rounded(matched(t).select("supported", "observed_active", "expected_active", "relative_deficit"), ["expected_active", "relative_deficit"], 9)


@query("j12_strata_join", f"{_MATCH} select last_label, age, m, hit, units, round(rate, 9) as rate from j")
def _(t: Tables):
    from .journeys import carried
    ev = t.windowed()

    def one(bound):
        at = C.ntz(bound)
        later = ev.filter(F.col("event_datetime") >= at).select("application_id", F.lit(1).alias("active")).distinct()
        c = carried(t, bound).join(later, "application_id", "left").na.fill(0, ["active"])
        return c.select("application_id", "last_label", F.when(C.seconds_between("application_created_at", at) <= 86400, "a").otherwise("b").alias("age"), "active")

    hist = one(_HB[0])
    for b in _HB[1:]:
        hist = hist.unionByName(one(b))
    cells = hist.groupBy("last_label", "age").agg(F.countDistinct("application_id").alias("units"), F.round(F.avg("active"), 9).alias("rate")).filter("units >= 20")
    aim = one("2024-01-24 00:00:00").groupBy("last_label", "age").agg(F.count(F.lit(1)).alias("m"), F.sum("active").alias("hit"))
    return aim.join(cells, ["last_label", "age"])


@query("h9_predictive_interval", f"""{_MATCH}, v as (select (select sum(i * i) from inf) as ev, (select sum(m * rate * (1 - rate)) from j) as wv, (select sum(m * rate) from j) as x)
  select round(ev, 9) as estimation_variance, round(wv, 9) as world_variance, round(greatest(0, x - 1.96 * sqrt(ev + wv)), 9) as low, round(x + 1.96 * sqrt(ev + wv), 9) as high from v""")
def _(t: Tables):
    c = ["estimation_variance", "world_variance", "low", "high"]
    return rounded(matched(t).select(*c), c, 9)


@query("g10_delay_interpolation", f"""{_RT}, d as (select state, regime, response, ('0x' || substr(sha256('7|' || state || '|' || regime || '|' || response), 1, 16))::ubigint::double / 18446744073709551616.0 as u, q50, q90, q95, q99 from rt)
  select state, regime, response, round(case when u < 0.5 then q50 * u / 0.5 when u < 0.9 then q50 + (q90 - q50) * (u - 0.5) / 0.4 when u < 0.95 then q90 + (q95 - q90) * (u - 0.9) / 0.05 when u < 0.99 then q95 + (q99 - q95) * (u - 0.95) / 0.04 else q99 end, 5) as delay_seconds from d""")
def _(t: Tables):
    r = M.regime_transitions(t.windowed(), SPEC).withColumn("u", C.draw(7, F.col("state"), F.col("regime"), F.col("response")))
    knots = [(0.0, 0.0), (0.5, "median_seconds"), (0.9, "p90_seconds"), (0.95, "p95_seconds"), (0.99, "p99_seconds"), (1.0, "p99_seconds")]
    return r.select("state", "regime", "response", F.round(C.interpolate("u", knots), 5).alias("delay_seconds"))


@query("g11_support_diagnostics", f"""{_BACK}, mx as (select {Q.LAW_BY}, max(duration_seconds) filter (where mass > 0) as last from law group by all),
  d as (select r.*, last, exists (select 1 from law l where {_JOIN} and l.mass > 0 and l.duration_seconds >= r.elapsed and l.duration_seconds < r.stop) as any_left from res r left join mx l on {_JOIN})
  select count(*) as rows, count(*) filter (where model_level is null) as no_pool, count(*) filter (where model_level is not null and not any_left) as no_remaining_donor, count(*) filter (where elapsed > last) as beyond_last_donor from d""")
def _(t: Tables):
    law = pooled_law(t)
    rows = cohort(t, law)
    last = renamed(law).filter("mass > 0").groupBy(*POOL).agg(F.max("duration_seconds").alias("last"))
    hit = S.conditional_score(rows.filter("model_level is not null"), renamed(law), POOL, "elapsed", "stop").join(last, POOL, "left")
    n = hit.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("remaining_event_mass") * F.col("survival") < 1e-12).alias("no_remaining_donor"), F.count_if(F.col("elapsed") > F.col("last")).alias("beyond_last_donor"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return n.select(total.alias("rows"), (total - F.col("found")).alias("no_pool"), "no_remaining_donor", "beyond_last_donor")


@query("g12_blocked_mass", f"""with {Q.EPI}, b as (select *, observed and next_state = 'purchase' and not ptp_eligible as blocked from epi)
  select state, count(*) as episodes, count(*) filter (where observed) as observed, count(*) filter (where blocked) as blocked, round(count(*) filter (where blocked) / count(*), 9) as blocked_share from b group by 1""")
def _(t: Tables):
    e = t.episodes()
    blocked = F.col("observed") & (F.col("next_labels") == S.BLANK)
    return e.groupBy("state").agg(F.count(F.lit(1)).alias("episodes"), F.count_if("observed").alias("observed"), F.count_if(blocked).alias("blocked"),
                                  F.round(F.sum(C.flag(blocked)) / F.count(F.lit(1)), 9).alias("blocked_share"))


_DON = f"""{_INT}, gp as (select source_row, journey_substage, cast(cb as bigint) as count_bucket, epoch_us(nx) - epoch_us(event_datetime) as gap from i1 where nx is not null),
  nf as (select *, row_number() over (partition by journey_substage, count_bucket order by sha256(cast(source_row as varchar))) - 1 as i, count(*) over (partition by journey_substage, count_bucket) as n from gp),
  nc as (select *, row_number() over (partition by journey_substage order by sha256(cast(source_row as varchar))) - 1 as i, count(*) over (partition by journey_substage) as n from gp),
  rq as (select source_row, journey_substage, cast(cb as bigint) as count_bucket, ('0x' || substr(sha256('7|gap|' || cast(source_row as varchar)), 1, 16))::ubigint::double / 18446744073709551616.0 as u from i1),
  fp as (select journey_substage, count_bucket, count(*) as fine_pool from gp group by 1, 2)"""


@query("g13_donor_pick", f"""{_DON}, r as (select rq.*, coalesce(fine_pool, 0) as fine_pool from rq left join fp using (journey_substage, count_bucket))
  select r.source_row, 'FINE' as pool_level, nf.gap as donor_value from r join nf on nf.journey_substage = r.journey_substage and nf.count_bucket = r.count_bucket and nf.i = floor(r.u * nf.n) where fine_pool >= 50
  union all select r.source_row, 'COARSE', nc.gap from r join nc on nc.journey_substage = r.journey_substage and nc.i = floor(r.u * nc.n) where fine_pool < 50""")
def _(t: Tables):
    pool = materialize(M.event_intensity(t.windowed(), SPEC)[1].select("source_row", "journey_substage", "count_bucket", "gap_microseconds"))
    rows = E.day_ordinal(t.windowed().filter(~L.is_label(SPEC.terminal))).select("source_row", "journey_substage", F.col("count_bucket").cast("long").alias("count_bucket"))
    rows = rows.withColumn("u", C.draw(7, "gap", F.col("source_row")))
    return G.donor_pick(rows, pool, ["journey_substage", "count_bucket"], ["journey_substage"], "gap_microseconds", "source_row", "u").select("source_row", "pool_level", "donor_value")


# --- statistics ---------------------------------------------------------------------------------------------

@query("h1_quantiles", _GAP.replace("as age_seconds", "as age_seconds, data_origin as origin") + f" select origin as data_origin, {qcols('gap_seconds')} from gp where gap_seconds is not null group by 1")
def _(t: Tables):
    return rounded(O.quantiles(E.gaps(keyed(t)), "gap_seconds", QUANTILES, ["data_origin"]), QUANTILES)


_EA = f"with {Q.CLEANLIFE}, {equal_age_sql(1)}, hs as (select * from ea1 where application_created_at < timestamp '2024-01-21'), si as (select * from ea1 where application_created_at >= timestamp '2024-01-21'), sw as (select weekday, count(*) / (select count(*) from si) as weight from si group by 1)"


def two_populations(t: Tables):
    ea = E.equal_age(t.windowed(), t.lifecycles(), 1, START, END, SPEC)
    early = F.col("application_created_at") < C.ntz("2024-01-21 00:00:00")
    return ea.filter(early), ea.filter(~early)


@query("h2_weighted_quantiles", f"""{_EA}, n as (select weekday, count(*) as n from hs group by 1), x as (select events::double as v, sum(weight / n) as w from hs join sw using (weekday) join n using (weekday) group by 1),
  c as (select v, sum(w) over (order by v) as cum, sum(w) over () as tot from x) select """ + ", ".join(f"min(v) filter (where round(cum, 9) >= round({p} * tot, 9)) as {k}" for k, p in QUANTILES.items()) + " from c")
def _(t: Tables):
    hist, sim = two_populations(t)
    n = hist.groupBy("weekday").agg(F.count(F.lit(1)).alias("n"))
    rows = hist.join(H.stratum_weights(sim, "weekday"), "weekday").join(n, "weekday").withColumn("w", F.col("weight") / F.col("n"))
    return O.quantiles(rows, "events", QUANTILES, weight="w")


_MET = ("events", "eventful_days", "transitions", "ptp")


@query("h3_post_stratified", f"{_EA}, " + ", ".join(f"g_{m} as (select '{m}' as metric, sum(weight * a) as mean, sum(weight * weight * v / n) as variance from (select weekday, avg({m}) as a, var_samp({m}) as v, count(*) as n from hs group by 1) join sw using (weekday))" for m in _MET)
       + " select metric, round(mean, 9) as mean, round(variance, 9) as variance, round(mean - 1.96 * sqrt(variance), 9) as low, round(mean + 1.96 * sqrt(variance), 9) as high from (" + " union all ".join(f"select * from g_{m}" for m in _MET) + ")")
def _(t: Tables):
    hist, sim = two_populations(t)
    return rounded(H.post_stratified(hist, H.stratum_weights(sim, "weekday"), "weekday", _MET), ["mean", "variance", "low", "high"], 9)


@query("h4_total_variation", f"""with {Q.EV}, a as (select event_name as c, count(*) / (select count(*) from ev where not is_simulated) as s from ev where not is_simulated group by 1),
  b as (select event_name as c, count(*) / (select count(*) from ev where is_simulated) as s from ev where is_simulated group by 1)
  select round(0.5 * sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))), 9) as total_variation from a full join b using (c)""")
def _(t: Tables):
    ev = t.stream()
    a, b = R.distribution(ev.filter("not is_simulated"), "event_name"), R.distribution(ev.filter("is_simulated"), "event_name")
    return rounded(H.total_variation(a, b, ["category"]), ["total_variation"], 9)


@query("h5_cluster_bootstrap", None)
def _(t: Tables):
    g = E.gaps(keyed(t)).filter("gap_seconds is not null").withColumns({"hit": C.flag(F.col("gap_seconds") <= 86400), "one": F.lit(1)})
    return H.bootstrap_ratio(g, "application_id", "hit", "one", 400, by=["journey_substage"])


@query("h5_calibration_bootstrap", None)
def _(t: Tables):
    c = calibration(t).withColumns({"error": F.col("visible") - F.col("prediction"), "one": F.lit(1)})
    return H.bootstrap_ratio(c, "application_id", "error", "one", 400)


@query("h6_survival_bootstrap", None)
def _(t: Tables):
    r = S.risk_episodes(t.windowed(), SPEC, END)
    return H.bootstrap_survival(r, "application_id", _TH, 400)


@query("h7_paired_bootstrap", None)
def _(t: Tables):
    hist, sim = two_populations(t)
    return H.bootstrap_difference(materialize(hist), materialize(sim), "application_id", "weekday", 400)


@query("h8_wilson", f"""with {Q.CLEANLIFE}, p as (select distinct application_id from clean where journey_substage = 'purchase'), g as (select cast(isodow(application_created_at) - 1 as int) as weekday, count(*) as n, count(p.application_id) as hits from life left join p using (application_id) group by 1)
  select weekday, n, hits, round((hits / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 9) as low,
    round((hits / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 9) as high from g""")
def _(t: Tables):
    life = t.lifecycles().join(L.first_terminals(t.windowed(), SPEC), "application_id", "left")
    g = life.groupBy(C.weekday("application_created_at").alias("weekday")).agg(F.count(F.lit(1)).alias("n"), F.count("terminal_datetime").alias("hits"))
    lo, hi = C.wilson("hits", "n")
    return g.select("weekday", "n", "hits", F.round(lo, 9).alias("low"), F.round(hi, 9).alias("high"))


@query("h10_expected_returning", f"""with {Q.ORD}, {_KIND}, c as (select *, cast(isodow(application_created_at) - 1 as int) as weekday, application_created_at >= (select max(o_orderdate) - interval 60 day from orders) as fresh from ck),
  r as (select weekday, avg(case when gap_days >= 30 then 1.0 else 0.0 end) as rate, count(*) as size from c where not fresh group by 1), n as (select weekday, count(*) as n from c where fresh group by 1),
  s as (select sum(n * rate) as expected, sum((n + n * n / size) * rate * (1 - rate)) as variance from n join r using (weekday))
  select round(expected, 9) as expected, round(variance, 9) as variance, round(expected - 1.96 * sqrt(variance), 9) as low, round(expected + 1.96 * sqrt(variance), 9) as high from s""")
def _(t: Tables):
    k = L.customer_kind(t.orders(), ORDER_SPEC).withColumn("weekday", C.weekday("application_created_at"))
    cut = t.table("orders").agg(F.max("o_orderdate").cast("timestamp_ntz") - F.expr("interval 60 day")).scalar()
    fresh = F.col("application_created_at") >= cut
    rates = k.filter(~fresh).groupBy("weekday").agg(F.avg(C.flag(F.col("customer_kind") == "RETURNING_CUSTOMER")).alias("rate"), F.count(F.lit(1)).alias("size"))
    return rounded(H.expected_count(rates, k.filter(fresh), "weekday"), ["expected", "variance", "low", "high"], 9)


_DIFF = f"""with {Q.EV}, s as (select time_bucket, journey_substage, avg(visitnum) filter (where not is_simulated) as h, avg(visitnum) filter (where is_simulated) as x,
    sqrt(var_samp(visitnum) filter (where not is_simulated) / count(*) filter (where not is_simulated) + var_samp(visitnum) filter (where is_simulated) / count(*) filter (where is_simulated)) as se from ev group by 1, 2),
  d as (select time_bucket, journey_substage, x - h as diff, x - h - 1.96 * se as lo, x - h + 1.96 * se as hi, 0.1 * h as margin from s)"""


def differences(t: Tables):
    sim = F.col("is_simulated")
    v = lambda c: F.when(c, F.col("visitnum"))
    s = t.stream().groupBy("time_bucket", "journey_substage").agg(
        F.avg(v(~sim)).alias("h"), F.avg(v(sim)).alias("x"), F.sqrt(F.var_samp(v(~sim)) / F.count(v(~sim)) + F.var_samp(v(sim)) / F.count(v(sim))).alias("se"))
    d = F.col("x") - F.col("h")
    return s.select("time_bucket", "journey_substage", d.alias("diff"), (d - 1.96 * F.col("se")).alias("lo"), (d + 1.96 * F.col("se")).alias("hi"), C.intensity_margin("h").alias("margin"))


_EQ = "case when lo >= -margin and hi <= margin then case when lo <= 0 and hi >= 0 then 'PASS' else 'LIMITATION' end when lo > margin or hi < -margin then 'FAIL' else 'INCONCLUSIVE' end"


@query("h11_equivalence", f"{_DIFF} select time_bucket, journey_substage, {_EQ} as verdict from d")
def _(t: Tables):
    return differences(t).select("time_bucket", "journey_substage", C.equivalence("diff", "lo", "hi", "margin").alias("verdict"))


@query("h12_inflation", f"{_DIFF} select time_bucket, journey_substage, case when lo <= 0 then 'PASS' else 'INCONCLUSIVE' end as verdict, case when lo <= 0 then 'PASS' else {_EQ} end as verdict_with_margin from d")
def _(t: Tables):
    return differences(t).select("time_bucket", "journey_substage", C.inflation("diff", "lo", "hi").alias("verdict"), C.inflation("diff", "lo", "hi", "margin").alias("verdict_with_margin"))


@query("h13_relative_margin", f"{_DIFF} select time_bucket, journey_substage, round(margin, 9) as margin from d")
def _(t: Tables):
    return rounded(differences(t).select("time_bucket", "journey_substage", "margin"), ["margin"], 9)


@query("h14_guard_comparison", f"""{_GUARD}, life as (select application_id, application_created_at from ev where journey_substage = 'signup' and application_id is not null),
  n as (select application_id, count(*) as n, max((journey_substage = 'purchase')::int) as p from k where stops = 0 and event_datetime < application_created_at + interval 1 day group by 1),
  x as (select cast(isodow(application_created_at) - 1 as int) as weekday, application_created_at >= timestamp '2024-01-21' as sim, coalesce(n, 0) as events, coalesce(p, 0) as ptp from life left join n using (application_id)
    where application_created_at <= timestamp '{END}' - interval 1 day), w as (select weekday, count(*) / (select count(*) from x where sim) as weight from x where sim group by 1),
  h as (select weekday, avg(events) as a, var_samp(events) as v, avg(ptp) as pa, count(*) as n from x where not sim group by 1), s as (select avg(events) as a, var_samp(events) / count(*) as v, avg(ptp) as pa from x where sim),
  hg as (select sum(weight * h.a) as hm, sum(weight * weight * h.v / h.n) as hv, sum(weight * h.pa) as hp from h join w using (weekday))
  select round(hm, 9) as historical_mean, round(s.a, 9) as simulated_mean, round(s.a - hm, 9) as difference, round(s.a - hm - 1.96 * sqrt(hv + s.v), 9) as low, round(s.a - hm + 1.96 * sqrt(hv + s.v), 9) as high,
    round(hp, 9) as historical_rate, round(s.pa, 9) as simulated_rate from hg, s""")
def _(t: Tables):
    kept = E.guard_prefix(t.windowed(), SPEC).filter("kept")
    x = E.equal_age(kept, t.lifecycles(), 1, START, END, SPEC)
    early = F.col("application_created_at") < C.ntz("2024-01-21 00:00:00")
    hist, sim = x.filter(early), x.filter(~early)
    g = H.post_stratified(hist, H.stratum_weights(sim, "weekday"), "weekday", ["events", "ptp"])
    one = F.lit(1).alias("__j")
    h = g.agg(F.max(F.when(F.col("metric") == "events", F.col("mean"))).alias("hm"), F.max(F.when(F.col("metric") == "events", F.col("variance"))).alias("hv"),
              F.max(F.when(F.col("metric") == "ptp", F.col("mean"))).alias("hp"), F.max(F.lit(1)).alias("__j"))
    s = sim.agg(F.avg("events").alias("a"), (F.var_samp("events") / F.count(F.lit(1))).alias("v"), F.avg("ptp").alias("pa"), F.max(F.lit(1)).alias("__j"))
    d, half = F.col("a") - F.col("hm"), 1.96 * F.sqrt(F.col("hv") + F.col("v"))
    out = h.join(s, "__j").select(F.col("hm").alias("historical_mean"), F.col("a").alias("simulated_mean"), d.alias("difference"), (d - half).alias("low"), (d + half).alias("high"),
                                  F.col("hp").alias("historical_rate"), F.col("pa").alias("simulated_rate"))
    return rounded(out, out.columns, 9)


@query("h15_timing_error", f"""with {Q.TRAIN}, trr as (select * from tr),{Q.product_limit('trr', 'pl', 'state')}, th as (select unnest([86400, 172800, 259200]) as threshold_seconds),
  o as (select state, threshold_seconds, count(*) filter (where observed and duration_seconds <= threshold_seconds) / count(*) as observed_cdf from te, th group by 1, 2),
  m as (select state, threshold_seconds, coalesce(sum(raw_mass) filter (where duration_seconds <= threshold_seconds), 0) as model_cdf from pl, th group by 1, 2)
  select state, round(max(abs(observed_cdf - model_cdf)), 9) as max_error from o join m using (state, threshold_seconds) group by 1""")
def _(t: Tables):
    th = (86400, 172800, 259200)
    law = S.product_limit(t.episodes(START, MID).withColumn("labels", F.col("next_labels")), ["state"])
    model = S.cdf_at(law, ["state"], th, "raw_mass").withColumnRenamed("cdf", "model_cdf")
    te = t.episodes(MID, END).groupBy("state").agg(*[(F.sum(C.flag(F.col("observed") & (F.col("duration_seconds") <= x))) / F.count(F.lit(1))).alias(f"t{x}") for x in th])
    obs = te.select("state", F.expr(f"stack({len(th)}, " + ", ".join(f"{x}, t{x}" for x in th) + ") as (threshold_seconds, observed_cdf)"))
    return obs.join(model, ["state", "threshold_seconds"]).groupBy("state").agg(F.round(F.max(F.abs(F.col("observed_cdf") - F.col("model_cdf"))), 9).alias("max_error"))


_DEST = "coalesce(json_extract_string({0}, '$[0]'), 'BLOCKED_TERMINAL')"
_PAIR = f"""with {Q.TRAIN},{Q.law('tr', 'law')}, ob as (select state as source, {_DEST.format("next_labels")} as destination, duration_seconds from te where observed and event_datetime < timestamp '{END}' - interval 1 day),
  lw as (select state as source, {_DEST.format("labels")} as destination, duration_seconds, mass * denominator as m from law where model_level = 'STATE' and labels <> '[]'),
  hx as (select model_level, case when model_level = 'GLOBAL' then '' else state end as source, duration_seconds, observed and next_state <> 'purchase' as observed from tr, (select unnest(['STATE', 'GLOBAL']) as model_level)),{Q.piecewise('hx', 'hz', 'source')},
  dk as (select source, {Q.hazard_interval('duration_seconds')} as k, duration_seconds, count(*) as n from hx where observed group by all),
  dp as (select *, sum(n) over (partition by source, k) as pool from dk where k is not null),
  bl as (select d.source, duration_seconds, survival_before * hazard * n / pool as m from dp d join hz h on h.source = d.source and h.k = d.k), th as (select unnest([86400, 172800, 259200]) as threshold_seconds),
  o as (select source, destination, threshold_seconds, count(*) as n, count(*) filter (where duration_seconds <= threshold_seconds) / count(*) as observed_cdf from ob, th group by 1, 2, 3 having count(*) >= 30),
  l as (select source, destination, threshold_seconds, coalesce(sum(m) filter (where duration_seconds <= threshold_seconds), 0) / sum(m) as law_cdf from lw, th group by 1, 2, 3 having sum(m) > 0),
  b as (select source, threshold_seconds, coalesce(sum(m) filter (where duration_seconds <= threshold_seconds), 0) / sum(m) as baseline_cdf from bl, th group by 1, 2 having sum(m) > 0),
  j as (select o.*, law_cdf, baseline_cdf from o join l using (source, destination, threshold_seconds) join b on b.threshold_seconds = o.threshold_seconds and b.source = case when o.source in (select source from b) then o.source else '' end)"""


@query("h15_pair_timing", f"""{_PAIR} select source, destination, n as rows, cast(threshold_seconds as bigint) as threshold_seconds, round(observed_cdf, 9) as observed_cdf, round(law_cdf, 9) as law_cdf, round(baseline_cdf, 9) as baseline_cdf,
  round(max(abs(observed_cdf - law_cdf)) over w, 9) as law_error, round(max(abs(observed_cdf - baseline_cdf)) over w, 9) as baseline_error from j window w as (partition by source, destination)""")
def _(t: Tables):
    """Timing of each transition of the second half: the competing-event law and the continuation hazard of the first."""
    first = lambda labels: F.coalesce(F.get(F.from_json(labels, "array<string>"), 0), F.lit("BLOCKED_TERMINAL"))
    train = materialize(t.episodes(START, MID).select("application_id", "state", "regime", "journey_stage", *LAW_STRATA, "duration_seconds", "observed", "next_labels", "next_state"))
    law = S.fit_law(train, SPEC).filter((F.col("model_level") == "STATE") & (F.col("labels") != S.BLANK)).select(
        F.col("state").alias("source"), first(F.col("labels")).alias("destination"), "duration_seconds", "mass", "denominator")
    go = F.coalesce(F.col("observed") & (F.col("next_state") != SPEC.terminal), F.lit(False))
    rows = materialize(train.select(F.explode(F.array(F.col("state"), F.lit(""))).alias("source"), "duration_seconds", go.alias("observed")))
    baseline = S.piecewise_mass(S.piecewise_hazard(rows, ["source"], HAZARD_EDGES), rows.filter("observed"), ["source"], HAZARD_EDGES)
    seen = t.episodes(MID, END).filter(F.col("observed") & (F.col("event_datetime") < C.ntz(END) - F.expr("interval 1 day"))).select(
        F.col("state").alias("source"), first(F.col("next_labels")).alias("destination"), "duration_seconds")
    got = S.pair_timing(seen, law, baseline, (86400, 172800, 259200), 30)
    return rounded(got, ["observed_cdf", "law_cdf", "baseline_cdf", "law_error", "baseline_error"], 9).withColumn("threshold_seconds", F.col("threshold_seconds").cast("long"))


_P17 = {"median": .5, "p90": .9, "p95": .95, "p99": .99}


@query("h17_latency_error", _GAP.replace("as age_seconds", "as age_seconds, data_origin as origin") + ", " + ", ".join(
    f"q_{k} as (select '{k}' as quantile, quantile_cont(gap_seconds, {p}) filter (where origin = 'HISTORICAL_MARCH') as reference, quantile_cont(gap_seconds, {p}) filter (where origin = 'SIMULATED_MAY') as candidate, quantile_cont(gap_seconds, {p}) filter (where origin = 'HISTORICAL_APRIL') as baseline from gp)" for k, p in _P17.items())
    + " select quantile, round(abs(candidate - reference) / reference, 8) as relative_error, abs(candidate - reference) / reference <= abs(baseline - reference) / reference as improves from (" + " union all ".join(f"select * from q_{k}" for k in _P17) + ")")
def _(t: Tables):
    g = E.gaps(keyed(t))
    of = lambda o: g.filter(F.col("data_origin") == o)
    r = H.latency_error(of("HISTORICAL_MARCH"), of("SIMULATED_MAY"), of("HISTORICAL_APRIL"), "gap_seconds", _P17)
    return rounded(r.select("quantile", "relative_error", "improves"), ["relative_error"], 8)


# --- caller extensions ---------------------------------------------------------------------------------------

def evening_policy(pdf: pd.DataFrame) -> pd.DataFrame:
    send = pdf["journey_substage"].isin(["view", "click"])
    return pd.DataFrame({"campaign_sent": send, "channel_id": pdf["channel"].str.lower().where(send), "theme": None, "time_bucket": pd.Series("evening", index=pdf.index).where(send)})


@query("u1_batch_policy", f"""with {Q.EV} select source_row, journey_substage in ('view', 'click') as campaign_sent, case when journey_substage in ('view', 'click') then channel end as channel_id,
  case when journey_substage in ('view', 'click') then 'EVENING' end as time_bucket, case when journey_substage = 'purchase' then 'TERMINAL' when journey_substage in ('view', 'click') and not (event_datetime < deadline) then 'SEND_AFTER_EXPIRY' end as violation
  from ev where application_id is not null""")
def _(t: Tables):
    s = keyed(t).select("source_row", "journey_substage", "channel", (F.col("journey_substage") == SPEC.terminal).alias("terminal"), (F.col("event_datetime") < F.col("deadline")).alias("live"))
    return X.apply_policy(s, evening_policy, "terminal", "live").select("source_row", "campaign_sent", "channel_id", "time_bucket", "violation")


def count_step(state, pdf: pd.DataFrame):
    counts = pdf["journey_substage"].value_counts()
    state = [0] * 5 if state is None else state
    return [a + int(counts.get(l, 0)) for a, l in zip(state, ("signup", "error", "view", "click", "purchase"))]


@query("u2_history_encoder", f"""with {Q.EV} select application_id, concat_ws(',', count(*) filter (where journey_substage = 'signup'), count(*) filter (where journey_substage = 'error'), count(*) filter (where journey_substage = 'view'),
  count(*) filter (where journey_substage = 'click'), count(*) filter (where journey_substage = 'purchase')) as embedding, cast(null as varchar) as violation from ev where application_id is not null group by 1""")
def _(t: Tables):
    rows = keyed(t).select("application_id", "event_datetime", "source_row", "journey_substage", "part")
    out = X.apply_encoder(rows, ["application_id"], count_step, lambda a, b: [x + y for x, y in zip(a, b)], list, 5, ["event_datetime", "source_row"])
    return out.select("application_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("embedding"), "violation")

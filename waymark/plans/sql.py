"""Shared DuckDB fragments: the adapter views said in SQL."""

STAGE = ("case {x} when 'signup' then 'Onboarding' when 'view' then 'Awareness' when 'click' then 'Consideration' "
         "when 'error' then 'Tech' when 'purchase' then 'Transaction' end")
K = "cast(json_extract_string(props, '$.k') as int)"


def _events(label: str, name: str) -> str:
    return f"""{name}0 as (
  select cast(user_id as varchar) as context_id, ts as event_datetime, event_id as source_row,
         {label} as journey_substage, 'k' || cast({K} // 10 as varchar) as event_name,
         case {K} % 3 when 0 then 'SMS' when 1 then 'WA' else 'GRCS' end as channel, value as visitnum
  from events),
{name}1 as (
  select *, sum(case when journey_substage = 'signup' then 1 else 0 end) over w as seq,
         last_value(case when journey_substage = 'signup' then event_datetime end ignore nulls) over w as application_created_at
  from {name}0 window w as (partition by context_id order by event_datetime, source_row
                            rows between unbounded preceding and current row)),
{name} as (
  select context_id, event_datetime, source_row, journey_substage, event_name, channel, visitnum,
         case when seq > 0 then context_id || '-' || cast(seq as varchar) end as application_id,
         {STAGE.format(x='journey_substage')} as journey_stage, application_created_at,
         application_created_at + interval 3 day as deadline,
         case when event_datetime < timestamp '2024-01-11' then 'HISTORICAL_MARCH'
              when event_datetime < timestamp '2024-01-21' then 'HISTORICAL_APRIL' else 'SIMULATED_MAY' end as data_origin,
         event_datetime >= timestamp '2024-01-21' as is_simulated,
         case when visitnum < 10 then 'WEB' else 'APP' end as source_type,
         cast(isodow(event_datetime) as bigint) as day_of_week_num,
         case when hour(event_datetime) < 6 then 'night' when hour(event_datetime) < 12 then 'morning'
              when hour(event_datetime) < 17 then 'afternoon' when hour(event_datetime) < 21 then 'evening'
              else 'night' end as time_bucket
  from {name}1)"""


EV = _events("event_type", "ev")
CAMPAIGN_LABEL = (f"case when {K} < 15 then 'campaign_sent' when {K} < 25 then 'campaign_open_read' "
                  f"when {K} < 30 then 'campaign_clicked' else event_type end")
CV = _events(CAMPAIGN_LABEL, "cv")
LIFE = EV + """,
life as (select application_id, context_id, application_created_at, deadline from ev
         where journey_substage = 'signup' and application_id is not null)"""
CLIFE = CV + """,
clife as (select application_id, context_id, application_created_at, deadline from cv
          where journey_substage = 'signup' and application_id is not null)"""
# rows inside the half-open window, cut after the first terminal
CLEAN = EV + """,
win as (select * from ev where application_id is not null and event_datetime >= application_created_at
        and event_datetime < deadline),
clean as (select * exclude(done) from (
  select *, coalesce(sum(case when journey_substage = 'purchase' then 1 else 0 end) over (
    partition by application_id order by event_datetime, source_row
    rows between unbounded preceding and 1 preceding), 0) as done from win) where done = 0)"""
CLEANLIFE = CLEAN + """,
life as (select application_id, context_id, application_created_at, deadline from ev
         where journey_substage = 'signup' and application_id is not null)"""
# copies of every error row arrive again at the end of the source
DUP = EV + """,
dup as (select * from ev union all select * replace (source_row + 1000000000 as source_row) from ev
        where journey_substage = 'error')"""
ORD = """reg as (select cast(o_orderkey as varchar) as application_id, cast(o_custkey as varchar) as context_id,
  o_orderdate as application_created_at, o_orderdate + interval 30 day as deadline, o_orderkey as source_row,
  o_orderstatus as status, o_totalprice as amount from orders)"""


def us(x: str) -> str:
    return f"epoch_us({x})"


def secs(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 1000000.0)"


PACK = CLEANLIFE + """,
base as (select * exclude(made) from (
  select *, coalesce(sum(case when journey_substage = 'signup' then 1 else 0 end) over (
    partition by application_id order by event_datetime, source_row
    rows between unbounded preceding and 1 preceding), 0) as made from clean)
  where not (journey_substage = 'signup' and made > 0)),
lab as (select application_id, date_trunc('day', event_datetime) as t, journey_substage, count(*) as n,
         min(row(event_datetime, source_row)) as first from base group by all),
grp as (select application_id, t, list(journey_substage order by first) as seen,
         string_agg(journey_substage, '|' order by journey_substage) as pattern, sum(n) as source_rows
        from lab group by all),
lastrow as (select application_id, date_trunc('day', event_datetime) as t,
         arg_max(journey_stage, row(event_datetime, source_row)) as journey_stage,
         arg_max(context_id, row(event_datetime, source_row)) as context_id,
         min(application_created_at) as application_created_at, min(deadline) as deadline from base group by all),
pat as (select pattern, count(*) filter (where t < timestamp '2024-01-16') as first_half,
         count(*) filter (where t >= timestamp '2024-01-16') as second_half from grp
        where len(seen) > 1 and not list_contains(seen, 'signup') and not list_contains(seen, 'purchase')
        group by pattern having first_half >= 5 and second_half >= 5),
pk0 as (select g.application_id, l.context_id, g.t as event_datetime, l.application_created_at, l.deadline, l.journey_stage,
         case when p.pattern is not null then list_transform(list_sort(list_transform(seen, lambda x: {'r':
                case x when 'signup' then 0 when 'error' then 1 when 'view' then 2 when 'click' then 3 else 4 end, 'l': x})), lambda y: y.l)
              when list_contains(seen, 'purchase') then ['purchase']
              when list_contains(seen, 'signup') then ['signup'] else [seen[len(seen)]] end as labels,
         len(seen) as n_seen, source_rows
        from grp g join lastrow l using (application_id, t) left join pat p using (pattern)),
pk1 as (select *, labels[len(labels)] as state, n_seen - len(labels) as omitted, source_rows - n_seen as repeats from pk0),
pk as (select *, case when state = 'error' and coalesce(down, false) then 'REVISIT' when state = 'error' then 'FIRST_PASS'
             else 'UNCONDITIONED' end as regime, coalesce(pd and ap, false) as ptp_eligible,
         case when epoch_us(event_datetime) - epoch_us(application_created_at) < 21600000000 then 'YOUNG' else 'LATE' end as source_age
  from (select *, bool_or(list_has_any(labels, ['view','click','purchase'])) over (w rows between unbounded preceding and 1 preceding) as down,
         sum(len(labels)) over (w rows between unbounded preceding and current row) as prior_depth,
         bool_or(list_contains(labels, 'view')) over (w rows between unbounded preceding and current row) as pd,
         bool_or(list_contains(labels, 'click')) over (w rows between unbounded preceding and current row) as ap
        from pk1 window w as (partition by application_id order by event_datetime))),
kind as (select application_id, case when epoch_us(application_created_at) - lag(epoch_us(application_created_at)) over (
           partition by context_id order by application_created_at) >= 259200000000 then 'RETURNING_CUSTOMER'
           else 'NEW_CUSTOMER' end as customer_kind from life),
kpk as (select pk.*, customer_kind from pk join kind using (application_id))"""


def episodes(start: str, end: str, name: str = "epi", src: str = "kpk") -> str:
    return f"""
{name}0 as (select *, lead(event_datetime) over w as next_time, lead(state) over w as next_state,
         lead(to_json(labels)) over w as next_l from {src} window w as (partition by application_id order by event_datetime)),
{name}1 as (select *, least(deadline, timestamp '{end}') as stop, coalesce(next_time < least(deadline, timestamp '{end}'), false) as observed
        from {name}0 where event_datetime >= timestamp '{start}' and event_datetime < timestamp '{end}' and state <> 'purchase'),
{name} as (select * from (select *, (epoch_us(case when observed then next_time else stop end) - epoch_us(event_datetime)) / 1000000.0 as duration_seconds,
         case when observed and not (next_state = 'purchase' and not ptp_eligible) then cast(next_l as varchar) else '[]' end as next_labels
        from {name}1) where duration_seconds > 0)"""


def levels(src: str, name: str, keep: str) -> str:
    """Next-event law levels of the stream spec."""
    strata = "ptp_eligible, source_age, customer_kind"
    return f"""
{name} as (select 'STATE_REGIME' as model_level, state, regime, '' as journey_stage, {strata}, {keep} from {src} where state = 'error'
  union all select 'STATE', state, '', '', {strata}, {keep} from {src}
  union all select 'STAGE', '', '', journey_stage, {strata}, {keep} from {src}
  union all select 'GLOBAL', '', '', '', {strata}, {keep} from {src})"""


def product_limit(src: str, name: str, by: str) -> str:
    """src: by..., duration_seconds, observed, next_labels. Gives name(by..., duration_seconds, labels, raw_mass, risk_set, support_count)."""
    return f"""
{name}_t as (select {by}, duration_seconds, count(*) as size, count(*) filter (where observed) as d from {src} group by all),
{name}_r as (select *, sum(size) over (partition by {by}) - coalesce(sum(size) over (partition by {by} order by duration_seconds
          rows between unbounded preceding and 1 preceding), 0) as risk_set from {name}_t),
{name}_s as (select *, coalesce(product(1.0 - d::double / risk_set) over (partition by {by} order by duration_seconds
          rows between unbounded preceding and 1 preceding), 1.0) / risk_set as unit from {name}_r),
{name}_c as (select {by}, duration_seconds, next_labels as labels, count(*) as support_count from {src} where observed group by all),
{name} as (select c.*, s.risk_set, support_count * unit as raw_mass,
          case when labels = '[]' then 0.0 else support_count * unit end as mass
        from {name}_c c join {name}_s s using ({by}, duration_seconds))"""


LAW_BY = "model_level, state, regime, journey_stage, ptp_eligible, source_age, customer_kind"


def law(src: str, name: str) -> str:
    return levels(src, f"{name}_x", "duration_seconds, observed, next_labels, application_id") + "," + product_limit(
        f"{name}_x", f"{name}_pl", LAW_BY) + f""",
{name}_pool as (select {LAW_BY}, count(*) as denominator, count(distinct application_id) as applications from {name}_x group by all
  having count(*) >= case model_level when 'STATE_REGIME' then 30 when 'STATE' then 30 when 'STAGE' then 50 else 1 end),
{name} as (select p.*, coalesce(l.duration_seconds, 0.0) as duration_seconds, coalesce(labels, '[]') as labels,
          coalesce(mass, 0.0) as mass, coalesce(risk_set, denominator) as risk_set, coalesce(support_count, 0) as support_count
        from {name}_pool p left join {name}_pl l using ({LAW_BY}))"""


START, MID, END = "2024-01-01 00:00:00", "2024-01-16 00:00:00", "2024-01-31 00:00:00"
EPI = PACK + "," + episodes(START, END)
LAW = EPI + "," + law("epi", "law")

TRAIN = PACK + "," + episodes(START, MID, "tr") + "," + episodes(MID, END, "te")


def landmarks(first: str, last: str) -> str:
    """Daily landmark risk rows over packets pk, bands in hours."""
    def band(x, bounds):
        return " + ".join(f"({x} > {b})::int" for b in bounds)
    return f"""
lm0 as (select p.*, bound, row_number() over (partition by application_id, bound order by p.event_datetime desc) as k
        from pk p, (select unnest(generate_series(timestamp '{first}', timestamp '{last}', interval 1 day)) as bound) where p.event_datetime < bound),
lm1 as (select l.*, n.event_datetime as next_time, n.labels as next_l from lm0 l left join pk n on n.application_id = l.application_id and n.event_datetime >= bound
          and not exists (select 1 from pk m where m.application_id = l.application_id and m.event_datetime >= bound and m.event_datetime < n.event_datetime)
        where k = 1 and l.deadline > bound and l.deadline <= timestamp '{END}' and l.state <> 'purchase'),
lm as (select *, coalesce(next_time < deadline, false) as observed,
        (epoch_us(case when coalesce(next_time < deadline, false) then next_time else deadline end) - epoch_us(bound)) / 1000000.0 as duration_seconds,
        case when coalesce(next_time < deadline, false) and not (not ptp_eligible and next_l = ['purchase']) then cast(to_json(next_l) as varchar) else '[]' end as next_labels,
        {band("(epoch_us(bound) - epoch_us(application_created_at)) / 3600000000.0", (12, 24, 36, 48, 60))} as age_band,
        {band("(epoch_us(bound) - epoch_us(event_datetime)) / 3600000000.0", (6, 12, 24, 48))} as silence_band,
        {band("prior_depth", (1, 2, 4))} as depth_band, cast(isodow(bound) - 1 as int) as weekday from lm1)"""


RES_BY = "weekday, model_level, state, age_band, silence_band, depth_band"


def residual(src: str, name: str) -> str:
    parts = []
    for level, cols in (("SOURCE_AGE_SILENCE_DEPTH", "state, age_band, silence_band, depth_band"), ("SOURCE_AGE_SILENCE", "state, age_band, silence_band, -1"),
                        ("SOURCE_AGE", "state, age_band, -1, -1"), ("SOURCE", "state, -1, -1, -1"), ("AGE_SILENCE", "'', age_band, silence_band, -1"), ("GLOBAL", "'', -1, -1, -1")):
        for day in ("weekday", "-1"):
            parts.append(f"select {day} as weekday, '{level}' as model_level, {cols}, duration_seconds, observed, next_labels, application_id from {src}")
    return f"""
{name}_x(weekday, model_level, state, age_band, silence_band, depth_band, duration_seconds, observed, next_labels, application_id) as ({' union all '.join(parts)}),{product_limit(f'{name}_x', f'{name}_pl', RES_BY)},
{name}_pool as (select {RES_BY}, count(*) as denominator, count(distinct application_id) as applications from {name}_x group by all having count(distinct application_id) >= 10),
{name} as (select p.*, coalesce(l.duration_seconds, 0.0) as duration_seconds, coalesce(labels, '[]') as labels, coalesce(mass, 0.0) as mass, coalesce(support_count, 0) as support_count
        from {name}_pool p left join (select * from {name}_pl where labels <> '[]') l using ({RES_BY}))"""


def hazard_interval(x: str) -> str:
    e = (0, 60, 300, 900, 1800, 3600, 7200, 21600, 86400, 259200, 604800, 1209600, 2592000)
    return "case " + " ".join(f"when {x} >= {a} and {x} < {b} then {i}" for i, (a, b) in enumerate(zip(e, e[1:]))) + " end"


def piecewise(src: str, name: str, by: str) -> str:
    return f"""
{name}_c as (select {by}, coalesce({hazard_interval('duration_seconds')}, 11) as k, count(*) filter (where observed) as events, count(*) filter (where not observed) as censored from {src} group by all),
{name}_g as (select * from (select {by}, sum(events + censored) as alln from {name}_c group by all), (select unnest(range(12)) as k)),
{name}_t as (select g.*, coalesce(events, 0) as events, coalesce(censored, 0) as censored from {name}_g g left join {name}_c c using ({by}, k)),
{name}_r as (select *, alln - coalesce(sum(events + censored) over (partition by {by} order by k rows between unbounded preceding and 1 preceding), 0) as risk_set from {name}_t),
{name}_h as (select *, case when risk_set > 0 then events / risk_set else 0.0 end as hazard from {name}_r),
{name} as (select *, coalesce(product(1.0 - hazard) over (partition by {by} order by k rows between unbounded preceding and 1 preceding), 1.0) as survival_before,
          1.0 - product(1.0 - hazard) over (partition by {by} order by k) as cumulative_incidence from {name}_h)"""


RISK = CLEANLIFE + f""",
rk0 as (select application_id, event_datetime, min(application_created_at) as application_created_at, min(deadline) as deadline from clean where journey_substage = 'click' group by 1, 2),
rkp as (select application_id, min(event_datetime) filter (where journey_substage = 'view') as da, min(event_datetime) filter (where journey_substage = 'purchase') as ta from clean group by 1),
rk1 as (select * from rk0 join rkp using (application_id) where da < event_datetime and (ta is null or event_datetime < ta)),
rk2 as (select *, lead(event_datetime) over (partition by application_id order by event_datetime) as na from rk1),
rk3 as (select *, least(na, deadline, timestamp '{END}') as stop from rk2),
rk as (select *, coalesce(ta >= event_datetime and ta < stop, false) as observed,
        (epoch_us(case when coalesce(ta >= event_datetime and ta < stop, false) then ta else stop end) - epoch_us(event_datetime)) / 1000000.0 as duration_seconds,
        case when epoch_us(event_datetime) - epoch_us(application_created_at) < 86400000000 then 'LT_1D' when epoch_us(event_datetime) - epoch_us(application_created_at) < 604800000000 then '1D_7D' else '7D_30D' end as bucket from rk3)"""


def level_union(src: str, levels: dict, fields: list, extra: str) -> str:
    return " union all ".join("select '%s' as model_level, %s, %s from %s" % (
        name, ", ".join((f if f in keys else f"'' as {f}") for f in fields), extra, src) for name, keys in levels.items())

"""Sources, sinks with a SQL meaning, and row-wise projections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import lifecycle as L
from ..operators.ordered import mark_parts
from ..session import materialize, shared_folder
from ..sources import readers, sinks
from ..sources.adapters import STREAM_SPEC as SPEC
from ..spec import EVENT_COLUMNS
from . import sql as Q
from .registry import Tables, query

EVENT_FIELDS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("a1_projected_scan", "select event_id, user_id, event_type, ts from events")
def _(t: Tables):
    return readers.scan_parquet(t.spark, t.path("events"), ["event_id", "user_id", "event_type", "ts"], EVENT_FIELDS)


@query("a2_multi_source_scan", "select event_id, event_type from events union all select o_orderkey, o_orderstatus from orders")
def _(t: Tables):
    a = readers.scan_parquet(t.spark, [t.path("events")], ["event_id", "event_type"], EVENT_FIELDS)
    b = readers.scan_parquet(t.spark, [t.path("orders")], ["o_orderkey", "o_orderstatus"], None)
    return a.union(b)


@query("a3_source_order", "select event_id, event_id as source_row, row_number() over (partition by user_id order by ts, event_id) as position from events")
def _(t: Tables):
    rows = readers.scan_parquet(t.spark, t.path("events"), ["event_id", "user_id", "ts"], EVENT_FIELDS, with_source=True)
    rows = L.scan(_parts(rows), ["user_id"], ["ts", "source_file", "source_row"], position=L.Running("sum", F.lit(1)))
    return rows.select("event_id", "source_row", "position")


def _parts(rows):
    return mark_parts(rows, ["user_id"], C.micros("ts"), SPEC.hot_rows)


@query("a4_daily_partitions", """select cast(ts as date) as day, event_type, count(*) as n from events
  where ts >= timestamp '2024-01-20' and ts < timestamp '2024-01-26' group by all""")
def _(t: Tables):
    ev = t.table("events").select("event_id", F.col("ts").alias("event_datetime"), F.col("user_id").alias("application_id"), "event_type")
    return _days(t, ev).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _days(t, ev):
    root = f"{shared_folder(t.spark)}/days-{uuid.uuid4().hex}"
    sinks.write_days(ev, root)
    return readers.read_days(t.spark, root, "2024-01-20", "2024-01-25")


@query("a6_audit_reasons", f"with {Q.EV} select application_id, 'ORGANIC_CONTINUATION' as category, journey_substage as reason from ev where application_id is not null")
def _(t: Tables):
    """Audit rows written as gzip JSON lines and read back with their nested reason."""
    root = f"{shared_folder(t.spark)}/audit-{uuid.uuid4().hex}"
    ev = t.stream().filter("application_id is not null")
    sinks.write_jsonl(ev.select("application_id", "context_id", F.col("event_datetime").cast("string").alias("explanation_time"),
                                F.lit("ORGANIC_CONTINUATION").alias("category"),
                                F.struct(F.col("journey_substage").alias("reason")).alias("explanation")), root)
    return readers.read_audit(t.spark, root).select("application_id", "category", F.col("explanation.reason").alias("reason"))


@query("a7_checkpoint_registry", f"with {Q.ORD} select application_id, context_id, application_created_at as creation_datetime, deadline from reg")
def _(t: Tables):
    """Registry documents written as gzip and read back: one JSON per month and bucket of contexts, a map of
    context to the lifecycles it opened in that month."""
    r = t.orders().select("application_id", "context_id", F.col("application_created_at").cast("string").alias("creation_datetime"),
                          F.col("deadline").cast("string").alias("deadline"))
    month = F.substring("creation_datetime", 1, 7)
    lives = r.groupBy("context_id", month.alias("month")).agg(F.collect_list(F.struct(*r.columns)).alias("lives"))
    buckets = F.greatest(F.lit(1), (r.agg(F.count(F.lit(1))).scalar() / 10000).cast("long"))  # so a document keeps its size
    docs = (lives.groupBy("month", F.pmod(F.xxhash64("context_id"), buckets).alias("bucket"))
            .agg(F.map_from_entries(F.collect_list(F.struct("context_id", "lives"))).alias("lifecycle_registry"))
            .select(F.to_json(F.struct("lifecycle_registry")).alias("value")))
    root = f"{shared_folder(t.spark)}/registry-{uuid.uuid4().hex}"
    docs.write.option("compression", "gzip").text(root)
    return readers.registry_rows(t.spark.read.text(root))


@query("a8_json_props", f"select event_id, {Q.K} as k from events")
def _(t: Tables):
    return t.table("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("a12_combined_export", f"""with {Q.EV} select is_simulated, event_datetime, context_id, application_id, journey_substage,
  case when is_simulated then null else source_row end as source_row from ev""")
def _(t: Tables):
    ev = t.stream()
    out = sinks.combine(ev.filter(~F.col("is_simulated")), ev.filter("is_simulated").drop("source_row"))
    return out.select("is_simulated", "event_datetime", "context_id", "application_id", "journey_substage", "source_row")


_LATEST = "select application_id, max(event_datetime) as checkpoint_time, count(*) as events from ev where application_id is not null and {w} group by 1"


@query("a14_upsert", f"""with {Q.EV}, old as ({_LATEST.format(w="event_datetime < timestamp '2024-01-16'")}),
  new as ({_LATEST.format(w="event_datetime >= timestamp '2024-01-10'")})
  select * from new union all select * from old where application_id not in (select application_id from new)""")
def _(t: Tables):
    ev = t.stream().filter("application_id is not null")
    latest = lambda df: df.groupBy("application_id").agg(F.max("event_datetime").alias("checkpoint_time"), F.count(F.lit(1)).alias("events"))
    return sinks.upsert(latest(ev.filter(F.col("event_datetime") < C.ntz("2024-01-16 00:00:00"))),
                        latest(ev.filter(F.col("event_datetime") >= C.ntz("2024-01-10 00:00:00"))), ["application_id"])


@query("a15_manifest_check", None)
def _(t: Tables):
    """Inventory of the table directory against a manifest that lacks one file and misstates hash and digest of a second,
    the row count of a third and the columns of a fourth."""
    inv = materialize(readers.file_inventory(t.spark, t.root))
    wrong = lambda c, file, value: F.when(F.col("file") == file, value).otherwise(F.col(c)).alias(c)
    manifest = inv.filter("file <> 'region.parquet'").select(
        "file", wrong("sha256", "nation.parquet", F.lit("0")), wrong("digest", "nation.parquet", F.lit("0")),
        wrong("rows", "customer.parquet", F.col("rows") + 1), wrong("columns", "supplier.parquet", F.lit("none")))
    return readers.verify_manifest(inv, manifest)


_APPEND = f"""with {Q.EV}, e as (select application_id, event_datetime, source_row, journey_substage from ev where application_id is not null),
  hist as (select * from e where event_datetime < timestamp '2024-01-21'),
  inc as (select * from e where event_datetime >= timestamp '2024-01-21'
          union all select * from hist where journey_substage = 'error'
          union all select application_id, event_datetime - interval 1 day, source_row + 2000000000, journey_substage from e
                    where event_datetime >= timestamp '2024-01-21' and journey_substage = 'click'),
  late as (select i.application_id from (select application_id, min(event_datetime) as f from inc group by 1) i
           join (select application_id, max(event_datetime) as l from hist group by 1) h using (application_id) where f < l),
  judged as (select *, case when source_row in (select source_row from hist)
                or source_row in (select source_row from inc group by 1 having count(*) > 1) then 'DUPLICATE_KEY'
                when application_id in (select application_id from late) then 'OUT_OF_ORDER' end as reason from inc)"""


def _append(t: Tables):
    e = t.stream().filter("application_id is not null").select("application_id", "event_datetime", "source_row", "journey_substage")
    cut = C.ntz("2024-01-21 00:00:00")
    hist, fresh = e.filter(F.col("event_datetime") < cut), e.filter(F.col("event_datetime") >= cut)
    early = fresh.filter("journey_substage = 'click'").withColumns(
        {"event_datetime": C.plus_seconds("event_datetime", -86400), "source_row": F.col("source_row") + 2000000000})
    inc = fresh.unionByName(hist.filter("journey_substage = 'error'")).unionByName(early)
    return sinks.append_history(hist, inc, "source_row")


@query("a16_append_accepted", f"{_APPEND} select * from hist union all select * exclude(reason) from judged where reason is null")
def _(t: Tables):
    return _append(t)[0]


@query("a16_append_rejected", f"{_APPEND} select * from judged where reason is not null")
def _(t: Tables):
    return _append(t)[1]


# --- projections -----------------------------------------------------------------------------------

@query("p1_origin_labels", f"with {Q.EV} select source_row, data_origin, is_simulated from ev")
def _(t: Tables):
    ev = t.table("events").select(F.col("event_id").alias("source_row"), F.col("ts").alias("event_datetime"))
    return sinks.with_origin(ev, "2024-01-21 00:00:00", [("2024-01-11 00:00:00", "HISTORICAL_MARCH"), ("2024-01-21 00:00:00", "HISTORICAL_APRIL")],
                             "SIMULATED_MAY").select("source_row", "data_origin", "is_simulated")


@query("p2_event_rows", f"""with {Q.CV}, k as (select *, case when journey_substage = 'campaign_sent' then 'CAMPAIGN_SEND_EVENT'
    when journey_substage in ('campaign_open_read', 'campaign_clicked') then 'CAMPAIGN_RESPONSE_EVENT'
    when journey_substage = 'signup' then 'SIMULATION_START_EVENT' when journey_substage = 'purchase' then 'TRANSACTION_EVENT'
    else 'JOURNEY_EVENT' end as kind from cv)
  select context_id, source_row as event_key, journey_substage,
    case when kind in ('CAMPAIGN_SEND_EVENT', 'CAMPAIGN_RESPONSE_EVENT') then journey_substage else event_name end as event_name,
    case when kind in ('CAMPAIGN_SEND_EVENT', 'CAMPAIGN_RESPONSE_EVENT') then null else journey_stage end as journey_stage,
    lower(time_bucket) as time_bucket, day_of_week_num, cast(null as varchar) as utm_source from k where kind <> 'SIMULATION_START_EVENT'""")
def _(t: Tables):
    label = F.col("journey_substage")
    ev = t.stream(True).withColumns({"event_key": F.col("source_row"), "event_type":
        F.when(label == "campaign_sent", "CAMPAIGN_SEND_EVENT").when(label.isin("campaign_open_read", "campaign_clicked"), "CAMPAIGN_RESPONSE_EVENT")
        .when(label == SPEC.creation, "SIMULATION_START_EVENT").when(label == SPEC.terminal, "TRANSACTION_EVENT").otherwise("JOURNEY_EVENT")})
    return event_rows(ev).select("context_id", "event_key", "journey_substage", "event_name", "journey_stage", "time_bucket",
                                 "day_of_week_num", "utm_source")


def event_rows(df):
    """World events as contract rows: markers dropped, campaign rows without a stage, unknown columns NULL."""
    kind = F.col("event_type")
    campaign = kind.isin("CAMPAIGN_SEND_EVENT", "CAMPAIGN_RESPONSE_EVENT")
    label = F.when(kind == "CAMPAIGN_SEND_EVENT", "campaign_sent").otherwise(F.col("journey_substage"))
    rows = df.filter(~kind.isin("SIMULATION_START_EVENT", "TERMINAL_EVENT")).withColumns({
        "event_name": F.when(campaign, label).otherwise(F.col("event_name")),
        "journey_stage": F.when(~campaign, F.col("journey_stage")), "journey_substage": label,
        "time_bucket": F.lower("time_bucket"), "day_of_week_num": C.iso_weekday("event_datetime")})
    missing = {c: F.lit(None).cast("string") for c in EVENT_COLUMNS if c not in rows.columns}
    return rows.withColumns(missing) if missing else rows


@query("p3_row_keys", """select event_id, 'H|' || sha256('events.parquet|' || cast(event_id as varchar)) as historical_key,
  'S|' || sha256('run-1|' || cast(event_id as varchar)) as simulated_key,
  'MAYCTX2_' || substr(sha256('7|' || cast(user_id as varchar)), 1, 28) as stable_id from events""")
def _(t: Tables):
    return t.table("events").select("event_id", C.hash_key("H|", "events.parquet", F.col("event_id")).alias("historical_key"),
                                    C.hash_key("S|", "run-1", F.col("event_id")).alias("simulated_key"),
                                    C.hash_key("MAYCTX2_", 7, F.col("user_id"), length=28).alias("stable_id"))


@query("p4_iso_weekday", "select event_id, cast(isodow(ts) as bigint) as day_of_week_num from events")
def _(t: Tables):
    return t.table("events").select("event_id", C.iso_weekday("ts").alias("day_of_week_num"))


@query("p5_daypart", """select event_id, case when hour(ts) < 6 then 'NIGHT' when hour(ts) < 12 then 'MORNING' when hour(ts) < 17 then 'AFTERNOON'
  when hour(ts) < 21 then 'EVENING' else 'NIGHT' end as daypart from events""")
def _(t: Tables):
    return t.table("events").select("event_id", C.daypart("ts").alias("daypart"))


def next_send_window(df, now: str, expiry: str, bucket: str):
    """First non-empty overlap of [now, expiry) with the bucket on the day before, the day, the day after."""
    hours = {"MORNING": (6, 12), "AFTERNOON": (12, 17), "EVENING": (17, 21), "NIGHT": (21, 30)}
    day = F.date_trunc("day", F.col(now)).cast("timestamp_ntz")
    out_lo = out_hi = F.lit(None).cast("timestamp_ntz")
    for off in (1, 0, -1):
        lo = hi = None
        for b, (h0, h1) in hours.items():
            is_b = F.upper(F.trim(F.col(bucket))) == b
            a, z = C.plus_seconds(day, off * 86400 + h0 * 3600), C.plus_seconds(day, off * 86400 + h1 * 3600)
            lo, hi = (F.when(is_b, a), F.when(is_b, z)) if lo is None else (lo.when(is_b, a), hi.when(is_b, z))
        lo, hi = F.greatest(F.col(now), lo), F.least(F.col(expiry), hi)
        out_lo, out_hi = F.when(lo < hi, lo).otherwise(out_lo), F.when(lo < hi, hi).otherwise(out_hi)
    open_ = F.col(now) < F.col(expiry)
    return df.withColumns({"window_start": F.when(open_, out_lo), "window_end": F.when(open_, out_hi)})


@query("p6_next_send_window", f"""with {Q.EV}, q as (select source_row, event_datetime as t, deadline as x, date_trunc('day', event_datetime) as d,
    case channel when 'SMS' then 'MORNING' when 'WA' then 'NIGHT' else 'EVENING' end as b from ev where application_id is not null),
  o as (select q.*, off, greatest(t, d + to_days(off) + to_hours(case b when 'MORNING' then 6 when 'NIGHT' then 21 else 17 end)) as lo,
    least(x, d + to_days(off) + to_hours(case b when 'MORNING' then 12 when 'NIGHT' then 30 else 21 end)) as hi
    from q, (values (-1), (0), (1)) v(off)),
  w as (select source_row, arg_min(lo, off) as lo, arg_min(hi, off) as hi from o where lo < hi and t < x group by 1)
  select q.source_row, lo as window_start, hi as window_end from q left join w using (source_row)""")
def _(t: Tables):
    rows = t.stream().filter("application_id is not null").withColumn(
        "bucket", F.when(F.col("channel") == "SMS", "MORNING").when(F.col("channel") == "WA", "NIGHT").otherwise("EVENING"))
    return next_send_window(rows, "event_datetime", "deadline", "bucket").select("source_row", "window_start", "window_end")


_AGE = Q.secs("application_created_at", "event_datetime")


@query("p7_approval_age_bucket", f"""with {Q.EV} select source_row, case when {_AGE} < 86400 then 'LT_1D' when {_AGE} < 604800 then '1D_7D'
  else '7D_30D' end as application_age_bucket from ev where application_id is not null""")
def _(t: Tables):
    age = C.seconds_between("application_created_at", "event_datetime")
    return t.stream().filter("application_id is not null").withColumn("s", age).select(
        "source_row", C.approval_age_bucket("s").alias("application_age_bucket"))


@query("p8_decision_buckets", f"""with {Q.CV}, s as (select source_row, {_AGE} / 86400 as days,
    coalesce(sum(case when journey_substage = 'campaign_sent' then 1 else 0 end) over w, 0) as sends,
    (epoch_us(event_datetime) - epoch_us(max(case when journey_substage = 'campaign_sent' then event_datetime end) over w)) / 86400000000.0 as gap
    from cv where application_id is not null
    window w as (partition by application_id order by event_datetime, source_row rows between unbounded preceding and 1 preceding))
  select source_row, case when days < 1 then 'LT_1D' when days < 3 then '1D_3D' when days < 7 then '3D_7D' when days < 14 then '7D_14D'
      when days < 21 then '14D_21D' else '21D_30D' end as age_bucket,
    case when sends = 0 then '0' when sends = 1 then '1' when sends <= 3 then '2_3' else '4_PLUS' end as prior_send_bucket,
    case when gap is null then 'NO_PRIOR_SEND' when gap < 1 then 'LT_1D' when gap < 3 then '1D_3D' when gap < 7 then '3D_7D' else '7D_PLUS' end
      as recent_send_gap_bucket from s""")
def _(t: Tables):
    from ..operators.models import decision_buckets
    return decision_buckets(t.stream(True).filter("application_id is not null")).select(
        "source_row", "age_bucket", "prior_send_bucket", "recent_send_gap_bucket")


@query("p9_bound_bands", "select event_id, cast((value > 5)::int + (value > 10)::int + (value > 20)::int as int) as band from events")
def _(t: Tables):
    return t.table("events").select("event_id", C.bound_band("value", (5, 10, 20)).alias("band"))


@query("p10_interval_labels", """select event_id, case when value > 0 and value <= 5 then '(0, 5]' when value > 5 and value <= 10 then '(5, 10]'
  when value > 10 and value <= 30 then '(10, 30]' end as label from events""")
def _(t: Tables):
    return t.table("events").select("event_id", C.interval_label("value", (0, 5, 10, 30)).alias("label"))


_ACTION = f"""with {Q.CV}, a as (select source_row, journey_substage = 'campaign_sent' as sent,
    case when journey_substage = 'view' then null when event_name = 'k9' then 'EMAIL' else lower(channel) end as channel_id,
    case when journey_substage = 'view' then null when event_name = 'k0' then 'noon' else time_bucket end as time_bucket,
    case when journey_substage = 'view' then null else 'theme_placeholder' end as theme from cv)
  select source_row, case when not sent and (channel_id is not null or time_bucket is not null or theme is not null) then 'NO_ACTION_WITH_FIELDS'
    when sent and upper(channel_id) not in ('SMS','WA','GRCS') then 'UNSUPPORTED_CHANNEL'
    when sent and upper(time_bucket) not in ('MORNING','AFTERNOON','EVENING','NIGHT') then 'UNSUPPORTED_TIME_BUCKET'
    when sent and upper(theme) <> 'THEME_PLACEHOLDER' then 'UNSUPPORTED_THEME' end as violation, upper(channel_id) as channel_id from a"""


@query("p11_action_rules", _ACTION)
def _(t: Tables):
    view = F.col("journey_substage") == "view"
    a = t.stream(True).select("source_row", (F.col("journey_substage") == "campaign_sent").alias("sent"),
        F.when(view, None).when(F.col("event_name") == "k9", "EMAIL").otherwise(F.lower("channel")).alias("channel_id"),
        F.when(view, None).when(F.col("event_name") == "k0", "noon").otherwise(F.col("time_bucket")).alias("time_bucket"),
        F.when(view, None).otherwise("theme_placeholder").alias("theme"))
    return a.select("source_row", C.action_violation("sent", "channel_id", "theme", "time_bucket").alias("violation"),
                    F.upper("channel_id").alias("channel_id"))


_FLAGS = f"""with {Q.CLEAN}, f as (select source_row, application_id, event_datetime, deadline, journey_substage,
    coalesce(max((journey_substage = 'view')::int) over w, 0) = 1 as details, coalesce(max((journey_substage = 'click')::int) over w, 0) = 1 as approved,
    coalesce(max((journey_substage = 'purchase')::int) over w, 0) = 1 as done from clean
    window w as (partition by application_id order by event_datetime, source_row))"""


def _flags(t):
    one = lambda l: L.Running("max", F.when(F.col("journey_substage") == l, 1).otherwise(0))
    rows = L.scan(t.windowed(), L.APP, L.TIMELINE, d=one("view"), a=one("click"), p=one("purchase"))
    return rows.withColumns({"details": F.col("d") == 1, "approved": F.col("a") == 1, "done": F.col("p") == 1})


@query("p12_action_mask", f"{_FLAGS} select source_row, not done as no_action_allowed, not done and event_datetime < deadline as send_allowed from f")
def _(t: Tables):
    return _flags(t).select("source_row", (~F.col("done")).alias("no_action_allowed"),
                            (~F.col("done") & (F.col("event_datetime") < F.col("deadline"))).alias("send_allowed"))


@query("p13_guards", f"{_FLAGS} select source_row, details as can_approve, details and approved and not done as can_push from f")
def _(t: Tables):
    return _flags(t).select("source_row", C.can_approve("details", "details").alias("can_approve"),
                            C.can_push("details", "details", "approved", "done").alias("can_push"))


@query("p14_cohort_filter", f"with {Q.EV} select source_row from ev where application_id in (select application_id from ev where journey_substage = 'purchase')")
def _(t: Tables):
    ev = t.stream()
    return ev.join(ev.filter("journey_substage = 'purchase'").select("application_id"), "application_id", "left_semi").select("source_row")


@query("p15_visible_history", f"""with {Q.LIFE}, d as (select context_id, application_id, application_created_at + interval 1 day as now from life)
  select d.application_id, d.now, count(e.source_row) as visible_rows, max(e.event_datetime) as last_visible
  from d left join ev e on e.context_id = d.context_id and e.event_datetime <= d.now group by all""")
def _(t: Tables):
    from ..operators.lookup import visible_summary
    d = t.lifecycles().withColumn("now", C.plus_seconds("application_created_at", 86400))
    return visible_summary(d, t.stream()).select("application_id", "now", "visible_rows", "last_visible")


@query("p15_visible_rows", f"""with {Q.LIFE}, d as (select context_id, application_id, application_created_at + interval 1 day as now from life),
  v as (select d.application_id, d.now, e.application_id as event_application_id, e.source_row, e.event_datetime, e.journey_substage, row_number() over (partition by d.application_id, d.now order by e.event_datetime desc, e.source_row desc) as place
    from d join ev e on e.context_id = d.context_id and e.event_datetime <= d.now) select * from v where place <= 5""")
def _(t: Tables):
    """The five newest rows of the customer, of any application, that each decision sees."""
    from ..operators.lookup import visible_rows
    d = t.lifecycles().withColumn("now", C.plus_seconds("application_created_at", 86400))
    return visible_rows(d, t.stream(), ["application_id", "source_row", "event_datetime", "journey_substage"], 5).drop("context_id").withColumn("place", F.col("place").cast("long"))


@query("p16_audit_lines", f"""with {Q.EV} select source_row, '[' || strftime(event_datetime, '%Y-%m-%d %H:%M:%S.%f') || '] ' || upper(journey_substage)
  || chr(10) || 'APPLICATION: ' || application_id || ' / CONTEXT: ' || context_id || chr(10) || 'EVIDENCE: ' ||
  '{{"channel":"' || channel || '","stage":"' || journey_stage || '"}}' as line from ev where application_id is not null""")
def _(t: Tables):
    return t.stream().filter("application_id is not null").select("source_row", F.format_string(
        "[%s] %s\nAPPLICATION: %s / CONTEXT: %s\nEVIDENCE: %s", F.date_format("event_datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        F.upper("journey_substage"), "application_id", "context_id",
        F.to_json(F.struct("channel", F.col("journey_stage").alias("stage")))).alias("line"))


@query("p17_vector_width", """select vec_id, len(embedding) as width, case when len(embedding) <> (select max(len(embedding)) from embeddings)
  then 'WRONG_WIDTH' end as violation from embeddings""")
def _(t: Tables):
    e = t.table("embeddings").withColumn("width", F.size("embedding").cast("long"))
    want = e.agg(F.max("width")).scalar()
    return e.select("vec_id", "width", F.when(F.col("width") != want, "WRONG_WIDTH").alias("violation"))

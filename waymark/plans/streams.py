"""Streams run to their end over deliveries derived from the given tables, and file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import checks as K
from ..session import shared_folder
from ..sources import readers, sinks
from ..sources.adapters import STREAM_SPEC as SPEC
from ..spec import LAW_STRATA
from ..streaming import jobs, rules
from . import sql as Q
from .journeys import _RESP
from .registry import Tables, query
from .reporting import rounded
from .scoring import _SCORE, LEVELS, pooled_law

#: Files of one delivery, which one micro-batch reads.
FILES = 4
DAY_US = 86400 * 10**6
STREAM = "application_id string, context_id string, event_datetime timestamp_ntz, source_row bigint, journey_substage string"
COLS = [c.split()[0] for c in STREAM.split(", ")]


def folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame, parts: int = 3) -> list[DataFrame]:
    """Deliveries that know no event order: a third of the rows each, by hash."""
    return [df.filter(F.pmod(F.xxhash64("application_id", "source_row", "event_datetime"), F.lit(parts)) == k) for k in range(parts)]


#: The application of the rows that end a delivery.
END = "end"


def time_range(parts: list[DataFrame]) -> tuple[int, int]:
    """Least and greatest event time of all parts, in microseconds."""
    found = [p.agg(F.min(C.micros("event_datetime")), F.max(C.micros("event_datetime"))).first() for p in parts]
    found = [r for r in found if r[0] is not None] or [(0, 0)]
    return min(r[0] for r in found), max(r[1] for r in found)


def ends(t: Tables, like: DataFrame, at_us: int) -> list[DataFrame]:
    """Two far later deliveries of an application `end`, a day apart, so that the watermark passes all other rows."""
    def value(c: str, us: int):
        kind = like.schema[c].dataType
        given = {"application_id": F.lit(END), "event_datetime": F.timestamp_micros(F.lit(us)).cast("timestamp_ntz"), "source_row": -F.col("id") - 1}
        if isinstance(kind, T.ArrayType):
            return F.array(F.lit(END)).cast(kind).alias(c)
        return given.get(c, F.lit(END) if c == "journey_substage" else F.lit(None)).cast(kind).alias(c)
    return [t.spark.range(0, FILES, 1, FILES).select(*[value(c, us) for c in like.columns]) for us in (at_us, at_us + DAY_US)]


def delivered(t: Tables, parts: list[DataFrame], close: bool = True) -> DataFrame:
    """The parts as a stream, one micro-batch each. The watermark's delay is the time that all parts span and a day, so that
    no order of delivery makes a row late; what ends it lies beyond that and every deadline, horizon and session gap."""
    root = folder(t, "delivery")
    for part in parts:
        part.repartition(FILES).write.mode("append").parquet(root)
    stored = t.spark.read.schema(parts[0].schema).parquet(root)
    low, high = time_range([stored])
    delay = (high - low) // 10**6 + 86400
    for end in ends(t, parts[0], high + (delay + SPEC.validity_seconds + 2 * 86400) * 10**6) if close else []:
        end.write.mode("append").parquet(root)
    return jobs.read_events(t.spark, root, parts[0].schema, delay=f"{delay} seconds", files_per_batch=FILES)


def drained(t: Tables, stream: DataFrame) -> DataFrame:
    """What a stream has appended once all deliveries are read."""
    out = folder(t, "stream")
    (stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.schema(stream.schema).parquet(f"{out}/data")


def owned(t: Tables, campaign: bool = False) -> DataFrame:
    return t.stream(campaign).filter("application_id is not null").select(*COLS)


@query("t1_activity_counts", f"with {Q.EV} select cast(date_trunc('day', event_datetime) as timestamp) as window_start, journey_substage, count(*) as events from ev where application_id is not null group by 1, 2")
def _(t: Tables):
    counts = drained(t, jobs.activity_counts(delivered(t, shuffled(owned(t))), by=["journey_substage"]))
    return counts.filter(F.col("journey_substage") != END).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("t2_append_once", f"with {Q.EV} select source_row from ev where application_id is not null")
def _(t: Tables):
    """Every error row is delivered twice."""
    ev = owned(t)
    twice = [*shuffled(ev), ev.filter("journey_substage = 'error'")]
    return drained(t, jobs.append_once(delivered(t, twice)).select("application_id", "source_row")).filter(F.col("application_id") != END).select("source_row")


@query("t3_reject_late", f"""with {Q.EV}, o as (select * from ev where application_id is not null), m as (select application_id, max(event_datetime) as top from o where source_row % 2 = 0 group by 1)
  select source_row, source_row % 2 = 0 or top is null or event_datetime >= top as accepted from o left join m using (application_id)""")
def _(t: Tables):
    """Even rows arrive first, odd rows in a second delivery."""
    ev = owned(t)
    parts = [ev.filter("source_row % 2 = 0"), ev.filter("source_row % 2 = 1")]
    return drained(t, rules.keyed_rule(delivered(t, parts, close=False), rules.RejectLate())).select("source_row", "accepted")


@query("t4_lifecycle_monitor", f"""with {Q.LIFE}, p as (select application_id, min(event_datetime) as pt from ev where journey_substage = 'purchase' and event_datetime between application_created_at and deadline group by 1)
  select application_id, case when pt is not null then 'TERMINAL' else 'EXPIRED' end as outcome, coalesce(pt, deadline) as at_time from life left join p using (application_id)""")
def _(t: Tables):
    got = drained(t, rules.lifecycle_monitor(delivered(t, shuffled(owned(t))), SPEC))
    return got.select("application_id", "outcome", F.timestamp_micros("at_us").cast("timestamp_ntz").alias("at_time"))


@query("t5_competing_send", f"{_RESP} select source_row as send_row, response, response_delay_seconds, status from resp")
def _(t: Tables):
    got = drained(t, rules.keyed_rule(delivered(t, shuffled(owned(t, True))), rules.CompetingSend(43200 * 10**6), timers=True))
    return got.select("send_row", "response", (F.col("delay_us") / 1e6).alias("response_delay_seconds"), "status")


@query("t6_running_features", f"with {Q.PACK} select application_id, event_datetime, regime, cast(prior_depth as bigint) as prior_depth, ptp_eligible from pk")
def _(t: Tables):
    p = t.packets().select("application_id", "event_datetime", F.lit(0).cast("long").alias("source_row"), "labels")
    got = drained(t, rules.running_features(delivered(t, shuffled(p)), SPEC)).filter(F.col("application_id") != END)
    return got.select("application_id", F.timestamp_micros("event_us").cast("timestamp_ntz").alias("event_datetime"), "regime", "prior_depth", "ptp_eligible")


@query("t7_sessions", f"""with {Q.EV}, g as (select *, case when event_datetime < lag(event_datetime) over w + interval 6 hour then 0 else 1 end as fresh from ev where application_id is not null window w as (partition by application_id order by event_datetime, source_row)),
  s as (select *, sum(fresh) over (partition by application_id order by event_datetime, source_row) as n from g)
  select application_id, min(event_datetime) as session_start, max(event_datetime) + interval 6 hour as session_end, count(*) as events from s group by application_id, n""")
def _(t: Tables):
    got = drained(t, jobs.sessions(delivered(t, shuffled(owned(t))), "6 hours")).filter(F.col("application_id") != END)
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("t8_commit_batches", f"""with {Q.EV}, o as (select source_row % 3 as k from ev where application_id is not null)
  select 'batch=000000000' || cast(k as varchar) as day, count(*) as rows, k > 0 as linked from o group by k""")
def _(t: Tables):
    """Three deliveries, each a batch with a chained marker; a second run over the same files adds nothing."""
    ev, out = owned(t), folder(t, "commits")
    stream = delivered(t, [ev.filter(f"source_row % 3 = {k}") for k in range(3)], close=False).select(*COLS)
    for run in ("a", "b"):
        jobs.commit_batches(stream, f"{out}/data", f"{out}/log", f"{out}/checkpoint-{run}").awaitTermination()
    return sinks.read_log(t.spark, f"{out}/log").select("day", "rows", (F.col("previous_hash") != "").alias("linked"))


@query("t9_stream_scoring", f"""{_SCORE} select r.application_id, r.event_datetime, r.model_level, r.ps as pool_state, r.pr as pool_regime, r.pj as pool_journey_stage, round(greatest(0, 1 - before_), 9) as survival,
  round(case when 1 - before_ > 1e-12 then (upto - before_) / (1 - before_) when before_ is not null then 0 end, 9) as remaining_event_mass from res r left join sc using (application_id, event_datetime)""")
def _(t: Tables):
    law, out = pooled_law(t), folder(t, "scored")
    rows = t.episodes(Q.MID, Q.END).select("application_id", "event_datetime", "state", "regime", "journey_stage", *LAW_STRATA, F.lit(40000.0).alias("elapsed"), C.seconds_between("event_datetime", "deadline").alias("stop"))
    root = folder(t, "delivery")
    rows.repartition(2 * FILES).write.parquet(root)
    stream = jobs.read_events(t.spark, root, rows.schema, files_per_batch=FILES).select(*rows.columns)
    jobs.score_stream(stream, law, LEVELS, LAW_STRATA, "elapsed", "stop", lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), f"{out}/checkpoint").awaitTermination()
    got = t.spark.read.parquet(out + "/batch=*").select("application_id", "event_datetime", "model_level", "pool_state", "pool_regime", "pool_journey_stage", "survival", "remaining_event_mass")
    return rounded(got, ["survival", "remaining_event_mass"], 9)


# --- files ------------------------------------------------------------------------------------------

_LABELS = "select coalesce(event_name, '') as event_name, case when channel = 'WA' then '' else channel end as channel, count(*) as n from ev group by 1, 2"


def _labels(t: Tables) -> DataFrame:
    return t.stream().groupBy(F.coalesce("event_name", F.lit("")).alias("event_name"), F.when(F.col("channel") == "WA", "").otherwise(F.col("channel")).alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@query("a5_table_csv", f"with {Q.EV} {_LABELS}")
def _(t: Tables):
    """A fitted table with blank keys, written as CSV and read back: blanks stay blanks."""
    root = folder(t, "csv")
    sinks.write_csv(_labels(t), root, ["event_name", "channel"])
    return readers.read_table_csv(t.spark, root, "event_name string, channel string, n bigint")


@query("a11_csv_order", f"with {Q.EV}, l as ({_LABELS}) select row_number() over (order by event_name, channel) as line, event_name, channel, n from l")
def _(t: Tables):
    """Lines of the CSV sink in file order: the order of its keys."""
    root = folder(t, "csv")
    sinks.write_csv(_labels(t), root, ["event_name", "channel"])
    lines = (t.spark.read.option("header", "true").option("nullValue", "\u0000").option("emptyValue", "").schema("event_name string, channel string, n bigint").csv(root)
             .select("*", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i")))
    from pyspark.sql import Window
    return lines.select(F.row_number().over(Window.orderBy("f", "i")).cast("long").alias("line"), F.coalesce("event_name", F.lit("")).alias("event_name"), F.coalesce("channel", F.lit("")).alias("channel"), "n")


@query("a13_load_table", "select (select count(*) from events) as loaded, true as refused, (select count(*) from events where event_type = 'error') as replaced")
def _(t: Tables):
    """Load a table, be refused once it is filled, then replace it."""
    name = f"reporting_{uuid.uuid4().hex}"
    ev = t.table("events")
    loaded = sinks.load_table(ev, name)
    try:
        sinks.load_table(ev, name)
        refused = False
    except ValueError:
        refused = True
    replaced = sinks.load_table(ev.filter("event_type = 'error'"), name, replace=True)
    t.spark.sql(f"drop table {name}")
    return t.spark.range(1).select(F.lit(loaded).cast("long").alias("loaded"), F.lit(refused).alias("refused"), F.lit(replaced).cast("long").alias("replaced"))


@query("a17_day_commits", """with d as (select cast(ts as date) as day, count(*) as rows from events group by 1)
  select cast(day as varchar) as day, rows, day > (select min(day) from d) as linked from d""")
def _(t: Tables):
    """All days committed in turn, the second twice; a day that holds a row of another one is refused. Rows as stored,
    dealt to days once, so that a day's commit reads that day only."""
    root, log, staged = folder(t, "days"), folder(t, "log"), folder(t, "staged")
    sinks.write_days(t.table("events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("event_datetime"), F.col("user_id").cast("string").alias("application_id")), staged)
    ev = t.spark.read.parquet(staged)
    of = lambda *days: ev.filter(F.col("day").isin(*days)).drop("day")
    days = sorted(r["d"] for r in ev.select(F.col("day").cast("string").alias("d")).distinct().collect())  # a calendar
    try:
        sinks.commit_day(of(*days[:2]), days[0], root, log)
    except ValueError:
        pass
    for day in (*days[:2], *days[1:]):
        sinks.commit_day(of(day), day, root, log)
    stored = t.spark.read.parquet(root).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    return stored.join(sinks.read_log(t.spark, log).select("day", (F.col("previous_hash") != "").alias("linked")), "day")


_WANTED = {"event_id": "bigint", "user_id": "int", "ts": "date", "event_type": "double", "value": "bigint", "props": "string", "absent": "string"}


@query("b1_schema", " union all ".join(f"""select '{c}' as column_name, {"'missing'" if c == 'absent' else f"(select replace(lower(any_value(typeof({c}))), 'varchar', 'string') from events)"} as found, count(*) as rows,
  {'count(*)' if c == 'absent' else f'count(*) - count({c})'} as nulls, {'0' if c == 'absent' else f"count({c}) - count(try_cast({c} as {kind.replace('string', 'varchar')}))"} as unfit from events""" for c, kind in _WANTED.items()))
def _(t: Tables):
    """The event table against a contract of types: what each column is, and how many of its values the wanted type cannot hold."""
    want = T.StructType([T.StructField(c, T._parse_datatype_string(kind)) for c, kind in _WANTED.items()])
    return K.column_conformity(t.table("events"), want).withColumn("found", F.regexp_replace("found", "timestamp_ntz", "timestamp"))

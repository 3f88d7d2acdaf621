"""Views that turn the given tables into the event and lifecycle contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import among, daypart, iso_weekday, micros, plus_seconds
from ..operators.ordered import GEOMETRY, Running, mark_parts, scan
from ..spec import EVENT_COLUMNS, LifecycleSpec

# Journey vocabulary of the clickstream tables.
STREAM_SPEC = LifecycleSpec(
    creation="signup", terminal="purchase", approval="click", prerequisites=("view",), form=("view",),
    close="close", focus=("error",), downstream=("view", "click", "purchase"),
    order=("signup", "error", "view", "click", "purchase"),
    validity_seconds=3 * 86400, returning_seconds=3 * 86400, young_seconds=6 * 3600,
    grain="day", pattern_split="2024-01-16 00:00:00", pattern_support=(5, 5),
    law_levels={"STATE_REGIME": (("state", "regime"), 30), "STATE": (("state",), 30),
                "STAGE": (("journey_stage",), 50), "GLOBAL": ((), 1)},
    residual_support=10, age_bounds=(12, 24, 36, 48, 60), silence_bounds=(6, 12, 24, 48),
    depth_bounds=(1, 2, 4), bound_seconds=3600,
)
ORDER_SPEC = LifecycleSpec(creation="order")
STAGES = {"signup": "Onboarding", "view": "Awareness", "click": "Consideration", "error": "Tech",
          "purchase": "Transaction"}
ORIGINS = (("2024-01-11 00:00:00", "HISTORICAL_MARCH"), ("2024-01-21 00:00:00", "HISTORICAL_APRIL"))


def stage_of(label):
    out = None
    for k, v in STAGES.items():
        out = F.when(label == k, v) if out is None else out.when(label == k, v)
    return out


def stream_events(events: DataFrame, spec: LifecycleSpec = STREAM_SPEC, campaign: bool = False) -> DataFrame:
    """Clickstream rows as lifecycle events.

    A creation row starts the user's next application; `application_created_at` is its time. One
    ordered scan per user gives both. With `campaign`, low values of the JSON field k become
    campaign rows.
    """
    label = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    if campaign:
        label = (F.when(k < 15, "campaign_sent").when(k < 25, "campaign_open_read")
                 .when(k < 30, "campaign_clicked").otherwise(label))
    rows = events.select(
        F.col("user_id").cast("string").alias("context_id"), F.col("ts").cast("timestamp_ntz").alias("event_datetime"),
        F.col("event_id").alias("source_row"), label.alias("journey_substage"),
        F.when(~among(label, spec.campaign), stage_of(label)).alias("journey_stage"),
        F.concat(F.lit("k"), F.floor(k / 10).cast("string")).alias("event_name"),
        F.element_at(F.array(F.lit("SMS"), F.lit("WA"), F.lit("GRCS")), k % 3 + 1).alias("channel"),
        F.col("value").alias("visitnum"))
    # Packets group by the grain, so a slot must not cut a grain in two.
    grain_us = {None: 1, "hour": 3600 * 10**6, "day": 86400 * 10**6}[spec.grain]
    rows = mark_parts(rows, ["context_id"], micros("event_datetime"), spec.hot_rows, grain_us)
    created = F.col("journey_substage") == spec.creation
    rows = scan(rows, ["context_id"], ["event_datetime", "source_row"],
                __seq=Running("sum", F.when(created, 1).otherwise(0)),
                application_created_at=Running("last", F.when(created, F.col("event_datetime"))))
    start = F.lit(ORIGINS[1][0]).cast("timestamp_ntz")
    origin = F.lit("SIMULATED_MAY")
    for edge, name in reversed(ORIGINS):
        origin = F.when(F.col("event_datetime") < F.lit(edge).cast("timestamp_ntz"), name).otherwise(origin)
    rows = rows.withColumn("application_id", F.when(
        F.col("__seq") > 0, F.concat_ws("-", "context_id", F.col("__seq").cast("string")))).drop("__seq")
    rows = rows.withColumns({
        "deadline": plus_seconds("application_created_at", spec.validity_seconds),
        "data_origin": origin, "is_simulated": F.col("event_datetime") >= start,
        "day_of_week_num": iso_weekday("event_datetime"), "time_bucket": F.lower(daypart("event_datetime")),
        "source_type": F.when(F.col("visitnum") < 10, "WEB").otherwise("APP"),
        "product_id": F.lit("PERSONAL_LOAN")})
    rows = rows.withColumns({x: F.lit(None).cast("string") for x in EVENT_COLUMNS if x not in rows.columns})
    return rows.select(*EVENT_COLUMNS, "source_row", "application_created_at", "deadline", "data_origin",
                       "is_simulated", "part", *GEOMETRY)


def stream_lifecycles(events: DataFrame, spec: LifecycleSpec = STREAM_SPEC) -> DataFrame:
    """One row per application, read off its creation row."""
    return (events.filter((F.col("journey_substage") == spec.creation) & F.col("application_id").isNotNull())
            .select("application_id", "context_id", "application_created_at", "deadline", "part", *GEOMETRY))


def order_lifecycles(orders: DataFrame, spec: LifecycleSpec = ORDER_SPEC) -> DataFrame:
    """Orders as a lifecycle registry: the customer is the context, each order an application."""
    at = F.col("o_orderdate").cast("timestamp_ntz")
    rows = orders.select(F.col("o_orderkey").cast("string").alias("application_id"),
                         F.col("o_custkey").cast("string").alias("context_id"),
                         at.alias("application_created_at"), F.col("o_orderkey").alias("source_row"),
                         F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    rows = mark_parts(rows, ["context_id"], micros("application_created_at"), spec.hot_rows)
    return rows.withColumn("deadline", plus_seconds("application_created_at", spec.validity_seconds))

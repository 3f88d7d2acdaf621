"""Domain parameters. Operators never hard-code a label or a bound; they take a spec."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values of the event contract: column names in their published order.
EVENT_COLUMNS = (
    "application_id", "context_id", "event_datetime", "event_name", "journey_stage",
    "journey_substage", "site_subsection", "channel_id", "platform_type", "product_id",
    "partner_id", "trigger_type", "time_bucket", "visitnum", "utm_source", "utm_medium",
    "utm_campaign", "source_type", "campaign_name", "session_id", "channel", "utm_channel",
    "day_of_week_num", "initiated_by",
)
PROVENANCE_COLUMNS = (
    "cumulative_row_key", "run_id", "is_simulated", "simulation_event_key",
    "source_file", "source_row",
)
EVENT_DDL = ", ".join(
    f"{c} " + {"event_datetime": "timestamp_ntz", "visitnum": "double",
               "day_of_week_num": "bigint"}.get(c, "string")
    for c in EVENT_COLUMNS
)

# Same-time order of the business labels.
CANONICAL_ORDER = (
    "Application Created", "Language Selection", "Application Resume",
    "Application OTP Verification", "Form filled", "Professional details",
    "Professional Details Submission", "AIP Approved", "Product Selection",
    "Address Submission", "Bank Approval Pending", "Bank Approved", "listing",
    "Push to Partner",
)
# Elapsed-time edges of the piecewise hazard, in seconds.
HAZARD_EDGES = (0, 60, 300, 900, 1800, 3600, 7200, 21600, 86400, 259200, 604800, 1209600, 2592000)
# Reporting quantiles and timing thresholds (seconds).
QUANTILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75,
             "p90": 0.90, "p95": 0.95, "p99": 0.99}
THRESHOLDS = (0, 60, 300, 900, 3600, 86400)
GAP_THRESHOLDS = (0, 60, 300, 900, 3600, 10800, 21600, 43200, 86400)
# Campaign action vocabulary.
CHANNELS = ("SMS", "WA", "GRCS")
TIME_BUCKETS = ("MORNING", "AFTERNOON", "EVENING", "NIGHT")
THEME = "THEME_PLACEHOLDER"
# Send-propensity backoff, most specific first.
SEND_LEVELS = {
    "STATE_AGE_PRIOR_GAP": ("current_state", "age_bucket", "prior_send_bucket", "recent_send_gap_bucket"),
    "STATE_AGE_GAP": ("current_state", "age_bucket", "recent_send_gap_bucket"),
    "STATE_PRIOR_GAP": ("current_state", "prior_send_bucket", "recent_send_gap_bucket"),
    "STATE_GAP": ("current_state", "recent_send_gap_bucket"),
    "AGE_PRIOR_GAP": ("age_bucket", "prior_send_bucket", "recent_send_gap_bucket"),
    "AGE_GAP": ("age_bucket", "recent_send_gap_bucket"),
    "ORIGIN_GAP": ("population_origin", "recent_send_gap_bucket"),
    "GAP": ("recent_send_gap_bucket",),
    "STATE_AGE_PRIOR": ("current_state", "age_bucket", "prior_send_bucket"),
    "STATE_AGE": ("current_state", "age_bucket"),
    "STATE_PRIOR": ("current_state", "prior_send_bucket"),
    "STATE": ("current_state",),
    "AGE_PRIOR": ("age_bucket", "prior_send_bucket"),
    "AGE": ("age_bucket",),
    "ORIGIN": ("population_origin",),
    "GLOBAL": (),
}
# Response-motif backoff, most specific first.
MOTIF_LEVELS = {
    "STATE_CHANNEL_TIME_PRIOR": ("current_journey_substage", "channel", "time_bucket", "prior_send_bucket"),
    "STATE_CHANNEL_TIME": ("current_journey_substage", "channel", "time_bucket"),
    "STATE_CHANNEL": ("current_journey_substage", "channel"),
    "STAGE_CHANNEL": ("current_journey_stage", "channel"),
    "CHANNEL_TIME_PRIOR": ("channel", "time_bucket", "prior_send_bucket"),
    "CHANNEL": ("channel",),
    "GLOBAL": (),
}
# Event-name backoff, most specific first.
NAME_LEVELS = {
    "STAGE_SUBSTAGE_SOURCE": ("journey_stage", "journey_substage", "source_type"),
    "STAGE_SUBSTAGE": ("journey_stage", "journey_substage"),
    "SUBSTAGE_SOURCE": ("journey_substage", "source_type"),
    "SUBSTAGE": ("journey_substage",),
}
# Residual-law backoff, most specific first.
RESIDUAL_LEVELS = {
    "SOURCE_AGE_SILENCE_DEPTH": ("state", "age_band", "silence_band", "depth_band"),
    "SOURCE_AGE_SILENCE": ("state", "age_band", "silence_band"),
    "SOURCE_AGE": ("state", "age_band"),
    "SOURCE": ("state",),
    "AGE_SILENCE": ("age_band", "silence_band"),
    "GLOBAL": (),
}
# Next-event law levels and their minimum occurrences.
LAW_LEVELS = {
    "STATE_REGIME": (("state", "regime"), 200),
    "STATE": (("state",), 200),
    "STAGE": (("journey_stage",), 500),
    "GLOBAL": ((), 1),
}
LAW_STRATA = ("ptp_eligible", "source_age", "customer_kind")


@dataclass(frozen=True)
class LifecycleSpec:
    creation: str = "Application Created"
    terminal: str = "Push to Partner"
    approval: str = "AIP Approved"
    prerequisites: tuple[str, ...] = ("Professional Details Submission", "Professional details")
    form: tuple[str, ...] = ("Form filled",)
    close: str = "Journey Close"
    focus: tuple[str, ...] = ("Application OTP Verification", "Application Resume")
    downstream: tuple[str, ...] = (
        "Professional Details Submission", "Professional details", "AIP Approved", "listing",
        "Product Selection", "Address Submission", "Bank Approval Pending", "Bank Approved",
        "Push to Partner")
    campaign: tuple[str, ...] = ("campaign_sent", "campaign_open_read", "campaign_clicked")
    order: tuple[str, ...] = CANONICAL_ORDER
    validity_seconds: int = 30 * 86400
    returning_seconds: int = 30 * 86400
    young_seconds: int = 86400
    # Packets share one timestamp; a coarser grain truncates it first.
    grain: str | None = None
    pattern_split: str = "2026-04-01 00:00:00"
    pattern_support: tuple[int, int] = (50, 25)
    law_levels: dict = field(default_factory=lambda: dict(LAW_LEVELS))
    law_strata: tuple[str, ...] = LAW_STRATA
    residual_levels: dict = field(default_factory=lambda: dict(RESIDUAL_LEVELS))
    residual_support: int = 30
    # Bounds in units of `bound_seconds`.
    age_bounds: tuple[int, ...] = (7, 14, 21, 22, 23, 24, 25, 26, 27, 28, 29)
    silence_bounds: tuple[int, ...] = (1, 7, 14, 21)
    depth_bounds: tuple[int, ...] = (3, 6, 10)
    bound_seconds: int = 86400
    hazard_edges: tuple[int, ...] = HAZARD_EDGES
    # Keys with more rows than this are cut into time parts (see operators.ordered).
    hot_rows: int = 2_000_000

    def but(self, **changes) -> "LifecycleSpec":
        return replace(self, **changes)

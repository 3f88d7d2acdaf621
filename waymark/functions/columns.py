"""Column helpers: time, hashing, buckets, verdicts. All stay inside JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import CHANNELS, THEME, TIME_BUCKETS, LifecycleSpec

SCALE_64 = 18446744073709551616.0
EPOCH = "1970-01-01 00:00:00"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def micros(ts) -> Column:
    """Epoch microseconds of a zone-free timestamp (the session zone is UTC)."""
    return F.unix_micros(c(ts).cast("timestamp"))


def seconds_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def plus_seconds(ts, seconds: float) -> Column:
    return F.timestamp_micros(micros(ts) + F.lit(int(round(seconds * 1_000_000))).cast("long")).cast("timestamp_ntz")


def truncated(ts, grain: str | None) -> Column:
    return c(ts) if grain is None else F.date_trunc(grain, c(ts)).cast("timestamp_ntz")


def weekday(ts) -> Column:
    """0 = Monday."""
    return F.weekday(c(ts)).cast("int")


def iso_weekday(ts) -> Column:
    return (F.weekday(c(ts)) + 1).cast("long")


def among(col, values) -> Column:
    """Membership that is FALSE for NULL."""
    return F.coalesce(c(col).isin(*values), F.lit(False))


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def ladder(x, steps, otherwise) -> Column:
    """First upper edge (exclusive) above x wins; NULL stays NULL."""
    x = c(x)
    out = None
    for edge, label in steps:
        out = F.when(x < edge, label) if out is None else out.when(x < edge, label)
    return out.when(x.isNotNull(), otherwise)


def daypart(ts) -> Column:
    h = F.hour(c(ts))
    return (F.when(h < 6, "NIGHT").when(h < 12, "MORNING").when(h < 17, "AFTERNOON")
            .when(h < 21, "EVENING").otherwise("NIGHT"))


def age_bucket(days) -> Column:
    return ladder(days, [(1, "LT_1D"), (3, "1D_3D"), (7, "3D_7D"), (14, "7D_14D"), (21, "14D_21D")],
                  "21D_30D")


def approval_age_bucket(seconds) -> Column:
    return ladder(seconds, [(86400, "LT_1D"), (7 * 86400, "1D_7D")], "7D_30D")


def prior_send_bucket(n) -> Column:
    n = c(n)
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2_3").otherwise("4_PLUS")


def motif_send_bucket(n) -> Column:
    n = c(n)
    return F.when(n == 0, "0").when(n == 1, "1").when(n >= 2, "2_PLUS")


def send_gap_bucket(seconds) -> Column:
    s = c(seconds)
    return F.when(s.isNull(), "NO_PRIOR_SEND").otherwise(
        ladder(s, [(86400, "LT_1D"), (3 * 86400, "1D_3D"), (7 * 86400, "3D_7D")], "7D_PLUS"))


def bound_band(x, bounds) -> Column:
    """Number of bounds strictly below x; a value equal to a bound stays in the lower band; NULL stays NULL."""
    x = c(x)
    return F.when(x.isNotNull(), reduce(lambda a, b: a + b, [flag(x > b) for b in bounds]).cast("int"))


def interval_label(x, edges) -> Column:
    """Label of the interval (lo, hi] holding x; NULL outside."""
    x = c(x)
    out = F.when(F.lit(False), "")
    for lo, hi in zip(edges, edges[1:]):
        out = out.when((x > lo) & (x <= hi), f"({lo}, {hi}]")
    return out


def draw(*parts) -> Column:
    """Uniform number in [0, 1) from the first 8 bytes (big end first) of a SHA-256."""
    text = F.concat_ws("|", *[F.lit(p) if not isinstance(p, Column) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(SCALE_64)


def hash_key(prefix: str, *parts, length: int = 64) -> Column:
    text = F.concat_ws("|", *[F.lit(p) if not isinstance(p, Column) else p.cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def labels_text(arr) -> Column:
    return F.concat(F.lit("["), F.array_join(c(arr), ","), F.lit("]"))


def regime(state, seen_downstream, spec: LifecycleSpec) -> Column:
    focus = among(state, spec.focus)
    return (F.when(focus & c(seen_downstream), "REVISIT").when(focus, "FIRST_PASS")
            .otherwise("UNCONDITIONED"))


def partial_probability(hazard, fraction) -> Column:
    h, f = c(hazard), c(fraction)
    return (F.when((h <= 0) | (f <= 0), 0.0).when(h >= 1, 1.0)
            .otherwise(1.0 - F.pow(1.0 - h, f)))


def interpolate(u, knots) -> Column:
    """Piecewise-linear value at u over knots [(u0, v0 Column), ...] in rising order of u."""
    u = c(u)
    out = None
    for (u0, v0), (u1, v1) in zip(knots, knots[1:]):
        v0, v1 = c(v0) if not isinstance(v0, (int, float)) else F.lit(float(v0)), c(v1)
        piece = v0 + (v1 - v0) * (u - u0) / (u1 - u0)
        out = F.when(u < u1, piece) if out is None else out.when(u < u1, piece)
    return out.otherwise(c(knots[-1][1]))


# --- contract of campaign actions --------------------------------------------------------------

def action_violation(sent, channel, theme, bucket) -> Column:
    """NULL when the action is admissible, else a code naming the first broken rule."""
    sent, channel, theme, bucket = c(sent), c(channel), c(theme), c(bucket)
    up = lambda x, d: F.upper(F.coalesce(x, F.lit(d)))
    any_field = channel.isNotNull() | theme.isNotNull() | bucket.isNotNull()
    return (F.when(sent.isNull(), "MISSING_SEND_FLAG")
            .when(~sent & any_field, "NO_ACTION_WITH_FIELDS")
            .when(sent & ~up(channel, "").isin(*CHANNELS), "UNSUPPORTED_CHANNEL")
            .when(sent & ~up(bucket, "").isin(*TIME_BUCKETS), "UNSUPPORTED_TIME_BUCKET")
            .when(sent & (up(theme, THEME) != THEME), "UNSUPPORTED_THEME"))


def can_approve(form_seen, details_seen) -> Column:
    return c(form_seen) & c(details_seen)


def can_push(form_seen, details_seen, approval_seen, done) -> Column:
    return can_approve(form_seen, details_seen) & c(approval_seen) & ~c(done)


# --- verdicts ------------------------------------------------------------------------------------

def _finite(*cols) -> Column:
    ok = F.lit(True)
    for x in cols:
        x = c(x)
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return ok


def equivalence(diff, low, high, margin) -> Column:
    d, lo, hi, m = c(diff), c(low), c(high), c(margin)
    valid = _finite(d, lo, hi, m) & (m > 0) & (lo <= hi) & (lo <= d) & (d <= hi)
    return (F.when(~valid, "INVALID")
            .when((lo >= -m) & (hi <= m), F.when((lo <= 0) & (hi >= 0), "PASS").otherwise("LIMITATION"))
            .when((lo > m) | (hi < -m), "FAIL").otherwise("INCONCLUSIVE"))


def inflation(diff, low, high, margin=None) -> Column:
    d, lo, hi = c(diff), c(low), c(high)
    valid = _finite(d, lo, hi) & (lo <= hi) & (lo <= d) & (d <= hi)
    beyond = F.lit("INCONCLUSIVE") if margin is None else F.when(
        c(margin).isNull(), "INCONCLUSIVE").otherwise(equivalence(d, lo, hi, margin))
    return F.when(~valid, "INVALID").when(lo <= 0, "PASS").otherwise(beyond)


def intensity_margin(mean, share: float = 0.10) -> Column:
    m = c(mean)
    return F.when(_finite(m) & (m > 0), m * share)


def wilson(hits, n, z: float = 1.96) -> tuple[Column, Column]:
    p, n = c(hits) / c(n), c(n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half

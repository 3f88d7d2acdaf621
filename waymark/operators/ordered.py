"""Ordered work over keys that may not fit in one task.

A plain window sends every row of a key to one task. `mark_parts` counts rows per key once. If no
key exceeds `hot_rows`, windows stay plain. Otherwise hot keys are cut into time parts, windows run
per (key, part), and a carry of per-part totals, one row per part of a hot key, links the parts
(`scan`). The choice travels with the data as metadata of the `part` column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

PART = "part"
GEOMETRY = ("part_lo", "part_width")
COLD = {"no_hot_keys": True}


def is_cold(df: DataFrame, part: str = PART) -> bool:
    return bool(df.schema[part].metadata.get("no_hot_keys"))


def no_parts(df: DataFrame, part: str = PART) -> DataFrame:
    """Declare that no key of `df` needs cutting (for data known to be small per key)."""
    return df.withColumn(part, F.lit(None).cast("long").alias(part, metadata=COLD))


def mark_parts(df: DataFrame, keys: Sequence[str], at: Column, hot_rows: int, grain_us: int = 1,
               oversplit: int = 16) -> DataFrame:
    """Add `part`: NULL for ordinary keys, a time slot number for hot ones; `part_lo` and
    `part_width` keep the slot geometry so that derived times can be slotted too (`repart`).

    Counting reads the key and time columns only and combines before its shuffle. The joined side
    holds only keys above `hot_rows`; Spark sends it to every task while it is small. Slots are equal in
    time and start on multiples of the grain; `oversplit` absorbs uneven density.
    """
    hot = (df.select(*keys, at.alias("__at")).groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__lo"), F.max("__at").alias("__hi"))
           .filter(F.col("__n") > hot_rows))
    if hot.isEmpty():
        return no_parts(df).withColumns({x: F.lit(None).cast("long") for x in GEOMETRY})
    raw = (F.col("__hi") - F.col("__lo") + 1) / (F.ceil(F.col("__n") / hot_rows) * oversplit)
    hot = hot.select(*keys, (F.floor(F.col("__lo") / grain_us) * grain_us).alias("part_lo"),
                     (F.greatest(F.lit(1), F.ceil(raw / grain_us)) * grain_us).alias("part_width"))
    return repart(df.join(hot, list(keys), "left").withColumn(PART, F.lit(None).cast("long")), at)


def repart(df: DataFrame, at: Column) -> DataFrame:
    """Slot rows by another time than the one they came with, on the same geometry."""
    if is_cold(df):
        return df
    return df.withColumn(PART, F.floor((at - F.col("part_lo")) / F.col("part_width")))


def like_parts(points: DataFrame, rows: DataFrame, key: str, at: Column) -> DataFrame:
    """Slot points on the geometry of the rows of the same key."""
    points = points.drop(PART, *GEOMETRY)
    if is_cold(rows):
        return no_parts(points)
    hot = rows.filter(F.col(PART).isNotNull()).groupBy(key).agg(*[F.min(x).alias(x) for x in GEOMETRY])
    return repart(points.join(hot, key, "left").withColumn(PART, F.lit(None).cast("long")), at)


def value_part(value) -> Column:
    """Monotone slot of a number, 256 per power of two: some thousand slots for any scale."""
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    return (F.floor(F.log2(F.abs(v) + 1) * 256) * F.signum(v)).cast("long")


def arrange(df: DataFrame, keys: Sequence[str], part: str = PART) -> DataFrame:
    """Spread rows by (key, part); needed after a join on the bare key, whose layout Spark
    would otherwise keep for the following windows."""
    return df if is_cold(df, part) else df.repartition(*keys, part)


@dataclass(frozen=True)
class Running:
    """Running aggregate in order: sum, max, min, last, first, product or collect; NULLs are skipped.
    `collect` is for expressions that are NULL on all but a bounded number of rows per key."""
    agg: str
    expr: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Shift:
    """Value n rows before (n > 0) or after (n < 0)."""
    expr: Column
    n: int = 1


_AGG = {
    "sum": F.sum, "max": F.max, "min": F.min, "product": F.product,
    "last": lambda e: F.last(e, ignorenulls=True),
    "first": lambda e: F.first(e, ignorenulls=True),
    "collect": F.collect_list,
}


def _merge(agg: str, inner: Column, carry: Column) -> Column:
    """Result of a running aggregate from its value inside the part and the carry before it."""
    if agg in ("sum", "product"):
        zero = F.lit(0 if agg == "sum" else 1.0)
        inner = F.coalesce(inner, zero)
        if carry is None:
            return inner
        carry = F.coalesce(carry, zero)
        return inner + carry if agg == "sum" else inner * carry
    if carry is None:
        return inner
    if agg == "collect":
        return F.when(carry.isNull(), inner).otherwise(F.concat(carry, inner))
    if agg == "max":
        return F.greatest(inner, carry)
    if agg == "min":
        return F.least(inner, carry)
    return F.coalesce(inner, carry) if agg == "last" else F.coalesce(carry, inner)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], part: str = PART,
         descending: bool = False, **wanted: Running | Shift) -> DataFrame:
    """Add ordered-window columns over `keys`, part by part. `order` must be a total order."""
    keys = list(keys)
    way = (lambda x: F.col(x).desc()) if descending else (lambda x: F.col(x).asc())
    kept = [x for x in df.columns if x not in wanted]
    if is_cold(df, part):
        w = Window.partitionBy(*keys).orderBy(*[way(o) for o in order])
        upto = lambda s: w.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        return df.select(*kept, *[
            (_merge(s.agg, _AGG[s.agg](s.expr).over(upto(s)), None) if isinstance(s, Running) else
             (F.lag(s.expr, s.n) if s.n > 0 else F.lead(s.expr, -s.n)).over(w)).alias(name)
            for name, s in wanted.items()])
    w = Window.partitionBy(*keys, part).orderBy(*[way(o) for o in order])
    depth = max([abs(s.n) for s in wanted.values() if isinstance(s, Shift)], default=0)
    src = df
    for name, s in wanted.items():
        src = src.withColumn(f"__x_{name}", s.expr)
    inner = []
    for name, s in wanted.items():
        x = F.col(f"__x_{name}")
        if isinstance(s, Running):
            frame = w.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
            inner.append(_AGG[s.agg](x).over(frame).alias(f"__in_{name}"))
        else:
            inner.append((F.lag(x, s.n) if s.n > 0 else F.lead(x, -s.n)).over(w).alias(f"__in_{name}"))
    if depth:
        one = F.count(F.lit(1))
        inner += [one.over(w.rowsBetween(-depth, -1)).alias("__pre"),
                  one.over(w.rowsBetween(1, depth)).alias("__post")]
    base = src.select("*", *inner)

    # One summary row per (key, part) of hot keys only.
    stamp = F.struct(*[F.col(o) for o in order])
    totals = []
    for name, s in wanted.items():
        x = F.col(f"__x_{name}")
        if not isinstance(s, Running):
            continue
        if s.agg == "collect":
            listed = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(stamp.alias("o"), x.alias("x")))), asc=not descending)
            totals.append(F.transform(listed, lambda i: i["x"]).alias(f"__t_{name}"))
        elif s.agg in ("last", "first"):
            pick = F.max_by if (s.agg == "last") != descending else F.min_by
            totals.append(pick(x, F.when(x.isNotNull(), stamp)).alias(f"__t_{name}"))
        else:
            totals.append(_AGG[s.agg](x).alias(f"__t_{name}"))
    shifts = [n for n, s in wanted.items() if isinstance(s, Shift)]
    if shifts:
        row = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)],
                       *[F.col(f"__x_{n}").alias(n) for n in shifts])
        totals += [F.sort_array(F.collect_list(F.when(F.col("__post") < depth, row)),
                                asc=not descending).alias("__tail"),
                   F.sort_array(F.collect_list(F.when(F.col("__pre") < depth, row)),
                                asc=not descending).alias("__head")]
    parts = base.filter(F.col(part).isNotNull()).groupBy(*keys, part).agg(*totals)
    cw = Window.partitionBy(*keys).orderBy(way(part))
    before = cw.rowsBetween(Window.unboundedPreceding, -1)
    carried = [(F.flatten(F.collect_list(f"__t_{n}").over(before)) if s.agg == "collect" else
                _AGG[s.agg](F.col(f"__t_{n}")).over(before)).alias(f"__c_{n}")
               for n, s in wanted.items() if isinstance(s, Running)]
    if shifts:
        carried += [F.flatten(F.collect_list("__tail").over(cw.rowsBetween(-depth, -1))).alias("__before"),
                    F.flatten(F.collect_list("__head").over(cw.rowsBetween(1, depth))).alias("__after")]
    # Written once: the main plan reads it back instead of repeating everything above it.
    carry = materialize(parts.select(*keys, part, *carried))
    joined = base.join(carry, [*keys, part], "left")

    out = []
    for name, s in wanted.items():
        local = F.col(f"__in_{name}")
        if isinstance(s, Running):
            out.append(_merge(s.agg, local, F.col(f"__c_{name}")).alias(name))
        elif s.n > 0:
            far = F.try_element_at(F.col("__before"), (F.col("__pre") - s.n).cast("int"))[name]
            out.append(F.when(F.col("__pre") >= s.n, local).otherwise(far).alias(name))
        else:
            far = F.try_element_at(F.col("__after"), (F.lit(-s.n) - F.col("__post")).cast("int"))[name]
            out.append(F.when(F.col("__post") >= -s.n, local).otherwise(far).alias(name))
    return joined.select(*kept, *out)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: Column, right_at: Column,
         values: dict[str, Column], tie: Column | None = None, forward: bool = False,
         strict: bool = False, part: str = PART) -> DataFrame:
    """Left rows plus the values of the nearest right row of the same key at or before
    (`forward`: at or after) their time; `strict` leaves equal times out.

    Both sides carry `part` in step with time, so one merge-ordered scan serves any key size.
    """
    keys = list(keys)
    right_first = not strict
    side_of_right = (0 if right_first else 1) if not forward else (1 if right_first else 0)
    tie = F.lit(0).cast("long") if tie is None else tie.cast("long")
    row = F.struct(*[F.col(x) for x in left.columns])
    val = F.struct(*[e.alias(n) for n, e in values.items()])
    r = right.select(*keys, part, right_at.alias("__at"), F.lit(side_of_right).alias("__side"),
                     tie.alias("__tie"), val.alias("__val"))
    cold = is_cold(left, part) and is_cold(right, part)
    l = left.select(*keys, part, left_at.alias("__at"), F.lit(1 - side_of_right).alias("__side"),
                    F.lit(0).cast("long").alias("__tie"), row.alias("__row"))
    both = l.unionByName(r, allowMissingColumns=True)
    both = no_parts(both, part) if cold else both.withColumn(part, F.col(part).alias(part, metadata={}))
    found = scan(both, keys, ["__at", "__side", "__tie"], part=part, descending=forward,
                 __hit=Running("last", F.col("__val")))
    return (found.filter(F.col("__row").isNotNull())
            .select("__row.*", *[F.col("__hit")[n].alias(n) for n in values]))


def ranked(df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """Rank (from 1) within the keys by value, then by a hash of `tie`. Distinct values are counted
    and summed slot by slot; rows of one value are ranked over hash slots, so neither a long range
    nor a crowd of equal values lands in one task."""
    keys = list(keys)
    steps = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")).withColumn(PART, value_part(value))
    steps = scan(steps, keys, [value], __before=Running("sum", F.col("__n"), inclusive=False))
    rows = df.withColumn("__h", F.sha2(F.col(tie).cast("string"), 256))
    rows = rows.withColumn(PART, F.conv(F.substring("__h", 1, 3), 16, 10).cast("long"))
    rows = scan(rows, [*keys, value], ["__h"], __i=Running("sum", F.lit(1))).drop("__h", PART)
    return rows.join(steps.select(*keys, value, "__before"), [*keys, value]).withColumn(
        name, F.col("__before") + F.col("__i")).drop("__before", "__i")


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
              weight: str | None = None, count: str | None = None) -> DataFrame:
    """Exact quantiles per group, one row each, without holding a group's values in one task. `count`: how often a row's
    value occurs, where rows are counted already.

    Values are counted once, located by slot totals, and only the slots that hold a wanted rank
    are ordered. Without `weight`: linear interpolation. With `weight`: first value whose
    cumulative weight reaches q times the total.
    """
    by = list(by)
    data = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"),
                                                      *([F.col(weight or count).alias("__w")] if weight or count else []))
    amount = F.sum("__w") if weight or count else F.count(F.lit(1))
    counted = data.groupBy(*by, "__v").agg(amount.alias("__n")).withColumn("__slot", value_part("__v"))
    w = Window.partitionBy(*by).orderBy("__slot")
    slots = (counted.groupBy(*by, "__slot").agg(F.sum("__n").alias("__sn"))
             .withColumn("__before", F.coalesce(F.sum("__sn").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("__total", F.sum("__sn").over(Window.partitionBy(*by))))

    def targets(p):
        if weight:
            return [F.lit(p) * F.col("__total")]
        rank = F.lit(p) * (F.col("__total") - 1)
        return [F.floor(rank), F.ceil(rank)]

    def covers(t, lo, hi):
        if weight:
            return (F.round(lo, 9) < F.round(t, 9)) & (F.round(hi, 9) >= F.round(t, 9))
        return (t >= lo) & (t < hi)

    needed = F.lit(False)
    for p in probs.values():
        for t in targets(p):
            needed = needed | covers(t, F.col("__before"), F.col("__before") + F.col("__sn"))
    picked = slots.filter(needed).drop("__sn")
    on = [*by, "__slot"]
    rows = counted.join(picked, on)
    run = F.sum("__n").over(Window.partitionBy(*by, "__slot").orderBy("__v"))
    rows = rows.withColumn("__hi", F.col("__before") + run).withColumn("__lo", F.col("__hi") - F.col("__n"))
    aggs = []
    for name, p in probs.items():
        ends = [F.max(F.when(covers(t, F.col("__lo"), F.col("__hi")), F.col("__v"))) for t in targets(p)]
        if weight:
            aggs.append(ends[0].alias(name))
        else:
            rank = F.lit(p) * (F.max("__total") - 1)
            aggs.append((ends[0] + (ends[1] - ends[0]) * (rank - F.floor(rank))).alias(name))
    return rows.groupBy(*by).agg(*aggs)

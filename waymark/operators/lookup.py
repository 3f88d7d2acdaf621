"""Backoff lookup, draws from fitted tables, visible history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import micros
from ..session import materialize
from .lifecycle import one_line
from .ordered import Running, repart, scan
from .survival import explode_levels


def backoff(rows: DataFrame, pools: DataFrame, levels: dict[str, Sequence[str]], strata: Sequence[str] = (),
            blank=lambda f: F.lit(""), prefix: str = "pool_") -> DataFrame:
    """Most specific level of `pools` that holds a row's key; NULL level when none does.

    Levels are tried once per distinct key combination, not once per row, and the answer is joined
    back; adaptive execution broadcasts the answer while it is small and splits skew otherwise.
    """
    fields = list(dict.fromkeys(k for keys in levels.values() for k in keys))
    combos = rows.select(*fields, *strata).distinct()
    combos = combos.withColumn("__key", F.struct(*fields, *strata))
    rank = F.lit(len(levels))
    for i, name in reversed(list(enumerate(levels))):
        rank = F.when(F.col("model_level") == name, i).otherwise(rank)
    found = (explode_levels(combos, levels, fields, blank)
             .join(pools.select("model_level", *fields, *strata).distinct(), ["model_level", *fields, *strata])
             .groupBy("__key").agg(F.min_by(F.struct("model_level", *fields), rank).alias("__hit")))
    answer = found.select("__key.*", F.col("__hit.model_level").alias("__level"), *[F.col("__hit")[f].alias(prefix + f) for f in fields])
    return rows.join(answer, [*fields, *strata], "left").withColumnRenamed("__level", "model_level")


#: Categories of a key that share one cell of its grid, about.
CELL_CATEGORIES = 8


def categorical_draw(rows: DataFrame, model: DataFrame, key: Sequence[str], label: str, u: str, weight: str = "support_count") -> DataFrame:
    """Inverse-CDF pick of a category by u in [0, 1); NULL where the model lacks the key.

    Each category covers a range of its key's cumulative weight. The range of u is cut into cells, one for every few
    categories, and a category is listed in the cells it covers, so a row meets the categories of one cell and not the
    vocabulary of its key: linear in rows and categories, with no list a key.
    """
    key = list(key)
    named = model.select(*key, F.col(label).alias("__l"), F.col(weight).cast("long").alias("__w")).filter("__w > 0")
    # labels in order; their first bytes cut a large vocabulary into parts that follow the order
    head = F.rpad(F.hex(F.substring(F.col("__l").cast("string").cast("binary"), 1, 3)), 6, "0")
    named = named.withColumn("part", F.conv(head, 16, 10).cast("long"))
    upto = scan(named, key, ["__l"], __hi=Running("sum", F.col("__w"))).drop("part")
    sizes = named.groupBy(*key).agg(F.sum("__w").alias("__total"), F.ceil(F.count(F.lit(1)) / CELL_CATEGORIES).cast("long").alias("__cells"))
    sizes = materialize(sizes)
    cell = lambda p: F.least(F.col("__cells") - 1, F.floor(p * F.col("__cells") / F.col("__total"))).cast("long")
    spread = upto.join(sizes, key).withColumn("__lo", F.col("__hi") - F.col("__w"))
    # one cell more on either side, as u * total is rounded
    spread = spread.select(*key, "__l", "__lo", "__hi", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), cell(F.col("__lo")) - 1), F.least(F.col("__cells") - 1, cell(F.col("__hi")) + 1))).alias("__cell"))
    asked = rows.join(sizes, key, "left").withColumn("__p", F.col(u) * F.col("__total"))
    asked = asked.withColumn("__cell", cell(F.col("__p"))).drop("__cells", "__total")
    # a side of its own name for each column of the range, so that the join is on key and cell and the range only filters
    hit = asked.join(spread, [*key, "__cell"], "left").withColumn("__in", F.coalesce((F.col("__lo") <= F.col("__p")) & (F.col("__p") < F.col("__hi")), F.lit(False)))
    found = hit.filter(F.col("__in") | F.col("__p").isNull())
    return found.withColumn(label, F.col("__l")).drop("__cell", "__p", "__l", "__lo", "__hi", "__in")


def number_donors(donors: DataFrame, key: Sequence[str], tie: str) -> DataFrame:
    """Position (from 0) of every donor within its key, in the order of a hash of `tie`. Any fixed
    order serves a uniform pick, and hash slots stay even whatever values repeat."""
    rows = donors.withColumn("__h", F.sha2(F.col(tie).cast("string"), 256))
    rows = rows.withColumn("part", F.conv(F.substring("__h", 1, 3), 16, 10).cast("long"))
    return scan(rows, list(key), ["__h"], __i=Running("sum", F.lit(1))).withColumn("donor_index", F.col("__i") - 1).drop("__i", "__h", "part")


def donor_pick(rows: DataFrame, donors: DataFrame, fine: Sequence[str], coarse: Sequence[str], value: str, tie: str, u: str,
               minimum: int = 50) -> DataFrame:
    """One historical row per request by hash index, from the fine pool or, when that is under the
    minimum, from the coarse one."""
    fine, coarse = list(fine), list(coarse)
    out = None
    size = donors.groupBy(*fine).agg(F.count(F.lit(1)).alias("fine_pool"))
    rows = rows.join(size, fine, "left").na.fill(0, ["fine_pool"])
    for name, key, use in (("FINE", fine, F.col("fine_pool") >= minimum), ("COARSE", coarse, F.col("fine_pool") < minimum)):
        n = donors.groupBy(*key).agg(F.count(F.lit(1)).alias("pool_size"))
        asks = rows.filter(use).join(n, key).withColumn("donor_index", F.floor(F.col(u) * F.col("pool_size")).cast("long"))
        got = asks.join(number_donors(donors, key, tie).select(*key, "donor_index", F.col(value).alias("donor_value")),
                        [*key, "donor_index"]).withColumn("pool_level", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def visible_rows(decisions: DataFrame, events: DataFrame, columns: Sequence[str], latest: int = 20) -> DataFrame:
    """The `latest` rows of the same customer that are visible at each decision, newest first (`place` 1, 2...).

    Events of a customer are numbered once, a decision knows from one scan how many it sees, and asks for the last of these
    numbers: `latest` rows a decision, whatever the customer's history, and no pair of decision and event is formed."""
    numbered = scan(events, ["context_id"], ["event_datetime", "source_row"], number=Running("sum", F.lit(1)))
    seen = visible_summary(decisions, events).filter("visible_rows > 0")
    asks = seen.select("application_id", "context_id", "now", "visible_rows", F.explode(F.sequence(F.greatest(F.lit(1), F.col("visible_rows") - latest + 1), F.col("visible_rows"))).alias("number"))
    rows = numbered.select(F.col("context_id"), "number", *[F.col(c).alias(f"event_{c}" if c in ("application_id", "context_id") else c) for c in columns])
    return asks.join(rows, ["context_id", "number"]).withColumn("place", F.col("visible_rows") - F.col("number") + 1).drop("visible_rows", "number")


def visible_summary(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Number and last time of the customer's visible rows per decision, by one ordered scan."""
    d = repart(decisions, micros("now")).select("context_id", "part", micros("now").alias("__at"), F.lit(1).alias("__kind"),
                         F.xxhash64("application_id").alias("__tie"), F.struct("application_id", "now").alias("__row"))
    e = events.select("context_id", "part", micros("event_datetime").alias("__at"), F.lit(0).alias("__kind"),
                      F.col("source_row").alias("__tie"), F.col("event_datetime").alias("__seen"))
    line = one_line(d.unionByName(e, allowMissingColumns=True), decisions, events)
    line = scan(line, ["context_id"], ["__at", "__kind", "__tie"], visible_rows=Running("sum", F.when(F.col("__kind") == 0, 1).otherwise(0)),
                last_visible=Running("last", F.col("__seen")))
    return line.filter(F.col("__row").isNotNull()).select("__row.*", "context_id", "visible_rows", "last_visible")

"""Distances, stratified means, intervals, bootstraps and cohort comparisons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SCALE_64, equivalence, flag, intensity_margin
from ..session import materialize
from .ordered import quantiles


def total_variation(left: DataFrame, right: DataFrame, keys: Sequence[str], share: str = "share") -> DataFrame:
    """Half the summed absolute difference over the union of categories."""
    a, b = left.select(*keys, F.col(share).alias("__a")), right.select(*keys, F.col(share).alias("__b"))
    both = a.join(b, list(keys), "full").na.fill(0, ["__a", "__b"])
    return both.agg((0.5 * F.sum(F.abs(F.col("__a") - F.col("__b")))).alias("total_variation"))


def post_stratified(df: DataFrame, weights: DataFrame, stratum: str, metrics: Sequence[str]) -> DataFrame:
    """Stratum-weighted mean and normal 95 % interval per metric. `weights`: stratum, weight."""
    g = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *[f(m).alias(f"{m}_{s}") for m in metrics for s, f in (("m", F.avg), ("v", F.var_samp))])
    g = g.join(weights, stratum)
    w = F.col("weight")
    s = g.agg(*[F.sum(w * F.col(f"{m}_m")).alias(f"{m}_m") for m in metrics], *[F.sum(w * w * F.col(f"{m}_v") / F.col("n")).alias(f"{m}_v") for m in metrics])
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_m").alias("mean"), F.col(f"{m}_v").alias("variance")) for m in metrics])
    return s.select(F.inline(items)).withColumns({
        "low": F.col("mean") - 1.96 * F.sqrt("variance"), "high": F.col("mean") + 1.96 * F.sqrt("variance")})


def stratum_weights(df: DataFrame, stratum: str) -> DataFrame:
    n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    return n.select(stratum, (F.col("n") / n.agg(F.sum("n")).scalar()).alias("weight"))


# Poisson(1) cumulative probabilities; a uniform draw above k of them counts k.
POISSON_STEPS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
                 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217)


def poisson_weight(cluster, replicate, seed: int) -> Column:
    """Multiplicity of a cluster in a replicate. Independent Poisson(1) counts stand in for drawing
    clusters with replacement, so every row decides alone and no draw list is shared."""
    h = F.xxhash64(F.col(cluster), replicate, F.lit(seed))
    u = (h.cast("double") + F.lit(SCALE_64 / 2)) / F.lit(SCALE_64)
    out = F.lit(0)
    for p in POISSON_STEPS:
        out = out + flag(u >= p)
    return out


def replicate_sums(clusters: DataFrame, cluster: str, values: Sequence[str], replicates: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Weighted sums per replicate. Replicates are columns of one array per cluster row and are summed
    map-side: the shuffle carries one row per (partition, group, replicate)."""
    reps = clusters.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    reps = reps.withColumn("__k", poisson_weight(cluster, F.col("replicate"), seed))
    return reps.filter("__k > 0").groupBy(*by, "replicate").agg(*[F.sum(F.col(v) * F.col("__k")).alias(v) for v in values], F.sum("__k").alias("clusters"))


def interval(draws: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """95 % percentile interval; a group holds one value per replicate, so it is small by design."""
    return draws.groupBy(*by).agg(F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def bootstrap_ratio(rows: DataFrame, cluster: str, top: str, bottom: str, replicates: int = 400, seed: int = 20260502, by: Sequence[str] = ()) -> DataFrame:
    """Ratio of sums with a whole-cluster bootstrap interval."""
    by = list(by)
    per = rows.groupBy(*by, cluster).agg(F.sum(top).alias("top"), F.sum(bottom).alias("bottom"))
    point = per.groupBy(*by).agg((F.sum("top") / F.sum("bottom")).alias("estimate"), F.count(F.lit(1)).alias("clusters"))
    draws = replicate_sums(per, cluster, ["top", "bottom"], replicates, seed, by).withColumn("r", F.col("top") / F.col("bottom"))
    ci = interval(draws, "r", by)
    return point.join(ci, by) if by else point.withColumn("__j", F.lit(1)).join(ci.withColumn("__j", F.lit(1)), "__j").drop("__j")


#: Rows of one duration from which on they are summed where they lie before they are shuffled, and rows worked on at a time.
CROWD, CHUNK = 100_000, 4096


def replicate_weights(clusters: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) multiplicities of clusters (64-bit hashes), a row each: one array per cluster, whatever the row."""
    with np.errstate(over="ignore"):
        x = clusters[:, None] + (np.arange(replicates, dtype=np.uint64)[None, :] + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(np.array(POISSON_STEPS), (x >> np.uint64(11)) * 2.0 ** -53, side="right")


def bootstrap_survival(rows: DataFrame, cluster: str, thresholds: Sequence[int], replicates: int = 400, seed: int = 20260502,
                       by: Sequence[str] = ()) -> DataFrame:
    """Interval of cumulative incidence at thresholds: in every replicate the rows weigh as often as their cluster is drawn.

    Rows are dealt by ranges of their duration. Each range gives the total weight of its rows per replicate; the totals of
    later ranges are what is at risk behind it; then a range goes through its durations from the last to the first with one
    array of replicates and leaves the logarithm of what survives up to each threshold. Rows are never copied per
    replicate. Durations of very many rows are summed before they are dealt, so that they are one row a task.
    """
    by, cuts, steps = list(by), np.array(sorted(thresholds), float), replicates
    counted = rows.groupBy(*by, cluster, "duration_seconds", "observed").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("binary")
    plain = counted.select(*by, F.col("duration_seconds").cast("double").alias("t"), F.coalesce("observed", F.lit(False)).alias("seen"), "n", F.xxhash64(cluster).alias("c"), none.alias("sums"))
    crowds = plain.groupBy("t").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= CROWD).select("t")
    fields, names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema), plain.columns

    def weigh(n, c):
        return replicate_weights(np.asarray(c, np.int64).view(np.uint64), steps, seed) * np.asarray(n)[:, None]

    def combine(frames):
        held: dict[tuple, np.ndarray] = {}

        def out():
            rows = [(*key, 0, 0, total.tobytes()) for key, total in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=names)

        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at:at + CHUNK]
                for key, own in part.groupby([*by, "t", "seen"], dropna=False):
                    held[key] = held.get(key, 0) + weigh(own["n"], own["c"]).sum(axis=0)
            if len(held) > CHUNK:
                yield out()
        yield out()

    if not crowds.isEmpty():
        crowds = materialize(crowds)
        plain = plain.join(crowds, "t", "left_anti").select(plain.columns).unionByName(plain.join(crowds, "t", "left_semi").select(plain.columns).mapInPandas(combine, fields))
    dealt = materialize(plain.repartitionByRange(*by, "t").withColumn("slot", F.spark_partition_id()))

    def weighed(frame: pd.DataFrame) -> np.ndarray:
        out = np.empty((len(frame), steps))
        summed = frame["sums"].notna().to_numpy()
        out[~summed] = weigh(frame["n"][~summed], frame["c"][~summed])
        for i in np.flatnonzero(summed):
            out[i] = np.frombuffer(frame["sums"].iloc[i], np.int64)
        return out

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        sums = sum((weighed(frame.iloc[at:at + CHUNK]).sum(axis=0) for at in range(0, len(frame), CHUNK)), np.zeros(steps))
        key = frame[[*by, "slot"]].iloc[:1]
        return key.loc[key.index.repeat(steps)].assign(replicate=np.arange(steps), total=sums)

    kinds = "".join(f"{f} {dealt.schema[f].dataType.simpleString()}, " for f in by)
    totals = dealt.groupBy(*by, "slot").applyInPandas(total, f"{kinds}slot int, replicate int, total double")
    later = Window.partitionBy(*by, "replicate").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    behind = materialize(totals.select(*by, "slot", "replicate", F.coalesce(F.sum("total").over(later), F.lit(0.0)).alias("behind")))

    def survive(frame: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        risk = carry.sort_values("replicate")["behind"].to_numpy()
        frame, logs = frame.sort_values("t", ascending=False, kind="stable"), np.zeros((len(cuts) + 1, steps))
        t, at = frame["t"].to_numpy(), 0
        while at < len(t):
            end = min(at + CHUNK, len(t))
            end = int(np.searchsorted(-t, -t[end - 1], side="right"))  # all rows of a time at once
            w, seen = weighed(frame.iloc[at:end]), frame["seen"].to_numpy()[at:end]
            first = np.flatnonzero(np.r_[True, np.diff(t[at:end]) != 0])
            size, hits = np.add.reduceat(w, first), np.add.reduceat(w * seen[:, None], first)
            upto = risk + np.cumsum(size, axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                np.add.at(logs, np.searchsorted(cuts, t[at:end][first]), np.where(hits > 0, np.log1p(-hits / upto), 0.0))
            risk, at = upto[-1], end
        key = frame[by].iloc[:1]
        cells = pd.DataFrame({"k": np.repeat(np.arange(len(cuts)), steps), "replicate": np.tile(np.arange(steps), len(cuts)), "x": logs[:-1].ravel()})
        return cells.assign(**{f: key[f].iloc[0] for f in by})[[*by, "k", "replicate", "x"]]

    parts = dealt.groupBy(*by, "slot").cogroup(behind.groupBy(*by, "slot")).applyInPandas(survive, f"{kinds}k int, replicate int, x double")
    sums = parts.groupBy(*by, "k", "replicate").agg(F.sum("x").alias("x"))
    run = Window.partitionBy(*by, "replicate").orderBy("k")  # as many rows as thresholds
    draws = sums.withColumn("cdf", 1 - F.exp(F.sum("x").over(run)))
    named = F.element_at(F.array(*[F.lit(x) for x in sorted(thresholds)]), F.col("k") + 1)
    return interval(draws.withColumn("threshold_seconds", named), "cdf", [*by, "threshold_seconds"])


def bootstrap_difference(hist: DataFrame, sim: DataFrame, cluster: str, stratum: str, replicates: int = 400, seed: int = 20260502,
                         total: str = "events", days: str = "eventful_days", support: int = 30) -> DataFrame:
    """Difference of the stratum-weighted mean and of the ratio (mean events per mean eventful day),
    whole clusters resampled within strata, weights fixed by the second population; with verdict."""
    weights = stratum_weights(sim, stratum)
    # a stratum that is weighed must have enough clusters in both populations; a few rows, one per stratum
    held = weights.select(stratum)
    for df in (hist, sim):
        held = held.join(df.groupBy(stratum).agg(F.countDistinct(cluster).alias("n")), stratum, "left").filter(F.coalesce("n", F.lit(0)) >= support).drop("n")
    thin = [str(r[0]) for r in weights.select(stratum).join(held, stratum, "left_anti").collect()]
    if thin:
        raise ValueError(f"fewer than {support} clusters in stratum {', '.join(sorted(thin))}")

    def curve(df, name, s):
        sums = replicate_sums(df.select(cluster, stratum, total, days), cluster, [total, days], replicates, s, [stratum])
        point = df.groupBy(stratum).agg(F.sum(total).alias(total), F.sum(days).alias(days), F.count(F.lit(1)).alias("clusters")).withColumn("replicate", F.lit(-1))
        both = sums.unionByName(point.select(*sums.columns)).join(weights, stratum)
        m = both.groupBy("replicate").agg(F.sum(F.col("weight") * F.col(total) / F.col("clusters")).alias("m"), F.sum(F.col("weight") * F.col(days) / F.col("clusters")).alias("d"))
        return m.select("replicate", F.col("m").alias(f"{name}_mean"), (F.col("m") / F.col("d")).alias(f"{name}_ratio"))

    both = curve(hist, "h", seed).join(curve(sim, "s", seed + 1), "replicate")
    long = both.select("replicate", F.inline(F.array(
        F.struct(F.lit("mean_sequence_length").alias("metric"), F.col("h_mean").alias("historical"), F.col("s_mean").alias("simulated")),
        F.struct(F.lit("events_per_eventful_day").alias("metric"), F.col("h_ratio").alias("historical"), F.col("s_ratio").alias("simulated")))))
    long = long.withColumn("difference", F.col("simulated") - F.col("historical"))
    out = long.filter("replicate = -1").drop("replicate").join(interval(long.filter("replicate >= 0"), "difference", ["metric"]), "metric")
    out = out.withColumn("margin", intensity_margin("historical"))
    return out.withColumn("status", equivalence("difference", "low", "high", "margin"))


def matched_expectation(target: DataFrame, history: DataFrame, strata: Sequence[str], active: str, unit: str, support: int = 30) -> DataFrame:
    """Expected and observed active targets over cells with enough distinct historical units, with the
    cluster-sandwich variance of the cell rates and the targets' own Bernoulli variance."""
    strata = list(strata)
    per = history.groupBy(*strata, unit).agg(F.count(F.lit(1)).alias("n"), F.sum(flag(F.col(active))).alias("a"))
    cells = per.groupBy(*strata).agg(F.sum("n").alias("opportunities"), F.count(F.lit(1)).alias("units"), (F.sum("a") / F.sum("n")).alias("rate")
                                     ).filter(F.col("units") >= support)
    aim = target.groupBy(*strata).agg(F.count(F.lit(1)).alias("m"), F.sum(flag(F.col(active))).alias("hit")).join(cells, strata)
    # A unit's influence adds up over the cells it appears in before it is squared.
    part = per.join(aim.select(*strata, "m", "rate", "opportunities"), strata)
    infl = part.groupBy(unit).agg(F.sum(F.col("m") / F.col("opportunities") * (F.col("a") - F.col("n") * F.col("rate"))).alias("i"))
    s = aim.agg(F.sum("m").alias("supported"), F.sum("hit").alias("observed_active"), F.sum(F.col("m") * F.col("rate")).alias("expected_active"),
                F.sum(F.col("m") * F.col("rate") * (1 - F.col("rate"))).alias("world_variance"))
    v = infl.agg(F.sum(F.col("i") * F.col("i"))).scalar()
    s = s.withColumn("estimation_variance", v)
    half = 1.96 * F.sqrt(F.col("estimation_variance") + F.col("world_variance"))
    return s.withColumns({"low": F.greatest(F.lit(0.0), F.col("expected_active") - half), "high": F.col("expected_active") + half,
                          "relative_deficit": 1 - F.col("observed_active") / F.col("expected_active")})


def expected_count(rates: DataFrame, targets: DataFrame, stratum: str) -> DataFrame:
    """Expected number over strata with a predictive interval. `rates`: stratum, rate, size."""
    n = targets.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).join(rates, stratum)
    p = F.col("rate") * (1 - F.col("rate"))
    s = n.agg(F.sum(F.col("n") * F.col("rate")).alias("expected"), F.sum((F.col("n") + F.col("n") * F.col("n") / F.col("size")) * p).alias("variance"))
    return s.withColumns({"low": F.col("expected") - 1.96 * F.sqrt("variance"), "high": F.col("expected") + 1.96 * F.sqrt("variance")})


def latency_error(reference: DataFrame, candidate: DataFrame, baseline: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Relative quantile error of a candidate and a baseline against a reference population."""
    items = lambda df, tag: quantiles(df, value, probs).select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("quantile"), F.col(k).alias(tag)) for k in probs])))
    rows = items(reference, "reference").join(items(candidate, "candidate"), "quantile").join(items(baseline, "baseline"), "quantile")
    err = lambda x: F.abs(F.col(x) - F.col("reference")) / F.col("reference")
    return rows.withColumns({"relative_error": err("candidate"), "baseline_error": err("baseline"), "improves": err("candidate") <= err("baseline")})

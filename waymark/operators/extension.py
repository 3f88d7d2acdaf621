"""Caller-supplied policies and encoders, run in Arrow batches and checked on the way out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import action_violation
from ..spec import THEME

ACTION_DDL = "campaign_sent boolean, channel_id string, theme string, time_bucket string"


def apply_policy(states: DataFrame, policy: Column | Callable[[pd.DataFrame], pd.DataFrame], terminal: str, before_expiry: str) -> DataFrame:
    """Action columns from a struct Column or from a batch callable, validated and masked.

    The callable gets a frame of states and returns the four action columns in the same row order.
    """
    if isinstance(policy, Column):
        rows = states.withColumn("__a", policy).select(*states.columns, "__a.*")
    else:
        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield pd.concat([pdf.reset_index(drop=True), policy(pdf).reset_index(drop=True)], axis=1)

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.schema.fields)
        rows = states.mapInPandas(batches, f"{ddl}, {ACTION_DDL}")
    bad = action_violation("campaign_sent", "channel_id", "theme", "time_bucket")
    masked = F.when(F.col(terminal), "TERMINAL").when(F.col("campaign_sent") & ~F.col(before_expiry), "SEND_AFTER_EXPIRY")
    return rows.withColumns({
        "violation": F.coalesce(bad, masked), "channel_id": F.upper("channel_id"), "time_bucket": F.upper("time_bucket"),
        "theme": F.when(F.col("campaign_sent"), F.upper(F.coalesce("theme", F.lit(THEME))))})


def apply_encoder(rows: DataFrame, keys: list[str], step: Callable[[Any, pd.DataFrame], Any], merge: Callable[[Any, Any], Any],
                  vector: Callable[[Any], list[float]], width: int, order: list[str], part: str = "part") -> DataFrame:
    """Vector per key from its ordered history, width-checked.

    The encoder folds batches of one (key, part) into a state (a list of numbers, None at the start);
    states of a key are merged in time order afterwards. A long history is therefore folded by many
    tasks and only its running state is held.
    """
    cols = [*keys, part]
    typed = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def runs(it, by, fold):
        current, state = None, None
        for pdf in it:
            for key, piece in pdf.groupby(by, sort=False, dropna=False):
                if current is not None and not same(key, current):
                    yield current, state
                    state = None
                current, state = key, fold(state, piece)
        if current is not None:
            yield current, state

    def same(a, b):
        return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))

    def fold_parts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, state in runs(it, cols, step):
            yield pd.DataFrame([[*key[:-1], None if pd.isna(key[-1]) else int(key[-1]), [float(x) for x in state]]], columns=[*cols, "state"])

    def fold_keys(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def join(state, piece):
            for s in piece["state"]:
                state = list(s) if state is None else merge(state, list(s))
            return state
        for key, state in runs(it, keys, join):
            yield pd.DataFrame([[*key, vector(state)]], columns=[*keys, "embedding"])

    parts = rows.repartition(*cols).sortWithinPartitions(*cols, *order).mapInPandas(fold_parts, f"{typed}, `{part}` bigint, state array<double>")
    out = parts.repartition(*keys).sortWithinPartitions(*cols).mapInPandas(fold_keys, f"{typed}, embedding array<float>")
    return out.withColumn("violation", F.when(F.size("embedding") != width, "WRONG_WIDTH"))

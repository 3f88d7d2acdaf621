"""Keyed stateful rules. A rule is given per application, and its state held per bucket of applications, as one key costs the
same calls whether it holds one application or thousands. State of an application is a few scalars, and for rules that
depend on event order the rows that the watermark has not passed yet, in spans of time, of which one is in memory at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..spec import LifecycleSpec

#: Keys of the state that applications are dealt to, by hash. A running stream must keep it.
BUCKETS = 512


def packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as to:
        to.write_table(rows)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class _Rule(StatefulProcessor):
    """The states of a bucket's applications are one packed value, read and written once per batch."""
    state_fields: tuple = (("x", pa.int64()),)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("s", "packed binary")

    def read(self) -> dict:
        """State of each application that has one."""
        if not self.state.exists():
            return {}
        of, *fields = (c.to_pylist() for c in unpacked(bytes(self.state.get()[0])).columns)
        return dict(zip(of, zip(*fields, strict=True), strict=True))

    def write(self, states: dict) -> None:
        if not states:
            return self.state.clear()
        columns = [list(states), *map(list, zip(*states.values(), strict=True))]
        self.state.update((packed(pa.table(columns, schema=pa.schema([("application_id", pa.string()), *self.state_fields]))),))

    def close(self) -> None:
        pass


class RejectLate(_Rule):
    """Accept a row unless it is earlier than the application's last accepted batch."""
    columns = ["source_row"]
    state_fields = (("top", pa.int64()),)
    out_ddl = "application_id string, source_row bigint, event_us bigint, accepted boolean"

    def handleInputRows(self, key, rows, timerValues):
        last = self.read()
        tops = dict(last)
        for df in rows:  # a batch's rows of one bucket come in several frames
            before = df["application_id"].map(lambda a: last[a][0] if a in last else None).astype("Int64")
            ok = ((df["event_us"] >= before) | before.isna()).fillna(False).astype(bool)
            for of, top in df[ok].groupby("application_id", dropna=False)["event_us"].max().dropna().items():
                of = None if pd.isna(of) else of
                tops[of] = (max(int(top), tops[of][0]) if of in tops else int(top),)
            yield pd.DataFrame({"application_id": df["application_id"], "source_row": df["source_row"], "event_us": df["event_us"], "accepted": ok})
        self.write(tops)


class _InEventOrder(_Rule):
    """Rows are held until the watermark passes them and then applied in event order, so a row that arrives in a later
    batch than its successor still takes its place. Rows later than the watermark are dropped by the stream.

    They are held by spans of time, in pieces as they arrived: a span is read, sorted and applied once the watermark is
    past its rows, and then forgotten, so that however many rows an application has, only those of one span meet. A bucket
    has one timer, at the first moment that has something to do."""
    label, label_type = "journey_substage", pa.string()
    out_types: dict = {}
    span_us = 86400 * 10**6

    @property
    def columns(self) -> list[str]:
        return ["source_row", self.label]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getMapState("held", "span bigint, first_us bigint, piece bigint", "packed binary")
        self.clock = handle.getValueState("clock", "pieces bigint, timer_ms bigint")
        self.row_schema = pa.schema([("application_id", pa.string()), ("event_us", pa.int64()), ("source_row", pa.int64()), (self.label, self.label_type)])

    def hold(self, rows: pa.Table, piece: int) -> int:
        """Keep rows of one span; gives the time of the first."""
        first = min(rows["event_us"].to_pylist())
        self.held.updateValue((first // self.span_us, first, piece), (packed(rows),))
        return first

    def handleInputRows(self, key, rows, timerValues):
        pieces, timer = self.clock.get() if self.clock.exists() else (0, None)
        firsts = []
        for part in rows:
            for _, own in part.groupby(part["event_us"].astype("int64") // self.span_us):
                firsts.append(self.hold(pa.Table.from_pandas(own[self.row_schema.names], schema=self.row_schema, preserve_index=False), pieces))
                pieces += 1
        due = min(firsts) // 1000 + 1
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.clock.update((pieces, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        pieces, _ = self.clock.get()
        states, keys = self.read(), sorted(tuple(k) for k in self.held.keys())
        nexts = [first for _, first, _ in keys if first >= now_us]
        for _, same in groupby([k for k in keys if k[1] < now_us], lambda k: k[0]):
            found = []
            for k in same:
                found.append(unpacked(bytes(self.held.getValue(k)[0])))
                self.held.removeKey(k)
            rows = pa.concat_tables(found).sort_by([("event_us", "ascending"), ("source_row", "ascending")])
            n = sum(us < now_us for us in rows["event_us"].to_pylist())
            if n < len(rows):
                nexts.append(self.hold(rows.slice(n), pieces))
                pieces += 1
            yield from self.frames(self.apply(states, rows.slice(0, n)))
        yield from self.frames(self.expire(states, now_us))
        nexts += [end for end in map(self.until, states.values()) if end is not None]
        timer = min(nexts) // 1000 + 1 if nexts else None
        if timer is not None:
            self.handle.registerTimer(timer)
        self.clock.update((pieces, timer))
        self.write(states)

    def apply(self, states: dict, rows: pa.Table) -> list:
        out: list = []
        for of, us, row, label in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            state = states.get(of)
            if state is not None and (end := self.until(state)) is not None and end < us:
                self.ended(of, state, out)
                state = None
            state = self.step(of, state, us, row, label, out)
            if state is not None:
                states[of] = state
            else:
                states.pop(of, None)
        return out

    def expire(self, states: dict, now_us: int) -> list:
        """End what lies before this moment: whatever is still held comes after it."""
        out: list = []
        for of, state in list(states.items()):
            if (end := self.until(state)) is not None and end < now_us:
                self.ended(of, state, out)
                del states[of]
        return out

    def frames(self, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.out_ddl.split(", ")]).astype(self.out_types)

    def until(self, state: tuple) -> int | None:
        """Last microsecond at which a row still counts for this state; None if it has no end."""
        return None

    def ended(self, of, state: tuple, out: list) -> None:
        """What a state gives that no row has ended."""

    def step(self, of, state: tuple | None, us: int, row: int, label, out: list) -> tuple | None:
        """The application's state after a row."""
        raise NotImplementedError


class LifecycleMonitor(_InEventOrder):
    """TERMINAL at the first terminal up to and including the deadline, else EXPIRED once the watermark is past it. Rows
    are applied before the deadline is judged, so a terminal at the deadline wins."""
    state_fields = (("deadline_us", pa.int64()), ("closed", pa.bool_()))
    out_ddl = "application_id string, outcome string, at_us bigint"

    def __init__(self, creation: str, terminal: str, validity_us: int):
        self.creation, self.terminal, self.validity_us = creation, terminal, validity_us

    def until(self, state):
        return state[0]

    def ended(self, of, state, out):
        if not state[1]:
            out.append((of, "EXPIRED", state[0]))

    def step(self, of, state, us, row, label, out):
        if label == self.creation and state is None:
            return us + self.validity_us, False
        if label == self.terminal and state is not None and not state[1]:
            out.append((of, "TERMINAL", us))
            return state[0], True
        return state


class CompetingSend(_InEventOrder):
    """First response of a send before the next send and within the horizon."""
    state_fields = (("send_row", pa.int64()), ("send_us", pa.int64()))
    out_ddl = "application_id string, send_row bigint, status string, response string, delay_us bigint"
    out_types = {"delay_us": "Int64"}

    def __init__(self, horizon_us: int):
        self.horizon_us = horizon_us

    def until(self, state):
        return state[1] + self.horizon_us

    def ended(self, of, state, out):
        out.append((of, state[0], "NO_RESPONSE", None, None))

    def step(self, of, state, us, row, label, out):
        if label == "campaign_sent":
            if state is not None:
                out.append((of, state[0], "CENSORED_BY_COMPETING_SEND", None, None))
            return row, us
        if state is not None:
            out.append((of, state[0], "RESPONDED", label, us - state[1]))
        return None


class RunningFeatures(_InEventOrder):
    """Regime, depth and eligibility of packets in event order."""
    label, label_type = "labels", pa.list_(pa.string())
    state_fields = (("down", pa.bool_()), ("depth", pa.int64()), ("details", pa.bool_()), ("approved", pa.bool_()))
    out_ddl = "application_id string, event_us bigint, regime string, prior_depth bigint, ptp_eligible boolean"

    def __init__(self, focus, downstream, prerequisites, approval):
        self.focus, self.downstream, self.prerequisites, self.approval = set(focus), set(downstream), set(prerequisites), approval

    def step(self, of, state, us, row, labels, out):
        down, depth, details, approved = state or (False, 0, False, False)
        kind = "UNCONDITIONED" if labels[-1] not in self.focus else "REVISIT" if down else "FIRST_PASS"
        down = down or bool(self.downstream & set(labels))
        depth += len(labels)
        details = details or bool(self.prerequisites & set(labels))
        approved = approved or self.approval in labels
        out.append((of, us, kind, depth, details and approved))
        return down, depth, details, approved


def keyed_rule(stream: DataFrame, rule: _Rule, timers: bool = False) -> DataFrame:
    """Apply a rule per application. With timers the stream must have a watermark."""
    rows = stream.select(F.pmod(F.xxhash64("application_id"), F.lit(BUCKETS)).alias("bucket"), "application_id", "event_time", "event_us", *rule.columns)
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=rule, outputStructType=rule.out_ddl, outputMode="append", timeMode="EventTime" if timers else "None")


def lifecycle_monitor(stream: DataFrame, spec: LifecycleSpec) -> DataFrame:
    return keyed_rule(stream, LifecycleMonitor(spec.creation, spec.terminal, spec.validity_seconds * 10**6), timers=True)


def running_features(stream: DataFrame, spec: LifecycleSpec) -> DataFrame:
    return keyed_rule(stream, RunningFeatures(spec.focus, spec.downstream, spec.prerequisites, spec.approval), timers=True)

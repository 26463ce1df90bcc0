"""Captures by timers in state: each fires when the watermark passes its moment, whether or not a poll comes then."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from priorline.streaming.capture import TIMERS

FIRED = "timer string, starts long, fired_at long, poll_id long"
_MINUTE = 60_000


class CaptureTimers(StatefulProcessor):
    """State of a group of events, often one alone: when each starts and its polls since its last timer. A poll that moves an
    event moves its timers; one that withdraws it (starts null) takes them away. A timer captures the last poll that was
    there at its moment; one without such a poll captures nothing. When an event starts its state goes. A moment is one timer
    of the group, however many of its events are due then. ``event`` names the columns that tell the group's events apart."""

    group: list[str]
    event: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("group", "held binary")

    def _held(self) -> pd.DataFrame:
        """A row for each poll, in order of time."""
        if self._state.exists():
            return pa.ipc.open_stream(self._state.get()[0]).read_pandas()
        return pd.DataFrame(columns=[*self.event, "poll_id", "polled", "starts"])

    def _hold(self, polls: pd.DataFrame) -> None:
        if polls.empty:
            self._state.clear()
            return
        table, sink = pa.Table.from_pandas(polls, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self._state.update((sink.getvalue().to_pybytes(),))

    def _last(self, polls: pd.DataFrame) -> pd.DataFrame:
        """The last poll of each event."""
        return polls[~polls.duplicated(self.event, keep="last")] if self.event else polls.tail(1)

    @staticmethod
    def _moments(polls: pd.DataFrame) -> set[int]:
        return {int(s) - minutes * _MINUTE for s in polls.starts.unique() for minutes in (*TIMERS.values(), 0)}

    def _out(self, found: list[pd.DataFrame]) -> pd.DataFrame:
        names = [*self.group, *self.event, *[x.split()[0] for x in FIRED.split(", ")]]
        return pd.concat(found)[names] if found else pd.DataFrame(columns=names)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, now = self._held(), timerValues.getCurrentWatermarkInMs()
        before = self._moments(held)
        come = pd.concat(list(rows)).sort_values(["polled", "poll_id"])[held.columns]
        told = self._last(come)[[*self.event, "starts"]]
        polls = pd.concat([held, come]) if len(held) else come
        if self.event:
            polls = polls.merge(told.rename(columns={"starts": "_new"}).assign(_told=True), "left", on=self.event)
            polls["starts"] = polls["_new"].where(polls["_told"].notna(), polls["starts"])
        else:
            polls = polls.assign(starts=told.starts.iloc[0])
        polls = polls[(polls.starts > now).fillna(False).astype(bool)][held.columns].astype({"poll_id": "int64", "polled": "int64", "starts": "int64"})
        after = self._moments(polls)
        for moment in before - after:
            self._handle.deleteTimer(moment)
        for moment in after - before:
            if moment > now:
                self._handle.registerTimer(moment)
        self._hold(polls.sort_values(["polled", "poll_id"]))
        yield self._out([])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        moment, polls, out = expiredTimerInfo.getExpiryTimeInMs(), self._held(), []
        polls = polls[polls.starts > moment]
        for name, minutes in TIMERS.items():
            due = polls.starts - minutes * _MINUTE == moment
            known = due & (polls.polled <= moment)
            last = self._last(polls[known])
            out.append(last.assign(timer=name, fired_at=moment, **dict(zip(self.group, key, strict=True))))
            polls = polls[~known | polls.index.isin(last.index)]
        self._hold(polls)
        yield self._out([x for x in out if len(x)])

    def close(self) -> None:
        """Nothing is held outside the state."""


def timed_captures(polls: DataFrame, by: dict[str, str], late: str = "10 minutes", shared: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """polls (the columns of ``by`` with their types, poll_id, ts, polled and starts in milliseconds, starts null once
    withdrawn) to one row for each timer that fired. The session needs RocksDB as its state store. Each event has a state
    and timers of its own, which cost some 30 ms an event; where many start together, name in ``shared`` those columns of
    ``by`` that they have in common: events equal in them are then held as ``buckets`` groups, dealt by the other columns."""
    group = list(by) if shared is None else shared
    event = [c for c in by if c not in group]
    bucket = F.pmod(F.xxhash64(*event), F.lit(buckets)).cast("int") if event else F.lit(0)
    # What tells events apart goes through the state as strings, which keep nulls and long numbers as they are.
    marked = polls.withWatermark("ts", late).select(*group, bucket.alias("_bucket"), *[F.col(c).cast("string").alias(c) for c in event], "poll_id", "ts", "polled", "starts")
    kinds = [*[f"{c} {by[c]}" for c in group], "_bucket int", *[f"{c} string" for c in event], FIRED]
    processor = type("CaptureTimers", (CaptureTimers,), {"group": [*group, "_bucket"], "event": event})()
    fired = marked.groupBy(*group, "_bucket").transformWithStateInPandas(processor, ", ".join(kinds), "Append", "EventTime")
    return fired.select(*[F.col(c).cast(kind).alias(c) for c, kind in by.items()], *[x.split()[0] for x in FIRED.split(", ")])

"""Captures that fall due before an event: one for each timer, in a window around it, never after the event."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TIMERS = {"T-6h": 360, "T-60": 60, "T-15": 15}
#: A poll so near a timer captures for it.
WINDOW_MINUTES = 2
#: Captures of events that began so long ago are forgotten.
FORGET_DAYS = 2
DUE = "key long, timer string, starts long, captured_at long, poll_id long"
_MINUTE, _DAY = 60_000_000, 86_400_000_000


def _due(window: int, key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = {tuple(x) for x in json.loads(state.get[0])} if state.exists else set()
    polls = pd.concat(list(batches)).sort_values(["polled", "poll_id"])
    out = []
    for poll_id, polled, starts in zip(polls.poll_id, polls.polled, polls.starts, strict=True):
        if pd.isna(starts) or polled > starts:  # withdrawn, or over
            continue
        for name, minutes in TIMERS.items():
            if abs(polled - (starts - minutes * _MINUTE)) <= window * _MINUTE and (name, int(starts)) not in seen:
                seen.add((name, int(starts)))
                out.append((int(key[0]), name, int(starts), int(polled), int(poll_id)))
    latest = int(polls.polled.max())
    state.update((json.dumps(sorted(x for x in seen if x[1] > latest - FORGET_DAYS * _DAY)),))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in DUE.split(", ")])


def due_captures(polls: DataFrame, window_minutes: int = WINDOW_MINUTES) -> DataFrame:
    """polls (key, poll_id, polled, starts in microseconds, null once withdrawn; each poll may move the event)
    to the captures that fell due, each timer of an event once, from state kept between micro-batches."""
    return polls.groupBy("key").applyInPandasWithState(partial(_due, window_minutes), DUE, "seen string", "append", GroupStateTimeout.NoTimeout)

"""Stage machine per analysis as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATE_DDL = "stage string, status string, source_hash string, last_event long"
EVENT_DDL = "kind string, stage string, decision string, source_hash string"
OUTPUT_DDL = "analysis_id string, event_id long, stage string, status string, source_hash string, note string"

NEXT_STAGE = {"triage": "analyze", "analyze": "evaluate", "evaluate": "completed"}


class Event(NamedTuple):
    """What an event says; its number is its key."""

    kind: str
    stage: str | None
    decision: str | None
    source_hash: str | None


def apply_event(state: tuple, event) -> tuple[tuple, str]:
    """One transition.  ``state``: stage, status, source hash.

    Events: ``capture`` (new text), ``result`` (a stage finished), ``error``,
    ``pause`` (the window closed) and ``retry``.
    """
    stage, status, source_hash = state
    if event.kind == "capture":
        if source_hash is None:
            return (stage, status, event.source_hash), "created"
        if event.source_hash == source_hash:
            return state, "same text"
        if status in ("pending", "running"):
            return ("triage", "pending", event.source_hash), "restarted"
        return (stage, status, event.source_hash), "text changed"
    if event.kind == "retry":
        return (("triage", "pending", source_hash), "retried") if status == "failed" else (state, "ignored")
    if status in ("completed", "failed"):
        return state, "ignored"
    if event.kind == "pause":
        return (stage, "pending", source_hash), "paused"
    if event.source_hash != source_hash:
        return state, "stale result"
    if event.kind == "error":
        return (stage, "failed", source_hash), "failed"
    if event.stage != stage:
        return state, "out of order"
    if stage == "triage" and event.decision == "ignore":
        following = "completed"
    else:
        following = NEXT_STAGE[stage]
    return (following, "completed" if following == "completed" else "running", source_hash), "advanced"


class StageMachine(StatefulProcessor):
    """Keeps stage, status and source hash of one analysis, and the events that came before their predecessors.

    Events are applied in the order of their numbers. One whose predecessor is missing
    waits in the state store, not in memory, until that comes.
    """

    def __init__(self, first: int, skip_gaps: bool) -> None:
        self.first, self.skip_gaps = first, skip_gaps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stage", STATE_DDL)
        self.waiting = handle.getMapState("waiting", "event_id long", EVENT_DDL)

    def _load(self) -> tuple[tuple, int]:
        stage, status, source_hash, seen = self.state.get() if self.state.exists() else ("triage", "pending", None, self.first - 1)
        return (stage, status, source_hash), seen

    def _drain(self, key, state: tuple, seen: int, out: list) -> tuple[tuple, int]:
        """Apply what waits for nothing any more."""
        while self.waiting.containsKey((seen + 1,)):
            event = Event(*self.waiting.getValue((seen + 1,)))
            self.waiting.removeKey((seen + 1,))
            state, note = apply_event(state, event)
            seen += 1
            out.append((key[0], seen, *state, note))
        return state, seen

    def _skip(self, key, state: tuple, seen: int) -> Iterator[tuple[tuple, int, list]]:
        """Go on over the gaps, from the smallest number that waits."""
        while self.waiting.exists():
            out: list = []
            state, seen = self._drain(key, state, min(k[0] for k in self.waiting.keys()) - 1, out)
            yield state, seen, out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, seen = self._load()
        held = self.waiting.exists()
        for frame in rows:  # one frame at a time, however many events an analysis has
            out: list = []
            for event in frame.sort_values("event_id").itertuples(index=False):
                number = int(event.event_id)
                if number <= seen:  # it changes nothing any more but is not hidden
                    out.append((key[0], number, *state, "late"))
                elif number > seen + 1:
                    self.waiting.updateValue((number,), (event.kind, event.stage, event.decision, event.source_hash))
                    held = True
                else:
                    state, note = apply_event(state, event)
                    seen = number
                    out.append((key[0], seen, *state, note))
                    if held:
                        state, seen = self._drain(key, state, seen, out)
            yield _output(out)
        if held and self.skip_gaps:
            for state, seen, out in self._skip(key, state, seen):
                yield _output(out)
        self.state.update((*state, seen))

    def close(self) -> None:
        pass


def _output(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["analysis_id", "event_id", "stage", "status", "source_hash", "note"])


def stage_stream(events: DataFrame, first: int = 1, skip_gaps: bool = False) -> DataFrame:
    """Transitions of every analysis, in the order of its events, whatever order they come in.

    ``events``: analysis_id, event_id (from ``first`` without gaps), kind, stage, decision,
    source_hash.  An event waits until its predecessors are there.  With ``skip_gaps`` it
    waits to the end of its batch only; what comes for a gap later is noted as ``late`` and
    changes nothing, as does a replay.  The session must use the RocksDB state store.
    """
    return events.groupBy("analysis_id").transformWithStateInPandas(
        StageMachine(first, skip_gaps), outputStructType=OUTPUT_DDL, outputMode="Append", timeMode="None"
    )

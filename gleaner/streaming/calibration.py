"""Running confusion counts over a stream of feedback edits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..schemas import RECOMMENDATIONS, recommendation_rank
from ..sources.tables import complete_numbers, write_snapshot

CHANGES_DDL = "ai_recommendation string, user_recommendation string, change long"
_STATE_DDL = "first_ts long, first_id long, model string, last_ts long, last_id long, reader string"


class CellChanges(StatefulProcessor):
    """Keeps the first event's model side and the last event's reader side of one analysis.

    Gives what its cell of the matrix loses and gains: a correction takes the earlier answer back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cell", _STATE_DDL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.state.get()) if self.state.exists() else None
        now = before
        for frame in rows:  # one frame at a time: a busy analysis needs no more memory
            for ts, number, model, reader in zip(frame["ts"], frame["event_id"], frame["ai_recommendation"], frame["preferred_recommendation"], strict=True):
                at = (int(ts), int(number))
                first = (*at, model) if now is None or at < now[:2] else now[:3]
                last = (*at, reader) if now is None or at >= now[3:5] else now[3:]
                now = (*first, *last)
        if now is not None:
            self.state.update(now)
        old, new = _cell(before), _cell(now)
        out = [] if old == new else [(*cell, change) for cell, change in ((old, -1), (new, 1)) if cell]
        yield pd.DataFrame(out, columns=["ai_recommendation", "user_recommendation", "change"])

    def close(self) -> None:
        pass


def _cell(state: tuple | None) -> tuple[str, str] | None:
    if state is None or state[2] not in RECOMMENDATIONS or state[5] not in RECOMMENDATIONS:
        return None
    return state[2], state[5]


def cell_changes(events: DataFrame) -> DataFrame:
    """Changes (-1, +1) of matrix cells. The session must use the RocksDB state store."""
    lowest = F.lit(-(1 << 62))
    keyed = events.select(
        "analysis_id", F.coalesce(F.unix_micros("ts"), lowest).alias("ts"), F.coalesce(F.col("event_id").cast("long"), lowest).alias("event_id"),
        "ai_recommendation", "preferred_recommendation",
    )
    return keyed.groupBy("analysis_id").transformWithStateInPandas(
        CellChanges(), outputStructType=CHANGES_DDL, outputMode="Append", timeMode="None"
    )


def calibration_stream(spark: SparkSession, events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Confusion counts after every batch, one version each.

    A batch reads its own changes and the sixteen cells of the version before; the
    analyses stay in the state store. A batch that runs again starts from the same version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        cells = batch.select("ai_recommendation", "user_recommendation", F.col("change").alias("count"))
        newest = max((v for v in complete_numbers(spark, out) if v <= batch_id), default=None)
        if newest is not None:
            cells = cells.unionByName(spark.read.parquet(f"{out}/version={newest:012d}"))
        summed = cells.groupBy("ai_recommendation", "user_recommendation").agg(F.sum("count").alias("count")).filter("count <> 0")
        ordered = summed.orderBy(recommendation_rank(F.col("ai_recommendation")), recommendation_rank(F.col("user_recommendation")))
        write_snapshot(ordered.coalesce(1), out, batch_id + 1)

    return cell_changes(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

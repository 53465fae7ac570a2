"""Keyed streaming state: reference slots of coded streams, updated record by record."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SLOTS = 8
STATE = "slots array<long>, last long"
OUT = "stream_id string, frame long, shown long, slots array<long>"


def step(slots: list[int], frame: int, mask: int, show: int) -> tuple[list[int], int]:
    """Slots after a frame, and what is shown: the frame (show -1), or the slot ``show`` (which then refreshes by the mask)."""
    shown = frame if show < 0 else slots[show]
    return [shown if mask >> i & 1 else s for i, s in enumerate(slots)], shown


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    slots, last = state.get if state.exists else ([-1] * SLOTS, -1)
    slots, out = list(slots), []
    rows = pd.concat(list(frames)).sort_values("frame")
    for frame, mask, show in zip(rows["frame"].tolist(), rows["mask"].tolist(), rows["show"].tolist(), strict=True):
        if frame <= last:
            continue
        slots, shown = step(slots, frame, mask, show)
        last = frame
        out.append((key[0], frame, shown, slots))
    state.update((slots, last))
    yield pd.DataFrame(out, columns=["stream_id", "frame", "shown", "slots"])


def decode_order(frames: DataFrame) -> DataFrame:
    """A streaming frame table (stream_id, frame, mask, show) to OUT rows; frames at or before the last one are repeats and are left out."""
    return frames.groupBy("stream_id").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def decode_batch(frames: DataFrame) -> DataFrame:
    """The same over a finished table: one ordered group a stream."""

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        slots, out = [-1] * SLOTS, []
        rows = rows.sort_values("frame").drop_duplicates("frame")
        for frame, mask, show in zip(rows["frame"].tolist(), rows["mask"].tolist(), rows["show"].tolist(), strict=True):
            slots, shown = step(slots, frame, mask, show)
            out.append((key[0], frame, shown, slots))
        return pd.DataFrame(out, columns=["stream_id", "frame", "shown", "slots"])

    return frames.groupBy("stream_id").applyInPandas(whole, OUT)

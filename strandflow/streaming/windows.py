"""Series as streams: event-time windows, and rolling statistics held as state per run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_means(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(event_type, start, v, n) per event-time window; rows later than `late` are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return out.select("event_type", F.col("window.start").alias("start"), "v", "n")


def rolling_z(stream: DataFrame, reach: int = 50) -> DataFrame:
    """(run_id, frame, z) of frames as they come, against the last `reach` frames of their run; state is those frames.

    Frames must come in order within a run; a frame at or before the last one seen is late and left out.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (-1, [])
        held, out = list(held), []
        for f in frames:
            for frame, v in sorted(zip(f["frame"].tolist(), f["v"].tolist(), strict=True)):
                if frame <= last:
                    continue
                if held:
                    m = sum(held) / len(held)
                    sd = (sum((x - m) ** 2 for x in held) / len(held)) ** 0.5
                    out.append((key[0], frame, abs(v - m) / sd if sd > 1e-10 else 0.0))
                else:
                    out.append((key[0], frame, 0.0))
                held, last = [*held, v][-reach:], frame
        state.update((last, held))
        yield pd.DataFrame(out, columns=["run_id", "frame", "z"])

    return stream.groupBy("run_id").applyInPandasWithState(run, "run_id string, frame int, z double", "last int, held array<double>", "append", GroupStateTimeout.NoTimeout)

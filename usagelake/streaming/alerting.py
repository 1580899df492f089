"""Threshold and trajectory alerts over a stream of gauge readings, with state for each window.

A threshold fires once for a window, the highest that is crossed alone; a
trajectory fires below the first threshold, once, if the window is projected to
fill before its reset.  A window that is not read for `forget` is forgotten; a
stream with such a timeout runs on, so leave it out where the stream is to end
with its input.  Readings without a percentage change nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.budget import DEFAULT_THRESHOLDS, TRAJECTORY, text_of, thresholds


def threshold_alerts(readings: DataFrame, given=DEFAULT_THRESHOLDS, projection: bool = True, forget: str | None = None) -> DataFrame:
    """readings (key, percent, seq; before_reset, if trajectories are known) -> (key, seq, threshold)."""
    steps = thresholds(given)
    hold_ms = int(pd.Timedelta(forget).total_seconds() * 1000) if forget else None
    if "before_reset" not in readings.columns:
        readings = readings.withColumn("before_reset", F.lit(False))

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        fired = set(state.get[0].split(",")) - {""} if state.exists else set()
        rows = pd.concat(list(batches)).sort_values("seq").dropna(subset=["percent"])
        out = []
        for percent, seq, early in zip(rows["percent"], rows["seq"], rows["before_reset"].fillna(False).astype(bool), strict=True):
            if projection and early and percent < steps[0] and TRAJECTORY not in fired:
                out.append((key[0], seq, TRAJECTORY))
                fired.add(TRAJECTORY)
            due = [text_of(t) for t in steps if percent >= t and text_of(t) not in fired]
            if due:
                out.append((key[0], seq, due[-1]))
                fired.update(due)
        state.update((",".join(sorted(fired)),))
        if hold_ms:
            state.setTimeoutDuration(hold_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "threshold"])

    slim = readings.select("key", "percent", "seq", "before_reset")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if hold_ms else GroupStateTimeout.NoTimeout
    return slim.groupBy("key").applyInPandasWithState(update, "key string, seq long, threshold string", "fired string", "append", timeout)

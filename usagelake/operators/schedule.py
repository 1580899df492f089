"""When a live source may be asked again: cadence, backoff and the server's own word, as a walk over its ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .scan import walked

# Fixed values.
INTERVAL_MS, REFUSED_MS, PASSING_MS, LONGEST_MS = 15 * 60_000, 10 * 60_000, 45_000, 60 * 60_000
TOO_MANY = 429
# End of fixed values.


class Poll:
    """What is known of a source: when it last answered, until when it is left alone, failures in a row."""

    def __init__(self, interval: int = INTERVAL_MS):
        self.interval, self.fetched_at, self.left_until, self.failures = interval, 0, 0, 0

    def tick(self, at: int, forced: bool | None, status: int | None, retry_after_s: int | None) -> tuple:
        """(called, failures, next_at, reason) after a tick; status: what the source answers if it is asked, null if it can't be reached.

        Asking by force passes over the cadence, never over a backoff.
        """
        waits = self.left_until > at
        paced = self.fetched_at != 0 and at - self.fetched_at < self.interval and not forced
        called = not waits and not paced
        if called and status == 200:
            self.fetched_at, self.left_until, self.failures = at, 0, 0
        elif called:
            self.failures += 1
            base = REFUSED_MS if status == TOO_MANY else PASSING_MS
            told = status is not None and retry_after_s is not None and retry_after_s > 0
            self.left_until = at + (retry_after_s * 1000 if told else min(base << min(self.failures - 1, 20), LONGEST_MS))
        next_at = max(self.left_until, self.fetched_at + self.interval if self.fetched_at else 0)
        return called, self.failures, next_at, "backoff" if self.left_until > at else "cadence" if next_at > at else None


def schedule(ticks: DataFrame, interval: int = INTERVAL_MS) -> DataFrame:
    """ticks (source, seq, at_ms, forced, status, retry_after_s) with called, failures, next_at and reason, in the order of at_ms and seq of each source."""
    return walked(
        ticks, "source", ["at_ms", "seq"], lambda: Poll(interval), Poll.tick, ["at_ms", "forced", "status", "retry_after_s"],
        "called boolean, failures long, next_at long, reason string",
    )

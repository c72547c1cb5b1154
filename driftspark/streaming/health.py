"""Whether frames keep coming: metrics that a running stream gives of itself, heard by a listener."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Name under which a stream observes its frames.
FRAMES = "frames"


def watched(frames: DataFrame, name: str = FRAMES) -> DataFrame:
    """The stream, which tells with each batch how many frames it had, and the time of the newest. Nothing is shuffled for it."""
    return frames.observe(name, F.count(F.lit(1)).alias("n"), F.max("t").alias("newest_t"))


class Freshness(StreamingQueryListener):
    """``spark.streams.addListener(Freshness())``; then ``status(now)`` at any time. A stream that gives no more progress, as one that has stalled
    or ended, grows stale like one without frames. clock: seconds, for tests."""

    def __init__(self, limit_s: float = 120.0, name: str = FRAMES, clock=time.time):
        self.limit_s, self.name, self.clock = limit_s, name, clock
        self.frames, self.newest_t, self.heard, self.failed = 0, None, None, None

    def onQueryStarted(self, event) -> None:
        self.failed = None

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None or not row["n"]:
            return  # another stream's progress, or a batch without frames
        self.frames += row["n"]
        self.newest_t = max(row["newest_t"], self.newest_t if self.newest_t is not None else row["newest_t"])
        self.heard = self.clock()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failed = event.exception

    def status(self, now: float | None = None) -> dict:
        """age_s of the newest frame by its own time, silent_s since a batch brought frames; fresh if neither is over the limit."""
        now = self.clock() if now is None else now
        age, silent = (None if x is None else now - x for x in (self.newest_t, self.heard))
        fresh = age is not None and max(age, silent) <= self.limit_s and self.failed is None
        return {"frames": self.frames, "age_s": age, "silent_s": silent, "fresh": fresh, "failed": self.failed}

"""Continuous passes: Structured Streaming over a change feed, with the batch functions in each micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.errors import BreakerOpen
from recordloom.operators import delta
from recordloom.state.shared import materialise


@dataclass
class Breaker:
    """Closed, open or half open by the last results; times are milliseconds given by the caller."""

    trip: float = 0.5
    least: int = 3
    ring: int = 20
    reset_ms: int = 10_000
    results: list[bool] = field(default_factory=list)
    opened: int | None = None

    def state(self, now: int) -> str:
        if self.opened is None:
            return "CLOSED"
        return "HALF_OPEN" if now - self.opened >= self.reset_ms else "OPEN"

    def record(self, ok: bool, now: int) -> str:
        at = self.state(now)
        if at == "HALF_OPEN":
            self.opened, self.results = (None, []) if ok else (now, self.results)
        elif at == "CLOSED":
            self.results = [*self.results, ok][-self.ring :]
            if len(self.results) >= self.least and self.results.count(False) / len(self.results) >= self.trip:
                self.opened = now
        return self.state(now)


    @classmethod
    def restored(cls, log: DataFrame, order: list[str], ok: str, at: str, **limits) -> Breaker:
        """A breaker as the last results of a log leave it: at most ten rings of rows come to the driver."""
        out = cls(**limits)
        last = log.orderBy(*(F.desc(c) for c in order)).limit(10 * out.ring).select(ok, at).collect()
        for r in reversed(last):
            out.record(bool(r[ok]), r[at])
        return out


def latest_changes(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of every key in a micro-batch."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")


def run(stream: DataFrame, read_state: Callable[[], DataFrame], commit: Callable[[int, DataFrame, DataFrame], None], key: str, fields: list[str], order: list[str], checkpoint: str, breaker: Breaker | None = None, now: Callable[[], int] = lambda: int(time.time() * 1000), **trigger) -> StreamingQuery:
    """Classify each micro-batch against the state and commit ``(batch id, delta, next state)``.

    A batch that comes again after a failure is classified against the state that its first commit left, so it
    yields only skips.  Late rows are not dropped by a watermark: ``order`` decides, as a stored row keeps its order
    columns and an older change is left out.  An open breaker stops the query before a batch is begun, and a commit that fails
    counts against it; the batch comes again when the query is started anew.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if breaker is not None and breaker.state(now()) == "OPEN":
            raise BreakerOpen("too many failures")
        state = read_state()
        new = latest_changes(batch, key, order)
        known = state.select(key, F.struct(*order).alias("_old"))
        new = new.join(known, key, "left").where(F.col("_old").isNull() | (F.struct(*order) >= F.col("_old"))).drop("_old")
        new = materialise(new.select(*state.columns), "batch")
        acts = delta.classify(new, state, key, fields)
        try:
            commit(batch_id, acts, delta.upsert(state, new, [key]))
        except Exception:
            if breaker is not None:
                breaker.record(False, now())
            raise
        if breaker is not None:
            breaker.record(True, now())

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

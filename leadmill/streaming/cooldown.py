"""The exact rolling cooldown over a stream: what leadmill.operators.cooldown finds on the whole log, as the log comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Cooldown(StatefulProcessor):
    """Of one recipient: the time of the last send that passed, and the sends that the watermark has not reached.

    A send is decided when the watermark reaches it, since then none before it can come any more; those that came late, but within the
    delay, are thus decided in the order of their times (ties: of their ids). The last passed time is forgotten once the watermark has
    passed the cooldown after it, so a recipient at rest has no state."""

    def __init__(self, gap_us: int) -> None:
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getListState("waiting", "at long, id long")

    def wake(self, at_us: int) -> None:
        self.handle.registerTimer(-(-at_us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for batch in rows:
            for at, id_ in zip(batch["at"], batch["id"], strict=True):
                self.waiting.appendValue((int(at), int(id_)))
                self.wake(int(at))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((int(at), int(id_)) for at, id_ in self.waiting.get())
        last = int(self.last.get()[0]) if self.last.exists() else None
        passed = []
        for at, id_ in waiting:
            if at <= now and (last is None or at - last >= self.gap):
                last = at
                passed.append((key[0], id_, at))
        rest = [w for w in waiting if w[0] > now]
        if len(rest) < len(waiting):
            self.waiting.put(rest) if rest else self.waiting.clear()
        if last is not None and last + self.gap <= now:
            self.last.clear()
        elif passed:
            self.last.update((last,))
            self.wake(last + self.gap)
        if passed:
            yield pd.DataFrame(passed, columns=["site", "id", "at"])


def cooled_down(sends: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """site, id, at (microseconds) of the sends of a stream(id, site, sent_at) that the cooldown lets through; each is given once the
    watermark, which trails the latest time by late, has reached it. What comes later than that is dropped. Sends without a site, a time or
    an id are left out. The state store must be the one on disk (spark.sql.streaming.stateStore.providerClass: RocksDB)."""
    own = sends.where("site is not null and sent_at is not null and id is not null").selectExpr("cast(site as long) as site", "cast(id as long) as id", "unix_micros(sent_at) as at", "sent_at")
    keyed = own.withWatermark("sent_at", late).groupBy("site")
    return keyed.transformWithStateInPandas(Cooldown(days * 86_400_000_000), "site long, id long, at long", "Append", "EventTime")

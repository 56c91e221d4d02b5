"""Daily load and its acute:chronic ratio of a stream of sessions, kept as state by entity.

Sessions come late, twice and corrected: a row of the same ``session_id`` with a
higher ``version`` replaces the one before. A day is final once the watermark, the
greatest time seen less ``late``, has passed its end; then its load is emitted with
the load of the 7 days up to it and the mean of the 28 before those, days without a
session as 0.

An entity's state is its open sessions, those of days that aren't final, and the
loads of its last 34 final days, whatever the stream's length. One timer an entity
waits for the end of its first open day. Sessions are kept and merged as arrays.

Defined cases: a row without an entity, an id or a time is passed over; one without a
load counts as 0; of equal versions the greater day and load stays; what belongs to a
day that is final is late and passed over, so a session can be corrected as long as
its day is open; after the last session nothing is emitted until there is another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.numbers import half_even

DAY_MS = 86_400_000
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: What is kept of an open session: its id, version, day and load.
OPEN = ("<i8", "<i8", "<i4", "<f8")
#: Rows of an entity that are merged at once.
AT_ONCE = 1 << 20


def latest(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of each session's rows the one with the greatest version, day and load."""
    ids, versions, days, loads = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((loads, days, versions, ids))
    last = order[np.append(ids[order][1:] != ids[order][:-1], True)] if len(order) else order
    return ids[last], versions[last], days[last], loads[last]


class DailyLoads(StatefulProcessor):
    """``day, load, acute, chronic`` of each day that is final; ``acute`` and ``chronic`` are null until their days are full."""

    def __init__(self, acute: int = 7, chronic: int = 28):
        self.acute, self.chronic = acute, chronic

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ids binary, versions binary, days binary, loads binary")
        self.final = handle.getValueState("final", "day int, loads array<double>")

    def _open(self) -> tuple[np.ndarray, ...]:
        """Ids, versions, days and loads of the open sessions, a session once."""
        held = self.open.get() if self.open.exists() else (b"",) * len(OPEN)
        return tuple(np.frombuffer(x, t) for x, t in zip(held, OPEN, strict=True))

    def _keep(self, sessions: tuple[np.ndarray, ...]) -> None:
        """Saves what is open and waits for the end of its first day."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not len(sessions[0]):
            self.open.clear()
            return
        self.open.update(tuple(x.tobytes() for x in sessions))
        self.handle.registerTimer((int(sessions[2].min()) + 1) * DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, size = [self._open()], 0
        last = self.final.get()[0] if self.final.exists() else None
        for frame in rows:
            new = tuple(frame[c].to_numpy(t) for c, t in zip(("session_id", "version", "day", "load"), OPEN, strict=True))
            found.append(new if last is None else tuple(x[new[2] > last] for x in new))
            size += len(new[0])
            if size > max(AT_ONCE, len(found[0][0])):  # rows sent again don't pile up
                found, size = [latest(found)], 0
        self._keep(latest(found))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions = self._open()
        until = timerValues.getCurrentWatermarkInMs() // DAY_MS - 1  # the last day that is over
        over = sessions[2] <= until
        if over.any():
            days, loads_of = sessions[2][over], sessions[3][over]
            first = int(days.min())
            totals = np.bincount(days - first, loads_of)
            before, loads = self.final.get() if self.final.exists() else (first - 1, [])
            loads, out = list(loads), []
            for day in range(before + 1, first + len(totals)):
                loads = [*loads[-(self.acute + self.chronic - 1) :], float(totals[day - first]) if day >= first else 0.0]
                near, far = loads[-self.acute :], loads[: -self.acute]
                out.append((day, loads[-1], sum(near) if len(near) == self.acute else None, sum(far) / self.chronic * self.acute if len(far) == self.chronic else None))
            self.final.update((first + len(totals) - 1, loads[-(self.acute + self.chronic - 1) :]))
            self._keep(tuple(x[~over] for x in sessions))
            yield pd.DataFrame([(*key, *x) for x in out], columns=[*self.names, "day", "load", "acute", "chronic"])

    def close(self) -> None:
        pass


def daily_acwr_stream(sessions: DataFrame, entity: list[str], value: str = "total_distance_m", late: str = "7 days", acute: int = 7, chronic: int = 28) -> DataFrame:
    """``entity, date, load, acute, chronic, acwr`` of ``sessions(entity, session_id, version, ts, value)``, append only."""
    processor = DailyLoads(acute, chronic)
    processor.names = entity
    known = sessions.filter(" and ".join(f"`{c}` is not null" for c in (*entity, "session_id", "ts")))
    rows = known.withWatermark("ts", late).select(
        *entity, "ts", F.col("session_id").cast("long").alias("session_id"), F.coalesce(F.col("version").cast("long"), F.lit(0)).alias("version"),
        F.unix_date(F.to_date("ts")).alias("day"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("load"),
    )
    schema = T.StructType([*(rows.schema[e] for e in entity), *(T.StructField(n, t) for n, t in (("day", T.IntegerType()), *((c, T.DoubleType()) for c in ("load", "acute", "chronic"))))])
    found = rows.groupBy(*entity).transformWithStateInPandas(processor, schema, "append", "eventTime")
    ratio = F.when(F.col("chronic") != 0, F.col("acute") / F.col("chronic"))
    return found.select(*entity, F.date_from_unix_date("day").alias("date"), "load", "acute", "chronic", half_even(ratio, 2).alias("acwr"))


def _append(batch: DataFrame, number: int, folder: str) -> None:
    """A batch has a folder of its own name: one that is run again replaces what it wrote."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def run_available(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Runs ``stream`` over all that its source holds now, into Parquet below ``folder``; goes on from ``checkpoint`` the next time."""
    spark = stream.sparkSession
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        query = stream.writeStream.foreachBatch(partial(_append, folder=folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        spark.conf.set(ROCKS[0], before) if before else spark.conf.unset(ROCKS[0])

"""ST-5: streaming transaction velocity.

``windowed_velocity`` — sliding event-time windows with a watermark: partial
aggregation per task, state per (merchant, window) only; scales with any key
skew.

``exact_velocity`` — per-event counts over (t-1h, t] and (t-24h, t] as a stream
of changes.  Events are counted by merchant and block of ``block_hours``: a
block's own events, the times of the block before it and of the block a day
before, and the number of events in the blocks between.  An event is sent to its
own block, to the blocks that hold it as context, and as a bare count to those
between.  A late event therefore finds its whole frames, and every count that it
changes is retracted (``change`` -1) and emitted anew (+1); ``current_counts``
adds the changes up.  Events older than the watermark are left out; a timer
drops a block once the watermark has passed its end.

(Merchant, block) pairs are hashed to ``buckets``, and a bucket is what the
processor is called for: its state is one packed table per block, and the counts
of all its merchants in a block are found at once, by searches in times sorted
by merchant.  So sparse merchants cost no call and no state entry each, and a
dense merchant's blocks lie in different buckets; with blocks of an hour no
state entry holds more of a merchant than an hour's events and two hours of
context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paylens.session import ship_package

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
OWN, BEFORE, DAY_BEFORE, BETWEEN = range(4)
CHANGES = "merchant_id string, transaction_id string, event_us long, txn_velocity_1h long, txn_velocity_24h long, change int"


def windowed_velocity(events: DataFrame, width: str = "1 hour", slide: str | None = None,
                      watermark: str = "2 hours") -> DataFrame:
    w = F.window("event_ts", width, slide) if slide else F.window("event_ts", width)
    return (events.withWatermark("event_ts", watermark)
            .groupBy("merchant_id", w.alias("window")).agg(F.count(F.lit(1)).alias("txn_count")))


#: rows of changes that are handed on together
_OUT_ROWS = 1 << 14
#: hash buckets of (merchant, block)
BUCKETS = 128
_SPAN = 4 * DAY_US
_HELD = pa.schema([("merchant", pa.string()), ("role", pa.int8()), ("us", pa.int64()), ("id", pa.string())])


def counts(own: np.ndarray, before: np.ndarray, day_before: np.ndarray, between: np.ndarray, block_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Events in (t-1h, t] and (t-24h, t] of each event of a block.

    Events are numbers, merchant * ``_SPAN`` + the time since two days before the
    block; ``own`` and the contexts are sorted, ``between`` is by merchant.
    """
    merchant = own // _SPAN
    first, end = merchant * _SPAN, (merchant + 1) * _SPAN

    def since(context: np.ndarray, width: int) -> np.ndarray:
        return np.searchsorted(context, end) - np.searchsorted(context, own - width, "right")

    upto = np.searchsorted(own, own, "right")
    hour = upto - np.searchsorted(own, own - HOUR_US, "right") + since(before, HOUR_US)
    return hour, upto - np.searchsorted(own, first) + between[merchant] + since(before if block_us == DAY_US else day_before, DAY_US)


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as out:
        out.write_table(pa.Table.from_pandas(rows, _HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(data) as read:
        return read.read_all().to_pandas()


class Velocity(StatefulProcessor):
    """Counts of a bucket's merchants by block, revised when a block's own events or its context grow.

    A block's rows: merchant, role, time and id (own events only); of role ``BETWEEN`` a number of events in place of the time.
    """

    def __init__(self, block_us: int):
        self.block_us = block_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "block long", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [p[p["event_us"] >= limit] for p in rows]
        fresh = pd.concat(parts).rename(columns={"merchant_id": "merchant", "event_us": "us", "transaction_id": "id"})
        out: list[pd.DataFrame] = []
        for block, some in fresh.groupby("block", sort=True):
            out += self._revised(int(block), some[["merchant", "role", "us", "id"]])
            if sum(map(len, out)) >= _OUT_ROWS:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    def _revised(self, block: int, fresh: pd.DataFrame) -> list[pd.DataFrame]:
        """Takes a block's new rows into its state; the changes that they make."""
        at = (block,)
        if self.held.containsKey(at):
            old = _unpacked(self.held.getValue(at)[0])
        else:
            old = fresh.iloc[:0]
            self.handle.registerTimer((block + 1) * self.block_us // 1000)
        bare = fresh["role"] == BETWEEN
        if bare.any():
            n = fresh[bare].groupby("merchant", dropna=False)["us"].size().reset_index()
            fresh = pd.concat([fresh[~bare], n.assign(role=BETWEEN, id=None)])
        both = pd.concat([old, fresh], ignore_index=True)
        code = pd.factorize(both["merchant"], use_na_sentinel=False)[0].astype(np.int64)
        role, us = both["role"].to_numpy(np.int64), both["us"].to_numpy(np.int64)
        bare, new = role == BETWEEN, np.arange(len(both)) >= len(old)
        event = code * _SPAN + us - (block * self.block_us - 2 * DAY_US)
        merchants = int(code.max()) + 1 if len(code) else 0

        def seen(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Sorted own events among some of the rows, and their counts."""
            own, before, day_before = (np.sort(event[some & (role == r)]) for r in (OWN, BEFORE, DAY_BEFORE))
            between = np.bincount(code[some & bare], us[some & bare], merchants).astype(np.int64)
            return own, *counts(own, before, day_before, between, self.block_us)

        def of(rows: np.ndarray, found: tuple) -> tuple[np.ndarray, np.ndarray]:
            place = np.searchsorted(found[0], event[rows])  # equal times of a merchant have equal counts
            return found[1][place], found[2][place]

        now, out = seen(np.ones(len(both), bool)), []
        known, added = np.flatnonzero(~new & (role == OWN)), np.flatnonzero(new & (role == OWN))
        if len(known):
            was, after = of(known, seen(~new)), of(known, now)
            moved = (was[0] != after[0]) | (was[1] != after[1])
            if moved.any():
                out += [self._changes(both, known[moved], [x[moved] for x in found], sign) for found, sign in ((was, -1), (after, 1))]
        if len(added):
            out.append(self._changes(both, added, of(added, now), 1))
        if bare.any():
            total = both[bare].groupby("merchant", dropna=False)["us"].sum().reset_index()
            both = pd.concat([both[~bare], total.assign(role=BETWEEN, id=None)])
        self.held.updateValue(at, (_packed(both),))
        return out

    @staticmethod
    def _changes(rows: pd.DataFrame, at: np.ndarray, found, change: int) -> pd.DataFrame:
        return pd.DataFrame({"merchant_id": rows["merchant"].to_numpy(object)[at], "transaction_id": rows["id"].to_numpy(object)[at],
                             "event_us": rows["us"].to_numpy(np.int64)[at], "txn_velocity_1h": found[0].astype(np.int64),
                             "txn_velocity_24h": found[1].astype(np.int64), "change": np.full(len(at), change, np.int32)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.removeKey((expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.block_us - 1,))
        return iter(())

    def close(self) -> None:
        pass


def exact_velocity(events: DataFrame, lateness_hours: int = 24, block_hours: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Changes of per-event rolling counts (stream twin of W-1 / W-2); events up to ``lateness_hours`` late are counted.

    ``events``: merchant_id, transaction_id, event_ts.  ``block_hours`` divides 24.
    Start the query within ``consumer.state_in_rocksdb``.
    """
    if 24 % block_hours:
        raise ValueError("blocks divide a day")
    ship_package(events.sparkSession)
    block_us, blocks = block_hours * HOUR_US, 24 // block_hours
    us = F.unix_micros("event_ts")
    timed = events.withWatermark("event_ts", f"{lateness_hours} hours").filter(F.col("event_ts").isNotNull()) \
        .select("merchant_id", "transaction_id", us.alias("event_us"), F.floor(us / F.lit(block_us)).cast("long").alias("_b"))
    roles = [(OWN, 0), (BEFORE, 1)] + ([(DAY_BEFORE, blocks)] if blocks > 1 else []) + [(BETWEEN, k) for k in range(1, blocks)]
    sent = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(k).cast("long").alias("ahead")) for r, k in roles]))
    spread = timed.select("*", sent.alias("_s")).select(
        "merchant_id", (F.col("_b") + F.col("_s.ahead")).alias("block"), F.col("_s.role").alias("role"), "event_us",
        F.when(F.col("_s.role") == OWN, F.col("transaction_id")).alias("transaction_id"))
    bucketed = spread.withColumn("bucket", F.pmod(F.xxhash64("merchant_id", "block"), F.lit(buckets)).cast("int"))
    changes = bucketed.groupBy("bucket").transformWithStateInPandas(Velocity(block_us), CHANGES, "Append", "EventTime")
    return changes.withColumn("event_ts", F.timestamp_micros("event_us")).drop("event_us")


def current_counts(changes: DataFrame) -> DataFrame:
    """The counts that hold after all changes, one row per event."""
    left = changes.groupBy("merchant_id", "transaction_id", "event_ts", "txn_velocity_1h", "txn_velocity_24h") \
        .agg(F.sum("change").alias("n")).filter("n > 0")
    return left.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n", "_copy")

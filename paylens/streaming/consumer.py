"""ST-1 … ST-4, ST-6, ST-7: the stream consumer as one stateful streaming query.

records (key, data) --decode (SRC-9)--> classify (P-2, ST-2) --one processor--> a tag for every record
    reject     undecodable, not an object, missing keys, bad timestamp, bad amount
    late       accepted, older than the watermark
    duplicate  accepted, its transaction id was seen before (ST-3)
    scored     the first of its transaction id
and per micro-batch the sinks
    raw        scored and duplicate records verbatim (SNK-5 layout)
    late, rejects, duplicates
    scored, alerts (R-6, score > .85), feature snapshot (ST-6)

One query has one watermark, so a record gets exactly one tag, and raw, late
and rejects together are what landed: a bad record does not abort its batch,
and one too late to be deduplicated is kept.  The newest event time is the
query's watermark, kept in its checkpoint.  The processor's state are the ids
seen, in hash buckets, by hour of their event time; a timer drops an hour once
the watermark has passed it.  Every sink write is keyed by the batch id
(``batch_id=N`` directories written in overwrite mode), so a replayed
micro-batch rewrites the same files instead of duplicating.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paylens import constants as C
from paylens.functions import risk as R
from paylens.session import ship_package
from paylens.sources.records import absent_keys, decode_base64

HOUR_US = 3_600_000_000
#: hash buckets of the seen transaction ids; each is one task's state
BUCKETS = 64

PARSED = ("transaction_id string, merchant_id string, merchant_abn string, customer_id string, "
          "amount_aud double, currency string, timestamp string, merchant_category string, state string, "
          "payment_terminal string, card_type string, is_outside_business_hours boolean, is_fraud boolean")


def record_stream(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """File-backed record source (Kafka/Kinesis stand-in): columns key, data (base64 JSON)."""
    r = spark.readStream.schema("key string, data string").format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def event_time(text: Column) -> Column:
    return text.try_cast("timestamp_ntz").cast("timestamp")


def classify(records: DataFrame) -> DataFrame:
    """ST-2: key, data, the decoded JSON ``value``, its event time, and ``reason`` (null: accepted).

    A key that is present with a null value passes; a timestamp must be
    readable, since the record cannot be placed in time without it; an amount
    that is present must be a number.
    """
    # each of these parses the text once: columns that are read more than once are not merged into their readers
    d = records.withColumn("value", decode_base64(F.col("data"))).withColumns({
        "_keys": F.json_object_keys("value"), "_amount": F.get_json_object("value", "$.amount_aud"),
        "_stamp": event_time(F.get_json_object("value", "$.timestamp"))})
    d = d.withColumn("_missing", absent_keys(F.col("_keys")))
    reason = (F.when(F.col("value").isNull(), F.lit("undecodable"))
              .when(F.col("_keys").isNull(), F.lit("not_json_object"))
              .when(F.size("_missing") > 0, F.concat(F.lit("missing:"), F.array_join("_missing", ",")))
              .when(F.col("_stamp").isNull(), F.lit("bad_timestamp"))
              .when(F.col("_amount").isNotNull() & F.col("_amount").try_cast("double").isNull(), F.lit("bad_amount")))
    return d.select("key", "data", "value", F.col("_stamp").alias("event_ts"), reason.alias("reason"))


def parse_events(accepted: DataFrame) -> DataFrame:
    """Accepted records as typed columns beside key and event_ts."""
    parsed, amount = _parsed()
    return _typed(accepted.select("key", "event_ts", parsed.alias("p"), amount.alias("_amount")))


def _parsed() -> tuple[Column, Column]:
    """The fields of ``value``, and its amount, which a text may hold too."""
    return F.from_json("value", PARSED), F.get_json_object("value", "$.amount_aud").try_cast("double")


def _typed(parsed: DataFrame) -> DataFrame:
    return parsed.select("key", "p.*", "event_ts", "_amount").withColumn("amount_aud", F.col("_amount")).drop("_amount")


class Tagger(StatefulProcessor):
    """Tags the records of one hash bucket of transaction ids; state: hour of the event time -> ids seen in it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "hour long", "ids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        held = {hour: list(ids) for (hour,), (ids,) in self.seen.iterator()}
        known = {i for ids in held.values() for i in ids}
        fresh: set[int] = set()
        for part in rows:
            tags = np.full(len(part), "reject", object)
            accepted = part["reason"].isna().to_numpy()
            times = part["event_us"].fillna(0).to_numpy(np.int64)
            tags[accepted] = np.where(times[accepted] < limit, "late", "duplicate")
            timely = np.flatnonzero(tags == "duplicate")
            names, hours = part["transaction_id"].to_numpy(object)[timely].tolist(), (times[timely] // HOUR_US).tolist()
            for at, name, hour in zip(timely.tolist(), names, hours):
                if name not in known:
                    tags[at] = "scored"
                    known.add(name)
                    held.setdefault(hour, []).append(name)
                    fresh.add(hour)
            kept = {c: part[c].astype(object) for c in ("key", "data")}
            yield pd.DataFrame(kept | {"event_us": part["event_us"].astype("Int64"), "reason": part["reason"].astype(object), "tag": tags})
        for hour in fresh:
            self.seen.updateValue((hour,), (held[hour],))
            self.handle.registerTimer((hour + 1) * HOUR_US // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.removeKey((expiredTimerInfo.getExpiryTimeInMs() * 1000 // HOUR_US - 1,))
        return iter(())

    def close(self) -> None:
        pass


def tag_records(records: DataFrame, watermark: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Every record with its tag.  The event time enters the processor as a plain number: late rows are tagged, not dropped."""
    ship_package(records.sparkSession)
    d = classify(records).withWatermark("event_ts", watermark)
    d = d.select("key", "data", F.unix_micros("event_ts").alias("event_us"), "reason",
                 F.get_json_object("value", "$.transaction_id").alias("transaction_id"))
    d = d.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("transaction_id", "data")), F.lit(buckets)).cast("int"))
    tagged = d.groupBy("bucket").transformWithStateInPandas(
        Tagger(), "key string, data string, event_us long, reason string, tag string", "Append", "EventTime")
    # the text is decoded again rather than sent through the processor
    return tagged.select("key", "data", decode_base64(F.col("data")).alias("value"), F.timestamp_micros("event_us").alias("event_ts"), "reason", "tag")


def score_events(valid: DataFrame) -> DataFrame:
    """R-6 on the stream: amount / 5000 clamped; alert above .85."""
    s = R.stream_score("amount_aud")
    return valid.withColumn("anomaly_score", s).withColumn("is_alert", s > C.STREAM_ALERT_CUTOFF)


def enrich(events: DataFrame, snapshot: DataFrame, key: str = "merchant_id") -> DataFrame:
    """J-7: stream-static left join of events to a feature snapshot on the merchant key.

    The static side is re-read each micro-batch, so a refreshed snapshot version
    is picked up without restarting the query.
    """
    return events.join(snapshot, key, "left")


def _write_batch(df: DataFrame, root: str, name: str, batch_id: int, partition_cols=None) -> None:
    w = df.write.mode("overwrite")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(f"{root}/{name}/batch_id={batch_id}")


def batch_sink(out_root: str, features: DataFrame | None = None):
    """foreachBatch writer of all zones, scored events, alerts and the feature snapshot."""
    from paylens.sinks.writers import with_processing_partitions
    from paylens.streaming.snapshots import upsert_snapshot

    def sink(batch: DataFrame, batch_id: int) -> None:
        # all sinks read what is persisted: records are parsed once, and only rejects keep their data
        parsed, amount = (F.when(F.col("tag") == "scored", x) for x in _parsed())
        batch = batch.select("key", F.when(F.col("tag") == "reject", F.col("data")).alias("data"), "value", "event_ts", "reason", "tag",
                             parsed.alias("p"), amount.alias("_amount")).persist()
        try:
            def tagged(*tags: str) -> DataFrame:
                return batch.filter(F.col("tag").isin(*tags))

            verbatim = ["key", "value", "event_ts"]
            _write_batch(with_processing_partitions(tagged("scored", "duplicate").select(*verbatim)),
                         out_root, "raw", batch_id, ["year", "month", "day", "hour"])
            _write_batch(tagged("late").select(*verbatim), out_root, "late", batch_id)
            _write_batch(tagged("duplicate").select(*verbatim), out_root, "duplicates", batch_id)
            _write_batch(tagged("reject").select("key", "data", "value", "reason"), out_root, "rejects", batch_id)
            events = _typed(tagged("scored"))
            scored = score_events(events if features is None else enrich(events, features))
            _write_batch(scored.drop("event_ts"), out_root, "scored", batch_id)
            _write_batch(scored.filter(F.col("is_alert")).drop("event_ts"), out_root, "alerts", batch_id)
            upsert_snapshot(scored, f"{out_root}/snapshots", batch_id)
        finally:
            batch.unpersist()
    return sink


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Stateful processors need this state store; the setting is read when a query starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def start_consumer(spark: SparkSession, records: DataFrame, out_root: str, checkpoint: str,
                   trigger_once: bool = True, features: DataFrame | None = None, watermark: str = "1 hour",
                   buckets: int = BUCKETS):
    """ST-1: start the consumer (a tuple of its one query); zones and sinks lie under ``out_root``.

    ``features`` (merchant_id, feature columns…) is joined to every event (J-7).
    """
    t = {"availableNow": True} if trigger_once else {"processingTime": "10 seconds"}
    with state_in_rocksdb(spark):
        return (tag_records(records, watermark, buckets).writeStream.foreachBatch(batch_sink(out_root, features))
                .option("checkpointLocation", checkpoint).trigger(**t).start(),)


def read_raw(spark: SparkSession, out_root: str) -> DataFrame:
    """The raw zone parsed, one row per transaction id (copies of a record are equal)."""
    from paylens.operators.cleaning import dedupe_latest
    raw = spark.read.parquet(f"{out_root}/raw").select("key", "value", "event_ts")
    events = parse_events(raw).withColumn("timestamp", F.col("timestamp").try_cast("timestamp_ntz"))
    return dedupe_latest(events.drop("key", "event_ts"), ["transaction_id"], ["timestamp"])


def live_feed_from_sink(spark: SparkSession, out_root: str, limit: int = 10) -> DataFrame:
    """ST-7: the R-3 live feed over the raw zone."""
    from paylens.operators.scoring import live_feed
    from paylens.session import cut_lineage
    return live_feed(cut_lineage(read_raw(spark, out_root)), limit)  # parsed once, read for the statistics and the rows

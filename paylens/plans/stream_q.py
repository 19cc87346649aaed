"""Streaming queries: each runs a Structured Streaming job to completion
(availableNow trigger) over a stream derived from the driver tables, writes to
files under the shared checkpoint folder and returns the sink read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens.plans.features_q import _frame
from paylens.operators import features as FT
from paylens.plans.registry import register
from paylens.plans.scoring_q import LIVE_FEED_SQL
from paylens.session import scratch_path
from paylens.sources.records import encode_records, to_base64
from paylens.sources.tables import transactions, with_transactions
from paylens.streaming import consumer as CS
from paylens.streaming import velocity as V


@register("stream_velocity", "ST-5", with_transactions(f"""
SELECT merchant_id, transaction_id,
       COUNT(*) OVER {_frame(FT.HOUR_US)} AS txn_velocity_1h,
       COUNT(*) OVER {_frame(FT.DAY_US)} AS txn_velocity_24h
FROM (SELECT *, epoch_us("timestamp") AS ts_us FROM transactions) t"""))
def q_stream_velocity(spark, sf_dir):
    """Three landings that each span the whole time, so most rows of the later ones are late and revise earlier counts."""
    root = scratch_path(spark, "stream")
    tx = transactions(spark, sf_dir).select("merchant_id", "transaction_id", F.col("timestamp").cast("timestamp").alias("event_ts"))
    part = F.pmod(F.xxhash64("transaction_id"), F.lit(3))
    for k in range(3):
        tx.filter(part == k).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(tx.schema).parquet(f"{root}/landing")
        with CS.state_in_rocksdb(spark):
            q = (V.exact_velocity(stream, lateness_hours=24 * 400, block_hours=24).writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", f"{root}/ckpt").option("path", f"{root}/out").trigger(availableNow=True).start())
        q.awaitTermination()
    return V.current_counts(spark.read.parquet(f"{root}/out")).select(
        "merchant_id", "transaction_id", "txn_velocity_1h", "txn_velocity_24h")


@register("stream_consumer", "ST-1", with_transactions("""
SELECT transaction_id, merchant_id, least(greatest(amount_aud / 5000.0, 0.0), 1.0) AS anomaly_score,
       least(greatest(amount_aud / 5000.0, 0.0), 1.0) > 0.85 AS is_alert
FROM transactions"""))
def q_stream_consumer(spark, sf_dir):
    root = scratch_path(spark, "stream")
    tx = transactions(spark, sf_dir)
    to_base64(encode_records(tx)).write.mode("overwrite").json(f"{root}/landing")
    for q in CS.start_consumer(spark, CS.record_stream(spark, f"{root}/landing"), f"{root}/out", f"{root}/ckpt"):
        q.awaitTermination()
    scored = spark.read.parquet(f"{root}/out/scored")
    return scored.select("transaction_id", "merchant_id", "anomaly_score", "is_alert")


@register("stream_live_feed", "ST-7", LIVE_FEED_SQL)
def q_stream_live_feed(spark, sf_dir):
    """R-3 over the consumer's raw sink: must equal the batch live feed."""
    root = scratch_path(spark, "stream")
    tx = transactions(spark, sf_dir)
    to_base64(encode_records(tx)).write.mode("overwrite").json(f"{root}/landing")
    for q in CS.start_consumer(spark, CS.record_stream(spark, f"{root}/landing"), f"{root}/out", f"{root}/ckpt"):
        q.awaitTermination()
    return CS.live_feed_from_sink(spark, f"{root}/out", 10)


# Landing of the zones query: every branch occurs.  n is the event number; the first seven of
# ten land first, the rest in a second run, when most of them are older than the watermark.
ZONE_LATENESS = "10 days"
_ZONE_CASES = """CASE WHEN n % 97 = 0 THEN 'undecodable' WHEN n % 89 = 0 THEN 'not_json_object'
  WHEN n % 83 = 0 THEN 'missing:amount_aud' WHEN n % 79 = 0 THEN 'bad_timestamp' WHEN n % 73 = 0 THEN 'bad_amount'
  ELSE 'accepted' END"""


def zone_landing(tx):
    """Transactions as stream records with broken, duplicate and extra-key ones; ``n`` numbers them."""
    n = F.regexp_extract("transaction_id", r"(\d+)$", 1).cast("long")
    rec = encode_records(tx).select("key", "value", F.get_json_object("value", "$.transaction_id").alias("transaction_id"))
    rec = rec.withColumn("n", n).withColumn("case", F.expr(_ZONE_CASES))
    swap = {"missing:amount_aud": ('"amount_aud":', '"amount":'), "bad_timestamp": ('"timestamp":"', '"timestamp":"about '),
            "bad_amount": ('"amount_aud":', '"amount_aud":"some ')}
    value = F.col("value")
    for case, (old, new) in swap.items():
        value = F.when(F.col("case") == case, F.replace(F.col("value"), F.lit(old), F.lit(new))).otherwise(value)
    value = F.when(F.col("case") == "bad_amount", F.regexp_replace(value, r'(some [^,}]*)', '$1"')).otherwise(value)
    value = F.when(F.col("n") % 7 == 0, F.concat(F.lit('{"channel":"web",'), F.substr(value, F.lit(2)))).otherwise(value)
    value = F.when(F.col("case") == "not_json_object", F.lit("[1, 2]")).otherwise(value)
    data = F.when(F.col("case") == "undecodable", F.lit("@@@")).otherwise(F.base64(F.encode(value, "UTF-8")))
    copies = F.when(F.col("n") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rec.select("key", data.alias("data"), "n", F.explode(copies).alias("_copy")).drop("_copy")


def _zones(spark, sf_dir, names):
    """(zone, reason, merchant_id, records) of a consumer that ran over the landing in two runs."""
    root = scratch_path(spark, "stream")
    records = zone_landing(transactions(spark, sf_dir))
    for first in (True, False):
        part = records.filter((F.col("n") % 10 < 7) == F.lit(first)).drop("n")
        part.write.mode("append").json(f"{root}/landing")
        for q in CS.start_consumer(spark, CS.record_stream(spark, f"{root}/landing"), f"{root}/out", f"{root}/ckpt",
                                   watermark=ZONE_LATENESS):
            q.awaitTermination()
    out = None
    for name in names:
        z = spark.read.parquet(f"{root}/out/{name}")
        reason = F.col("reason") if name == "rejects" else F.lit(None).cast("string")
        key = F.col("merchant_id" if name == "scored" else "key").alias("merchant_id")
        z = z.select(F.lit(name).alias("zone"), reason.alias("reason"), key)
        out = z if out is None else out.union(z)
    return out.groupBy("zone", "reason", "merchant_id").agg(F.count(F.lit(1)).alias("records"))


_ZONE_RECS = f"""recs AS (SELECT *, {_ZONE_CASES} AS c FROM (
  SELECT *, CAST(regexp_extract(transaction_id, '(\\d+)$', 1) AS BIGINT) AS n FROM transactions) t)"""
_IS_LATE = """n % 10 >= 7 AND "timestamp" < (SELECT max("timestamp") FROM recs WHERE n % 10 < 7 AND c = 'accepted') - INTERVAL 10 DAY"""


@register("stream_tags", "ST-3", with_transactions(f"""
SELECT zone, reason, merchant_id, COUNT(*) AS records FROM (
  SELECT merchant_id, CASE WHEN c <> 'accepted' THEN c END AS reason,
         unnest(CASE WHEN c <> 'accepted' THEN ['rejects'] WHEN {_IS_LATE} THEN ['late']
                     WHEN k = 1 THEN ['raw', 'scored'] ELSE ['raw', 'duplicates'] END) AS zone
  FROM recs r, (VALUES (1), (2)) copies(k) WHERE k = 1 OR n % 5 = 0) z
GROUP BY 1, 2, 3""", _ZONE_RECS))
def q_stream_tags(spark, sf_dir):
    """All zones of the consumer; scored holds each accepted, timely transaction once."""
    return _zones(spark, sf_dir, ["raw", "late", "rejects", "duplicates", "scored"])


@register("stream_zones", "ST-2", with_transactions("""
SELECT zone, reason, merchant_id, COUNT(*) AS records FROM (
  SELECT r.merchant_id, CASE WHEN c <> 'accepted' THEN c END AS reason,
         CASE WHEN c <> 'accepted' THEN 'rejects'
              WHEN n % 10 >= 7 AND "timestamp" < (SELECT max("timestamp") FROM recs WHERE n % 10 < 7 AND c = 'accepted') - INTERVAL 10 DAY
              THEN 'late' ELSE 'raw' END AS zone
  FROM recs r, (VALUES (1), (2)) copies(k) WHERE k = 1 OR n % 5 = 0) z
GROUP BY 1, 2, 3""", _ZONE_RECS))
def q_stream_zones(spark, sf_dir):
    """ST-1/2/3, SNK-5: broken, late, duplicate and extra-key records; raw + late + rejects = landed."""
    return _zones(spark, sf_dir, ["raw", "late", "rejects"])

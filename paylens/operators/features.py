"""Rolling per-merchant features (W-1 … W-13, W-16, W-17, J-5, P-9 … P-16).

Frames are half-open ``(t-w, t]`` like a pandas time-rolling window.  No
sliding frame is used: Spark re-aggregates a sliding range frame over its whole
buffer for every row, which is quadratic for dense merchants.  All frames come
from one segmented prefix scan (``rolling``): one shuffle by merchant and time,
in which a merchant of any size is many tasks.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions.numeric import money_avg, zero_if_not_finite
from paylens.functions.timecols import epoch_micros, ntz_literal
from paylens.operators.cleaning import latest_per_key
from paylens.operators.rolling import Rolling, rolling

US = 1_000_000
HOUR_US = 3600 * US
DAY_US = 24 * HOUR_US
WINDOW_US = {"1H": HOUR_US, "24H": DAY_US, "1D": DAY_US, "7D": 7 * DAY_US, "30D": 30 * DAY_US}
NULL_CUSTOMER = "<null>"


def ts_micros(c: str = "timestamp") -> Column:
    return epoch_micros(c)


def indicator(cond: Column) -> Column:
    """P-10: boolean condition as 0/1 double (null -> 0)."""
    return F.coalesce(cond.cast("double"), F.lit(0.0))


def state_means(tx: DataFrame) -> DataFrame:
    return tx.groupBy("state").agg(money_avg("amount_aud").alias("_state_avg"))


def _flag(cond: Column) -> Column:
    return F.coalesce(cond.cast("long"), F.lit(0).cast("long"))


def _rolling_inputs(tx: DataFrame) -> DataFrame:
    """The transaction columns with the long columns that are rolled; amounts in exact millionths."""
    amt = F.col("amount_aud")
    return tx.withColumns({
        "_ts_us": ts_micros(), "_micros": F.rint(amt * 1e6).cast("long"), "_n": _flag(amt.isNotNull()),
        "_id": _flag(F.col("transaction_id").isNotNull()), "_one": F.lit(1).cast("long"),
        "_tap": _flag(F.col("payment_terminal") == "tap_and_go"), "_debit": _flag(F.col("card_type") == "debit"),
        "_off": _flag(F.col("is_outside_business_hours")), "_amount": amt.cast("double"), "_customer": F.col("customer_id")})


def _std_samp(n: Column, spread: Column) -> Column:
    """Sample standard deviation in units from ``n sum(v^2) - sum(v)^2`` of millionths; null below two values."""
    return F.when(n >= 2, F.sqrt(spread / (n * (n - 1)).cast("double")) / 1e6)


#: the transaction columns that the features are made of
FEATURE_INPUTS = ["transaction_id", "merchant_id", "customer_id", "amount_aud", "timestamp", "state", "payment_terminal",
                  "card_type", "is_outside_business_hours"]


def training_features(tx: DataFrame, slab_rows: int | None = None, beside: list[str] | None = None) -> DataFrame:
    """W-11: the 17 model features beside the transaction columns (``beside``: only these of them).

    Rows without a timestamp are left out (P-3).  The state mean (J-5) is an
    aggregate of the shuffled rows, joined back.  ``slab_rows``: see ``rolling``.
    """
    if beside is not None:
        tx = tx.select(*dict.fromkeys([*FEATURE_INPUTS, *beside]))
    h1, d1, d7, d30 = (WINDOW_US[w] for w in ("1H", "24H", "7D", "30D"))
    spec = Rolling(
        sums=(("_v1h", "_id", h1), ("_v24h", "_id", d1), ("_n7", "_n", d7), ("_s7", "_micros", d7), ("_rows7", "_one", d7),
              ("_tap7", "_tap", d7), ("_debit7", "_debit", d7), ("_off7", "_off", d7), ("_n30", "_n", d30)),
        spreads=(("_spread30", "_micros", d30, "_n"),), maxima=(("_max7", "_amount", d7),), distinct=(("_customers", "_customer", d1),))
    passthrough = [c for c in (tx.columns if beside is None else beside) if c not in C.FEATURE_COLUMNS]
    keep = [c for c in tx.columns if c in FEATURE_INPUTS and c != "customer_id" or c in passthrough]
    rolled, shuffled = rolling(_rolling_inputs(tx), spec, "merchant_id", "_ts_us", slab_rows, keep)
    amt = F.col("amount_aud")
    f = rolled.withColumn("avg_amount_7d", F.col("_s7").cast("double") / 1e6 / F.nullif("_n7", F.lit(0)).cast("double"))
    avg7 = F.col("avg_amount_7d")
    std = F.coalesce(_std_samp(F.col("_n30"), F.col("_spread30")), F.lit(0.0))
    std_safe = F.when(std == 0, F.lit(C.STD_FLOOR)).otherwise(std)
    f = f.select(
        *dict.fromkeys([*passthrough, "state"]),
        F.col("_v1h").cast("double").alias("txn_velocity_1h"), F.col("_v24h").cast("double").alias("txn_velocity_24h"),
        "avg_amount_7d", std.alias("stddev_amount_30d"),
        ((amt - avg7) / std_safe).alias("amount_zscore"),                                   # P-15 offline
        F.col("_max7").alias("max_amount_7d"), F.col("_customers").cast("double").alias("unique_customers_1d"),
        (F.col("_tap7") / F.col("_rows7")).alias("pct_tap_payments_7d"),
        F.hour("timestamp").cast("double").alias("hour_of_day"),                            # P-11
        indicator(F.col("is_outside_business_hours")).alias("is_outside_business_hours"),   # P-10
        (F.col("_debit7") / F.col("_rows7")).alias("pct_debit_7d"), (F.col("_off7") / F.col("_rows7")).alias("off_hours_txn_ratio_7d"),
        indicator(F.col("payment_terminal") == "manual_entry").alias("is_manual_entry"),
        indicator(F.col("payment_terminal") == "chip_and_pin").alias("is_chip_and_pin"),
        indicator(F.col("card_type") == "credit").alias("is_credit_card"),
        (amt / F.greatest(avg7, F.lit(1.0))).alias("amount_to_merchant_avg_7d"))            # P-16
    dev = (F.col("avg_amount_7d") - F.col("_state_avg")).alias("state_avg_amount_deviation")   # J-5
    j = f.join(state_means(shuffled), "state", "left")
    return j.select(*passthrough, *[zero_if_not_finite(dev if c == "state_avg_amount_deviation" else F.col(c))
                                   .alias(c) for c in C.FEATURE_COLUMNS])                        # P-9


def batch_day_features(tx: DataFrame, day: date, lookback: bool = False, slab_rows: int | None = None) -> DataFrame:
    """W-12: closed [t-w, t] frames; by default computed after the day filter.

    ``lookback=True`` computes the frames over the preceding 30 days first and
    then keeps the day, so early-morning rows see the previous evening.
    """
    from datetime import datetime, timedelta
    start = datetime.combine(day, datetime.min.time())
    end = start + timedelta(days=1)
    lo = start - timedelta(days=30) if lookback else start
    rows = tx.filter((F.col("timestamp") >= ntz_literal(lo)) & (F.col("timestamp") < ntz_literal(end)))
    spec = Rolling(  # [t - w, t] is (t - w - 1us, t]
        sums=(("_v1h", "_one", HOUR_US + 1), ("_n7", "_n", 7 * DAY_US + 1), ("_s7", "_micros", 7 * DAY_US + 1),
              ("_n30", "_n", 30 * DAY_US + 1)), spreads=(("_spread30", "_micros", 30 * DAY_US + 1, "_n"),))
    rolled, _ = rolling(_rolling_inputs(rows), spec, "merchant_id", "_ts_us", slab_rows,
                        ["merchant_id", "transaction_id", "timestamp", "is_fraud"])
    out = rolled.select(
        "merchant_id", "transaction_id", "timestamp", F.col("_v1h").alias("txn_velocity_1h"),
        (F.col("_s7").cast("double") / 1e6 / F.nullif("_n7", F.lit(0)).cast("double")).alias("avg_amount_7d"),
        _std_samp(F.col("_n30"), F.col("_spread30")).alias("stddev_amount_30d"),
        F.hour("timestamp").alias("hour_of_day"), "is_fraud")
    if lookback:
        out = out.filter(F.col("timestamp") >= ntz_literal(start))
    return out


def latest_snapshot(df: DataFrame, key: str = "merchant_id",
                    order: tuple[str, ...] = ("timestamp", "transaction_id")) -> DataFrame:
    """W-16: latest row per key (``cleaning.latest_per_key``)."""
    rest = [c for c in df.columns if c != key and c not in order]
    return latest_per_key(df, [key], list(order)).select(key, *order, *rest)


def merchant_history(tx: DataFrame, limit: int = C.HISTORY_LIMIT) -> DataFrame:
    """SRC-8 / T-4: newest ``limit`` rows per merchant (all merchants at once).

    ``row_number() <= k`` plans as WindowGroupLimit, which also runs map-side
    before the shuffle, so at most k rows per merchant and map task move; the
    planner infers it for k up to a threshold that the package's session raises.
    """
    w = Window.partitionBy("merchant_id").orderBy(F.desc("timestamp"), F.desc("transaction_id"))
    return tx.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


# computation name in the registry -> aggregate over the rows inside the feature's window
_AGGREGATES = {
    "count": lambda inside: F.count(F.when(inside, 1)).cast("double"),
    "mean": lambda inside: F.avg(F.when(inside, F.col("amount_aud"))),
    "std": lambda inside: F.stddev_pop(F.when(inside, F.col("amount_aud"))),
    "max": lambda inside: F.max(F.when(inside, F.col("amount_aud"))),
    "nunique": lambda inside: F.count_distinct(
        F.when(inside, F.coalesce(F.col("customer_id"), F.lit(NULL_CUSTOMER)))).cast("double"),
    "ratio": lambda inside: F.avg(F.when(inside, indicator(F.col("payment_terminal") == "tap_and_go"))),
    "debit_ratio": lambda inside: F.avg(F.when(inside, indicator(F.col("card_type") == "debit"))),
    "off_hours_ratio": lambda inside: F.avg(F.when(inside, indicator(F.col("is_outside_business_hours")))),
}


def _state_deviation(inside: Column) -> list[Column]:
    """Inputs of the state deviation: the window's mean and its amounts by state (at most ``limit`` entries)."""
    return [F.avg(F.when(inside, F.col("amount_aud"))).alias("_avg_w"),
            F.collect_list(F.when(inside, F.struct("state", "amount_aud"))).alias("_by_state")]


def realtime_features(tx: DataFrame, current: DataFrame | None = None, limit: int = C.HISTORY_LIMIT,
                      registry: list[tuple[str, str, str]] = C.FEATURE_REGISTRY) -> DataFrame:
    """W-17: the registry's features (name, computation, window) at each merchant's newest history row.

    Windows are closed ``[anchor-w, anchor]`` over the newest ``limit`` rows;
    std is the population std; empty windows give 0.  ``current`` holds the
    transaction being scored (merchant_id, amount_aud, state, timestamp); by
    default each merchant's newest row stands in for it.  A z-score is the
    registry's mean under its std (floor 0.01), as served online.
    """
    hist = merchant_history(tx, limit)
    anchor = F.max("_ts_us").over(Window.partitionBy("merchant_id"))
    hist = hist.withColumn("_ts_us", ts_micros()).withColumn("_anchor", anchor)

    def within(key: str) -> Column:
        return F.col("_ts_us") >= F.col("_anchor") - F.lit(WINDOW_US[key])

    aggregates = [_AGGREGATES[how](within(w)).alias(name) for name, how, w in registry if how in _AGGREGATES]
    for _, how, w in registry:
        if how == "state_deviation":
            aggregates += _state_deviation(within(w))
    g = hist.groupBy("merchant_id").agg(
        *aggregates, F.max_by(F.col("state"), F.struct("_ts_us", "transaction_id")).alias("_last_state"),
        F.max(F.struct("timestamp", "transaction_id", "amount_aud", "state")).alias("_newest"))
    if current is None:                              # the newest row of the history stands in
        j = g.select("*", F.col("_newest.amount_aud").alias("_cur_amount"), F.col("_newest.state").alias("_cur_state"),
                     F.col("_newest.timestamp").alias("_cur_ts"))
    else:
        j = g.join(current.select("merchant_id", F.col("amount_aud").alias("_cur_amount"),
                                  F.col("state").alias("_cur_state"), F.col("timestamp").alias("_cur_ts")),
                   "merchant_id", "left")
    zero = F.lit(0.0)
    hour = F.hour(F.coalesce(F.col("_cur_ts"), F.current_timestamp().cast("timestamp_ntz")))
    named = {how: name for name, how, _ in registry}

    def finish(name: str, how: str) -> Column:
        if how == "extract_hour":
            return hour.cast("double")
        if how == "business_hours_check":                                                # P-12
            return ((hour < 8) | (hour > 20)).cast("double")
        if how == "zscore":
            return ((F.col("_cur_amount") - F.coalesce(F.col(named["mean"]), zero))
                    / F.greatest(F.coalesce(F.col(named["std"]), zero), F.lit(C.STD_FLOOR)))
        if how == "state_deviation":
            st = F.coalesce(F.col("_cur_state"), F.col("_last_state"))
            own = F.filter("_by_state", lambda r: r["state"] == st)
            total = F.aggregate(own, F.lit(0.0), lambda acc, r: acc + r["amount_aud"])
            mean = F.when(F.size(own) > 0, total / F.size(own)).otherwise(F.col("_avg_w"))
            return F.coalesce(F.col("_avg_w") - mean, zero)
        return F.coalesce(F.col(name), zero)

    return j.select("merchant_id", *[finish(name, how).alias(name) for name, how, _ in registry])

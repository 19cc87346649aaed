"""Rolling features against a brute-force pandas oracle on window-edge fixtures (F12)."""

from datetime import datetime, timedelta

import math

import numpy as np
import pandas as pd
import pytest

from paylens import constants as C
from paylens import schemas
from paylens.operators import features as FT

T0 = datetime(2024, 1, 1, 10, 0, 0)
US = timedelta(microseconds=1)


def _row(tid, m, cust, ts, amt, term="tap_and_go", card="debit", off=False, state="NSW", cat="retail"):
    return (tid, m, "00000000001", cust, amt, "AUD", ts, cat, state, term, card, False, off)


ROWS = [
    _row("T01", "M1", "C1", T0, 10.0),
    _row("T02", "M1", "C2", T0 + timedelta(hours=1), 20.0, term="chip_and_pin"),        # exactly t-1h
    _row("T03", "M1", "C1", T0 + timedelta(hours=1) + US, 30.0, card="credit"),          # 1us later
    _row("T04", "M1", None, T0 + timedelta(hours=2), 40.0, off=True),                   # null customer
    _row("T05", "M1", None, T0 + timedelta(hours=2), 50.0),                             # equal timestamp
    _row("T06", "M1", "C3", T0 + timedelta(days=1), 60.0),                              # exactly t-1d
    _row("T07", "M1", "C1", T0 + timedelta(days=45), 70.0, term="manual_entry"),        # gap > 30 days
    _row("T08", "M2", "C9", T0, 99.0, state="VIC"),                                     # single row
    _row("T09", "M3", "C1", T0, 5.0, state="VIC"),
    _row("T10", "M3", "C2", T0 + timedelta(minutes=5), 5.0, state="VIC"),               # constant amounts
    _row("T11", "M3", "C1", T0 + timedelta(minutes=10), 5.0, state="VIC"),
]


def brute(df: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, r in df.iterrows():
        g = df[df.merchant_id == r.merchant_id]

        def frame(w):
            return g[(g.timestamp > r.timestamp - w) & (g.timestamp <= r.timestamp)]
        f1h, f24, f7, f30 = (frame(timedelta(hours=1)), frame(timedelta(hours=24)),
                             frame(timedelta(days=7)), frame(timedelta(days=30)))
        std = f30.amount_aud.std(ddof=1) if len(f30) > 1 else 0.0
        avg7 = f7.amount_aud.mean()
        out.append(dict(
            transaction_id=r.transaction_id,
            txn_velocity_1h=float(len(f1h)), txn_velocity_24h=float(len(f24)),
            avg_amount_7d=avg7, stddev_amount_30d=std, max_amount_7d=f7.amount_aud.max(),
            unique_customers_1d=float(f24.customer_id.fillna("<null>").nunique()),
            pct_tap_payments_7d=(f7.payment_terminal == "tap_and_go").mean(),
            pct_debit_7d=(f7.card_type == "debit").mean(),
            off_hours_txn_ratio_7d=f7.is_outside_business_hours.astype(float).mean(),
            amount_zscore=(r.amount_aud - avg7) / (std if std != 0 else 0.01),
            amount_to_merchant_avg_7d=r.amount_aud / max(avg7, 1.0),
        ))
    return pd.DataFrame(out).set_index("transaction_id")


@pytest.mark.parametrize("mode", [dict(), dict(slab_rows=1), dict(slab_rows=3), dict(slab_rows=5)])
def test_training_features_match_brute_force(spark, mode):
    df = spark.createDataFrame(ROWS, schemas.TRANSACTIONS)
    got = FT.training_features(df, **mode).toPandas().set_index("transaction_id")
    assert len(got) == len(ROWS)
    exp = brute(pd.DataFrame(ROWS, columns=[f.name for f in schemas.TRANSACTIONS.fields]))
    for col in exp.columns:
        for tid in exp.index:
            assert math.isclose(got.loc[tid, col], exp.loc[tid, col], rel_tol=1e-9, abs_tol=1e-9), (tid, col)
    # state deviation: avg_7d minus the mean of all amounts in the row's state (J-5)
    nsw = np.mean([r[4] for r in ROWS if r[8] == "NSW"])
    assert math.isclose(got.loc["T01", "state_avg_amount_deviation"], exp.loc["T01", "avg_amount_7d"] - nsw)
    assert set(C.FEATURE_COLUMNS) <= set(got.columns)


def test_training_features_empty(spark):
    df = spark.createDataFrame([], schemas.TRANSACTIONS)
    assert FT.training_features(df).count() == 0


def test_only_what_is_read_comes_back_from_python(spark):
    """``beside`` names the transaction columns in the result; features are the same, and columns that are only rolled are not returned."""
    df = spark.createDataFrame(ROWS, schemas.TRANSACTIONS)
    f, g = FT.training_features(df), FT.training_features(df, beside=["transaction_id", "is_fraud"])
    assert g.columns == ["transaction_id", "is_fraud", *C.FEATURE_COLUMNS]
    assert sorted(map(repr, f.select(*g.columns).collect())) == sorted(map(repr, g.collect()))
    returned = next(x for x in g._jdf.queryExecution().analyzed().toString().splitlines() if "MapInArrow" in x)
    assert "max_7" not in returned and "_max7" in returned and "_micros" not in returned.split(")")[-1] and "currency" not in returned


def test_rows_are_shuffled_once(spark):
    """W-11 range-partitions the rows by merchant and time; what is planned after that shuffle reads its checkpoint only."""
    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    from paylens.sources.tables import events_to_transactions
    f = FT.training_features(events_to_transactions(df))
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Window" not in plan
    assert plan.count("MapInArrow") == 1
    assert "FlatMapGroupsInArrow" in plan or "FlatMapGroups" not in plan


@pytest.mark.parametrize("slab_rows", [40, 700])
def test_small_slabs_equal_large_ones_on_driver_data(spark, slab_rows):
    from paylens.sources.tables import transactions
    tx = transactions(spark, "/root/testdata/sf0.001" if slab_rows < 100 else "/root/testdata/sf0.01")
    a = FT.training_features(tx)
    b = FT.training_features(tx, slab_rows=slab_rows)
    cols = ["transaction_id"] + C.FEATURE_COLUMNS
    pa = a.select(*cols).toPandas().set_index("transaction_id").sort_index()
    pb = b.select(*cols).toPandas().set_index("transaction_id").sort_index()
    assert len(pa) == len(pb) == tx.count()
    assert np.allclose(pa.to_numpy(), pb.to_numpy(), rtol=1e-12, atol=1e-12)


SPEC_SCHEMA = "k string, ts long, a long, n long, v double, c string, note string"


def _brute_rolling(rows, w):
    out = []
    for k, ts, a, n, v, c, note in rows:
        if ts is None:
            continue
        f = [r for r in rows if r[0] == k and r[1] is not None and ts - w < r[1] <= ts]
        s = sum(r[2] or 0 for r in f)
        vs = [r[4] for r in f if r[4] is not None]
        out.append((note, s, float(sum(r[3] or 0 for r in f) * sum((r[2] or 0) ** 2 for r in f) - s * s), max(vs, default=None),
                    len({r[5] for r in f})))
    return out


def _random_rows(rnd, n, keys, span):
    """One key holds 40 % of the rows; times tie, values and keys are null here and there."""
    rows = []
    for i in range(n):
        k = "hot" if rnd.random() < 0.4 else rnd.choice(keys)
        ts = None if rnd.random() < 0.02 else rnd.randrange(span) * 5 - span
        rows.append((k, ts, rnd.choice([None, 0, 1, -7, 10 ** 12 + rnd.randrange(9)]), rnd.choice([0, 1, None]),
                     rnd.choice([None, rnd.random(), 3.0]), rnd.choice(["x", "y", "z", None, str(rnd.randrange(30))]), f"r{i}"))
    return rows


@pytest.mark.parametrize("seed,slab_rows", [(1, 7), (2, 20), (3, 60), (4, 500), (5, None), (6, 1)])
def test_scan_equals_brute_force_with_a_hot_key(spark, seed, slab_rows):
    import random
    from paylens.operators.rolling import Rolling, rolling
    rnd = random.Random(seed)
    rows = _random_rows(rnd, 300, ["a", "b", "c", None, "", "é"], rnd.choice([60, 900]))
    for w in rnd.sample([1, 5, 37, 400, 2500, 100000], 3):
        other = w * 3 + 1
        spec = Rolling(sums=(("s", "a", w), ("far", "a", other)), spreads=(("q", "a", w, "n"),),
                       maxima=(("m", "v", w),), distinct=(("d", "c", w),))
        found, _ = rolling(spark.createDataFrame(rows, SPEC_SCHEMA).repartition(3), spec, "k", "ts", slab_rows)
        got = found.select("note", "s", "q", "m", "d", "far").collect()
        want = _brute_rolling(rows, w)
        far = {r[0]: r[1] for r in _brute_rolling(rows, other)}
        assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
        assert {r.note: r.far for r in got} == far


def test_a_hot_merchant_is_many_tasks(spark):
    """One merchant holds 40 % of the rows: no slab, and no group of the scan, holds more than a slab's share."""
    from paylens.operators import rolling as RL
    df = spark.range(20000).selectExpr(
        "case when id % 5 < 2 then 'hot' else concat('m', id % 700) end k", "id * 1000 ts", "1L one", "cast(id % 90 as string) c")
    spec = RL.Rolling(sums=(("s", "one", 5_000_000),), distinct=(("d", "c", 5_000_000),))
    found, base = RL.rolling(df, spec, "k", "ts", slab_rows=1000)
    shares = base.groupBy("_slab").count().collect()
    assert len(shares) >= 20 and max(r["count"] for r in shares) <= 1500
    hot = base.filter("_key = '=hot'").groupBy("_slab").count().collect()
    assert len(hot) >= 7 and max(r["count"] for r in hot) <= 1500
    rows = found.filter("k = 'hot'").orderBy("ts").select("ts", "s", "d").collect()
    times = [r.ts for r in rows]
    for i in range(0, len(rows), 397):
        inside = [t for t in times if times[i] - 5_000_000 < t <= times[i]]
        assert rows[i].s == len(inside) and rows[i].d == len({t // 1000 % 90 for t in inside})


def test_latest_snapshot_and_history(spark):
    df = spark.createDataFrame(ROWS, schemas.TRANSACTIONS)
    snap = {r.merchant_id: r.transaction_id for r in FT.latest_snapshot(df).collect()}
    assert snap == {"M1": "T07", "M2": "T08", "M3": "T11"}
    hist = FT.merchant_history(df, 2).filter("merchant_id = 'M1'").collect()
    assert sorted(r.transaction_id for r in hist) == ["T06", "T07"]


def test_realtime_features_closed_frames(spark):
    df = spark.createDataFrame(ROWS, schemas.TRANSACTIONS)
    rt = {r.merchant_id: r for r in FT.realtime_features(df).collect()}
    m3 = rt["M3"]                                   # anchor 10:10; all three rows inside 1h
    assert m3.txn_velocity_1h == 3.0 and m3.stddev_amount_30d == 0.0
    assert m3.amount_zscore == 0.0                 # (5 - 5) / max(0, .01)
    m1 = rt["M1"]                                   # anchor day 45: only itself in 30d
    assert m1.txn_velocity_24h == 1.0 and m1.unique_customers_1d == 1.0
    assert m1.hour_of_day == 10.0 and m1.is_outside_business_hours == 0.0

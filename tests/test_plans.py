"""Plan shape checks: filters reach the Parquet scan, only needed columns are read."""

import re

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _scan(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "FileScan" in line or "Scan parquet" in line]


def test_date_window_pushed_to_scan(spark):
    for name in ("threat_map", "merchant_revenue_trend"):
        scans = _scan(spark, name)
        assert any(re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", s) for s in scans), name


def test_column_pruning(spark):
    scan = _scan(spark, "fraud_by_state")[0]
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", scan).group(1)
    assert schema == "struct<user_id:bigint,event_type:string,value:double>"


def test_top_k_is_take_ordered(spark):
    plan = E.queries()["top_merchants"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_latest_snapshot_is_an_aggregate(spark):
    plan = E.queries()["latest_snapshot"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" in plan


def test_first_per_key_hashes_before_the_shuffle(spark, monkeypatch):
    """Keys are counted by a hash aggregate, without a sort; whole rows are sorted only where their key has several."""
    from paylens.operators import cleaning as CL
    plans = []
    whole = CL.cut_lineage
    monkeypatch.setattr(CL, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    for name in ("dedupe_lineitem", "latest_snapshot", "curated_clean"):
        plans.clear()
        final = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        for plan in plans:
            below = plan[plan.index("Exchange"):]
            assert "HashAggregate" in below and "Sort" not in below and "ObjectHash" not in below, name
        assert plans and "SortMergeJoin" not in final, name
        rows, several = final.split("SortAggregate", 1)[0], final
        assert "Sort" not in rows and several.count("BroadcastHashJoin") == 2, name


def test_latest_per_key_against_brute_force(spark, monkeypatch):
    import random
    from paylens.operators import cleaning as CL
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice(["a", None, "c", f"k{i}"]), rnd.choice([1, None, 2]), rnd.choice([None, 1, 2, 3]),
             rnd.choice([None, "x", "y"]), rnd.random()) for i in range(200)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "k string, j int, t long, s string, v double")
    key = lambda x: (x is not None, x)
    for order in (["t", "s"], ["s", "t"]):
        best = {}
        for k, j, t, s, v in rows:
            by = [key({"t": t, "s": s}[c]) for c in order] + [key(v)]
            if (k, j) not in best or by > best[k, j][0]:
                best[k, j] = (by, (k, j, t, s, v))
        for limit in (1 << 18, 0):
            monkeypatch.setattr(CL, "DUPLICATE_KEYS", limit)
            got = [tuple(r) for r in CL.latest_per_key(df, ["k", "j"], order).collect()]
            assert sorted(map(str, got)) == sorted(str(x) for _, x in best.values())
    assert CL.latest_per_key(df.limit(0), ["k"], ["t"]).count() == 0


def test_history_trimmed_before_shuffle(spark):
    """W-17's newest-2000 history is cut map-side (partial WindowGroupLimit below the Exchange)."""
    plan = E.queries()["realtime_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2

"""Two-sample tests against NumPy and textbook values."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paylens.operators import drift as DR


def test_statistics_equal_numpy(spark):
    rng = np.random.default_rng(1)
    n = 900
    cur = rng.random(n) < 0.4
    pdf = pd.DataFrame({"cur": cur, "same": np.round(rng.standard_normal(n), 1), "moved": rng.standard_normal(n) + cur * 0.7,
                        "gaps": [None if rng.random() < 0.2 else float(v) for v in rng.integers(0, 5, n)], "one": 1.0,
                        "kind": rng.choice(["a", "b", "c"], n), "other": np.where(cur, rng.choice(["x", "y"], n), "x")})
    pdf.loc[::50, "kind"] = None
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = {r.feature: r for r in DR.two_sample_columns(df.repartition(4), F.col("cur"), ["same", "moved", "gaps", "one"], ["kind", "other"]).collect()}
    for c in ("same", "moved", "gaps", "one"):
        a, b = (np.sort(pdf.loc[pdf.cur == k, c].dropna().to_numpy(float)) for k in (False, True))
        at = np.unique(np.r_[a, b])
        d = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
        lam = d * math.sqrt(len(a) * len(b) / (len(a) + len(b)))
        p = 1.0 if lam < 0.2 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
        assert abs(got[c].statistic - d) < 1e-12 and abs(got[c].p_value - min(max(p, 0), 1)) < 1e-9
    assert got["moved"].drifted and not got["one"].drifted and got["one"].p_value == 1.0
    for c in ("kind", "other"):
        t = pd.crosstab(pdf[c].fillna("null"), pdf.cur).to_numpy(float)
        e = t.sum(1, keepdims=True) * t.sum(0) / t.sum()
        assert abs(got[c].statistic - ((t - e) ** 2 / e).sum()) < 1e-9
    assert got["other"].drifted
    whole = DR.two_sample_drift(DR.two_sample_columns(df, F.col("cur"), ["moved"], ["other"])).first()
    assert tuple(whole) == (1.0, 2, True)


def test_tail_of_chi_square(spark):
    rows = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05),
            (23.209251158954356, 10, 0.01), (0.0, 4, 1.0), (5.0, 0, 1.0), (2000.0, 3, 0.0), (124.342113404004, 100, 0.05)]
    df = spark.createDataFrame(rows, "stat double, free int, want double")
    for r in df.select("want", DR.chi_square_p("stat", "free").alias("p")).collect():
        assert abs(r.p - r.want) < 1e-9


def test_running_counts_within_groups_of_any_size(spark):
    from paylens.operators.ranking import grouped_cumulative
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "hot", "hot", "b", "c"], 2000), "x": np.round(rng.standard_normal(2000), 2), "n": 1})
    for buckets in (1, 7, 40):
        got = grouped_cumulative(spark.createDataFrame(pdf), "g", "x", ["n"], buckets).toPandas().sort_values(["g", "x"])
        want = pdf.groupby(["g", "x"])["n"].sum().groupby(level=0).cumsum()
        assert got["cum_n"].tolist() == want.tolist()

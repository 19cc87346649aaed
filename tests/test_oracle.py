"""Every registered query with an oracle equals its DuckDB SQL at sf0.001."""

import pytest

from tools.oracle_check import close, norm_frame

import __spark_entry__ as E
from tests.conftest import SF_SMALL

ORACLES = E.oracle_sql()
SLOW = {"stream_velocity", "stream_consumer"}


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SLOW))
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dd = duck.execute(ORACLES[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    a, b = norm_frame(sp), norm_frame(dd)
    assert len(a) == len(b)
    for i in range(len(a)):
        ra, rb = a.iloc[i].tolist(), b.iloc[i].tolist()
        assert all(close(x, y) for x, y in zip(ra, rb)), (name, dict(zip(a.columns, ra)), dict(zip(b.columns, rb)))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"transaction_id", "anomaly_score", "risk_level", "is_anomaly"} <= set(df.columns)

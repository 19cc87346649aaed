import os
import shutil
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from paylens.session import get_spark
    s = get_spark("local[4]", app="paylens-tests", shuffle_partitions=4)
    scratch = None
    if not s.conf.get("spark.checkpoint.dir", None):
        scratch = tempfile.mkdtemp(prefix="paylens-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", scratch)
    yield s
    s.stop()
    if scratch:
        shutil.rmtree(scratch, ignore_errors=True)


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    from paylens.sources.tables import TABLE_NAMES
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con

"""Large merchants' segments, and package code on workers of any master."""

import os
import subprocess
import sys

from paylens.operators import features as FT
from paylens.operators import rolling as RL
from paylens.sources.tables import transactions

SF = "/root/testdata/sf0.001"


def test_only_merchants_larger_than_a_slab_are_scanned_in_segments(spark, monkeypatch):
    seen = {}
    whole = RL._large_keys

    def recorded(base, spec, slabs, *rest):
        seen.update({k: len(s.number) for k, s in slabs.items()})
        return whole(base, spec, slabs, *rest)

    monkeypatch.setattr(RL, "_large_keys", recorded)
    tx = transactions(spark, SF)
    sizes = {"=" + r.merchant_id: r["count"] for r in tx.groupBy("merchant_id").count().collect()}
    cut = sorted(sizes.values())[-4]
    features = FT.training_features(tx, slab_rows=cut)
    assert set(seen) <= {k for k, n in sizes.items() if n > cut} and seen and all(n > 1 for n in seen.values())
    assert features.count() == tx.count()


def test_figures_by_slab_only_reach_the_driver(spark):
    """Exit events of a large key land in few slabs, so their totals are a few rows per slab and width."""
    rows = spark.range(4000).selectExpr("'k' k", "id * 10 ts", "1L one")
    spec = RL.Rolling(sums=(("s", "one", 1000), ("t", "one", 20_000)))
    found, base = RL.rolling(rows, spec, "k", "ts", slab_rows=100)
    slabs = base.select("_slab").distinct().count()
    got = {r.ts: (r.s, r.t) for r in found.collect()}
    assert slabs > 30 and got == {10 * i: (min(i + 1, 100), min(i + 1, 2000)) for i in range(4000)}


PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from paylens import session
from paylens.session import get_spark
spark = get_spark("local-cluster[1,1,1024]", app="ship", shuffle_partitions=2,
                  extra={{"spark.checkpoint.dir": "file://{shared}", "spark.executor.memory": "512m", "spark.driver.memory": "1g"}})
assert not session.is_local(spark)
from pyspark.sql import functions as F
from paylens.operators import retrieval as K
v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
q = spark.createDataFrame([(1, [3.2, 1.0])], "query_id long, query_vec array<double>")
print("FOUND", [r.vec_id for r in K.knn(v, q, 3).orderBy("rank").collect()])
"""


def test_workers_off_local_mode_get_the_package_and_the_shared_folder_is_emptied(tmp_path):
    """The driver starts in the package's own folder, the workers elsewhere and without PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shared = tmp_path / "shared"
    shared.mkdir()
    home = tmp_path / "home"
    home.mkdir()
    import pyspark
    spark_home = os.path.dirname(pyspark.__file__)
    for name in os.listdir(spark_home):
        if name != "work":
            os.symlink(os.path.join(spark_home, name), home / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {
        "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13"}
    out = subprocess.run([sys.executable, "-c", PROGRAM.format(root=root, shared=shared)], cwd=root, env=env, capture_output=True,
                         text=True, timeout=240)
    assert "FOUND [3, 4, 2]" in out.stdout, out.stderr[-3000:]
    assert [f for _, _, files in os.walk(shared) for f in files] == []


def test_one_thread_local_master_is_local():
    from paylens import session

    class Spark:
        class sparkContext:  # noqa: N801
            master = "local"

    assert session.is_local(Spark)
    for master, local in (("local[3]", True), ("local-cluster[1,1,512]", False), ("spark://h:7077", False), ("yarn", False)):
        Spark.sparkContext.master = master
        assert session.is_local(Spark) == local

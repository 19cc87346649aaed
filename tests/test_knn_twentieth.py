"""The searches' stated query set."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_every_twentieth_vector_is_a_query(spark):
    ids = [r.vec_id for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id").collect()]
    got = {r.query_id for r in E.queries()["knn_search"](spark, SF_SMALL).collect()}
    assert {q for q in got if q >= 0} == {i for i in ids if i % 20 == 0}
    assert any(q < 0 for q in got)

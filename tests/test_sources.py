"""Payload parsers (F3, F4), record codec (F11), cleaning and provenance."""

import json

from pyspark.sql import functions as F

from paylens import schemas
from paylens.sources import payloads as PL
from paylens.sources import records as RC
from paylens.sources import seeds as SD


def test_statistical_payload_list_and_dict(spark):
    lst = {"data": {"observations": [{"TIME_PERIOD": "2026-01", "OBS_VALUE": 128.0},
                                     {"TIME_PERIOD": "2026-02", "OBS_VALUE": 129.1}]}}
    dct = {"data": {"observations": {"k1": {"time_period": "2026-03", "obs_value": "130.5"},
                                     "2026-04": 131, "bad": "n/a", "k4": {"OBS_VALUE": 0},
                                     "2026-05": 0}}}
    empty = {"data": {"observations": []}}
    df = spark.createDataFrame([(json.dumps(p),) for p in (lst, dct, empty)], "payload string")
    got = sorted((r.TIME_PERIOD, r.OBS_VALUE) for r in PL.parse_statistical_payload(df).collect())
    assert got == [("2026-01", 128.0), ("2026-02", 129.1), ("2026-03", 130.5), ("2026-04", 131.0),
                   ("2026-05", 0.0)]


def test_card_ratio_table_mixed_scales(spark):
    df = spark.createDataFrame([("2026-01", "0.95", "0.69", "0.0012"), ("2026-02", "96", "70", "0.13"),
                                ("2026-02-15", "50%", "1,0", "0.1")],
                               "month string, contactless_ratio string, debit_ratio string, fraud_rate string")
    got = [tuple(r) for r in PL.parse_card_ratio_table(df).collect()]
    assert got[0] == ("2026-01", 0.0095, 0.0069, 0.0012)
    assert got[1] == ("2026-02", 0.96, 0.7, 0.13)          # first row of the month kept
    assert len(got) == 2


def test_card_ratio_table_missing_column(spark):
    df = spark.createDataFrame([("2026-01", "1")], "month string, contactless string")
    assert PL.parse_card_ratio_table(df).count() == 0


def test_pick_column():
    assert PL.pick_column(["Month", "Contactless %"], ["contactless"]) == "Contactless %"
    assert PL.pick_column(["a", "b"], ["month", "date", "period"]) is None


def test_record_codec_edges(spark):
    good = {"transaction_id": "T1", "merchant_id": "M1", "amount_aud": 5000.0, "timestamp": "2026-01-01T10:00:00+10:00"}
    rows = [("M1", RC_b64(json.dumps(good))),
            ("M1", RC_b64(json.dumps({**good, "amount_aud": None}))),          # null value passes
            ("M1", RC_b64(json.dumps({"merchant_id": "M1"}))),                  # missing keys
            ("M1", "%%%not-base64%%%"),
            ("M1", RC_b64("{not json")),
            (None, RC_b64(json.dumps(good)))]
    df = RC.decode_and_validate(spark.createDataFrame(rows, "key string, data string"))
    got = [(r.valid, list(r.missing_keys) if r.missing_keys is not None else None) for r in df.collect()]
    assert got[0] == (True, []) and got[1] == (True, [])
    assert got[2] == (False, ["amount_aud", "timestamp", "transaction_id"])
    assert got[3][0] is False and got[4][0] is False and got[5][0] is True
    # zoned timestamps keep their own clock hour
    h = df.select(F.hour(F.col("parsed.timestamp").try_cast("timestamp_ntz"))).first()[0]
    assert h == 10


def RC_b64(s: str) -> str:
    import base64
    return base64.b64encode(s.encode()).decode()


def test_provenance_and_reports(spark):
    empty = spark.createDataFrame([], "x int")
    live = spark.createDataFrame([(1,)], "x int")
    outcomes = [SD.choose_source("a", live, SD.retail_trade_fallback(spark)),
                SD.choose_source("b", empty, SD.card_payments_fallback(spark)),
                SD.calibrated("c", SD.terminal_mix(spark))]
    prov = SD.provenance(spark, outcomes)
    modes = {r.source: (r.mode, r.records) for r in prov.collect()}
    assert modes == {"a": ("live", 1), "b": ("fallback", 4), "c": ("calibrated", 4)}
    rep = SD.ingestion_report(prov).first()
    assert (rep.success_count, rep.live_success_count, rep.fallback_success_count, rep.calibrated_count) == (3, 1, 1, 1)
    assert prov.schema == schemas.PROVENANCE


def test_clean_raw_json(spark, tmp_path):
    from paylens.operators.cleaning import clean_raw
    from paylens.sources.files import read_raw_json
    p = tmp_path / "raw.json"
    p.write_text("\n".join([
        json.dumps({"transaction_id": "T1", "merchant_id": "M1", "amount_aud": "10.5", "timestamp": "2026-01-01T10:00:00"}),
        json.dumps({"transaction_id": "T1", "merchant_id": "M1", "amount_aud": "11", "timestamp": "2026-01-01T11:00:00"}),
        json.dumps({"transaction_id": None, "merchant_id": "M1", "amount_aud": "1", "timestamp": "2026-01-01T10:00:00"}),
        json.dumps({"transaction_id": "T2", "merchant_id": "M1", "amount_aud": "-3", "timestamp": "2026-01-01T10:00:00"}),
        json.dumps({"transaction_id": "T3", "merchant_id": "M1", "amount_aud": "abc", "timestamp": "x"}),
        "{broken"]))
    out = clean_raw(read_raw_json(spark, str(p)), stamp=False).collect()
    assert [(r.transaction_id, r.amount_aud) for r in out] == [("T1", 11.0)]
    assert out[0].data_quality_flag == "PASSED"


def test_payload_rows_are_kept_as_they_are(spark):
    """A null, missing or text value in the first observation does not lose the payload."""
    from paylens.sources.payloads import parse_statistical_payload
    obs = [{"TIME_PERIOD": "2026-01", "OBS_VALUE": None}, {"TIME_PERIOD": "2026-02"},
           {"TIME_PERIOD": "2026-03", "OBS_VALUE": "1.5"}, {"TIME_PERIOD": "2026-04", "OBS_VALUE": "n/a"},
           {"OBS_VALUE": 7, "other": 1}]
    wrap = lambda o: json.dumps({"data": {"observations": o}})
    df = spark.createDataFrame([(wrap(obs),), (wrap([{"TIME_PERIOD": "x"}]),), (wrap([]),)], "payload string")
    got = parse_statistical_payload(df, text=True).collect()
    assert sorted((str(r.TIME_PERIOD), str(r.OBS_TEXT), r.OBS_VALUE) for r in got if r.OBS_VALUE is not None) == [
        ("2026-03", "1.5", 1.5), ("None", "7", 7.0)]
    assert len(got) == 5 and {r.OBS_TEXT for r in got} == {None, "1.5", "n/a", "7"}


def test_category_bias_states(spark):
    from paylens.operators.governance import category_bias
    schema = "merchant_category string, s double, y int"
    state = lambda rows: category_bias(spark.createDataFrame(rows, schema), "s", "y").first()
    assert tuple(state([])) == ("no_data", 0.0)
    assert tuple(state([(None, 0.9, 1)])) == ("no_groups", 0.0)
    assert tuple(state([(None, 0.9, 1), ("a", 0.9, 0), ("a", 0.9, 1), ("b", 0.9, 1)])) == ("ok", 0.5)


def test_knn_any_number_of_queries_and_blocks(spark, monkeypatch):
    import numpy as np
    from paylens.operators import retrieval as K
    monkeypatch.setattr(K, "VECTOR_BLOCK", 5)                        # many blocks on both sides
    monkeypatch.setattr(K, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (60, 3)).astype(float)                    # many ties
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:25] + 0.25)], "query_id long, query_vec array<double>")
    got = {}
    for r in K.knn(v, q, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.distance))
    for i in range(25):
        d = ((x - x[i] - 0.25) ** 2).sum(1)
        best = np.lexsort((np.arange(60), d))[:4]
        assert [(k, j) for k, j, _ in sorted(got[i])] == [(n + 1, int(j)) for n, j in enumerate(best)]


def test_shared_folder_is_required_off_local_mode():
    import pytest
    from paylens import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())

import corpus_pipeline as P
import __spark_entry__ as E
from paylens.llm import langid, packing, toxicity
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, frame, near_groups
from tests.llm.test_text_operators import check_packing


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    compressors = langid._compressors(langid.fit_dictionaries(docs))
    left = {r.doc_id: r.text for r in docs.collect()}
    for d in list(left):
        lang, _, margin = langid.judge(left[d], compressors)
        if lang == "und" or margin < langid.MIN_MARGIN:
            del left[d]
    after_language = docs.filter(docs.doc_id.isin(list(left)))
    field = toxicity.fit(after_language, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(after_language, field).collect()}
    left = {d: t for d, t in left.items() if scores[d] < 0.5}
    left = {d: left[d] for d, (_, c) in near_groups(left.items()).items() if c == d}
    rows = P.run(spark, SF_SMALL).collect()
    assert {r.doc_id for r in rows} == set(left)
    check_packing(rows, list(left.items()), packing.CAPACITY)


def test_stages_take_awkward_documents_and_keep_the_columns(spark):
    docs = frame(spark, awkward())
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert tuple(docs.columns) == P.COLUMNS
    assert [r.doc_id for r in docs.filter("doc_id = 2").collect()] == []  # a copy of document 1
    empty = frame(spark, []).select(*P.COLUMNS)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF_SMALL).collect() == []


def test_every_operator_is_registered():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_unlike_texts_under_one_id_stay(spark):
    """A text goes only when its own group keeps another."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1), "en", "s"), (1, text(2), "en", "s"), (1, text(1), "en", "s"), (2, text(2) + " more", "en", "s"),
            (3, text(1), "en", "s"), (4, text(4), "en", "s"), (None, text(1), "en", "s")]
    got = sorted((str(r.doc_id), r.text.split("x")[0]) for r in P.near_dedup(spark, frame(spark, rows), SF_SMALL).collect())
    assert sorted(w for _, w in got) == ["w1", "w1", "w2", "w4"]
    assert ("None", "w1") in got and ("4", "w4") in got

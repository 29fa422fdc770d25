import pytest
from pyspark.sql import functions as F

from sparkloom.llm import queries

from harness import SMALL, assert_equal


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    if name in queries.ORACLES:
        assert_equal(df, queries.ORACLES[name])
    else:
        n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
        assert df.count() >= n and df.select("doc_id").distinct().count() == n


ROWS = [
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (None, "no id at all but a text of six words", "en", "b", 36),
    (3, "calm tree river stone cloud green bread mail me@x.org", "en", "a", 53),
    (4, "calm tree river stone cloud green bread mail me@x.org", "en", "b", 53),
    (5, "you are an idiot and a moron, pathetic scum, worthless trash", "en", "b", 60),
    (6, "some quiet text about a river in the north and its green banks", "de", "c", 62),
    (6, "some quiet text about a river in the north and its green banks", "de", "c", 62),
    (7, "house " * 40_000, "en", "c", 240_000),
]


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on rows that hold nulls, empty and long texts, copies and repeated rows; what it must do is worked out plainly."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "packing"]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_text_", F.lit("mine"))
    key = lambda r: repr((r["doc_id"], r["text"], r["source"]))
    clean = stages["toxicity"](spark, docs, SMALL)
    assert clean.columns == docs.columns and sorted(map(key, clean.collect())) == sorted(key(r) for r in docs.collect() if r["doc_id"] != 5)
    one = stages["ngram_jaccard_join"](spark, clean, SMALL).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in one) == [(False, 1), (False, 3), (False, 6), (False, 7), (True, 0)]
    one = spark.createDataFrame(one, docs.schema)
    masked = stages["pii"](spark, one, SMALL).collect()
    for r in masked:
        if r["doc_id"] == 3:
            assert r["text"] == "calm tree river stone cloud green bread mail [EMAIL]" and r["n_chars"] == len(r["text"])
    assert sorted(r["doc_id"] or 0 for r in masked) == [0, 1, 3, 6, 7] and next(r for r in masked if r["doc_id"] == 1)["text"] is None
    masked = spark.createDataFrame(masked, docs.schema)
    mixed = stages["mixing"](spark, masked, SMALL)
    taken = mixed.collect()
    assert mixed.columns == docs.columns and {key(r) for r in taken} <= {key(r) for r in masked.collect()}
    assert all(sum(key(t) == key(r) for t in taken) <= 2 for r in masked.collect())
    packed = stages["packing"](spark, mixed, SMALL).collect()
    ends, fill = {}, {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
        ends[r["doc_id"]] = ends.get(r["doc_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048
    assert ends.keys() == {r["doc_id"] for r in taken}
    none = docs.filter("false")
    for name in list(stages)[:-1]:
        assert stages[name](spark, none, SMALL).count() == 0


def test_pipeline_runs_and_keeps_the_columns(spark):
    import corpus_pipeline

    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, SMALL).count() > 0

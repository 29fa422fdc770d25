import math
import uuid

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import web as W
from sparkloom.operators import chunking, labels, metrics, provenance, retrieval, stats
from sparkloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank int")


def test_fusion_keeps_first_seen_order_for_ties_and_counts_lists(spark):
    a, b = ranked(spark, [(1, 10, 1), (1, 20, 2)]), ranked(spark, [(1, 20, 1), (1, 10, 2), (1, None, 3)])
    got = retrieval.fuse([a, b], 5).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [10, 20]
    assert got[0]["source_ranks"] == {0: 1, 1: 2}
    assert math.isclose(got[0]["score"], 1 / 61 + 1 / 62, abs_tol=1e-9)


def test_bm25_equals_a_plain_restatement(spark):
    texts = {1: "red fish blue fish", 2: "red dog", 3: "old cat sat on a blue mat", 4: "one two"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    q = spark.createDataFrame([(7, "blue blue fish"), (8, ""), (9, "zebra")], "query_id long, text string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(retrieval.build_index(docs, F.col("text"), least_tokens=1), q, 10).collect()}
    ws = {k: t.split() for k, t in texts.items()}
    n, avg = len(ws), sum(map(len, ws.values())) / len(ws)
    df = {w: sum(w in d for d in ws.values()) for d in ws.values() for w in d}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    want = {}
    for k, d in ws.items():
        s = sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in ["blue", "blue", "fish"])
        if s > 0:
            want[k] = round(s, 6)
    assert got == want


def test_measures_of_missing_and_late_ranks(spark):
    r = spark.createDataFrame([(1,), (4,), (120,), (None,)], "rank_of_gold int").agg(*metrics.measures(), *metrics.buckets()).first()
    assert (r["hit_1"], r["hit_5"], r["not_retrieved"], r["n"]) == (0.25, 0.5, 0.25, 4)
    assert (r["rank_1"], r["rank_2_5"], r["rank_21_100"], r["rank_none"]) == (1, 1, 0, 1)


def test_kendall_of_reversed_lists_and_single_items(spark):
    a = ranked(spark, [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 5, 1)])
    b = ranked(spark, [(1, 3, 1), (1, 2, 2), (1, 1, 3), (2, 5, 9)])
    assert {r["query_id"]: r["tau"] for r in metrics.kendall_tau(a, b).collect()} == {1: -1.0, 2: 0.0}


def test_mcnemar_exact_values(spark):
    for b, c, want in ((3, 9, 0.146), (5, 5, 1.0), (0, 0, 1.0), (0, 6, 0.03125)):  # exact: 2 * 299 / 4096, ..., 2 / 64
        assert abs(one(spark, stats.mcnemar(F.lit(b), F.lit(c))) - want) < 1e-4


def test_holm_runs_up_and_stops_at_one(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "pair string, p double")
    got = {r["pair"]: round(r["p_holm"], 6) for r in stats.holm(df).collect()}
    assert got == {"a": 0.04, "b": 0.09, "c": 0.09, "d": 0.9}


def test_wilson_and_auc(spark):
    r = spark.range(1).select(*stats.wilson(F.lit(8), F.lit(10))).first()
    assert (r["share"], round(r["low"], 4), round(r["high"], 4)) == (0.8, 0.4902, 0.9433)
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1)], "s double, y int")
    assert stats.auc(df, "s", "y").first()["auc"] == 0.875


def test_chunks_follow_a_greedy_fold(spark):
    text = "a b c\n\nd e\n\nf g h i j k l m. n o p q r s t u v w x y z.\n\nlast one"
    got = one(spark, chunking.page_chunks(F.lit(text), 5))
    assert got == ["a b c\n\nd e", "f g h i j", "k l m", "n o p q r", "s t u v w", "x y z", "last one"]
    assert one(spark, chunking.page_chunks(F.lit(" "), 5)) == []


def test_questions_are_cleaned_and_parsed(spark):
    raw = "1. According to the passage, what is red?\n- is it red? yes\nno\n2) what is red?"
    assert one(spark, T.parse_questions(F.lit(raw), 5)) == ["What is red?", "Is it red?"]


def test_three_valued_labels(spark):
    rows = spark.createDataFrame([("mixed", None), ("mixed", True), ("parametric", False)], "r string, h boolean")
    got = rows.select(provenance.cell_label(F.col("r"), F.col("h")).alias("c"), provenance.quadrant(F.col("r"), F.col("h")).alias("q")).collect()
    assert [r["c"] for r in got] == ["grounded?", "both", "unverified"]
    assert got[1]["q"] == "parametric recall"


def test_gold_on_top_is_null_where_it_cannot_be_said(spark):
    f = lambda d, r: one(spark, provenance.gold_on_top(F.lit(d) if d else F.array(F.lit(1.0), F.lit(None)), F.lit(r)))
    assert f([0.1, 0.5], 2) is True and f([0.1, 0.5], 1) is False and f(None, 1) is None and f([0.1], None) is None


def test_links_keep_their_first_place(spark):
    html = '<a href="/x.pdf">a</a><a href="/media/7">m</a><a class="download" href="/x.pdf">d</a>'
    assert one(spark, W.links(F.lit(html), "https://h")) == ["https://h/media/7/download", "https://h/x.pdf"]


def test_upsert_fills_only_what_is_missing(spark):
    old, new = (spark.createDataFrame(r, "id long, a string") for r in ([(1, " "), (2, "x")], [(1, "n"), (2, "n"), (3, "n")]))
    assert {tuple(r) for r in files.upsert(old, new, "id").collect()} == {(1, "n"), (2, "x"), (3, "n")}


def test_resumed_sink_adds_only_new_keys(spark, tmp_path):
    p = str(tmp_path / "t")
    files.append_missing(spark.createDataFrame([(1, "a")], "k long, v string"), p, "k")
    files.append_missing(spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"), p, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "c")]


def test_docx_and_salvage(spark):
    import io
    import zipfile

    body = io.BytesIO()
    xml = '<w:document xmlns:w="w"><w:p><w:t>Hello</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:document>'
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", xml)
    assert files.docx(body.getvalue()) == "Hello\n\na | b"
    assert one(spark, W.legacy_text(F.lit("\x00This is a readable line of text\x00123"))) == "This is a readable line of text"


def test_round_robin_takes_arms_in_turn(spark):
    df = spark.createDataFrame([("b", "x", k) for k in range(10)] + [("b", "y", 100)], "bucket string, arm string, k long")
    got = labels.round_robin(df, "bucket", "arm", "k", 4, "s").collect()
    assert len(got) == 4 and sum(r["arm"] == "y" for r in got) == 1


def test_uuid5_is_the_standard_one(spark):
    import uuid

    assert one(spark, T.uuid5(str(uuid.NAMESPACE_URL), F.lit("é:1"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "é:1"))


def test_label_stream_keeps_the_last(spark, tmp_path):
    from sparkloom.streaming import label_log

    schema, src = "k string, label string, ts timestamp", tmp_path / "in"
    def add(rows):
        spark.createDataFrame(rows, "k string, label string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").json(str(src))
        label_log.keep_latest(spark.readStream.schema(schema).json(str(src)), ["k"], "ts", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    add([("a", "yes", "2024-01-01 00:00:00"), ("b", "no", "2024-01-01 00:00:00")])
    add([("a", "no", "2024-01-02 00:00:00"), ("b", "no", "2024-01-01 00:00:00")])
    assert {(r["k"], r["label"]) for r in label_log.current(spark, str(tmp_path / "out")).collect()} == {("a", "no"), ("b", "no")}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert retrieval.bm25(retrieval.build_index(docs, F.col("text")), q, 3).count() == 0
    assert chunking.chunks(spark.createDataFrame([], "slug string, page int, text string"), 5).count() == 0


def test_approximate_neighbours_find_nine_in_ten(spark):
    from sparkloom.plans import queries

    from harness import SMALL

    exact, near = ({(r["query_id"], r["doc_id"]) for r in queries()[n](spark, SMALL).collect()} for n in ("cosine_topk", "approximate_knn"))
    assert len(exact & near) >= 0.9 * len(exact)


def test_diverse_terms_avoid_repeats(spark):
    df = spark.createDataFrame([(1, "flooding", 1.0), (1, "flooded", 0.95), (1, "policy", 0.8)], "k long, t string, s double")
    got = [r["term"] for r in retrieval.diverse(df, "k", "t", "s", 2).orderBy("place").collect()]
    assert got == ["flooding", "policy"]


def test_ports_see_every_sentence_and_whole_texts(spark, tmp_path):
    from sparkloom.plans import stat_plans

    spark.createDataFrame([(1, "One is here. Two is here. Three. Four. Five."), (2, " " * 300 + "what does the end of this text say")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["q_idx"]) for r in stat_plans.cross_encoder_port(spark, str(tmp_path)).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    asked = {r["doc_id"]: r["questions"] for r in stat_plans.generated_questions(spark, str(tmp_path)).collect()}
    assert asked[2] == "What does the end of this?"


def test_entity_regions_of_long_names_and_many_regions(spark, tmp_path):
    from harness import assert_equal
    from sparkloom import plans

    spark.createDataFrame([(k, f"REGION{k}") for k in range(120)], "r_regionkey long, r_name string").coalesce(1).toPandas().to_parquet(tmp_path / "region.parquet")
    spark.createDataFrame([(40, "Isles Of The Far North", 119), (3, "Peru", 1)], "n_nationkey long, n_name string, n_regionkey long").toPandas().to_parquet(tmp_path / "nation.parquet")
    spark.createDataFrame([(1, "the isles of the far north and region118"), (2, "none")], "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    out = plans.queries()["entity_regions"](spark, str(tmp_path))
    assert out.filter("doc_id = 1").first()["countries"] == "Isles Of The Far North"
    assert_equal(out, plans.oracles()["entity_regions"], str(tmp_path))


def written_rows(folder):
    import pyarrow.parquet as pq

    return sum(pq.read_metadata(f).num_rows for f in folder.rglob("*.parquet"))


def test_runs_of_one_pass_equal_an_index_each(spark):
    texts = ["red fish, blue fish. Red", "red dog. ÉTÉ_1 ÉTÉ_1", "old cat sat on a blue mat. dog", None, "", "one", *["red red dog cat"] * 3]
    docs = spark.createDataFrame([(i, t, f"dog s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    q = spark.createDataFrame([(7, "blue blue fish"), (8, ""), (9, "zebra"), (10, "red dog cat été_1"), (None, "s1 dog")], "query_id long, text string")
    parts = {"t": T.tokens(F.col("text")), "s": T.tokens(F.col("source"))}
    whole = {"base": F.col("text"), "more": F.concat_ws(" ", "text", "source")}
    lists = lambda d: sorted(map(repr, d.collect()))
    for rows in (docs, docs.withColumn("doc_id", F.col("doc_id") % 4), docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), docs.limit(0)):
        for least in (1, 3):
            got = retrieval.ranked_runs(rows, parts, {"base": ["t"], "more": ["t", "s"]}, q, 2, least)
            for run, text in whole.items():
                want = retrieval.bm25(retrieval.build_index(rows, text, least), q, 2)
                assert lists(got.filter(F.col("run") == run).drop("run")) == lists(want), (run, least)


@pytest.mark.parametrize("name", ["count_ablation", "keep_fraction_sweep", "kendall_jaccard", "run_profile"])
def test_compared_runs_write_no_postings_each(spark, tmp_path, monkeypatch, name):
    from sparkloom.plans import metric_plans
    from sparkloom.sources import tables

    monkeypatch.setattr(tables, "scratch", lambda s: f"{tmp_path}/{uuid.uuid4().hex}")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text"))))).count()
    getattr(metric_plans, name)(spark, "/root/testdata/sf0.001").count()
    assert written_rows(tmp_path) < 1.5 * pairs


def test_run_profile_of_repeated_ids_equals_sql_and_writes_few_postings(spark, tmp_path, monkeypatch):
    import harness

    from sparkloom.plans import metric_plans, registry
    from sparkloom.sources import tables

    docs = spark.read.parquet(f"{harness.SMALL}/documents.parquet")
    twice = docs.withColumn("doc_id", F.when(F.col("doc_id") < 6, F.col("doc_id") % 2).when(F.col("doc_id") < 8, F.lit(None).cast("long")).otherwise(F.col("doc_id")))
    twice = twice.unionByName(twice.filter("doc_id = 9").withColumn("text", F.reverse("text")))
    items = spark.read.parquet(f"{harness.SMALL}/benchmark.parquet")
    first = F.repeat(F.lit(items.first()["text"] + " "), 8)  # so a null id comes first in some list
    twice = twice.withColumn("text", F.when(F.col("doc_id").isNull(), first).otherwise(F.col("text")))
    twice.toPandas().to_parquet(tmp_path / "documents.parquet")
    items.toPandas().to_parquet(tmp_path / "benchmark.parquet")
    sql = registry.ORACLES["run_profile"]
    harness.assert_equal(metric_plans.run_profile(spark, str(tmp_path)), sql, str(tmp_path))
    monkeypatch.setattr(tables, "scratch", lambda s: f"{tmp_path}/made/{uuid.uuid4().hex}")
    metric_plans.run_profile(spark, str(tmp_path)).count()
    pairs = twice.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text"))))).count()
    assert written_rows(tmp_path / "made") < 1.5 * pairs


def test_sentence_scores_count_words_that_the_text_has(spark):
    from sparkloom.plans.stat_plans import sentence_scores

    texts = ["One two. one ONE.  . three", "ΟΔΟΣ.ΑΒ ΟΔΟΣ. ΟΔΟΣ", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ws = T.tokens(F.col("text"))
    want = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", r"\."), lambda s: F.trim(s)), lambda s: s != "")).alias("q_idx", "question"), ws.alias("ws"))
    own = T.tokens(F.col("question"))
    want = want.select("doc_id", "q_idx", "question", F.round(F.size(F.array_intersect(own, "ws")) / F.greatest(F.size(F.array_distinct(own)), F.lit(1)) + F.size(own) / 1000, 6).alias("score"))
    got = docs.select("doc_id", F.posexplode(sentence_scores()).alias("q_idx", "p")).select("doc_id", "q_idx", "p.question", "p.score")
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() == 6

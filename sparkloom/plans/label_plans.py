"""Label logs, samples and cross-tabs: events stand for label records, labels for annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import stats as S
from .registry import load, query
from .stat_plans import _draw
from .text_plans import T

COL = F.col
_REL = "CASE WHEN value / 100 >= 0.30 THEN 'context' WHEN value / 100 <= 0.05 THEN 'parametric' ELSE 'mixed' END"


def marked(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("reliance", T.cti_bucket(COL("value") / 100))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY ALL")
def latest_label(spark, sf_dir):
    e = load(spark, sf_dir, "events", "user_id", "event_type", "ts", "event_id", "value")
    return L.latest(e.withColumn("seq", COL("event_id")), ["user_id", "event_type"], "ts", "seq").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("""
WITH s AS (SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0), d AS (SELECT event_id FROM events WHERE event_id % 2 = 0)
SELECT user_id, count(*) AS n_todo, round(1 - count(*) / max(n), 6) AS progress FROM s JOIN (SELECT user_id, count(*) AS n FROM s GROUP BY 1) t USING (user_id) WHERE event_id NOT IN (SELECT event_id FROM d) GROUP BY user_id
""")
def annotation_progress(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_id", "user_id")
    s = e.filter("event_id % 3 <> 0")
    left = L.todo(s, e.filter("event_id % 2 = 0"), "event_id").groupBy("user_id").agg(F.count("*").alias("n_todo"))
    return left.join(s.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").select("user_id", "n_todo", F.round(1 - COL("n_todo") / COL("n"), 6).alias("progress"))


@query(f"""
WITH e AS (SELECT event_id, {_REL} AS reliance, event_type FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY reliance, event_type ORDER BY {_draw("'9'", "event_id")}, event_id) AS round FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY reliance ORDER BY round, event_type) AS place FROM r)
SELECT reliance, event_type, event_id, place FROM p WHERE place <= 40
""")
def stratified_roundrobin(spark, sf_dir):
    return L.round_robin(marked(spark, sf_dir), "reliance", "event_type", "event_id", 40, "9").select("reliance", "event_type", "event_id", COL("place").cast("long").alias("place"))


@query(f"SELECT event_id, {_draw("'11'", "event_id")} AS draw FROM events ORDER BY draw, event_id")
def random_order(spark, sf_dir):
    """A final order by hash."""
    e = load(spark, sf_dir, "events", "event_id")
    return e.withColumn("draw", S.hash_draw("11", COL("event_id"))).orderBy("draw", "event_id")


@query("""
WITH r AS (SELECT item_id, unnest([item_id * 3, item_id * 7 + 1, 999999999]) AS id, generate_subscripts([1, 2, 3], 1) AS place FROM benchmark)
SELECT item_id, string_agg(r.id || '=' || left(coalesce(text, '(chunk text not found)'), 20), '|' ORDER BY place) AS passages FROM r LEFT JOIN documents d ON d.doc_id = r.id GROUP BY item_id
""")
def passage_resolution(spark, sf_dir):
    r = load(spark, sf_dir, "benchmark", "item_id").withColumn("ids", F.array(COL("item_id") * 3, COL("item_id") * 7 + 1, F.lit(999999999).cast("long")))
    p = L.passages(r, load(spark, sf_dir, "documents").select(COL("doc_id").alias("chunk_id"), "text"))
    return p.select("item_id", F.array_join(F.transform("passages", lambda x: F.concat(x["chunk_id"].cast("string"), F.lit("="), F.left(x["text"], F.lit(20)))), "|").alias("passages"))


@query(f"""
WITH e AS (SELECT {_REL} AS reliance, event_type FROM events), c AS (SELECT reliance, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM e GROUP BY reliance)
SELECT reliance, click, view, purchase, click + view + purchase AS total FROM c UNION ALL SELECT 'all', CAST(sum(click) AS BIGINT), CAST(sum(view) AS BIGINT), CAST(sum(purchase) AS BIGINT), CAST(sum(click + view + purchase) AS BIGINT) FROM c
""")
def crosstab_rollup(spark, sf_dir):
    return L.crosstab(marked(spark, sf_dir), "reliance", "event_type", ["click", "view", "purchase"])


@query(f"""
WITH e AS (SELECT {_REL} AS reliance, event_type FROM events)
SELECT coalesce(reliance, 'all') AS reliance, coalesce(event_type, 'all') AS event_type, count(*) AS n, CAST(grouping(reliance) AS INTEGER) AS level FROM e GROUP BY ROLLUP (reliance, event_type)
""")
def rollup_totals(spark, sf_dir):
    r = marked(spark, sf_dir).rollup("reliance", "event_type").agg(F.count("*").alias("n"), F.grouping("reliance").cast("int").alias("level"))
    return r.select(F.coalesce("reliance", F.lit("all")).alias("reliance"), F.coalesce("event_type", F.lit("all")).alias("event_type"), "n", "level")


@query(f"""
WITH e AS (SELECT event_type, {_REL} AS reliance, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY event_type), 1) AS pct FROM e)
SELECT event_type, string_agg(reliance || '=' || n, ', ' ORDER BY reliance) AS distribution, max(pct) AS largest_pct FROM p GROUP BY event_type
""")
def label_distribution(spark, sf_dir):
    from pyspark.sql import Window

    e = marked(spark, sf_dir).groupBy("event_type", "reliance").agg(F.count("*").alias("n"))
    e = e.withColumn("pct", L.percent(COL("n"), F.sum("n").over(Window.partitionBy("event_type"))))
    parts = F.array_sort(F.collect_list(F.concat_ws("=", "reliance", COL("n").cast("string"))))
    return e.groupBy("event_type").agg(F.array_join(parts, ", ").alias("distribution"), F.max("pct").alias("largest_pct"))


_CAL = "SELECT CASE WHEN n_chars < 800 THEN 'low' WHEN n_chars < 3000 THEN 'mid' ELSE 'high' END AS bucket, quality, toxic FROM labels JOIN documents USING (doc_id)"


@query(f"""
WITH c AS (SELECT bucket, CAST(count(*) AS BIGINT) AS n, CAST(sum(quality) AS BIGINT) AS k FROM ({_CAL}) GROUP BY bucket)
SELECT bucket, n, k, round(k / n, 6) AS share, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM c
""")
def bucket_calibration(spark, sf_dir):
    b = F.when(COL("n_chars") < 800, "low").when(COL("n_chars") < 3000, "mid").otherwise("high")
    c = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents", "doc_id", "n_chars"), "doc_id").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("k"))
    return c.select("bucket", "n", "k", *S.wilson(COL("k"), COL("n")))


_HIT = "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 2 = 0 END"


@query(f"""
WITH e AS (SELECT *, {_REL} AS reliance, {_HIT} AS hit, event_type || ':' || user_id AS key FROM events)
SELECT split_part(key, ':', 1) AS condition, count(*) FILTER (reliance = 'parametric' AND hit = false) AS hallucinated, count(*) FILTER (reliance = 'parametric' AND hit IS NULL) AS untraced, count(*) FILTER (value >= 50) AS correct FROM e GROUP BY 1
""")
def hallucination_cell(spark, sf_dir):
    e = marked(spark, sf_dir).withColumn("hit", F.expr(_HIT)).withColumn("key", F.concat_ws(":", "event_type", COL("user_id").cast("string")))
    p = COL("reliance") == "parametric"
    return e.groupBy(F.substring_index("key", ":", 1).alias("condition")).agg(F.count_if(p & ~COL("hit")).alias("hallucinated"), F.count_if(p & COL("hit").isNull()).alias("untraced"), F.count_if(COL("value") >= 50).alias("correct"))


@query(f"SELECT event_id, user_id FROM events WHERE {_REL} = 'mixed' AND event_type = 'click' ORDER BY event_id LIMIT 50")
def drill_down(spark, sf_dir):
    """A report of at most 50 rows of one cell."""
    return marked(spark, sf_dir).filter("reliance = 'mixed' AND event_type = 'click'").orderBy("event_id").limit(50).select("event_id", "user_id")


@query("SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND contains(lower(text), lower('Tion'))")
def search_filter(spark, sf_dir):
    return load(spark, sf_dir, "conversations").filter(COL("role").isin("user", "assistant") & F.contains(F.lower("text"), F.lit("tion"))).select("conv_id", "turn")


@query(f"SELECT {_HIT} AS hit, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY hit")
def value_by_hit(spark, sf_dir):
    q = lambda p, n: F.round(F.percentile("value", F.lit(p)), 6).alias(n)
    return load(spark, sf_dir, "events").groupBy(F.expr(_HIT).alias("hit")).agg(F.count("*").alias("n"), q(0.25, "q1"), q(0.5, "median"), q(0.75, "q3"))


@query("""
WITH s AS (SELECT DISTINCT left(text, 10 + turn * 5) AS span FROM conversations), a AS (SELECT 'shortest' AS kind, span FROM s ORDER BY length(span), span LIMIT 6), b AS (SELECT 'longest' AS kind, span FROM s ORDER BY length(span) DESC, span LIMIT 3)
SELECT * FROM a UNION ALL SELECT * FROM b
""")
def span_length_profile(spark, sf_dir):
    """A report: the six shortest and three longest distinct spans."""
    s = load(spark, sf_dir, "conversations").select(F.left("text", (10 + COL("turn") * 5).cast("int")).alias("span")).distinct()
    return s.orderBy(F.length("span"), "span").limit(6).select(F.lit("shortest").alias("kind"), "span").unionByName(s.orderBy(F.desc(F.length("span")), "span").limit(3).select(F.lit("longest").alias("kind"), "span"))


@query("SELECT count(*) AS n, count(*) FILTER (text <> '') AS with_text, count(*) FILTER (n_chars > 500) AS with_body, count(DISTINCT source) AS n_sources FROM documents")
def progress_counters(spark, sf_dir):
    return load(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(COL("text") != "").alias("with_text"), F.count_if(COL("n_chars") > 500).alias("with_body"), F.count_distinct("source").alias("n_sources"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) ORDER BY c_custkey")
def semi_join(spark, sf_dir):
    return load(spark, sf_dir, "customer", "c_custkey", "c_name").join(load(spark, sf_dir, "orders").select(COL("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").orderBy("c_custkey")

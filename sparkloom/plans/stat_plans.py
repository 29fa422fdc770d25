"""Statistics and sampling over orders, events, labels and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ports
from ..operators import stats as S
from ..sources.tables import stored
from .registry import load, query
from .text_plans import T

COL = F.col
REPS = 100


def _draw(*parts: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 8) AS BIGINT)"


def _clusters(where: str = "true", value: str = "o_totalprice / 1000") -> str:
    return f"SELECT o_custkey, sum({value}) AS s, sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS f, count(*) AS n FROM orders WHERE {where} GROUP BY o_custkey"


def _boot(name: str, where: str, seed: str) -> str:
    return f"""{name}_c AS (SELECT *, row_number() OVER (ORDER BY o_custkey) - 1 AS place FROM ({_clusters(where)})), {name}_n AS (SELECT count(*) AS t FROM {name}_c),
{name} AS (SELECT rep, sum(s) / sum(n) AS s, sum(f) / sum(n) AS f FROM (SELECT rep, {_draw(f"'{seed}'", "rep", "draw")} % t AS place FROM {name}_n, range({REPS}) r(rep), range(t) d(draw)) JOIN {name}_c USING (place) GROUP BY rep)"""


def _cluster_sums(spark, sf_dir, where="true"):
    return load(spark, sf_dir, "orders").filter(where).groupBy("o_custkey").agg(F.sum(COL("o_totalprice") / 1000).alias("s"), F.sum((COL("o_orderstatus") == "F").cast("double")).alias("f"), F.count("*").alias("n"))


@query(f"WITH {_boot('b', 'true', 'q1')} SELECT count(*) AS reps, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM b")
def bootstrap_clusters(spark, sf_dir):
    """Interval of a mean with customers as clusters of orders."""
    return S.bootstrap(_cluster_sums(spark, sf_dir), "o_custkey", ["s"], REPS, "q1").agg(F.count("*").alias("reps"), *S.interval(COL("s")))


@query(f"WITH {_boot('b', 'true', 'q2')} SELECT round(quantile_cont(s / 100 - f, 0.025), 6) AS low, round(quantile_cont(s / 100 - f, 0.975), 6) AS high FROM b")
def bootstrap_paired(spark, sf_dir):
    """Two measures on one set of draws: the interval of their difference."""
    return S.bootstrap(_cluster_sums(spark, sf_dir), "o_custkey", ["s", "f"], REPS, "q2").agg(*S.interval(COL("s") / 100 - COL("f")))


@query(f"WITH {_boot('x', 'o_orderkey % 2 = 0', 'qa')}, {_boot('y', 'o_orderkey % 2 = 1', 'qb')} SELECT round(quantile_cont(x.s - y.s, 0.025), 6) AS low, round(quantile_cont(x.s - y.s, 0.975), 6) AS high FROM x JOIN y USING (rep)")
def bootstrap_unpaired(spark, sf_dir):
    """Each side resampled on its own (even and odd orders are the two arms)."""
    a, b = (S.bootstrap(_cluster_sums(spark, sf_dir, f"o_orderkey % 2 = {k}"), "o_custkey", ["s"], REPS, seed) for k, seed in ((0, "qa"), (1, "qb")))
    return a.join(b.withColumnRenamed("s", "t"), "rep").agg(*S.interval(COL("s") - COL("t")))


@query()
def bootstrap_numpy_mode(spark, sf_dir):
    """NumPy's generator on one value per region: parity with published intervals, rows only."""
    n = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").cast("double").alias("v"))
    return S.bootstrap_numpy(n, "v", 200).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_SEEDS = ", ".join(f"""s{k} AS (SELECT rep, sum(s) / sum(n) AS s FROM (SELECT rep, {_draw(f"'seed{k}'", "rep", "draw")} % t AS place FROM n, range(40) r(rep), range(t) d(draw)) JOIN c USING (place) GROUP BY rep)""" for k in range(5))


@query(f"WITH c AS (SELECT *, row_number() OVER (ORDER BY o_custkey) - 1 AS place FROM ({_clusters()})), n AS (SELECT count(*) AS t FROM c), {_SEEDS}, l AS (" + " UNION ALL ".join(f"SELECT round(quantile_cont(s, 0.025), 6) AS low FROM s{k}" for k in range(5)) + ") SELECT min(low) AS least, max(low) AS most, round(stddev_samp(low), 6) AS sd FROM l")
def seed_stability(spark, sf_dir):
    """Least, greatest and spread of the lower end over seeds."""
    c = stored(_cluster_sums(spark, sf_dir))
    lows = reduce(lambda a, b: a.unionByName(b), [S.bootstrap(c, "o_custkey", ["s"], 40, f"seed{k}").agg(*S.interval(COL("s"))) for k in range(5)])
    return lows.agg(F.min("low").alias("least"), F.max("low").alias("most"), F.round(F.stddev_samp("low"), 6).alias("sd"))


_HITS = "SELECT o_orderkey AS q, (o_orderkey % 7 < 3) AS base, (o_orderkey % 5 < 3) AS a, (o_orderkey % 11 < 6) AS b, o_orderstatus = 'F' AS c FROM orders"


@query(f"""
WITH h AS ({_HITS}), d AS (
  SELECT '1 base-a' AS pair, count(*) FILTER (base AND NOT a) AS n01, count(*) FILTER (a AND NOT base) AS n10 FROM h UNION ALL
  SELECT '2 a-b', count(*) FILTER (a AND NOT b), count(*) FILTER (b AND NOT a) FROM h UNION ALL
  SELECT '3 b-c', count(*) FILTER (b AND NOT c), count(*) FILTER (c AND NOT b) FROM h UNION ALL
  SELECT '4 base-c', count(*) FILTER (base AND NOT c), count(*) FILTER (c AND NOT base) FROM h UNION ALL
  SELECT '5 base-base', 0, 0 FROM h GROUP BY 1),
p AS (SELECT pair, n01, n10, CASE WHEN n01 + n10 = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2))) FROM range(least(n01, n10) + 1) r(i))) END AS p FROM d),
s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY round(p, 9), pair) + 1) * p AS s FROM p)
SELECT *, CASE WHEN p_holm < 0.001 THEN '***' WHEN p_holm < 0.01 THEN '**' WHEN p_holm < 0.05 THEN '*' ELSE '' END AS stars
FROM (SELECT pair, n01, n10, round(p, 6) AS p, round(least(1.0, max(s) OVER (ORDER BY round(p, 9), pair ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM s)
""")
def mcnemar_holm(spark, sf_dir):
    """Adjacent runs, and the first against the last."""
    h = load(spark, sf_dir, "orders").select((COL("o_orderkey") % 7 < 3).alias("base"), (COL("o_orderkey") % 5 < 3).alias("a"), (COL("o_orderkey") % 11 < 6).alias("b"), (COL("o_orderstatus") == "F").alias("c"))
    pairs = [("1 base-a", "base", "a"), ("2 a-b", "a", "b"), ("3 b-c", "b", "c"), ("4 base-c", "base", "c"), ("5 base-base", "base", "base")]
    counts = h.agg(*(F.struct(F.lit(n).alias("pair"), F.count_if(COL(x) & ~COL(y)).alias("n01"), F.count_if(COL(y) & ~COL(x)).alias("n10")).alias(f"_{i}") for i, (n, x, y) in enumerate(pairs)))
    d = counts.select(F.inline(F.array(*(COL(f"_{i}") for i in range(len(pairs))))))
    d = d.withColumn("p", S.mcnemar(COL("n01"), COL("n10"))).withColumn("_p", F.round("p", 9))
    held = S.holm(d, "_p").select("pair", "n01", "n10", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))
    return held.withColumn("stars", S.stars(COL("p_holm")))


@query("SELECT o_orderpriority AS g, round(avg(x) / stddev_samp(x), 6) AS d, round(stddev_pop(x), 4) AS population_sd, count(*) AS n FROM (SELECT *, o_totalprice - 150000 AS x FROM orders) GROUP BY g")
def effect_size(spark, sf_dir):
    return load(spark, sf_dir, "orders").withColumn("x", COL("o_totalprice") - 150000).groupBy(COL("o_orderpriority").alias("g")).agg(S.cohens_d("x").alias("d"), F.round(F.stddev_pop("x"), 4).alias("population_sd"), F.count("*").alias("n"))


@query("""
WITH x AS (SELECT event_type, round(value, 0) AS a, CAST(event_id % 50 AS DOUBLE) AS b, value FROM events),
r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY a) + (count(*) OVER (PARTITION BY event_type, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY event_type ORDER BY b) + (count(*) OVER (PARTITION BY event_type, b) - 1) / 2.0 AS rb FROM x)
SELECT event_type, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY event_type
""")
def spearman_rank(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", F.round("value", 0).alias("a"), (COL("event_id") % 50).cast("double").alias("b"))
    return S.spearman(e, "a", "b", "event_type")


@query("""
WITH p AS (SELECT value / 100 AS x, value / 100 + ((event_id % 21) - 10) / 200.0 AS y FROM events)
SELECT round(avg(y - x), 6) AS bias, round(median(abs(y - x)), 6) AS median_abs, round(corr(x, y), 6) AS r, round(avg(CASE WHEN abs(y - x) > 0.04 THEN 1.0 ELSE 0.0 END), 6) AS over_share,
round(avg(y - x) - 1.96 * stddev_samp(y - x), 6) AS low, round(avg(y - x) + 1.96 * stddev_samp(y - x), 6) AS high, corr(x, y) >= 0.95 AND median(abs(y - x)) <= 0.05 AS passed FROM p
""")
def bland_altman(spark, sf_dir):
    p = load(spark, sf_dir, "events").select((COL("value") / 100).alias("x"), (COL("value") / 100 + ((COL("event_id") % 21) - 10) / 200.0).alias("y")).withColumn("d", COL("y") - COL("x"))
    sd = F.stddev_samp("d")
    return p.agg(F.round(F.avg("d"), 6).alias("bias"), F.round(F.median(F.abs("d")), 6).alias("median_abs"), F.round(F.corr("x", "y"), 6).alias("r"), F.round(F.avg((F.abs("d") > 0.04).cast("double")), 6).alias("over_share"), F.round(F.avg("d") - 1.96 * sd, 6).alias("low"), F.round(F.avg("d") + 1.96 * sd, 6).alias("high"), ((F.corr("x", "y") >= 0.95) & (F.median(F.abs("d")) <= 0.05)).alias("passed"))


_SCORED = "SELECT l.doc_id, l.quality AS y, l.toxic, d.lang, CAST(d.n_chars // 100 AS DOUBLE) AS score FROM labels l JOIN documents d USING (doc_id)"


@query(f"""
WITH x AS ({_SCORED}), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM x)
SELECT lang, sum(y) :: BIGINT AS n_pos, sum(1 - y) :: BIGINT AS n_neg, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) END AS auc FROM r GROUP BY lang
""")
def auc_by_language(spark, sf_dir):
    return S.auc(_scored(spark, sf_dir), "score", "y", "lang")


def _scored(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    return load(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", COL("quality").alias("y"), "toxic", "lang", F.floor(COL("n_chars") / 100).cast("double").alias("score"))


_WILSON = """round(k / n, 6) AS share, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high"""


@query(f"WITH x AS ({_SCORED}), c AS (SELECT t AS threshold, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS k FROM x JOIN (VALUES (5.0), (10.0), (20.0), (50.0)) v(t) ON score >= t GROUP BY t) SELECT CAST(threshold AS DOUBLE) AS threshold, n, k, {_WILSON} FROM c")
def threshold_sweep(spark, sf_dir):
    """Precision of flagging at each threshold, with its interval; thresholds are a few literals."""
    bars = spark.createDataFrame([(5.0,), (10.0,), (20.0,), (50.0,)], "threshold double")
    c = _scored(spark, sf_dir).join(F.broadcast(bars), COL("score") >= COL("threshold")).groupBy("threshold").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("k"))
    return c.select("threshold", "n", "k", *S.wilson(COL("k"), COL("n")))


@query("SELECT event_type, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN value < 10 THEN 1.0 ELSE 0.0 END), 6) AS under_10, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 6) AS under_50 FROM events GROUP BY event_type")
def percentile_profile(spark, sf_dir):
    p = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    under = [F.round(F.avg((COL("value") < t).cast("double")), 6).alias(f"under_{t}") for t in (10, 50)]
    return load(spark, sf_dir, "events").groupBy("event_type").agg(*(F.round(F.percentile("value", F.lit(q)), 6).alias(n) for n, q in p.items()), *under)


def _pairs(spark, sf_dir):
    """(document, sentence) pairs: every sentence of every document stands for a question it would have got."""
    d = load(spark, sf_dir, "documents", "doc_id", "text")
    q = F.filter(F.transform(F.split("text", r"\."), lambda s: F.trim(s)), lambda s: s != "")
    return d.select("doc_id", F.posexplode(q).alias("q_idx", "question"))


_PAIRS = r"""SELECT doc_id, q_idx, question, len(regexp_extract_all(lower(question), '[\p{L}\p{M}\p{N}_]+')) AS nq, len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{M}\p{N}_]+')), list_distinct(ws))) AS hit, len(list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{M}\p{N}_]+'))) AS nd
FROM (SELECT doc_id, unnest(qs) AS question, generate_subscripts(qs, 1) - 1 AS q_idx, ws FROM (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda s: trim(s)), lambda s: s <> '') AS qs, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS ws FROM documents))"""


def sentence_scores(text="text"):
    """A document's sentences as question, words, score. A sentence's words are words of its text, since no word holds a full stop; only a
    capital sigma's lower case depends on what stands near, so texts with one are searched, once, for words that they lack."""
    sentences = F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), lambda s: s != "")
    cut = F.transform(sentences, lambda s: F.struct(s.alias("question"), T.tokens(s).alias("words")))

    def scored(cut, lacking):
        def score(own, n):
            return F.round((F.size(own) - F.when(F.size(lacking) == 0, 0).otherwise(F.size(F.array_intersect(own, lacking)))) / F.greatest(F.size(own), F.lit(1)) + n / 1000, 6)

        return F.transform(cut, lambda x: F.struct(x["question"].alias("question"), x["words"].alias("words"), T.let(F.array_distinct(x["words"]), lambda own: score(own, F.size(x["words"]))).alias("score")))

    lacking = lambda cut: F.when(F.contains(COL(text), F.lit("Σ")), F.array_except(F.flatten(F.transform(cut, lambda x: x["words"])), T.tokens(COL(text)))).otherwise(T.texts([]).cast("array<string>"))
    return T.let(cut, lambda c: T.let(lacking(c), lambda gone: scored(c, gone)))


def scored_pairs(spark, sf_dir):
    """Scores are made inside the document's row, where its words are at hand once; only sentences and scores leave it."""
    d = load(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.posexplode(sentence_scores()).alias("q_idx", "p")).select("doc_id", "q_idx", "p.question", "p.score")


@query(f"WITH p AS ({_PAIRS}) SELECT doc_id, CAST(q_idx AS INTEGER) AS q_idx, round(hit / greatest(nd, 1) + nq / 1000, 6) AS score FROM p WHERE doc_id % 4 <> 0")
def score_pairs(spark, sf_dir):
    """Pairs not yet in the cache (documents of a fourth of the ids are) get a score; arguments go in as (text, question)."""
    cached = load(spark, sf_dir, "documents", "doc_id").filter("doc_id % 4 = 0")
    return scored_pairs(spark, sf_dir).join(cached, "doc_id", "left_anti").select("doc_id", "q_idx", "score")


@query(f"""WITH p AS (SELECT doc_id, q_idx, question, round(hit / greatest(nd, 1) + nq / 1000, 6) AS score FROM ({_PAIRS})), k AS (
""" + " UNION ALL ".join(f"SELECT {f} AS keep, doc_id, q_idx FROM p WHERE score >= (SELECT {'min(score)' if f == 1.0 else f'quantile_cont(score, {round(1 - f, 2)})'} FROM p)" for f in (1.0, 0.75, 0.5, 0.25)) + ") SELECT CAST(keep AS DOUBLE) AS keep, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM k GROUP BY keep")
def keep_fraction(spark, sf_dir):
    """One threshold over all scores for each fraction; documents left without questions drop out."""
    p, every = stored(scored_pairs(spark, sf_dir)), None
    for f in (1.0, 0.75, 0.5, 0.25):
        one = S.keep_fraction(p, f).select(F.lit(f).alias("keep"), "doc_id")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("keep").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_draw("'42'", "doc_id")}, doc_id) AS i FROM documents)
SELECT doc_id, source FROM r WHERE i = 1 ORDER BY {_draw("'42'", "source")}, source LIMIT 12""")
def sample_one_per_group(spark, sf_dir):
    """At most one a group, the first 12 groups in hash order (a sampling operator): the least hash of a group by an aggregate, not a window."""
    d = load(spark, sf_dir, "documents", "doc_id", "source").withColumn("h", S.hash_draw("42", COL("doc_id")))
    one = d.groupBy("source").agg(F.min_by("doc_id", F.struct("h", "doc_id")).alias("doc_id"))
    return one.orderBy(S.hash_draw("42", COL("source")), "source").limit(12).select("doc_id", "source")


@query(f"""WITH p AS (SELECT doc_id, q_idx, question FROM ({_PAIRS})), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_draw("'7'", "doc_id", "q_idx")}) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
SELECT doc_id, CAST(q_idx AS INTEGER) AS q_idx, CASE WHEN doc_id % 2 = 0 AND i = 1 THEN 'held_out' WHEN i = 1 THEN 'unused' ELSE 'indexed' END AS part FROM r WHERE n >= 2""")
def holdout_split(spark, sf_dir):
    """Even ids are the evaluation chunks; the others leave out as many, so all are indexed to equal depth; chunks with too few are skipped."""
    p = _pairs(spark, sf_dir).select("doc_id", "q_idx")
    qs = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(S.hash_draw("7", COL("doc_id"), COL("q_idx")).alias("h"), "q_idx"))).alias("qs")).filter(F.size("qs") >= 2)
    part = F.when(COL("i") > 0, "indexed").when(COL("doc_id") % 2 == 0, "held_out").otherwise("unused")
    return qs.select("doc_id", F.posexplode("qs").alias("i", "q")).select("doc_id", "q.q_idx", part.alias("part"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, i // CAST(ceil(n / 7.0) AS BIGINT) AS range_shard, i % 7 AS modulo_shard FROM r")
def shards(spark, sf_dir):
    """Contiguous and modulo shards from one global row number. The number comes from counts of key ranges plus a number inside each, so no
    task sorts all rows."""
    d = load(spark, sf_dir, "documents", "doc_id")
    n = d.count()
    cuts = d.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / 16) for k in range(1, 16)]), 10_000).alias("c")).first()[0] if n else []
    d = d.withColumn("b", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>"), lambda c: c < COL("doc_id"))))
    before = d.groupBy("b").agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("b")) - COL("m")).select("b", "before")
    i = d.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("doc_id"))).join(F.broadcast(before), "b").withColumn("i", COL("before") + COL("r") - 1)
    return i.select("doc_id", F.floor(COL("i") / -(-n // 7)).alias("range_shard"), (COL("i") % 7).alias("modulo_shard"))


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn AND d.turn % 2 = 0)")
def resume_anti_join(spark, sf_dir):
    """What a resumed run still has to do: composite keys without a finished record."""
    c = load(spark, sf_dir, "conversations", "conv_id", "turn")
    return c.join(c.filter("turn % 2 = 0"), ["conv_id", "turn"], "left_anti")


@query()
def generated_questions(spark, sf_dir):
    """The generator port with its offline stand-in, given whole texts, cleaned by the question parser."""
    d = load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", COL("text").alias("prompt"))
    made = ports.generate(d, lambda: ports.first_sentence_asker(), "prompt", "raw")
    return made.select("doc_id", F.array_join(T.parse_questions(COL("raw"), 3), "|").alias("questions"))


@query()
def cross_encoder_port(spark, sf_dir):
    """The pair scorer port with its offline stand-in, for every sentence of every document."""
    score = ports.score_pairs(lambda: ports.overlap_scorer())
    texts = load(spark, sf_dir, "documents", "doc_id", F.array_join(T.tokens(COL("text")), " ").alias("words"))
    return _pairs(spark, sf_dir).join(texts, "doc_id").select("doc_id", "q_idx", score(COL("words"), COL("question")).alias("score"))

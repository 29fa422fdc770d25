"""Provenance and reliance over conversations (answers), documents (corpus) and events (recorded cells)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import provenance as P
from ..operators import retrieval as R
from ..operators import stats as S
from ..sources.tables import stored
from .registry import load, query
from .text_plans import T

COL = F.col
_CLAIMS = r"""SELECT conv_id, turn, unnest(cs) AS claim, generate_subscripts(cs, 1) - 1 AS claim_idx FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z"''“])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS cs FROM conversations WHERE role = 'assistant')"""
_SPANS = "SELECT conv_id, turn, CASE WHEN claim_idx % 2 = 0 THEN left(claim, 40) ELSE '  ' || claim || ' and more' END AS span, claim_idx AS span_idx FROM c WHERE claim_idx % 3 < 2"
_NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"


def claims_and_spans(spark, sf_dir):
    d = load(spark, sf_dir, "conversations").filter("role = 'assistant'")
    claims = d.select("conv_id", "turn", F.posexplode(T.claims(COL("text"))).alias("claim_idx", "claim"))
    span = F.when(COL("claim_idx") % 2 == 0, F.left("claim", F.lit(40))).otherwise(F.concat(F.lit("  "), "claim", F.lit(" and more")))
    return claims, claims.filter("claim_idx % 3 < 2").select("conv_id", "turn", span.alias("span"), COL("claim_idx").alias("span_idx"))


@query(rf"""
WITH c AS ({_CLAIMS}), s AS (SELECT *, {_NORM.format("span")} AS ns FROM ({_SPANS})), g AS (SELECT * FROM s WHERE length(ns) >= 16 AND len(string_split(ns, ' ')) >= 3),
h AS (SELECT conv_id, turn, claim_idx, count(*) AS n FROM (SELECT *, {_NORM.format("claim")} AS nc FROM c) c JOIN g USING (conv_id, turn) WHERE contains(nc, ns) OR contains(ns, nc) GROUP BY ALL)
SELECT conv_id, turn, CAST(claim_idx AS INTEGER) AS claim_idx, coalesce(n, 0) AS n_spans, CASE WHEN reliance IN ('context', 'mixed') THEN CASE WHEN hit IS NULL THEN 'grounded?' WHEN hit THEN 'both' ELSE 'rag' END ELSE CASE WHEN hit IS NULL THEN 'memory?' WHEN hit THEN 'parametric' ELSE 'unverified' END END AS label,
 CASE WHEN hit IS NULL THEN 'uncorroborated' WHEN reliance IN ('context', 'mixed') THEN 'corpus' WHEN hit THEN 'parametric' ELSE 'unverified' END AS provenance,
 CASE WHEN reliance = 'context' THEN CASE WHEN hit IS NULL THEN 'context-use (trace n/a)' WHEN hit THEN 'corpus-grounded use' ELSE 'context-driven, novel' END ELSE CASE WHEN hit IS NULL THEN 'parametric? (trace n/a)' WHEN hit THEN 'parametric recall' ELSE 'UNVERIFIED (hallucination signal)' END END AS quadrant
FROM (SELECT c.*, n, CASE WHEN c.conv_id % 5 = 0 THEN NULL ELSE n IS NOT NULL END AS hit, CASE (c.conv_id + c.claim_idx) % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'mixed' ELSE 'parametric' END AS reliance FROM c LEFT JOIN h ON h.conv_id = c.conv_id AND h.turn = c.turn AND h.claim_idx = c.claim_idx)
""")
def span_trace(spark, sf_dir):
    """Claims against trace spans of their own answer, and the labels; answers of every fifth conversation have no trace (null)."""
    claims, spans = claims_and_spans(spark, sf_dir)
    pairs = P.contained(claims, spans.filter(P.long_enough(COL("span"))), "conv_id", "turn").groupBy("conv_id", "turn", "claim_idx").agg(F.count("*").alias("n"))
    j = claims.join(pairs, ["conv_id", "turn", "claim_idx"], "left")
    hit = F.when(COL("conv_id") % 5 != 0, COL("n").isNotNull())
    rel = F.when((COL("conv_id") + COL("claim_idx")) % 3 == 0, "context").when((COL("conv_id") + COL("claim_idx")) % 3 == 1, "mixed").otherwise("parametric")
    return j.select("conv_id", "turn", "claim_idx", F.coalesce("n", F.lit(0)).alias("n_spans"), P.cell_label(rel, hit).alias("label"), P.cell_provenance(rel, hit).alias("provenance"), P.quadrant(rel, hit).alias("quadrant"))


@query(rf"""
WITH c AS ({_CLAIMS}), s AS (SELECT *, {_NORM.format("span")} AS ns FROM ({_SPANS}))
SELECT conv_id, turn, CAST(claim_idx AS INTEGER) AS claim_idx, count(*) AS n_matches FROM (SELECT *, {_NORM.format("claim")} AS nc FROM c) c JOIN s USING (conv_id, turn) WHERE contains(nc, ns) AND len(string_split(ns, ' ')) >= 6 GROUP BY ALL
""")
def one_way_containment(spark, sf_dir):
    claims, spans = claims_and_spans(spark, sf_dir)
    return P.contained(claims, spans, "conv_id", "turn", both_ways=False, least_words=6).groupBy("conv_id", "turn", "claim_idx").agg(F.count("*").alias("n_matches"))


@query(rf"""
WITH p AS (SELECT DISTINCT text AS phrase, {_NORM.format("text")} AS p FROM benchmark), d AS (SELECT doc_id, {_NORM.format("text")} AS d FROM documents),
f AS (SELECT phrase, doc_id, CAST((length(d) - length(replace(d, p, ''))) / length(p) AS BIGINT) AS n FROM p JOIN d ON contains(d, p))
SELECT p.phrase, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, coalesce(array_to_string(list_sort(list(DISTINCT doc_id))[1:2], ','), '') AS docs, coalesce(sum(n), 0) > 0 AND coalesce(sum(n), 0) <= 500 AS distinctive FROM p LEFT JOIN f USING (phrase) GROUP BY p.phrase
""")
def phrase_rarity(spark, sf_dir):
    n = P.phrase_counts(load(spark, sf_dir, "benchmark").select(COL("text").alias("phrase")), load(spark, sf_dir, "documents", "doc_id", "text"))
    return n.select("phrase", "n", F.coalesce(F.array_join("docs", ","), F.lit("")).alias("docs"), ((COL("n") > 0) & (COL("n") <= 500)).alias("distinctive"))


@query(r"""
WITH r AS (SELECT conv_id AS key, turn, role, trim(' ' || left(text, 30) || ' ') AS span, CASE WHEN turn % 2 = 0 THEN 'Pre-training' ELSE 'SFT' END AS usage FROM conversations)
SELECT key, span, CAST(count(*) AS INTEGER) AS n_matches FROM r WHERE usage = 'Pre-training' AND span <> '' GROUP BY key, span
""")
def trace_reshape(spark, sf_dir):
    doc = F.struct(COL("role").alias("source"), F.when(COL("turn") % 2 == 0, "Pre-training").otherwise("SFT").alias("usage"), F.array(F.concat(F.lit(" "), F.left("text", F.lit(30)), F.lit(" "))).alias("spans"), COL("text").alias("snippet"))
    r = load(spark, sf_dir, "conversations").groupBy(COL("conv_id").alias("key")).agg(F.collect_list(doc).alias("documents"))
    return P.reshape_trace(r, pretraining_only=True).select("key", "span", F.size("matches").alias("n_matches"))


@query("""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: p[1] * p[2])), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.label = q.label AND v.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score >= 0.40),
b AS (SELECT q.vec_id AS query_id, count(k.doc_id) AS n_sources, coalesce(max(k.score), 0.0) AS best FROM embeddings q LEFT JOIN k ON k.query_id = q.vec_id AND r <= 5 WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id)
SELECT query_id, n_sources, best, CASE WHEN best >= 0.65 THEN 'strong' WHEN best >= 0.45 THEN 'partial' ELSE 'none' END AS support,
 CASE WHEN best >= 0.45 THEN 'corpus' WHEN query_id % 3 = 0 THEN 'uncorroborated' WHEN query_id % 3 = 1 THEN 'parametric' ELSE 'unverified' END AS provenance FROM b
""")
def cosine_grounding(spark, sf_dir):
    """Spans (vectors whose id is divisible by 20) against the passages of their own label; sources at 0.40 or more, the five best."""
    e = load(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(COL("vec_id").alias("query_id"), COL("embedding").alias("q"), "label")
    s = e.join(R.small(q), "label").filter("vec_id <> query_id").select("query_id", COL("vec_id").alias("doc_id"), F.round(R.dot(COL("embedding"), COL("q")), 6).alias("score")).filter("score >= 0.40")
    best = R.top(s, 5).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("m"))
    b = q.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_sources"), F.coalesce("m", F.lit(0.0)).alias("best"))
    hit = F.when(COL("query_id") % 3 != 0, COL("query_id") % 3 == 1)
    return b.withColumn("support", T.support_bucket(COL("best"))).withColumn("provenance", P.provenance(COL("support"), hit))


@query("""
WITH e AS (SELECT user_id, event_type, round(value / 100, 4) AS v FROM events) SELECT user_id, round(avg(v), 3) AS answer_score, round(max(v), 4) AS most, count(*) AS n FROM e GROUP BY user_id
""")
def answer_scores(spark, sf_dir):
    """Claim values are rounded first, then averaged over the answer."""
    e = load(spark, sf_dir, "events").select("user_id", F.round(COL("value") / 100, 4).alias("v"))
    return e.groupBy("user_id").agg(F.round(F.avg("v"), 3).alias("answer_score"), F.round(F.max("v"), 4).alias("most"), F.count("*").alias("n"))




@query("""
WITH x AS (SELECT event_id, [1.0 + event_id % 5, 2.0, 3.0, 1.5] AS a, [2.0, 1.0 + event_id % 3, 2.0, 2.5] AS b FROM events),
n AS (SELECT event_id, list_transform(a, lambda v: ln(v / list_sum(a))) AS lp, list_transform(b, lambda v: ln(v / list_sum(b))) AS lq FROM x)
SELECT event_id, round(list_sum(list_transform(list_zip(lp, lq), lambda z: exp(z[1]) * (z[1] - z[2]))), 6) AS kl, round(lp[1] - lq[1], 6) AS signed FROM n
""")
def token_divergence(spark, sf_dir):
    """KL of two next-token distributions and the signed gap at the token that came."""
    i = COL("event_id")
    e = load(spark, sf_dir, "events", "event_id").select("event_id", F.array(1.0 + i % 5, F.lit(2.0), F.lit(3.0), F.lit(1.5)).alias("a"), F.array(F.lit(2.0), 1.0 + i % 3, F.lit(2.0), F.lit(2.5)).alias("b"))
    logs = lambda c: F.transform(F.transform(F.array(COL(c)), lambda xs: F.struct(xs.alias("x"), F.aggregate(xs, F.lit(0.0), lambda s, v: s + v).alias("t"))), lambda s: F.transform(s["x"], lambda v: F.log(v / s["t"])))[0]
    n = e.select("event_id", logs("a").alias("lp"), logs("b").alias("lq"))
    return n.select("event_id", F.round(P.divergence(COL("lp"), COL("lq")), 6).alias("kl"), F.round(COL("lp")[0] - COL("lq")[0], 6).alias("signed"))


@query(rf"""
WITH c AS ({_CLAIMS}), s AS (SELECT conv_id, turn, claim_idx, sum(length(claim) + 1) OVER (PARTITION BY conv_id, turn ORDER BY claim_idx) - length(claim) - 1 AS s_start, length(claim) AS len FROM c),
t AS (SELECT conv_id, turn, unnest(range(0, CAST(max(s_start + len) AS BIGINT), 7)) AS t_start FROM s GROUP BY conv_id, turn)
SELECT s.conv_id, s.turn, CAST(s.claim_idx AS INTEGER) AS claim_idx, count(*) AS n_tokens, CAST(min(t_start) AS BIGINT) AS first FROM s JOIN t ON s.conv_id = t.conv_id AND s.turn = t.turn AND t_start < s_start + len AND t_start + 6 > s_start GROUP BY ALL
""")
def token_to_sentence(spark, sf_dir):
    """Tokens of six characters and a space, mapped to the claims they overlap; half-open intervals under the answer's key."""
    from pyspark.sql import Window

    c, _ = claims_and_spans(spark, sf_dir)
    w = Window.partitionBy("conv_id", "turn").orderBy("claim_idx")
    s = c.withColumn("s_start", F.sum(F.length("claim") + 1).over(w) - F.length("claim") - 1).withColumn("s_end", COL("s_start") + F.length("claim"))
    t = s.groupBy("conv_id", "turn").agg(F.max("s_end").alias("e")).select("conv_id", "turn", F.explode(F.sequence(F.lit(0).cast("long"), COL("e") - 1, F.lit(7).cast("long"))).alias("t_start")).withColumn("t_end", COL("t_start") + 6)
    return P.overlaps(t, s, "conv_id", "turn").groupBy("conv_id", "turn", "claim_idx").agg(F.count("*").alias("n_tokens"), F.min("t_start").alias("first"))


@query(r"""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
w AS (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS a, regexp_extract_all(lower(before), '[\p{L}\p{M}\p{N}_]+') AS b FROM p WHERE before IS NOT NULL),
s AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, greatest(len(a) - 1, 1)), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) AS x, list_transform(range(1, greatest(len(b) - 1, 1)), lambda i: b[i] || ' ' || b[i + 1] || ' ' || b[i + 2]) AS y FROM w)
SELECT conv_id, turn, CASE WHEN len(x) > 0 THEN round(len(list_intersect(x, y)) / len(x), 4) ELSE 0.0 END AS coverage FROM s
""")
def coverage_3gram(spark, sf_dir):
    from pyspark.sql import Window

    p = load(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("before IS NOT NULL")
    return p.select("conv_id", "turn", P.coverage(COL("text"), COL("before")).alias("coverage"))


_CELLS = "SELECT user_id AS q, user_id % 2 = 0 AS rescued, avg(value) FILTER (event_id % 4 = 0) AS dd, avg(value) FILTER (event_id % 4 = 1) AS dh, avg(value) FILTER (event_id % 4 = 2) AS hd, avg(value) FILTER (event_id % 4 = 3) AS hh FROM events GROUP BY user_id"


def _cells(spark, sf_dir):
    v = lambda k: F.avg(F.when(COL("event_id") % 4 == k, COL("value")))
    c = load(spark, sf_dir, "events").groupBy(COL("user_id").alias("q")).agg(v(0).alias("dd"), v(1).alias("dh"), v(2).alias("hd"), v(3).alias("hh"))
    return c.withColumn("rescued", COL("q") % 2 == 0)


@query(f"""
WITH c AS ({_CELLS}), d AS (SELECT q, rescued, hh - dd AS S, ((dh - dd) + (hh - hd)) / 2 AS Delta, ((hd - dd) + (hh - dh)) / 2 AS A, dd + hh - dh - hd AS I FROM c)
SELECT rescued, count(*) AS n, round(avg(S), 6) AS s, round(avg(Delta), 6) AS delta, round(avg(A), 6) AS a, round(avg(I), 6) AS i, max(abs(Delta + A - S)) < 1e-9 AS additive FROM d WHERE S IS NOT NULL AND Delta IS NOT NULL GROUP BY rescued
""")
def did_2x2(spark, sf_dir):
    d = _cells(spark, sf_dir).select("q", "rescued", *P.decompose(COL("dd"), COL("dh"), COL("hd"), COL("hh"))).filter("S IS NOT NULL AND Delta IS NOT NULL")
    m = [F.round(F.avg(k), 6).alias(k.lower()) for k in ("S", "Delta", "A", "I")]
    return d.groupBy("rescued").agg(F.count("*").alias("n"), *m, (F.max(F.abs(COL("Delta") + COL("A") - COL("S"))) < 1e-9).alias("additive"))


@query(f"WITH c AS ({_CELLS}) SELECT round(avg(hh - dd) FILTER (rescued) - avg(hh - dd) FILTER (NOT rescued), 6) AS did, round(avg(hh - dd) FILTER (rescued AND dd > 5) - avg(hh - dd) FILTER (NOT rescued AND dd > 5), 6) AS did_per_protocol FROM c")
def difference_in_differences(spark, sf_dir):
    shift = COL("hh") - COL("dd")
    gap = lambda ok: F.round(F.avg(F.when(ok & COL("rescued"), shift)) - F.avg(F.when(ok & ~COL("rescued"), shift)), 6)
    return _cells(spark, sf_dir).agg(gap(F.lit(True)).alias("did"), gap(COL("dd") > 5).alias("did_per_protocol"))


_REPS = 60
_SIDE = """{n}_c AS (SELECT k, s, n, row_number() OVER (ORDER BY k) - 1 AS place FROM ({rows})), {n}_n AS (SELECT count(*) AS t FROM {n}_c),
{n} AS (SELECT rep, sum(s) / sum(n) AS m FROM (SELECT rep, CAST('0x' || substr(md5(concat_ws(':', '{n}', rep, draw)), 1, 8) AS BIGINT) % t AS place FROM {n}_n, range(60) r(rep), range(t) d(draw)) JOIN {n}_c USING (place) GROUP BY rep)"""
_BY_Q = "SELECT q AS k, sum(hh - dd) AS s, count(*) AS n FROM c WHERE hh - dd IS NOT NULL AND {} GROUP BY q"
_BY_CLUSTER = "SELECT q // 5 AS k, sum(hh - dd) AS s, count(*) AS n FROM c WHERE hh - dd IS NOT NULL AND {} GROUP BY q // 5"
_GAP = "SELECT '{u}' AS unit, round(quantile_cont(x.m - y.m, 0.025), 6) AS low, round(quantile_cont(x.m - y.m, 0.975), 6) AS high FROM {x} x JOIN {y} y USING (rep)"


@query(
    f"WITH c AS ({_CELLS}), "
    + ", ".join(_SIDE.format(n=f"{u}{side}", rows=rows.format(cond)) for u, rows in (("q", _BY_Q), ("c", _BY_CLUSTER)) for side, cond in (("r", "rescued"), ("k", "NOT rescued")))
    + " " + _GAP.format(u="question", x="qr", y="qk") + " UNION ALL " + _GAP.format(u="cluster", x="cr", y="ck")
)
def did_intervals(spark, sf_dir):
    """Intervals of rescued minus control shifts: each side resampled on its own, by question and by cluster (five questions stand for one)."""
    c, out = _cells(spark, sf_dir).withColumn("s", COL("hh") - COL("dd")).filter("s IS NOT NULL"), None
    for unit, letter, key in (("question", "q", COL("q")), ("cluster", "c", F.floor(COL("q") / 5))):
        sides = []
        for side, rows in (("r", c.filter("rescued")), ("k", c.filter("NOT rescued"))):
            sums = stored(rows.groupBy(key.alias("k")).agg(F.sum("s").alias("s"), F.count("*").alias("n")))
            sides.append(S.bootstrap(sums, "k", ["s"], _REPS, letter + side))
        one = sides[0].join(sides[1].withColumnRenamed("s", "t"), "rep").agg(*S.interval(COL("s") - COL("t"))).select(F.lit(unit).alias("unit"), "low", "high")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH c AS ({_CELLS}) SELECT round(max(abs((hd - dd) + (hh - dh)) / 2), 6) AS max_a, round(max(abs(dd + hh - dh - hd)), 6) AS max_i, round(max(abs((dh - dd + hh - hd) / 2 - (hh - dd))), 6) AS max_gap FROM c WHERE q % 3 = 0")
def identical_answers(spark, sf_dir):
    """What would be 0 if the two answers were the same (questions of a third of the ids stand for identical answers)."""
    d = _cells(spark, sf_dir).filter("q % 3 = 0").select(*P.decompose(COL("dd"), COL("dh"), COL("hd"), COL("hh")))
    return d.agg(F.round(F.max(F.abs("A")), 6).alias("max_a"), F.round(F.max(F.abs("I")), 6).alias("max_i"), F.round(F.max(F.abs(COL("Delta") - COL("S"))), 6).alias("max_gap"))


_DROPS = "SELECT user_id AS q, list(CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END ORDER BY event_id) AS drops, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 4 END AS gold_rank FROM events GROUP BY user_id"


@query(f"""WITH d AS (SELECT q, drops[1:8] AS drops, gold_rank FROM ({_DROPS}))
SELECT q, CASE WHEN gold_rank IS NULL OR len(list_filter(drops, lambda x: x IS NULL)) > 0 THEN NULL ELSE list_position(drops, list_max(drops)) = gold_rank END AS gold_on_top,
CASE WHEN gold_rank IS NULL THEN 'none' WHEN gold_rank = 1 THEN '1' WHEN gold_rank <= 3 THEN '2-3' WHEN gold_rank <= 7 THEN '4-7' ELSE '8+' END AS bucket FROM d""")
def gold_saliency(spark, sf_dir):
    """Eight passages a question, as a reader gets them; only those rows of a question are gathered."""
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events").select(COL("user_id").alias("q"), "event_id", F.when(COL("event_id") % 97 != 0, COL("value")).alias("v"))
    first = e.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy("event_id"))).filter("i <= 8")
    drops = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    d = first.groupBy("q").agg(drops.alias("drops")).withColumn("gold_rank", F.when(COL("q") % 4 != 0, COL("q") % 4))
    return d.select("q", P.gold_on_top(COL("drops"), COL("gold_rank")).alias("gold_on_top"), P.position_bucket(COL("gold_rank")).alias("bucket"))


_POSITIONS = "SELECT event_id AS q, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 11 END AS gold_rank, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS d FROM events"
_BUCKET = "CASE WHEN gold_rank IS NULL THEN 'none' WHEN gold_rank = 1 THEN '1' WHEN gold_rank <= 3 THEN '2-3' WHEN gold_rank <= 7 THEN '4-7' ELSE '8+' END"


@query(f"""
WITH p AS ({_POSITIONS}), k AS (SELECT *, {_BUCKET} AS bucket FROM p WHERE d IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY gold_rank) + (count(*) OVER (PARTITION BY gold_rank) - 1) / 2.0 AS ra, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS rb FROM k WHERE gold_rank IS NOT NULL)
SELECT bucket, count(*) AS n, round(avg(d), 6) AS mean_drop, (SELECT round(corr(ra, rb), 6) FROM r) AS rho FROM k GROUP BY bucket
""")
def position_buckets(spark, sf_dir):
    """Does a passage's place explain what its removal costs? Mean drop by bucket of the gold rank, and Spearman of rank and drop."""
    p = load(spark, sf_dir, "events").select(F.when(COL("event_id") % 11 != 0, COL("event_id") % 11).alias("gold_rank"), F.when(COL("event_id") % 97 != 0, COL("value")).alias("d")).filter("d IS NOT NULL")
    rho = S.spearman(p.filter("gold_rank IS NOT NULL"), "gold_rank", "d").select("rho")
    return p.groupBy(P.position_bucket(COL("gold_rank")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_drop")).crossJoin(F.broadcast(rho))


_ARMS = "SELECT conv_id AS q, turn % 2 = 0 AS dense, conv_id % 3 = turn % 3 AS refused, text FROM conversations"


@query(f"""
WITH a AS ({_ARMS}), p AS (SELECT q, bool_or(refused) FILTER (dense) AS rd, bool_or(refused) FILTER (NOT dense) AS rh FROM a GROUP BY q)
SELECT count(*) FILTER (rd AND NOT rh) AS cured, count(*) FILTER (rh AND NOT rd) AS caused, count(*) FILTER (NOT rd AND NOT rh) AS main_arm, count(*) FILTER (rd AND NOT rh) AS refusal_arm, count(*) FILTER (rd IS NULL OR rh IS NULL) AS unpaired FROM p
""")
def refusal_pairs(spark, sf_dir):
    """Paired arms of one question: which refusals the second arm cures or causes, and who is eligible for the main analysis."""
    a = load(spark, sf_dir, "conversations").select(COL("conv_id").alias("q"), (COL("turn") % 2 == 0).alias("dense"), (COL("conv_id") % 3 == COL("turn") % 3).alias("refused"))
    p = a.groupBy("q").agg(F.bool_or(F.when(COL("dense"), COL("refused"))).alias("rd"), F.bool_or(F.when(~COL("dense"), COL("refused"))).alias("rh"))
    rd, rh = COL("rd"), COL("rh")
    return p.agg(F.count_if(rd & ~rh).alias("cured"), F.count_if(rh & ~rd).alias("caused"), F.count_if(~rd & ~rh).alias("main_arm"), F.count_if(rd & ~rh).alias("refusal_arm"), F.count_if(rd.isNull() | rh.isNull()).alias("unpaired"))


@query(f"""
WITH a AS ({_ARMS}), p AS (SELECT q, bool_or(refused) FILTER (dense) AS rd, bool_or(refused) FILTER (NOT dense) AS rh FROM a GROUP BY q),
k AS (SELECT count(*) FILTER (rd AND NOT rh) AS cured, count(*) FILTER (rh AND NOT rd) AS caused, avg(CAST(rh AS INT) - CAST(rd AS INT)) FILTER (q % 2 = 0) - avg(CAST(rh AS INT) - CAST(rd AS INT)) FILTER (q % 2 <> 0) AS did FROM p)
SELECT cured, caused, CASE WHEN cured + caused = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(cured + caused + 1) - lgamma(i + 1) - lgamma(cured + caused - i + 1) - (cured + caused) * ln(2))) FROM range(least(cured, caused) + 1) r(i))), 6) END AS p, round(did, 6) AS did FROM k
""")
def refusal_outcome(spark, sf_dir):
    """Refusal itself as the outcome: cured against caused with the exact p, and the shift of even questions less that of odd ones."""
    a = load(spark, sf_dir, "conversations").select(COL("conv_id").alias("q"), (COL("turn") % 2 == 0).alias("dense"), (COL("conv_id") % 3 == COL("turn") % 3).alias("refused"))
    p = a.groupBy("q").agg(F.bool_or(F.when(COL("dense"), COL("refused"))).alias("rd"), F.bool_or(F.when(~COL("dense"), COL("refused"))).alias("rh"))
    rd, rh, even = COL("rd"), COL("rh"), COL("q") % 2 == 0
    shift = rh.cast("int") - rd.cast("int")
    k = p.agg(F.count_if(rd & ~rh).alias("cured"), F.count_if(rh & ~rd).alias("caused"), F.round(F.avg(F.when(even, shift)) - F.avg(F.when(~even, shift)), 6).alias("did"))
    return k.select("cured", "caused", F.round(S.mcnemar(COL("cured"), COL("caused")), 6).alias("p"), "did")


@query(f"""
WITH a AS ({_ARMS}) SELECT q % 2 = 0 AS rescued, dense, count(*) AS n, count(*) FILTER (refused) AS n_refused, count(*) FILTER (trim(text) = '') AS n_empty FROM a GROUP BY ALL
""")
def condition_health(spark, sf_dir):
    a = load(spark, sf_dir, "conversations").select((COL("conv_id") % 2 == 0).alias("rescued"), (COL("turn") % 2 == 0).alias("dense"), (COL("conv_id") % 3 == COL("turn") % 3).alias("refused"), "text")
    return a.groupBy("rescued", "dense").agg(F.count("*").alias("n"), F.count_if("refused").alias("n_refused"), F.count_if(F.trim("text") == "").alias("n_empty"))


@query(rf"""
WITH c AS ({_CLAIMS}), k AS (SELECT conv_id, turn, count(*) AS n FROM c GROUP BY ALL)
SELECT count(*) AS n_answers, count(*) FILTER (n IS NULL) AS without_claims, CAST(sum(n) AS BIGINT) AS n_claims, count(*) FILTER (u.conv_id IS NULL) AS without_question FROM conversations a LEFT JOIN k USING (conv_id, turn) LEFT JOIN (SELECT conv_id, turn + 1 AS turn FROM conversations WHERE role = 'user') u USING (conv_id, turn) WHERE a.role = 'assistant'
""")
def integrity_checks(spark, sf_dir):
    """Before a run: answers whose claims or question are missing."""
    c = load(spark, sf_dir, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.size(T.claims(COL("text"))).alias("n"))
    u = c.filter("role = 'user'").select("conv_id", (COL("turn") + 1).alias("turn"), F.lit(True).alias("asked"))
    return a.join(u, ["conv_id", "turn"], "left").agg(F.count("*").alias("n_answers"), F.count_if(COL("n") == 0).alias("without_claims"), F.sum("n").alias("n_claims"), F.count_if(COL("asked").isNull()).alias("without_question"))


@query(r"""
WITH p AS (SELECT d.doc_id, 'Context: ' || d.text || ' Question: ' || trim(b.text) AS prompt, substr(trim(d.text), 20) AS passage FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)
SELECT doc_id, CAST(CASE WHEN passage = '' THEN 0 ELSE position(passage IN prompt) END AS INTEGER) - 1 AS start, CASE WHEN passage <> '' AND position(passage IN prompt) > 0 THEN CAST(position(passage IN prompt) - 1 + length(passage) AS INTEGER) END AS stop FROM p
""")
def prompt_spans(spark, sf_dir):
    """Where a stripped passage stands in its rendered prompt; -1 and null where it does not."""
    b = load(spark, sf_dir, "benchmark").select(COL("item_id").alias("i"), F.trim("text").alias("q"))
    d = load(spark, sf_dir, "documents", "doc_id", "text").join(R.small(b), COL("i") == COL("doc_id") % 40)
    p = d.select("doc_id", F.concat(F.lit("Context: "), "text", F.lit(" Question: "), "q").alias("prompt"), F.substring(F.trim("text"), 20, 1 << 30).alias("passage"))
    at = F.when(COL("passage") == "", 0).otherwise(F.expr("instr(prompt, passage)"))
    return p.select("doc_id", (at - 1).alias("start"), F.when(at > 0, at - 1 + F.length("passage")).alias("stop"))


@query("""
WITH e AS (SELECT user_id AS q, event_id % 5 AS passage, abs(value - 50) AS g FROM events), s AS (SELECT q, passage, sum(g) AS g FROM e GROUP BY ALL)
SELECT q, passage, round(g / sum(g) OVER (PARTITION BY q), 6) AS share, row_number() OVER (PARTITION BY q ORDER BY round(g, 6) DESC, passage) = 1 AS top FROM s
""")
def saliency_shares(spark, sf_dir):
    """Gradient mass a passage, normalised over the question, and its largest."""
    from pyspark.sql import Window

    s = load(spark, sf_dir, "events").groupBy(COL("user_id").alias("q"), (COL("event_id") % 5).alias("passage")).agg(F.sum(F.abs(COL("value") - 50)).alias("g"))
    w = Window.partitionBy("q")
    return s.select("q", "passage", F.round(COL("g") / F.sum("g").over(w), 6).alias("share"), (F.row_number().over(w.orderBy(F.desc(F.round("g", 6)), "passage")) == 1).alias("top"))


@query("""
WITH t AS (SELECT conv_id AS q, [regexp_matches(text, 'a'), regexp_matches(text, 'z')] AS c FROM conversations WHERE turn = 1)
SELECT CASE WHEN c[1] AND c[2] THEN 'both' WHEN c[1] THEN 'first_only' WHEN c[2] THEN 'second_only' ELSE 'neither' END AS stratum, count(*) AS n FROM t GROUP BY stratum
""")
def citation_strata(spark, sf_dir):
    a, b = F.contains("text", F.lit("a")), F.contains("text", F.lit("z"))
    s = F.when(a & b, "both").when(a, "first_only").when(b, "second_only").otherwise("neither")
    return load(spark, sf_dir, "conversations").filter("turn = 1").groupBy(s.alias("stratum")).agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT user_id AS q, event_id % 6 AS passage, CASE WHEN event_id % 31 = 0 THEN NULL ELSE value / 10 END AS lp FROM events), f AS (SELECT q, avg(lp) AS full_lp FROM e GROUP BY q), m AS (SELECT q, passage, CASE WHEN count(*) = count(lp) THEN avg(lp) END AS masked FROM e GROUP BY ALL)
SELECT q, passage, round(full_lp - masked, 6) AS drop FROM m JOIN f USING (q)
""".replace("AS drop FROM", 'AS "drop" FROM'))
def leave_one_out(spark, sf_dir):
    """How much the answer's log probability falls without each passage; null where a passage was not found in the prompt."""
    e = load(spark, sf_dir, "events").select(COL("user_id").alias("q"), (COL("event_id") % 6).alias("passage"), F.when(COL("event_id") % 31 != 0, COL("value") / 10).alias("lp"))
    m = e.groupBy("q", "passage").agg(F.when(F.count("*") == F.count("lp"), F.avg("lp")).alias("masked"))
    return m.join(e.groupBy("q").agg(F.avg("lp").alias("full_lp")), "q").select("q", "passage", F.round(COL("full_lp") - COL("masked"), 6).alias("drop"))

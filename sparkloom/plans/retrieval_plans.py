"""Retrieval: BM25, exact cosine, fusion, reranking, and the table of four pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import retrieval as R
from .registry import load, query

COL = F.col
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"


def bm25_ctes(docs: str, queries: str, k: int, name: str = "bm") -> str:
    """CTEs that end in ``name``(query_id, doc_id, rank, score). docs: SELECT doc_id, text; queries: SELECT query_id, text."""
    p = name
    return rf"""
{p}_d AS (SELECT doc_id, {TOKENS.format("text")} AS ws FROM ({docs})),
{p}_k AS (SELECT * FROM {p}_d WHERE len(ws) >= 30),
{p}_p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM {p}_k) GROUP BY ALL),
{p}_t AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avgdl FROM {p}_k),
{p}_r AS (SELECT term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {p}_p, {p}_t GROUP BY term, n_docs),
{p}_i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {p}_r) ELSE raw END AS idf FROM {p}_r),
{p}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format("text")}) AS term FROM ({queries})) GROUP BY ALL),
{p}_s AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM {p}_p JOIN {p}_q USING (term) JOIN {p}_i USING (term), {p}_t GROUP BY query_id, doc_id),
{p} AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, score FROM {p}_s WHERE score > 0 QUALIFY rank <= {k})"""


DOCS, ITEMS = "SELECT doc_id, text FROM documents", "SELECT item_id AS query_id, text FROM benchmark"
META = "SELECT doc_id, concat_ws(' ', text, source, lang, lang) AS text FROM documents"


def docs_items(spark, sf_dir):
    return load(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), load(spark, sf_dir, "benchmark").select(COL("item_id").alias("query_id"), "text")


@query(f"WITH {bm25_ctes(DOCS, ITEMS, 100)} SELECT query_id, doc_id, rank, score FROM bm")
def bm25_topk(spark, sf_dir):
    docs, items = docs_items(spark, sf_dir)
    return R.bm25(R.build_index(docs, COL("text")), items, 100)


@query(f"WITH {bm25_ctes(DOCS, ITEMS, 100)} SELECT count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_tokens, count(DISTINCT term) AS n_terms, count(DISTINCT doc_id) AS n_docs, round(any_value(avgdl), 6) AS avgdl, round((SELECT sum(idf) FROM bm_i), 4) AS idf_sum FROM bm_p, bm_t")
def bm25_index(spark, sf_dir):
    docs, _ = docs_items(spark, sf_dir)
    i = R.build_index(docs, COL("text"))
    counts = i.postings.agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"), F.count_distinct("term").alias("n_terms"), F.count_distinct("doc_id").alias("n_docs"))
    return counts.crossJoin(i.totals.select(F.round("avgdl", 6).alias("avgdl"))).crossJoin(i.terms.agg(F.round(F.sum("idf"), 4).alias("idf_sum")))


_EXPANDED = "SELECT doc_id, concat_ws(' ', text, split_part(text, '.', 1), split_part(text, '.', 2)) AS text FROM documents"


@query(f"WITH {bm25_ctes(DOCS, ITEMS, 20, 'a')}, {bm25_ctes(META, ITEMS, 20, 'b')}, {bm25_ctes(_EXPANDED, ITEMS, 20, 'c')} SELECT 'text' AS variant, * FROM a UNION ALL SELECT 'metadata', * FROM b UNION ALL SELECT 'expanded', * FROM c")
def bm25_variants(spark, sf_dir):
    docs, items = docs_items(spark, sf_dir)
    texts = {"text": COL("text"), "metadata": F.concat_ws(" ", "text", "source", "lang", "lang"), "expanded": F.concat_ws(" ", "text", F.split_part("text", F.lit("."), F.lit(1)), F.split_part("text", F.lit("."), F.lit(2)))}
    runs = [R.bm25(R.build_index(docs, t), items, 20).select(F.lit(name).alias("variant"), "*") for name, t in texts.items()]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: p[1] * p[2])), 6) AS score
  FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, score FROM s QUALIFY rank <= 10
""")
def cosine_topk(spark, sf_dir):
    """The query set is the vectors whose id is divisible by 20, against all of them."""
    e = load(spark, sf_dir, "embeddings")
    return R.nearest(e.select(COL("vec_id").alias("doc_id"), COL("embedding").alias("v")), e.filter("vec_id % 20 = 0").select(COL("vec_id").alias("query_id"), COL("embedding").alias("q")), 10)


def dense_ctes(docs: str, queries: str, k: int, name: str = "dn") -> str:
    p, bucket = name, "CAST(('0x' || substr(md5(w), 1, 4)) AS INTEGER) % 64"
    vec = lambda src, key: f"(SELECT {key}, b, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM (SELECT {key}, {bucket} AS b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {key}, unnest({TOKENS.format('text')}) AS w FROM ({src})) GROUP BY ALL))"
    return f"""
{p}_v AS {vec(docs, "doc_id")}, {p}_w AS {vec(queries, "query_id")},
{p}_x AS (SELECT query_id, doc_id, sum(v.x * w.x) AS s FROM {p}_v v JOIN {p}_w w USING (b) GROUP BY query_id, doc_id),
{p}_s AS (SELECT q.query_id, d.doc_id, round(coalesce(s, 0), 6) AS score FROM ({queries}) q CROSS JOIN ({docs}) d LEFT JOIN {p}_x x ON x.query_id = q.query_id AND x.doc_id = d.doc_id),
{p} AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, score FROM {p}_s QUALIFY rank <= {k})"""


def fuse_ctes(lists: list[str], top_k: int, name: str = "hy") -> str:
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, {i} AS source, rank FROM {x}" for i, x in enumerate(lists))
    return f"""
{name}_f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min((source, rank)) AS first, string_agg(source || ':' || rank, ',' ORDER BY source) AS ranks FROM ({union}) GROUP BY query_id, doc_id),
{name} AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS INTEGER) AS rank, score, ranks FROM {name}_f QUALIFY rank <= {top_k})"""


def rerank_ctes(ranked: str, name: str, top_k: int = 100) -> str:
    q, d = TOKENS.format("b.text"), TOKENS.format("t.text")
    return f"""
{name}_s AS (SELECT r.query_id, r.doc_id, r.rank AS prior, round(len(list_intersect(list_distinct({q}), list_distinct({d}))) / greatest(len(list_distinct({q})), 1), 6) AS score FROM {ranked} r JOIN benchmark b ON b.item_id = r.query_id JOIN documents t ON t.doc_id = r.doc_id),
{name} AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior, doc_id) AS INTEGER) AS rank, score, prior FROM {name}_s QUALIFY rank <= {top_k})"""


GOLD = r"gold AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\s+', ' ', 'g')))))"
FOUR = f"{bm25_ctes(DOCS, ITEMS, 100)}, {dense_ctes(DOCS, ITEMS, 100)}, {fuse_ctes(['dn', 'bm'], 100)}, {rerank_ctes('dn', 'dr')}, {rerank_ctes('hy', 'hr')}, {GOLD}"
RUNS = (
    FOUR
    + """, runs AS (SELECT 'dense' AS pipeline, query_id, doc_id, rank, score FROM dn UNION ALL SELECT 'dense_rerank', query_id, doc_id, rank, score FROM dr
UNION ALL SELECT 'hybrid', query_id, doc_id, rank, score FROM hy UNION ALL SELECT 'hybrid_rerank', query_id, doc_id, rank, score FROM hr),
ranks AS (SELECT p.pipeline, b.item_id AS query_id, r.rank_of_gold FROM (SELECT DISTINCT pipeline FROM runs) p CROSS JOIN benchmark b
  LEFT JOIN (SELECT pipeline, query_id, min(rank) AS rank_of_gold FROM runs JOIN gold USING (query_id, doc_id) GROUP BY ALL) r ON r.pipeline = p.pipeline AND r.query_id = b.item_id)"""
)
MEASURES = """round(avg(CASE WHEN rank_of_gold <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN rank_of_gold <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3, round(avg(CASE WHEN rank_of_gold <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5,
round(avg(CASE WHEN rank_of_gold <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_10, round(avg(coalesce(1.0 / rank_of_gold, 0)), 6) AS mrr, round(avg(CASE WHEN rank_of_gold <= 10 THEN 1 / log2(rank_of_gold + 1) ELSE 0 END), 6) AS ndcg_10,
round(avg(CASE WHEN rank_of_gold IS NULL THEN 1.0 ELSE 0.0 END), 6) AS not_retrieved, count(*) AS n"""


def four_runs(spark, sf_dir):
    docs, items = docs_items(spark, sf_dir)
    every = None
    for name, ranked in R.pipelines(docs, items).items():
        one = ranked.select(F.lit(name).alias("pipeline"), "query_id", "doc_id", "rank", "score")
        every = one if every is None else every.unionByName(one)
    return every, docs, items


def four_ranks(spark, sf_dir):
    runs, docs, items = four_runs(spark, sf_dir)
    return M.rank_of_gold(runs, items, M.gold_pairs(items, docs), "pipeline")


@query(f"WITH {RUNS} SELECT pipeline, {MEASURES} FROM ranks GROUP BY pipeline")
def retrieval_pipelines(spark, sf_dir):
    """Flagship: dense and hybrid retrieval, each with and without reranking, measured against gold passages."""
    return four_ranks(spark, sf_dir).groupBy("pipeline").agg(*M.measures())


@query(f"WITH {FOUR} SELECT query_id, doc_id, rank, score, ranks AS source_ranks FROM hy")
def rrf_fusion(spark, sf_dir):
    docs, items = docs_items(spark, sf_dir)
    vectors = docs.select("doc_id", R.hashed_vector(COL("text")).alias("v"))
    dense = R.nearest(vectors, items.select("query_id", R.hashed_vector(COL("text")).alias("q")), 100)
    fused = R.fuse([dense, R.bm25(R.build_index(docs, COL("text")), items, 100)], 100)
    written = F.array_join(F.transform(F.array_sort(F.map_entries("source_ranks")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return fused.withColumn("source_ranks", written)


@query(f"WITH {bm25_ctes(DOCS, ITEMS, 50)}, {rerank_ctes('bm', 'rr', 20)} SELECT query_id, doc_id, rank, score, prior FROM rr")
def rerank_overlap(spark, sf_dir):
    docs, items = docs_items(spark, sf_dir)
    return R.rerank(R.bm25(R.build_index(docs, COL("text")), items, 50), items, docs, 20)


@query(f"WITH {bm25_ctes(DOCS, ITEMS, 10)} SELECT query_id, rank, score, source AS title, CASE WHEN length(flat) <= 80 THEN flat ELSE regexp_replace(left(flat, 80), ' [^ ]*$', '') || '…' END AS snippet FROM bm JOIN (SELECT doc_id, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents) USING (doc_id)")
def search_hits(spark, sf_dir):
    """Batch search with formatted hits; texts join late, for the hits alone."""
    docs, items = docs_items(spark, sf_dir)
    hits = R.bm25(R.build_index(docs, COL("text")), items, 10)
    return docs.join(R.small(hits), "doc_id").select("query_id", "rank", "score", COL("source").alias("title"), T.snippet(COL("text"), 80).alias("snippet"))


_TERMS = r"""
w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z\-]{2,}'), lambda x: NOT list_contains(['the','and','for','with','that','this','are','was','from'], x)) AS ws FROM documents WHERE lang = 'en'),
g AS (SELECT doc_id, unnest(list_concat(ws, list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2]))) AS g FROM w),
c AS (SELECT doc_id, g, count(*) AS tf FROM g WHERE g IS NOT NULL GROUP BY ALL),
v AS (SELECT g, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM c GROUP BY g HAVING count(*) >= 2 AND count(*) <= 0.15 * (SELECT count(*) FROM w)),
k AS (SELECT g AS term, df, total FROM v ORDER BY total DESC, g LIMIT 50000)"""


@query(f"WITH {_TERMS} SELECT term, df, total FROM k")
def keyword_vocabulary(spark, sf_dir):
    """The first of two passes: one- and two-word terms by document frequency bounds, the 50,000 most frequent."""
    return _keywords(spark, sf_dir)[1]


def _keywords(spark, sf_dir):
    stop = T.texts(["the", "and", "for", "with", "that", "this", "are", "was", "from"])
    d = load(spark, sf_dir, "documents", "doc_id", "text", "lang").filter("lang = 'en'")
    ws = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z\-]{2,}"), F.lit(0)), lambda w: ~F.array_contains(stop, w))
    d = d.select("doc_id", ws.alias("ws"))
    counts = d.select("doc_id", F.explode(F.concat("ws", T.shingles(COL("ws"), 2))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    n = d.agg(F.count("*").alias("n"))
    vocabulary = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(n)).filter("df >= 2 AND df <= 0.15 * n")
    return counts, vocabulary.orderBy(F.desc("total"), "term").limit(50_000).select("term", "df", "total"), n


@query(f"WITH {_TERMS}, s AS (SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM w) / df), 6) AS score FROM c JOIN k ON c.g = k.term) SELECT doc_id, term, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS INTEGER) AS rank, score FROM s QUALIFY rank <= 10")
def keyword_tfidf(spark, sf_dir):
    """The second pass: each document's ten best terms by tf-idf."""
    counts, vocabulary, n = _keywords(spark, sf_dir)
    scored = counts.join(vocabulary, "term").crossJoin(F.broadcast(n)).withColumn("score", F.round(COL("tf") * F.log(COL("n") / COL("df")), 6))
    return R.top(scored.select(COL("doc_id").alias("query_id"), COL("term").alias("doc_id"), "score"), 10).select(COL("query_id").alias("doc_id"), COL("doc_id").alias("term"), "rank", "score")


@query()
def keyword_mmr(spark, sf_dir):
    """Ten diverse keywords a document, out of its thirty best by tf-idf."""
    counts, vocabulary, n = _keywords(spark, sf_dir)
    scored = counts.join(vocabulary, "term").crossJoin(F.broadcast(n)).withColumn("score", F.round(COL("tf") * F.log(COL("n") / COL("df")), 6))
    best = R.top(scored.select(COL("doc_id").alias("query_id"), COL("term").alias("doc_id"), "score"), 30)
    return R.diverse(best.select(COL("query_id").alias("doc_id"), COL("doc_id").alias("term"), "score"), "doc_id", "term", "score")


@query()
def approximate_knn(spark, sf_dir):
    """Vectors whose id is divisible by 20 against all vectors, through hashed buckets."""
    e = load(spark, sf_dir, "embeddings")
    return R.nearly_nearest(e.select(COL("vec_id").alias("doc_id"), COL("embedding").alias("v")), e.filter("vec_id % 20 = 0").select(COL("vec_id").alias("query_id"), COL("embedding").alias("q")), 10)

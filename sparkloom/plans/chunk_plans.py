"""Chunking: lines of documents stand for paragraphs, doc_id for the page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as K
from .registry import load, query

COL = F.col
CAP = 120
_N = r"len(regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_]+'))"


def _packed(name: str, items: str, key: str, joint: str) -> str:
    """items(key, i, txt, n): chunk numbers by walking each key's items in order."""
    return f"""
{name}_n AS (SELECT {key}, i, txt, n, row_number() OVER (PARTITION BY {key} ORDER BY i) AS r FROM {items}),
{name}_w AS (SELECT {key}, r, txt, n, 0 AS c, n AS open, n > {CAP} AS big FROM {name}_n WHERE r = 1
  UNION ALL SELECT x.{key}, x.r, x.txt, x.n, CASE WHEN x.n > {CAP} OR w.big OR w.open + x.n > {CAP} THEN w.c + 1 ELSE w.c END,
    CASE WHEN x.n > {CAP} OR w.big OR w.open + x.n > {CAP} THEN x.n ELSE w.open + x.n END, x.n > {CAP} FROM {name}_w w JOIN {name}_n x ON x.{key} = w.{key} AND x.r = w.r + 1),
{name} AS (SELECT {key}, c, bool_or(big) AS big, min(r) AS r, string_agg(txt, {joint} ORDER BY r) AS txt FROM {name}_w GROUP BY {key}, c)"""


@query(rf"""
WITH RECURSIVE p AS (SELECT doc_id, i, txt, {_N.format("txt")} AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(txt) <> ''),
s AS (SELECT k, i, txt, {_N.format("txt")} AS n FROM (SELECT doc_id || ':' || i AS k, unnest(string_split(regexp_replace(txt, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30))) AS txt, generate_subscripts(string_split(regexp_replace(txt, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), 1) AS i FROM p WHERE n > {CAP}) WHERE trim(txt) <> ''),
{_packed("pk", "p", "doc_id", "chr(10)")}, {_packed("sk", "s", "k", "' '")},
ws AS (SELECT k, r, regexp_extract_all(lower(txt), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM sk WHERE big),
wk AS (SELECT k, r, j, array_to_string(w[j * {CAP} + 1 : j * {CAP} + {CAP}], ' ') AS txt FROM (SELECT *, unnest(generate_series(0, (len(w) - 1) // {CAP})) AS j FROM ws)),
sub AS (SELECT k, r, 0 AS j, txt FROM sk WHERE NOT big UNION ALL SELECT * FROM wk),
pn AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM p),
u AS (SELECT doc_id, r, 0 AS r2, 0 AS j, txt FROM pk WHERE NOT big UNION ALL
  SELECT pk.doc_id, pk.r, sub.r, sub.j, sub.txt FROM pk JOIN pn ON pn.doc_id = pk.doc_id AND pn.r = pk.r JOIN sub ON sub.k = pk.doc_id || ':' || pn.i WHERE pk.big),
d AS (SELECT doc_id, text FROM documents WHERE {_N.format("text")} <= {CAP} AND trim(text) <> ''),
e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r, r2, j) - 1 AS sub_index, txt FROM u WHERE doc_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT doc_id, 0, text FROM d)
SELECT 'd' || doc_id || ':' || doc_id || ':' || sub_index AS chunk_id, doc_id AS page, CAST(sub_index AS INTEGER) AS sub_index, md5(txt) AS text_md5, CAST({_N.format("txt")} AS INTEGER) AS token_count FROM e
""")
def chunk_pack(spark, sf_dir):
    pages = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), COL("doc_id").cast("string")).alias("slug"), COL("doc_id").alias("page"), "text")
    return K.chunks(pages, CAP, split="\n").select("chunk_id", "page", "sub_index", F.md5("text").alias("text_md5"), "token_count")


@query(r"""
WITH n AS (SELECT lang, len(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS n FROM documents),
g AS (SELECT lang, list_sort(list(n)) AS s FROM n GROUP BY lang)
SELECT lang, CAST(len(s) AS BIGINT) AS n, CAST(s[len(s) // 2 + 1] AS INTEGER) AS p50, CAST(s[CAST(floor(0.9 * len(s)) AS INTEGER) + 1] AS INTEGER) AS p90, CAST(s[-1] AS INTEGER) AS most FROM g
""")
def token_profile(spark, sf_dir):
    """Index picks, not interpolated: by a running count over the histogram of lengths, so no list of all rows is built."""
    from pyspark.sql import Window

    n = load(spark, sf_dir, "documents").select("lang", K.token_length(COL("text")).alias("v")).groupBy("lang", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang").orderBy("v")
    n = n.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("lang")))
    pick = lambda i: F.min(F.when(COL("upto") > i, COL("v")))
    return n.groupBy("lang").agg(F.max("n").alias("n"), pick(F.floor(COL("n") / 2)).alias("p50"), pick(F.floor(0.9 * COL("n"))).alias("p90"), F.max("v").alias("most"))


@query(r"""
WITH e AS (SELECT 'p' || page_id AS slug, CASE WHEN page_id % 4 = 0 THEN [] WHEN page_id % 4 = 1 THEN [url] ELSE [url, url || '/b', url || '/c'] END AS urls, CASE WHEN page_id % 3 = 0 THEN '' ELSE '20' || lpad(CAST(page_id % 30 AS VARCHAR), 2, '0') || '-01-01' END AS publication_date FROM pages),
r AS (SELECT slug, publication_date, unnest(CASE WHEN len(urls) = 0 THEN [NULL] ELSE urls END) AS url, generate_subscripts(CASE WHEN len(urls) = 0 THEN [NULL] ELSE urls END, 1) - 1 AS idx FROM e)
SELECT CASE WHEN idx = 0 THEN slug ELSE slug || '_' || (idx + 1) END AS slug, CASE WHEN idx > 0 THEN slug END AS parent_slug, url, publication_date FROM r
""")
def document_rows(spark, sf_dir):
    u = COL("url")
    urls = F.when(COL("page_id") % 4 == 0, F.array().cast("array<string>")).when(COL("page_id") % 4 == 1, F.array(u)).otherwise(F.array(u, F.concat(u, F.lit("/b")), F.concat(u, F.lit("/c"))))
    date = F.when(COL("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("20"), F.lpad((COL("page_id") % 30).cast("string"), 2, "0"), F.lit("-01-01")))
    e = load(spark, sf_dir, "pages").select(F.concat(F.lit("p"), COL("page_id").cast("string")).alias("slug"), urls.alias("urls"), date.alias("publication_date"))
    return K.document_rows(e).orderBy(F.desc("publication_date"), F.desc("slug")).select("slug", "parent_slug", "url", "publication_date")

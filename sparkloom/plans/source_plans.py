"""Sources and sinks: files are written to the shared folder and read back, so each query is a round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from ..operators import retrieval as R
from ..sources import files as S
from ..sources.tables import scratch
from .registry import load, query

COL = F.col
BASE, DAY = "https://site.example", "20240131"


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def jsonl_strict(spark, sf_dir):
    p = scratch(spark)
    load(spark, sf_dir, "conversations").write.json(p)
    return S.json_lines(spark, p, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 <> 0")
def jsonl_tolerant(spark, sf_dir):
    """Every tenth line is torn."""
    p = scratch(spark)
    e = load(spark, sf_dir, "events", "event_id", "event_type")
    line = F.to_json(F.struct("event_id", "event_type"))
    e.select(F.when(COL("event_id") % 10 == 0, F.left(line, F.lit(12))).otherwise(line).alias("value")).write.text(p)
    return S.json_lines_tolerant(spark, p, "event_id long, event_type string").filter("event_id IS NOT NULL")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def json_array_scan(spark, sf_dir):
    """A file a region, each one JSON list."""
    p = scratch(spark)
    n = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(COL("n_nationkey").alias("id"), COL("n_name").alias("name"), COL("n_regionkey").alias("region"))))).alias("value"))
    n.select("value").repartition(5).write.text(p)
    return S.json_array(spark, p, "id int, name string, region int", "id")


@query(r"SELECT trim(regexp_replace(text, '\s*\n\s*', ' ', 'g')) AS query FROM benchmark WHERE item_id % 3 = 0")
def query_file(spark, sf_dir):
    p = scratch(spark)
    one = F.regexp_replace("text", r"\s*\n\s*", " ")
    load(spark, sf_dir, "benchmark").select(F.when(COL("item_id") % 3 == 1, F.concat(F.lit("# "), one)).when(COL("item_id") % 3 == 2, "  ").otherwise(F.concat(F.lit(" "), one)).alias("value")).write.text(p)
    return S.query_lines(spark, p)


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 2 = 0")
def id_list(spark, sf_dir):
    p = scratch(spark)
    S.write_ids(load(spark, sf_dir, "documents", "doc_id").filter("doc_id % 2 = 0"), p)
    return S.id_lines(spark, p)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS slug, CAST(len(string_split(n_name, ' ')) AS INTEGER) AS n_words FROM nation WHERE n_nationkey % 2 = 0")
def text_per_document(spark, sf_dir):
    """A text file a document (a partition each); documents without one are left out."""
    p = scratch(spark)
    n = load(spark, sf_dir, "nation").select(COL("n_nationkey").cast("string").alias("slug"), "n_name")
    n.filter("slug % 2 = 0").select("slug", COL("n_name").alias("value")).write.partitionBy("slug").text(p)
    texts = spark.read.text(p, wholetext=True).select(COL("slug").cast("string").alias("slug"), COL("value").alias("text"))
    return n.select("slug").join(texts, "slug").select("slug", T.word_count(COL("text")).alias("n_words"))


@query(r"""
WITH t AS (SELECT doc_id, text || repeat(chr(10), CAST(doc_id % 7 AS INTEGER)) || 'end' AS t FROM documents)
SELECT doc_id, md5(regexp_replace(t, '\n{4,}', chr(10) || chr(10), 'g')) AS clean_md5 FROM t
""")
def extract_cleanup(spark, sf_dir):
    t = F.concat("text", F.repeat(F.lit("\n"), (COL("doc_id") % 7).cast("int")), F.lit("end"))
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(W.page_text(t)).alias("clean_md5"))


@query(r"""
WITH t AS (SELECT doc_id, text || chr(1) || '12345 67890 12345 6789 x' || chr(2) || 'short' AS t FROM documents), r AS (SELECT doc_id, array_to_string(regexp_extract_all(t, '[\x20-\x7E\r\n\t]{20,}'), chr(10)) AS r FROM t)
SELECT doc_id, array_to_string(list_filter(string_split(r, chr(10)), lambda x: x <> '' AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) > 0.3 * length(x)), chr(10)) AS salvaged FROM r
""")
def legacy_salvage(spark, sf_dir):
    t = F.concat("text", F.lit("\x0112345 67890 12345 6789 x\x02short"))
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", W.legacy_text(t).alias("salvaged"))


_URL = "CASE page_id % 8 WHEN 0 THEN 'https://www.undrr.org/media/' || page_id WHEN 1 THEN 'https://www.linkedin.com/x/y' WHEN 2 THEN 'https://a.example/' WHEN 3 THEN 'https://a.example/x.html?q=1' WHEN 4 THEN 'https://www.preventionweb.net/files/' || page_id || '.PDF?x=1' WHEN 5 THEN 'https://site.example/a/report.docx' WHEN 6 THEN 'https://www.preventionweb.net/files/a.doc' ELSE url END"


@query(rf"""
WITH u AS (SELECT page_id, {_URL} AS u FROM pages), m AS (SELECT *, CASE WHEN regexp_matches(u, '/media/\d+') AND NOT contains(u, '/download') THEN regexp_replace(u, '/+$', '') || '/download' ELSE u END AS m FROM u)
SELECT page_id, u AS url, NOT (regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) IN ('www.linkedin.com', 'www.emerald.com', 'cc.preventionweb.net') OR regexp_replace(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') = '' OR regexp_matches(u, '{"|".join(W.SKIP_PATTERNS)}')) AS downloadable,
 CASE WHEN (contains(m, 'preventionweb.net/') OR contains(m, 'undrr.org/')) AND NOT contains(m, '?') THEN m || '?startDownload={DAY}' ELSE m END AS download_url, starts_with(u, '{BASE}') AS same_origin,
 CASE WHEN page_id % 16 = 3 THEN '.pdf' WHEN page_id % 16 = 11 THEN '.docx' WHEN regexp_matches(lower(split_part(u, '?', 1)), '\.(pdf|docx|doc|xls|xlsx|pptx)$') THEN regexp_extract(lower(split_part(u, '?', 1)), '\.(pdf|docx|doc|xls|xlsx|pptx)$') END AS kind FROM m
""")
def url_filter(spark, sf_dir):
    u = COL("u")
    head = F.when(COL("page_id") % 16 == 3, "255044462D").when(COL("page_id") % 16 == 11, "504B0304AA").otherwise("3C68")
    return load(spark, sf_dir, "pages", "page_id", "url").withColumn("u", F.expr(_URL)).select("page_id", u.alias("url"), W.downloadable(u).alias("downloadable"), W.download_url(u, DAY).alias("download_url"), W.same_origin(u, BASE).alias("same_origin"), W.sniff(head, u).alias("kind"))


@query(rf"""
WITH b AS (SELECT page_id, {_URL} AS u, length(html) AS n, regexp_matches(html, '(?i)^\s*(<!doctype html|<html)') AS is_page FROM pages)
SELECT page_id, NOT (n < 500 OR is_page OR NOT regexp_matches(lower(split_part(u, '?', 1)), '\.(pdf|docx|doc|xls|xlsx|pptx)$')) AS accepted,
 CASE WHEN regexp_matches(lower(split_part(u, '?', 1)), '\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(split_part(u, '?', 1)), '\.docx$') THEN 'docx' WHEN regexp_matches(lower(split_part(u, '?', 1)), '\.doc$') THEN 'doc' ELSE 'unsupported' END AS parser FROM b
""")
def payload_checks(spark, sf_dir):
    """Too small, HTML or of no known type: refused; and the parser that a suffix goes to."""
    kind = W.sniff(F.lit(""), COL("u"))
    p = load(spark, sf_dir, "pages").withColumn("u", F.expr(_URL))
    bad = (F.length("html") < 500) | COL("html").rlike(r"(?i)^\s*(<!doctype html|<html)") | kind.isNull()
    parser = F.when(kind.isin(".pdf", ".docx", ".doc"), F.substring(kind, 2, 10)).otherwise("unsupported")
    return p.select("page_id", (~bad).alias("accepted"), parser.alias("parser"))


_HTML = """html || '<a href="/media/' || page_id || '">m</a><a class="x" href="/files/a.pdf">p</a><a href="https://o.example/b.PDF?x=1">q</a><a class="download" href="/get/' || page_id || '">d</a><a class="download-box__link" href="/box">b</a><a href="/files/a.pdf">again</a>'"""


@query(rf"""
WITH h AS (SELECT page_id, {_HTML} AS h FROM pages),
l AS (SELECT page_id, list_concat(list_transform(regexp_extract_all(h, '<a[^>]*href="([^"]*/media/\d+(?:/download)?)"', 1), lambda x: CASE WHEN ends_with(x, '/download') THEN x ELSE x || '/download' END), regexp_extract_all(h, '(?i)<a[^>]*href="([^"]*\.pdf(?:\?[^"]*)?)"', 1), regexp_extract_all(h, '<a class="download" href="([^"]+)"', 1), regexp_extract_all(h, '<a class="download-box__link" href="([^"]+)"', 1)) AS l FROM h),
e AS (SELECT page_id, CASE WHEN regexp_matches(u, '^[a-z]+://') THEN u ELSE '{BASE}' || regexp_replace(u, '^/*', '/') END AS u, i FROM (SELECT page_id, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM l)),
f AS (SELECT page_id, u, min(i) AS i FROM e GROUP BY ALL)
SELECT page_id, string_agg(u, ' ' ORDER BY i) AS links FROM f GROUP BY page_id
""")
def html_links(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(W.links(F.expr(_HTML), BASE), " ").alias("links"))


_CARD = """'<div class="views-row"><h3><a href="/publication/item-' || page_id || '">Title ' || page_id || '</a></h3><time datetime="2020-01-0' || (page_id % 9 + 1) || '">x</time><p>First ' || page_id || '</p><p>Second</p></div><div class="views-row"><a href="/news/n">No</a></div>'"""


@query("SELECT page_id, 'https://site.example/publication/item-' || page_id AS source_url, 'item-' || page_id AS slug, 'Title ' || page_id AS title, '2020-01-0' || (page_id % 9 + 1) AS day, 'First ' || page_id AS description FROM pages")
def listing_cards(spark, sf_dir):
    """Cards of a listing page; those without a publication link are left out."""
    c = load(spark, sf_dir, "pages").select("page_id", F.explode(F.split(F.expr(_CARD), '<div class="views-row">')).alias("card"))
    href = F.regexp_extract("card", r'<a href="([^"]*/publication/[^"]+)"', 1)
    one = lambda p: F.regexp_extract("card", p, 1)
    return c.filter(href != "").select("page_id", F.concat(F.lit(BASE), href).alias("source_url"), F.substring_index(href, "/", -1).alias("slug"), one(r'<a href="[^"]*/publication/[^"]+">([^<]*)</a>').alias("title"), one(r'datetime="([^"]*)"').alias("day"), one(r"<p>([^<]*)</p>").alias("description"))


@query("""
WITH e AS (SELECT 'p' || page_id AS slug, [url, url || '/b'] AS urls FROM pages), r AS (SELECT slug, unnest(urls) AS url, generate_subscripts(urls, 1) - 1 AS i FROM e), s AS (SELECT slug, CASE WHEN i = 0 THEN slug ELSE slug || '_' || (i + 1) END AS stem, url FROM r)
SELECT stem, slug, url FROM s WHERE stem NOT IN (SELECT 'p' || page_id FROM pages WHERE page_id % 2 = 0)
""")
def gap_finder(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    slug = F.concat(F.lit("p"), COL("page_id").cast("string"))
    return S.gaps(p.select(slug.alias("slug"), F.array("url", F.concat("url", F.lit("/b"))).alias("urls")), p.filter("page_id % 2 = 0").select(slug.alias("stem")))


@query("""
WITH o AS (SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN ' ' ELSE url END AS url FROM pages WHERE page_id % 2 = 0), n AS (SELECT page_id AS id, 'new:' || url AS url FROM pages WHERE page_id % 3 = 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(nullif(trim(o.url), ''), n.url) AS url FROM o FULL JOIN n ON o.id = n.id
""")
def upsert_merge(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    old = p.filter("page_id % 2 = 0").select(COL("page_id").alias("id"), F.when(COL("page_id") % 4 == 0, " ").otherwise(COL("url")).alias("url"))
    return S.upsert(old, p.filter("page_id % 3 = 0").select(COL("page_id").alias("id"), F.concat(F.lit("new:"), "url").alias("url")), "id")


@query("""
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR))) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((CAST('0x' || substr(h, 17, 1) AS INTEGER)) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h
""")
def uuid5_ids(spark, sf_dir):
    return load(spark, sf_dir, "documents", "doc_id").select("doc_id", T.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", COL("doc_id").cast("string")).alias("uuid"))


@query("SELECT doc_id, max(v) AS version, 'corpus_title_' || lang AS collection FROM (SELECT doc_id, lang, doc_id % 3 AS v FROM documents UNION ALL SELECT doc_id, lang, 1 FROM documents) GROUP BY doc_id, lang")
def point_upsert(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "lang")
    p = S.upsert_points(d.withColumn("version", COL("doc_id") % 3).unionByName(d.withColumn("version", F.lit(1).cast("long"))), "doc_id", "version")
    return p.select("doc_id", "version", S.collection_name(F.concat(F.lit("title+"), "lang")).alias("collection"))


@query("SELECT count(*) AS n_postings, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT DISTINCT doc_id, unnest(ws) AS t FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS ws FROM documents) WHERE len(ws) >= 30)")
def index_round_trip(spark, sf_dir):
    p = scratch(spark)
    R.build_index(load(spark, sf_dir, "documents", "doc_id", "text"), COL("text")).save(p)
    return R.Index.read(spark, p).postings.agg(F.count("*").alias("n_postings"), F.sum(F.length("term")).alias("chars"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'shard1' ELSE 'shard0' END AS shard FROM benchmark")
def shard_merge(spark, sf_dir):
    """Two shards; what both hold is taken from the later file name."""
    p, b = scratch(spark), load(spark, sf_dir, "benchmark", "item_id")
    b.select("item_id", F.lit("shard0").alias("shard")).coalesce(1).write.json(f"{p}/a")
    b.filter("item_id % 2 = 0").select("item_id", F.lit("shard1").alias("shard")).coalesce(1).write.json(f"{p}/b")
    return S.merge_shards(spark, [f"{p}/a", f"{p}/b"], "item_id long, shard string", "item_id")


@query("""
WITH r AS (SELECT conv_id, turn, '{"index": "x", "prompt": "' || conv_id || '", "turn": ' || turn || '}' AS request FROM conversations), k AS (SELECT *, substr(sha256(request), 1, 20) AS key FROM r)
SELECT conv_id, turn, key, CASE WHEN turn % 2 = 0 THEN 'cached ' || turn END AS response FROM k
""")
def cached_lookup(spark, sf_dir):
    request = F.concat(F.lit('{"index": "x", "prompt": "'), COL("conv_id").cast("string"), F.lit('", "turn": '), COL("turn").cast("string"), F.lit("}"))
    r = load(spark, sf_dir, "conversations", "conv_id", "turn").withColumn("request", request)
    cache = r.filter("turn % 2 = 0").select(S.request_key(COL("request")).alias("key"), F.concat(F.lit("cached "), COL("turn").cast("string")).alias("response"))
    return S.cached(r, cache).select("conv_id", "turn", "key", "response")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 <> 0")
def incremental_ids(spark, sf_dir):
    """What an incremental index still has to embed."""
    d = load(spark, sf_dir, "documents", "doc_id")
    return d.join(d.filter("doc_id % 5 = 0"), "doc_id", "left_anti")


@query("SELECT o_orderstatus AS status, count(*) AS n, printf('%.1f%%', 100.0 * count(*) / (SELECT count(*) FROM orders)) AS share FROM orders GROUP BY 1")
def report_numbers(spark, sf_dir):
    """The numbers of a Markdown report; ``sources.files.markdown`` writes the table."""
    o = load(spark, sf_dir, "orders")
    n = o.agg(F.count("*").alias("all"))
    return o.groupBy(COL("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("status", "n", F.format_string("%.1f%%", 100.0 * COL("n") / COL("all")).alias("share"))

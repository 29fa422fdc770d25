"""Text gates, enrichment and formatting over documents, conversations, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import load, query

COL = F.col


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS ws, text FROM documents)
SELECT doc_id, CAST(len(ws) AS INTEGER) AS n_tokens, CAST(len(list_distinct(ws)) AS INTEGER) AS n_distinct,
       CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS n_words,
       length(left(text, 500)) AS head_500, md5(left(text, 2000)) AS head_2000 FROM t
""")
def tokenize_counts(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "text").withColumn("ws", T.tokens(COL("text")))
    return d.select("doc_id", F.size("ws").alias("n_tokens"), F.size(F.array_distinct("ws")).alias("n_distinct"), T.word_count(COL("text")).alias("n_words"), F.length(T.head(COL("text"), 500)).cast("long").alias("head_500"), F.md5(T.head(COL("text"), 2000)).alias("head_2000"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(x) <> '') AS ss,
  list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z"''“])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS cs FROM documents)
SELECT doc_id, CAST(len(ss) AS INTEGER) AS n_sentences, md5(array_to_string(ss, '|')) AS sentences_md5, CAST(len(cs) AS INTEGER) AS n_claims, md5(array_to_string(cs, '|')) AS claims_md5 FROM s
""")
def sentence_split(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.sentences(COL("text")).alias("ss"), T.claims(COL("text")).alias("cs"))
    return d.select("doc_id", F.size("ss").alias("n_sentences"), F.md5(F.array_join("ss", "|")).alias("sentences_md5"), F.size("cs").alias("n_claims"), F.md5(F.array_join("cs", "|")).alias("claims_md5"))


@query(r"""
WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, md5(lower(flat)) AS normal_md5,
       CASE WHEN length(flat) <= 120 THEN flat ELSE regexp_replace(left(flat, 120), ' [^ ]*$', '') || '…' END AS snippet,
       left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 50) AS slug,
       md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html_md5,
       md5(regexp_replace(text, '([\\`*_{}\[\]<>|$])', '\\\1', 'g')) AS markdown_md5 FROM f
""")
def normalise_snippet(spark, sf_dir):
    t = COL("text")
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(T.normalised(t)).alias("normal_md5"), T.snippet(t, 120).alias("snippet"), T.slug(t).alias("slug"), F.md5(T.html_escape(t)).alias("html_md5"), F.md5(T.markdown_escape(t)).alias("markdown_md5"))


_LANG = r"""CASE WHEN regexp_matches(left(text, 500), '[\x{0600}-\x{06FF}]') THEN 'ar' WHEN regexp_matches(left(text, 500), '[\x{4E00}-\x{9FFF}]') THEN 'zh'
  WHEN regexp_matches(left(text, 500), '[\x{0400}-\x{04FF}]') THEN 'ru'
  WHEN len(list_intersect(ws, ['de','la','el','en','los','las','del','por','para','con','una'])) > 4 AND list_has_any(ws, ['los','las','para','pero','como']) THEN 'es'
  WHEN len(list_intersect(ws, ['de','la','le','les','des','du','en','et','pour','dans','une'])) > 4 AND list_has_any(ws, ['les','des','dans','cette','sont']) THEN 'fr' ELSE 'en' END"""


@query(rf"""
WITH w AS (SELECT doc_id, lang, text, list_distinct(regexp_split_to_array(lower(left(text, 2000)), '\s+')) AS ws FROM documents)
SELECT doc_id, lang, {_LANG} AS detected, {_LANG} = 'en' AS is_english FROM w
""")
def lang_heuristic(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "lang", "text").withColumn("detected", T.language(COL("text")))
    return d.select("doc_id", "lang", "detected", (COL("detected") == "en").alias("is_english"))


@query(rf"""
WITH w AS (SELECT doc_id, text, list_distinct(regexp_split_to_array(lower(left(text, 2000)), '\s+')) AS ws,
  CAST(len(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS INTEGER) AS n, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS nw FROM documents),
g AS (SELECT CASE WHEN n < 30 THEN 'short'
  WHEN regexp_matches(left(text, 300), '(?i){T.HEADINGS}') OR nw = 0 OR len(regexp_extract_all(text, '(?i){T.CREDITS}')) / greatest(nw, 1) > 0.012
       OR len(regexp_extract_all(text, '{T.YEAR_PAREN}')) > 5 THEN 'non_content'
  WHEN len(regexp_extract_all(text, '[a-z]\.\s+[A-Z]')) < 3 THEN 'non_prose' WHEN {_LANG} <> 'en' THEN 'non_english' ELSE 'kept' END AS drop_reason FROM w)
SELECT drop_reason, count(*) AS n FROM g GROUP BY drop_reason
""")
def gate_cascade(spark, sf_dir):
    t = COL("text")
    reason = F.when(F.size(T.tokens(t)) < 30, "short").when(~T.is_content(t), "non_content").when(~T.is_prose(t), "non_prose").when(T.language(t) != "en", "non_english").otherwise("kept")
    return load(spark, sf_dir, "documents", "text").groupBy(reason.alias("drop_reason")).agg(F.count("*").alias("n"))


@query(r"""
WITH e AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') || 'T10:00:00Z' WHEN 1 THEN strftime(ts, '%-d %B %Y') WHEN 2 THEN strftime(ts, '%B %Y') WHEN 3 THEN strftime(ts, '%Y') ELSE 'soon' END AS raw FROM events)
SELECT event_id, raw, CASE event_id % 5 WHEN 2 THEN strftime(date_trunc('month', ts), '%Y-%m-%d') WHEN 3 THEN strftime(date_trunc('year', ts), '%Y-%m-%d') WHEN 4 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM e
""")
def date_normalise(spark, sf_dir):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') || 'T10:00:00Z' WHEN 1 THEN date_format(ts, 'd MMMM yyyy') WHEN 2 THEN date_format(ts, 'MMMM yyyy') WHEN 3 THEN date_format(ts, 'yyyy') ELSE 'soon' END")
    return load(spark, sf_dir, "events", "event_id", "ts").withColumn("raw", raw).select("event_id", "raw", T.date_of(COL("raw")).alias("day"))


@query(rf"""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' 1990-2015 and 2001 – 2020' WHEN 1 THEN ' in 1999, 2004' WHEN 2 THEN ' since 2010' ELSE '' END || ' ' || text AS text FROM documents),
y AS (SELECT doc_id, list_concat(regexp_extract_all(text, '{T.YEARS}', 1), regexp_extract_all(text, '{T.YEARS}', 2)) AS ends, regexp_extract_all(text, '{T.YEAR}', 0) AS ys FROM t)
SELECT doc_id, CASE WHEN len(ends) > 0 THEN list_min(ends) || '-' || list_max(ends) WHEN len(ys) > 1 THEN list_min(ys) || '-' || list_max(ys) WHEN len(ys) = 1 THEN ys[1] ELSE '' END AS coverage FROM y
""")
def temporal_coverage(spark, sf_dir):
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN ' 1990-2015 and 2001 – 2020' WHEN 1 THEN ' in 1999, 2004' WHEN 2 THEN ' since 2010' ELSE '' END || ' ' || text")
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.temporal_coverage(text).alias("coverage"))


@query(r"""
WITH g AS (SELECT n_nationkey, ' ' || array_to_string(regexp_extract_all(lower(n_name), '[\p{L}\p{M}\p{N}_]+'), ' ') || ' ' AS n, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE length(n_name) >= 4),
t AS (SELECT d.doc_id, lower(left(coalesce(string_agg(n_name || ', ' || r_name, ' ' ORDER BY n_nationkey), '') || ' ' || text, 20000)) AS t FROM documents d LEFT JOIN nation ON n_nationkey = d.doc_id % 25 OR n_nationkey = d.doc_id % 7 LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY d.doc_id, text),
ts AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(t, '[\p{L}\p{M}\p{N}_]+'), ' ') || ' ' AS s FROM t),
h AS (SELECT doc_id, n_name, r_name FROM ts JOIN g ON contains(s, n)),
c AS (SELECT doc_id, list_sort(list(DISTINCT n_name)) AS countries, list_sort(list(DISTINCT r_name)) AS regions FROM h GROUP BY doc_id),
m AS (SELECT doc_id, list(r_name ORDER BY r_regionkey) AS said FROM ts JOIN region ON contains(s, ' ' || lower(r_name) || ' ') GROUP BY doc_id)
SELECT t.doc_id, coalesce(array_to_string(countries, '|'), '') AS countries, coalesce(array_to_string(regions, '|'), '') AS regions, coalesce(array_to_string(said, '|'), '') AS said FROM t LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
""")
def entity_regions(spark, sf_dir):
    """Whole-word gazetteer matches by an equi-join of token n-grams with the names, then names mapped to their regions."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    named = nation.join(F.broadcast(region), COL("n_regionkey") == COL("r_regionkey"))
    d = load(spark, sf_dir, "documents", "doc_id", "text")
    added = d.select("doc_id").join(F.broadcast(named), (COL("n_nationkey") == COL("doc_id") % 25) | (COL("n_nationkey") == COL("doc_id") % 7))
    added = added.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat_ws(", ", "n_name", "r_name").alias("s")))).alias("a"))
    t = d.join(added, "doc_id", "left").select("doc_id", F.left(F.concat(F.coalesce(F.array_join(F.transform("a", lambda x: x["s"]), " "), F.lit("")), F.lit(" "), "text"), F.lit(20_000)).alias("text"))
    names = named.filter(F.length("n_name") >= 4).select(F.array_join(T.tokens(COL("n_name")), " ").alias("gram"), "n_name", "r_name")
    spoken = region.select(F.lower("r_name").alias("gram"), "r_regionkey", "r_name")
    longest = names.select("gram").unionByName(spoken.select("gram")).agg(F.max(F.size(F.split("gram", " ")))).first()[0] or 1
    ws = T.tokens(COL("text"))
    grams = t.select("doc_id", F.explode(F.array_distinct(F.concat(ws, *(T.shingles(ws, k) for k in range(2, longest + 1))))).alias("gram"))
    hits = grams.join(F.broadcast(names), "gram").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "|").alias("countries"), F.array_join(F.array_sort(F.collect_set("r_name")), "|").alias("regions"))
    said = grams.join(F.broadcast(spoken), "gram").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("m"))
    said = said.select("doc_id", F.array_join(F.transform("m", lambda x: x["r_name"]), "|").alias("said"))
    out = t.select("doc_id").join(hits, "doc_id", "left").join(said, "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("countries", "regions", "said")))



_TAGS = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{k}' END" for k, p in T.FRAMEWORKS.items())


@query(rf"""
WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' the Sendai  Framework, SDGs' WHEN 1 THEN ' Paris Accord' WHEN 2 THEN ' HFA and IPOA' ELSE ' hfax' END || ' ' || text AS text FROM documents)
SELECT doc_id, array_to_string(list_filter([{_TAGS}], lambda x: x IS NOT NULL), ',') AS frameworks FROM t
""")
def framework_tags(spark, sf_dir):
    text = F.expr("CASE doc_id % 5 WHEN 0 THEN ' the Sendai  Framework, SDGs' WHEN 1 THEN ' Paris Accord' WHEN 2 THEN ' HFA and IPOA' ELSE ' hfax' END || ' ' || text")
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(T.tagged(text, T.FRAMEWORKS), ",").alias("frameworks"))


TYPES = {"brass": "metal_report", "steel": "metal_report", "copper": "metal_note", "tin": "metal_note"}


@query("""
WITH p AS (SELECT p_partkey, CASE lower(trim(list_last(string_split(p_type, ' ')))) WHEN 'brass' THEN 'metal_report' WHEN 'steel' THEN 'metal_report' WHEN 'copper' THEN 'metal_note' WHEN 'tin' THEN 'metal_note' ELSE 'other' END AS kind FROM part)
SELECT kind, count(*) AS n FROM p GROUP BY kind
""".replace("list_last(string_split(p_type, ' '))", "string_split(p_type, ' ')[-1]"))
def type_mapping(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    kind = F.coalesce(F.try_element_at(kinds, F.lower(F.trim(F.element_at(F.split("p_type", " "), -1)))), F.lit("other"))
    return load(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(rf"""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN [source] ELSE [] END AS organisations, lang FROM documents),
w AS (SELECT *, list_distinct(regexp_split_to_array(lower(left(text, 2000)), '\s+')) AS ws FROM r)
SELECT doc_id, CASE WHEN text IS NULL THEN lang ELSE {_LANG} END AS language, array_to_string(CASE WHEN len(organisations) = 0 AND text IS NOT NULL THEN ['web_' || lang] ELSE organisations END, ',') AS organisations, text IS NOT NULL AS enriched FROM w
""")
def enrichment_update(spark, sf_dir):
    """Rows without text stay as they are; organisations are filled only where empty; the flag says what was enriched."""
    d = load(spark, sf_dir, "documents", "doc_id", "text", "source", "lang").withColumn("text", F.when(COL("doc_id") % 10 != 0, COL("text")))
    orgs = F.when(COL("doc_id") % 3 == 0, F.array("source")).otherwise(F.array().cast("array<string>"))
    has = COL("text").isNotNull()
    filled = F.when((F.size(orgs) == 0) & has, F.array(F.concat(F.lit("web_"), COL("lang")))).otherwise(orgs)
    return d.select("doc_id", F.when(has, T.language(COL("text"))).otherwise(COL("lang")).alias("language"), F.array_join(filled, ",").alias("organisations"), has.alias("enriched"))


@query(r"""
WITH d AS (SELECT doc_id, text AS body, CASE WHEN doc_id % 2 = 0 THEN ' ' || source || ' ' ELSE ' ' END AS title, CASE WHEN doc_id % 3 = 0 THEN [lang, source] ELSE [] END AS themes FROM documents)
SELECT doc_id, concat_ws(' ', body, nullif(trim(title), ''), nullif(array_to_string(themes, ' '), ''), 'what is ' || doc_id || '?') AS indexable,
       concat_ws(chr(10), CASE WHEN trim(title) <> '' THEN 'Title: ' || trim(title) END, CASE WHEN len(themes) > 0 THEN 'Themes: ' || array_to_string(themes, ', ') END, '', body) AS embedded,
       '{' || concat_ws(',', '"doc_id":' || doc_id, '"title":"' || nullif(trim(title), '') || '"', CASE WHEN len(themes) > 0 THEN '"themes":["' || array_to_string(themes, '","') || '"]' END) || '}' AS payload FROM d
""")
def index_text_builders(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    themes = F.when(COL("doc_id") % 3 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    d = d.select("doc_id", COL("text").alias("body"), T.present(F.when(COL("doc_id") % 2 == 0, F.concat(F.lit(" "), "source", F.lit(" "))).otherwise(" ")).alias("title"), themes.alias("themes"))
    asked = F.concat(F.lit("what is "), COL("doc_id").cast("string"), F.lit("?"))
    full = F.nullif(COL("themes"), F.array().cast("array<string>"))
    return d.select(
        "doc_id",
        F.concat_ws(" ", "body", "title", "themes", asked).alias("indexable"),
        F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), T.labelled_list("Themes", COL("themes")), F.lit(""), "body").alias("embedded"),
        F.to_json(F.struct("doc_id", "title", full.alias("themes"))).alias("payload"),
    )


_ASK = "CASE turn % 4 WHEN 0 THEN 'According to the passage, ' WHEN 1 THEN 'in this short report ,  ' WHEN 2 THEN 'the document states that ' ELSE '' END"
_RAW = "CASE conv_id % 5 WHEN 0 THEN '1. ' WHEN 1 THEN '- ' WHEN 2 THEN '* - ' WHEN 3 THEN '1.) ' ELSE '' END"


@query(r"""
WITH q AS (SELECT conv_id, turn, regexp_replace(left(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), 40), '^ +| +$', '', 'g') AS body FROM conversations)
SELECT conv_id, turn, upper(left(b, 1)) || substr(b, 2) || '?' AS question,
       CASE WHEN length(b) + 1 >= 10 THEN upper(left(b, 1)) || substr(b, 2) || '?' ELSE '' END AS parsed, upper(left(b, 1)) || substr(b, 2) || '?' AS paraphrase
FROM (SELECT conv_id, turn, trim(body) AS b FROM q) WHERE b <> ''
""")
def question_cleanup(spark, sf_dir):
    d = load(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    d = d.withColumn("body", F.trim(F.left(F.regexp_replace("text", "[^A-Za-z]+", " "), F.lit(40)))).filter("body <> ''")
    raw = F.expr(f"{_RAW} || body || '? and more\n\nno question here\n' || {_RAW} || body || '?'")
    return d.select("conv_id", "turn", T.clean_question(F.expr(f"{_ASK} || body || ' ,'")).alias("question"), F.array_join(T.parse_questions(raw, 3), "|").alias("parsed"), T.parse_paraphrase(F.expr("CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN '- ' ELSE '1. ' END || 'Rewritten question: \"' || body || '?\"'"), F.lit("x")).alias("paraphrase"))


@query(r"""
SELECT conv_id, string_agg('[P' || (turn + 1) || '] ' || text, chr(10) ORDER BY turn) || chr(10) || 'Question: ' || conv_id || '?' AS prompt FROM conversations WHERE turn < 6 GROUP BY conv_id
""")
def prompt_templates(spark, sf_dir):
    d = load(spark, sf_dir, "conversations").filter("turn < 6").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    passages = F.array_join(F.transform("p", lambda x: F.format_string("[P%d] %s", x["turn"] + 1, x["text"])), "\n")
    return d.select("conv_id", F.concat(passages, F.lit("\nQuestion: "), COL("conv_id").cast("string"), F.lit("?")).alias("prompt"))


_ANSWER = "text || CASE turn % 5 WHEN 0 THEN ' This is NOT in the text.' WHEN 1 THEN ' It is not specified.' WHEN 2 THEN ' See [P2] and [P11][P2].' ELSE '' END"


@query(rf"""
WITH a AS (SELECT conv_id, turn, {_ANSWER} AS answer FROM conversations)
SELECT conv_id, turn, regexp_matches(lower(answer), '{"|".join(T.REFUSALS).replace("'", "''")}') AS refusal, regexp_matches(lower(answer), '{"|".join(T.SOFT_REFUSALS)}') AS soft,
       trim(answer) <> '' AND NOT regexp_matches(lower(answer), '{"|".join(T.REFUSALS).replace("'", "''")}') AS usable,
       CASE WHEN turn % 5 = 2 THEN '2,11' ELSE '' END AS tags FROM a
""")
def refusal_flags(spark, sf_dir):
    d = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ANSWER).alias("answer"))
    refusal = T.says_any(COL("answer"), T.REFUSALS)
    usable = T.present(COL("answer")).isNotNull() & ~F.coalesce(refusal, F.lit(False))
    return d.select("conv_id", "turn", refusal.alias("refusal"), T.says_any(COL("answer"), T.SOFT_REFUSALS).alias("soft"), usable.alias("usable"), F.array_join(T.citation_tags(COL("answer")), ",").alias("tags"))


@query("""
SELECT event_id, CASE WHEN value / 100 >= 0.30 THEN 'context' WHEN value / 100 <= 0.05 THEN 'parametric' ELSE 'mixed' END AS reliance,
       CASE WHEN value / 100 >= 0.65 THEN 'strong' WHEN value / 100 >= 0.45 THEN 'partial' ELSE 'none' END AS support FROM events
""")
def score_buckets(spark, sf_dir):
    v = COL("value") / 100
    return load(spark, sf_dir, "events").select("event_id", T.cti_bucket(v).alias("reliance"), T.support_bucket(v).alias("support"))


@query(r"""
WITH c AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z"''“])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS cs FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS claim_idx, unnest(cs) AS claim FROM c
""")
def claims_explode(spark, sf_dir):
    d = load(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return d.select("conv_id", "turn", F.posexplode(T.claims(COL("text"))).alias("claim_idx", "claim"))


@query(r"""
WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS dense, list(turn ORDER BY turn DESC) AS hybrid FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN dense[2] IS NULL THEN false ELSE dense[2] = hybrid[2] END AS swap_safe FROM c
""")
def citation_swap_safe(spark, sf_dir):
    """A tag keeps its meaning if both contexts hold the same passage at its place."""
    d = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("dense"), F.sort_array(F.collect_list("turn"), asc=False).alias("hybrid"))
    tags = T.citation_tags(F.lit("as said in [P2]"))
    safe = F.forall(tags, lambda k: F.coalesce(F.try_element_at("dense", k) == F.try_element_at("hybrid", k), F.lit(False)))
    return d.select("conv_id", safe.alias("swap_safe"))

"""Quality rules, line first: lines that fail a rule are removed, then documents that lose too much are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, spare, table, words

SYMBOLS = "#*$%&|<>"
#: A line that says one of these is boilerplate. RE2 and Java read the pattern alike.
BOILERPLATE = r"(?i)all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie policy|uses cookies|enable javascript|click here|read more|subscribe to our|sign up for|share this|copyright (\(c\)|©)"
#: A run of two marks that sentences do not hold, as in shouting or symbol noise.
NOISE = r"[#*$%&|<>!?~^=_]{2,}"
BAR = "|"
WIDTH = 8


def repeated_words(ws: Column, width: int = WIDTH) -> Column:
    """How many words stand in a window of ``width`` words that the text holds twice or more, the first one included.

    Windows are held as 64-bit hashes. Texts whose windows all differ end at the distinct count; else the windows are sorted, those that
    equal a neighbour kept, and the union of their words measured by one fold over their places.
    """
    span = F.when(F.size(ws) >= width, F.sequence(F.lit(1), F.size(ws) - width + 1)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(span, lambda i: F.xxhash64(F.slice(ws, i, width)))

    def covered(sorted_):
        def twin(x, i):
            h = x["h"]
            return F.coalesce(F.get(sorted_, i - 1)["h"] == h, F.lit(False)) | F.coalesce(F.get(sorted_, i + 1)["h"] == h, F.lit(False))

        at = F.array_sort(F.transform(F.filter(sorted_, twin), lambda x: x["i"]))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i + width - a["end"])).alias("n"), (i + width).alias("end"))
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])

    def count(hs):
        placed = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(placed, covered))

    return let(windows, count)


def bad_line(line: Column, n: Column) -> Column:
    """Does a line of n words fail? Navigation: three bars or more. Boilerplate: a known phrase. Punctuation: every third word or more
    carries a run of marks, or eight words or more without any sentence mark."""
    bars = F.length(line) - F.length(F.translate(line, BAR, ""))
    plain = F.length(F.translate(line, ".,;:!?…。！？、", "")) == F.length(line)
    return (bars >= 3) | line.rlike(BOILERPLATE) | (F.regexp_count(line, F.lit(NOISE)) * 3 >= F.greatest(n, F.lit(1))) | ((n >= 8) & plain)


def quality(docs: DataFrame, text: str = "text", most_lost: float = 0.5) -> DataFrame:
    """docs' columns, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_words, kept, cleaned.

    One projection, no shuffle, so repeated rows and ties stay as they are. Null text counts as empty: all counts 0, base_failed, not kept,
    cleaned ''. An empty table gives an empty result. Added names that docs already has get "_" appended; no column of docs is touched.
    """
    w, l = spare(docs, "_w", "_l")
    names = spare(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words", "kept", "cleaned")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")

    def line_facts(ls):
        return F.transform(ls, lambda x: let(F.size(words(x)), lambda n: F.struct(x.alias("line"), n.alias("n"), ((n > 0) & bad_line(x, n)).alias("bad"))))

    facts = docs.withColumn(w, let(words(t), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_words(ws).cast("long").alias("again"))))
    facts = facts.withColumn(l, let(line_facts(lines), lambda ls: F.struct(
        let(F.filter(ls, lambda x: x["n"] > 0), lambda full: F.size(full) - F.size(F.array_distinct(F.transform(full, lambda x: x["line"])))).cast("long").alias("dups"),
        F.aggregate(ls, F.lit(0), lambda a, x: a + F.when(x["bad"], F.lit(0)).otherwise(x["n"])).cast("long").alias("kept"),
        F.array_join(F.transform(F.filter(ls, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("cleaned"),
    )))
    n, again = F.col(w)["n"], F.col(w)["again"]
    failed = (n < 20) | (100 * again > 30 * n)
    kept = ~failed & (F.col(l)["kept"] >= n * F.lit(1 - most_lost))
    out = (
        n,
        F.length(F.translate(t, SPACES, "")).cast("long"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        F.col(l)["dups"],
        again,
        failed,
        F.col(l)["kept"],
        kept,
        F.col(l)["cleaned"],
    )
    return facts.select(*docs.columns, *[c.alias(name) for c, name in zip(out, names, strict=True)])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a row each: the contract's counts, the verdict, and the words in the lines that stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


QUERIES = {"op9_quality": op9_quality}
ORACLES = {
    "op9_quality": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS x FROM d)),
g AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o,
             lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) AS g, lead(w, 7) OVER o IS NOT NULL AS whole
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE whole) WHERE c > 1),
n AS (SELECT doc_id, sum(least(8, coalesce(i - before, 8))) AS again
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
b AS (SELECT doc_id, line, n,
             length(line) - length(replace(line, '|', '')) >= 3
             OR regexp_matches(line, '(?i)all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie policy|uses cookies|enable javascript|click here|read more|subscribe to our|sign up for|share this|copyright (\(c\)|©)')
             OR len(regexp_extract_all(line, '[#*$%&|<>!?~^=_]{2,}')) * 3 >= greatest(n, 1)
             OR (n >= 8 AND NOT regexp_matches(line, '[.,;:!?…。！？、]')) AS bad
      FROM m WHERE n > 0),
k AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, coalesce(sum(n) FILTER (NOT bad), 0) AS kept FROM b GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(kept, 0) AS BIGINT) AS kept_words
      FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_words >= n_words * 0.5 AS kept, kept_words
FROM f
""",
}

"""Where claims come from: containment joins, labels on three-valued hits, and the algebra of answer-by-context cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def reshape_trace(responses: DataFrame, pretraining_only: bool = False) -> DataFrame:
    """responses: key, documents (array of struct source, usage, spans array of string, snippet). A row a stripped span text: key, span,
    matches."""
    d = responses.select("key", F.explode("documents").alias("d"))
    if pretraining_only:
        d = d.filter(F.col("d.usage") == "Pre-training")
    s = d.select("key", F.explode("d.spans").alias("span"), F.struct("d.source", "d.usage", F.left("d.snippet", F.lit(200)).alias("snippet")).alias("match"))
    return s.select("key", F.trim("span").alias("span"), "match").filter("span <> ''").groupBy("key", "span").agg(F.array_sort(F.collect_list("match")).alias("matches"))


def long_enough(c: Column, chars: int = 16, tokens: int = 3) -> Column:
    return (F.length(T.normalised(c)) >= chars) & (T.word_count(c) >= tokens)


def contained(claims: DataFrame, spans: DataFrame, *keys: str, both_ways: bool = True, least_words: int = 0) -> DataFrame:
    """Pairs of claim and span of equal keys where one normalised text holds the other (or, one way only, the claim holds the span). The
    keys are equi-joined, so only spans of one answer meet its claims."""
    s = spans.withColumn("_s", T.normalised(F.col("span"))).filter((F.col("_s") != "") & (T.word_count(F.col("span")) >= least_words))
    c = claims.withColumn("_c", T.normalised(F.col("claim")))
    hit = F.contains("_c", F.col("_s"))
    pairs = c.join(s, [*keys])
    return pairs.filter((hit | F.contains("_s", F.col("_c"))) & (F.col("_c") != "") if both_ways else hit).drop("_c", "_s")


def provenance(support: Column, parametric: Column) -> Column:
    return F.when(support != "none", "corpus").when(parametric.isNull(), "uncorroborated").when(parametric, "parametric").otherwise("unverified")


def cell_label(reliance: Column, hit: Column) -> Column:
    """Grounded is context or mixed here."""
    g = reliance.isin("context", "mixed")
    return F.when(hit.isNull(), F.when(g, "grounded?").otherwise("memory?")).when(g, F.when(hit, "both").otherwise("rag")).otherwise(F.when(hit, "parametric").otherwise("unverified"))


def cell_provenance(reliance: Column, hit: Column) -> Column:
    g = reliance.isin("context", "mixed")
    return F.when(hit.isNull(), "uncorroborated").when(g, "corpus").otherwise(F.when(hit, "parametric").otherwise("unverified"))


def quadrant(reliance: Column, hit: Column) -> Column:
    """Grounded is context alone here; mixed counts as not. The five names are fixed values."""
    c = reliance == "context"
    return (
        F.when(hit.isNull(), F.when(c, "context-use (trace n/a)").otherwise("parametric? (trace n/a)"))
        .when(c & hit, "corpus-grounded use").when(c, "context-driven, novel").when(hit, "parametric recall")
        .otherwise("UNVERIFIED (hallucination signal)")
    )


def phrase_counts(phrases: DataFrame, corpus: DataFrame, examples: int = 2, around: int = 300) -> DataFrame:
    """phrase, n (exact occurrences over all documents), docs (ids of the first few, by id) and snippets (up to ``around`` characters of each
    of those, from half as many before the phrase on). Both texts are normalised. Sums are partial; only the first few rows of a phrase are
    gathered, each partition keeping no more."""
    from pyspark.sql import Window

    from ..sources.tables import stored
    from .retrieval import holding

    asked = phrases.select("phrase").distinct()
    n = (F.length("_d") - F.length(F.replace("_d", "_p", F.lit("")))) / F.length("_p")
    at = F.greatest(F.instr("_d", F.col("_p")) - around // 2, F.lit(1))
    found = stored(holding(corpus, asked.withColumn("text", F.col("phrase")), "phrase").select("phrase", "doc_id", n.cast("long").alias("n"), F.substr("_d", at, F.lit(around)).alias("snippet")))
    first = found.groupBy("phrase", "doc_id").agg(F.min("snippet").alias("snippet")).withColumn("_i", F.row_number().over(Window.partitionBy("phrase").orderBy("doc_id"))).filter(F.col("_i") <= examples)
    shown = first.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("doc_id", "snippet"))).alias("shown"))
    found = found.groupBy("phrase").agg(F.sum("n").alias("n")).join(shown, "phrase")
    each = lambda name: F.transform("shown", lambda x: x[name]).alias(name + "s")
    return asked.join(found, "phrase", "left").select("phrase", F.coalesce("n", F.lit(0)).alias("n"), each("doc_id").alias("docs"), each("snippet"))


def divergence(lp: Column, lq: Column) -> Column:
    """KL(p || q) from log probabilities."""
    return F.aggregate(F.zip_with(lp, lq, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def overlaps(tokens: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """Half-open intervals: tokens (t_start, t_end) that share a character with spans (s_start, s_end) of equal keys."""
    return tokens.join(spans, [*keys]).filter("t_start < s_end AND t_end > s_start")


def coverage(answer: Column, context: Column, n: int = 3) -> Column:
    """Share of the answer's distinct n-grams that the context holds; 0 without any."""
    a, c = F.array_distinct(T.shingles(T.tokens(answer), n)), T.shingles(T.tokens(context), n)
    return T.let(F.struct(a.alias("a"), c.alias("c")), lambda s: F.when(F.size(s["a"]) > 0, F.round(F.size(F.array_intersect(s["a"], s["c"])) / F.size(s["a"]), 4)).otherwise(0.0))


def decompose(dd: Column, dh: Column, hd: Column, hh: Column) -> list[Column]:
    """Total shift, context and answer effects, interaction, and the context effect within each answer; total = context + answer."""
    parts = {"S": hh - dd, "Delta": ((dh - dd) + (hh - hd)) / 2, "A": ((hd - dd) + (hh - dh)) / 2, "I": dd + hh - dh - hd, "Delta_ad": dh - dd, "Delta_ah": hh - hd}
    return [v.alias(k) for k, v in parts.items()]


def gold_on_top(drops: Column, rank: Column) -> Column:
    """Is the gold passage the one whose removal costs most? Null with any null drop or without gold."""
    return F.when(rank.isNull() | F.exists(drops, lambda d: d.isNull()), F.lit(None).cast("boolean")).otherwise(F.array_position(drops, F.array_max(drops)) == rank)


def position_bucket(rank: Column) -> Column:
    return F.when(rank.isNull(), "none").when(rank == 1, "1").when(rank <= 3, "2-3").when(rank <= 7, "4-7").otherwise("8+")

"""Greedy packing of paragraphs, sentences and token windows into chunks under a token cap, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_NONE = "array<string>"


def token_length(c: Column) -> Column:
    return F.size(T.tokens(c))


def pack(items: Column, cap: int, joint: str) -> Column:
    """items: array of struct txt, n, sub. Items join the open chunk while it stays within ``cap``; an item with ``sub`` closes it and adds
    its own chunks instead. Order matters, so this is a fold, not a window."""

    def closed(acc):
        return F.when(acc["cur"].isNotNull(), F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])

    def state(done, cur, n):
        return F.struct(done.alias("done"), cur.cast("string").alias("cur"), n.cast("int").alias("n"))

    def step(acc, x):
        full = acc["cur"].isNotNull() & (acc["n"] + x["n"] > cap)
        return (
            F.when(F.size(x["sub"]) > 0, state(F.concat(closed(acc), x["sub"]), F.lit(None), F.lit(0)))
            .when(full, state(closed(acc), x["txt"], x["n"]))
            .when(acc["cur"].isNotNull(), state(acc["done"], F.concat(acc["cur"], F.lit(joint), x["txt"]), acc["n"] + x["n"]))
            .otherwise(state(acc["done"], x["txt"], x["n"]))
        )

    return F.aggregate(items, state(F.array().cast(_NONE), F.lit(None), F.lit(0)), step, closed)


def windows(c: Column, cap: int) -> Column:
    """Consecutive runs of ``cap`` tokens, joined by a space."""
    one = F.transform(F.array(T.tokens(c)), lambda ws: F.when(F.size(ws) > 0, F.transform(F.sequence(F.lit(0), F.size(ws) - 1, F.lit(cap)), lambda i: F.array_join(F.slice(ws, i + 1, cap), " "))).otherwise(F.array().cast(_NONE)))
    return one[0]


def item(c: Column, cap: int, below) -> Column:
    n = token_length(c)
    return F.struct(c.alias("txt"), n.alias("n"), F.when(n > cap, below(c)).otherwise(F.array().cast(_NONE)).alias("sub"))


def sentence_chunks(c: Column, cap: int) -> Column:
    return pack(F.transform(T.sentences(c), lambda s: item(s, cap, lambda x: windows(x, cap))), cap, " ")


def page_chunks(c: Column, cap: int, split: str = "\n\n") -> Column:
    """A page within the cap is one chunk; else its paragraphs are packed, over-cap ones by sentence, over-cap sentences by token window."""
    paragraphs = F.filter(F.split(T.or_empty(c), split), lambda p: F.trim(p) != "")
    packed = pack(F.transform(paragraphs, lambda p: item(p, cap, lambda x: sentence_chunks(x, cap))), cap, split)
    whole = F.when(F.trim(T.or_empty(c)) == "", F.array().cast(_NONE)).otherwise(F.array(c))
    return F.when(token_length(c) <= cap, whole).otherwise(packed)


def chunks(pages: DataFrame, cap: int, slug: str = "slug", page: str = "page", split: str = "\n\n") -> DataFrame:
    """chunk_id ``slug:page:sub``, slug, page, sub_index, text, token_count."""
    rows = pages.select(F.col(slug).alias("slug"), F.col(page).alias("page"), F.posexplode(page_chunks(F.col("text"), cap, split)).alias("sub_index", "text"))
    return rows.select(F.concat_ws(":", "slug", F.col("page").cast("string"), F.col("sub_index").cast("string")).alias("chunk_id"), "slug", "page", "sub_index", "text", token_length(F.col("text")).alias("token_count"))


def document_rows(entries: DataFrame, urls: str = "urls") -> DataFrame:
    """A row a URL of each entry, one for none: the first keeps the slug, others are slug_2, slug_3, ... with the entry as parent."""
    at = F.col("idx")
    rows = entries.select("*", F.posexplode_outer(F.col(urls)).alias("idx", "url")).withColumn("idx", F.coalesce("idx", F.lit(0)))
    return rows.withColumn("parent_slug", F.when(at > 0, F.col("slug"))).withColumn("slug", F.when(at == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), (at + 1).cast("string"))))

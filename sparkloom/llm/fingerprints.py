"""Document fingerprints: threshold-scaled sketches that keep every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table, words

WIDTH = 5
#: One shingle in so many is kept.
SCALE = 8
#: Hex digits a kept hash is written with; the range it is kept from is 2^(4 * DIGITS) / SCALE wide.
DIGITS = 12


def below(hashes: Column, scale: int) -> Column:
    """The hashes under the threshold, distinct and ascending; where there is none, the least one alone."""
    low = F.filter(hashes, lambda h: h < (1 << 4 * DIGITS) // scale)
    least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(least)


def sketch(text: Column, scale: int = SCALE) -> Column:
    """The kept hashes, distinct and ascending, as array of long.

    Shingles are five words in lower case; a text of fewer words has one shingle of all its words, a text without words none. All hashes
    below 2^48 / scale are kept, so sketches of one scale can be united and compared whatever the documents' lengths. A text with words
    whose hashes all lie above keeps its least one, so that it has a fingerprint at all; ``merge`` knows of that one.
    """

    def hashes(ws: Column) -> Column:
        span = F.when(F.size(ws) > 0, F.sequence(F.lit(1), F.greatest(F.size(ws) - WIDTH + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(span, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(ws, i, WIDTH)), 64 - 4 * DIGITS))

    return let(let(words(F.lower(text)), hashes), lambda hs: below(hs, scale))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the two shingle sets' union, from their sketches alone. Hashes above the threshold are only there as a set's least
    one: they go as soon as the other set has one below, and of two such the lesser stays."""
    return let(F.array_union(a, b), lambda hs: below(hs, scale))


def written(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), ",")


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Jaccard of two texts' shingles, as estimated from their sketches: what both hold of the union's sketch; 1 for two empty ones."""

    def share(both: Column) -> Column:
        either = merge(a, b, scale)
        held = F.when(F.size(both) == 0, F.lit(0)).otherwise(F.size(F.array_intersect(both, either)))
        return F.when(F.size(either) == 0, F.lit(1.0)).otherwise(held / F.size(either))

    return let(F.array_intersect(a, b), share)


def containment(a: Column, b: Column) -> Column:
    """The share of a's shingles that b holds, as estimated from their sketches, however unequal the texts; null for a without shingles."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def with_next(docs: DataFrame, key: str = "doc_id", bucket_bytes: int = 8_000_000, most_buckets: int = 65_536) -> tuple[DataFrame, list]:
    """docs in ranges of ``key``, with the columns _bucket and _guest, and the window order inside a bucket.

    Each bucket also gets the first row of the next one as a guest, and the last bucket the very first row of all, so that "the next
    row" is always found inside a bucket: no window over all rows and one shuffle of the texts. Buckets hold about ``bucket_bytes`` of text;
    their bounds are the least keys of a range partitioning, so keys of any ordered type do, and come to the driver: above ``most_buckets``
    of them (0.5 TB) buckets grow instead. Each bound is a key that occurs, and so the first of its bucket. Null keys go last; equal keys
    go by text and meet in one bucket.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(most_buckets, size // bucket_bytes))
    ids = docs.select(key).filter(F.col(key).isNotNull())
    if parts > 1:
        ids = ids.repartitionByRange(parts, key).groupBy(F.spark_partition_id()).agg(F.min(key).alias(key)).select(key)
    else:
        ids = ids.agg(F.min(key).alias(key))
    bounds = sorted(r[0] for r in ids.collect() if r[0] is not None)
    last = max(len(bounds) - 1, 0)
    kind = docs.schema[key].dataType.simpleString()
    edge = F.from_json(F.lit(json.dumps(bounds, default=str)), f"array<{kind}>")  # one literal; the search below looks at 16 of them a row
    # binary search: the last bound that is not above the key
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, last).bit_length()))])
    at = F.when(F.col(key).isNull(), F.lit(last)).otherwise(F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.coalesce(F.get(edge, a + s) <= F.col(key), F.lit(False)), a + s).otherwise(a)))
    placed = docs.withColumn("_at", at)
    first = F.col(key).eqNullSafe(F.get(edge, F.col("_at")))
    home = F.struct(F.col("_at").alias("_bucket"), F.lit(0).alias("_guest"))
    guest = F.struct(F.when(F.col("_at") == 0, F.lit(last)).otherwise(F.col("_at") - 1).alias("_bucket"), F.lit(1).alias("_guest"))
    rows = placed.withColumn("_places", F.when(first, F.array(home, guest)).otherwise(F.array(home))).select(*docs.columns, F.inline("_places"))
    return rows, [F.col("_guest"), F.col(key).asc_nulls_last(), F.col("text")]


def fingerprints(docs: DataFrame, key: str = "doc_id", scale: int = SCALE) -> DataFrame:
    """docs: key and text. Each document and its edited text: key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next,
    and within_edited, within_next: the share of the document's shingles that the other text holds.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document by key; after
    the last comes the first (with a single document: itself). Null text counts as empty: no hash, an empty fingerprint. Equal keys go by
    text, null keys come last, keys may be of any ordered type, and repeated rows follow one another. Columns other than key and text are
    not carried, so none can clash. An empty table gives an empty result.
    """
    docs = docs.select(F.col(key).alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, order = with_next(docs, "_id")
    inside = Window.partitionBy("_bucket").orderBy(*order)
    rows = rows.withColumn("_next", F.lead("text").over(inside)).withColumn("_sketch", sketch(F.col("text"), scale))
    rows = rows.withColumn("_next_sketch", F.lead("_sketch").over(inside)).filter("_guest = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("_next", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("_edited_sketch", sketch(F.col("edited"), scale))
    own, changed, after = F.col("_sketch"), F.col("_edited_sketch"), F.col("_next_sketch")
    return rows.select(
        F.col("_id").alias(key),
        n.cast("long").alias("n_chars"),
        "edited",
        written(own).alias("fingerprint"),
        written(changed).alias("edited_fingerprint"),
        likeness(own, changed, scale).alias("near_edited"),
        likeness(own, after, scale).alias("near_next"),
        containment(own, changed).alias("within_edited"),
        containment(own, after).alias("within_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a row each: fingerprints of the text and the edited text, and how like the estimates say they are."""
    marks = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marks.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "within_edited", "within_next")


QUERIES = {"op3_fingerprints": op3_fingerprints}
ORACLES: dict[str, str] = {}

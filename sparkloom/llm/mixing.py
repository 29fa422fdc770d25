"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import count_words, let, spare, stored, table

SEED = 20240


def source_key(source: Column) -> Column:
    """A join key that keeps null apart from every text."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share=1.5, most=2.0) -> DataFrame:
    """sizes: _key, _source, _words, _docs, one row a source. Adds _target.

    Sources in code-point order, null last, weigh as ``weights``, repeated. They share ``share`` times all words by weight; a
    target stops at ``most`` times its source's words and what exceeds that is shared again by weight, until none is above. That is
    water filling: with sources sorted by cap / weight, the level is (total - caps before) / (weights from here on) at the first source
    that this level does not fill. The windows are over one row a source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("_i", F.row_number().over(everything.orderBy(F.col("_source").isNull(), F.col("_source").cast("string"))))
        .withColumn("_w", w)
        .withColumn("_cap", F.col("_words") * F.lit(float(most)))
        .withColumn("_total", F.sum("_words").over(everything) * F.lit(float(share)))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_level", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(everything))
        .withColumn("_target", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w"))))
        .drop("_i", "_w", "_cap", "_total", "_level")
    )


def _log_factorial(n: Column) -> Column:
    """ln n! for whole n as double: exact up to 15, then Stirling's series, whose next term is below 1e-11."""
    x = F.greatest(n, F.lit(1.0))
    series = x * F.ln(x) - x + F.ln(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 16, F.ln(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def hypergeometric(u: Column, total: Column, own: Column, places: Column) -> Column:
    """How many of ``own`` among ``total`` items fall on ``places`` of them, by inversion at u in [0, 1).

    Probabilities are summed from the mode outwards, in turns up and down, each from its neighbour's by their ratio. 24 standard
    deviations and 48 more steps leave out less than 1e-30, so a draw takes steps in the root of the items, not one an item.
    """
    n, k, t = places.cast("double"), own.cast("double"), total.cast("double")
    lo, hi = F.greatest(F.lit(0.0), n - (t - k)), F.least(n, k)

    def walk(p: Column) -> Column:
        lo, hi, n, k, t, m = (p[c] for c in ("lo", "hi", "n", "k", "t", "m"))
        log = sum((_log_factorial(x) for x in (k, t - k, n, t - n)), F.lit(0.0)) - sum((_log_factorial(x) for x in (t, m, k - m, n - m, t - k - n + m)), F.lit(0.0))
        spread = F.sqrt(n * (k / t) * ((t - k) / t) * ((t - n) / F.greatest(t - 1, F.lit(1.0))))
        steps = F.least(hi - lo, F.ceil(spread * 24) + 48).cast("int")

        def step(a, i):
            up = (a["up"] < hi) & ((i % 2 == 1) | (a["down"] <= lo))
            above = a["p_up"] * (k - a["up"]) * (n - a["up"]) / ((a["up"] + 1) * (t - k - n + a["up"] + 1))
            under = a["p_down"] * a["down"] * (t - k - n + a["down"]) / ((k - a["down"] + 1) * (n - a["down"] + 1))
            at = F.when(up, a["up"] + 1).otherwise(a["down"] - 1)
            sum_ = a["sum"] + F.when(up, above).otherwise(under)
            return F.struct(
                F.when(up, at).otherwise(a["up"]).alias("up"), F.when(up, above).otherwise(a["p_up"]).alias("p_up"),
                F.when(up, a["down"]).otherwise(at).alias("down"), F.when(up, a["p_down"]).otherwise(under).alias("p_down"),
                sum_.alias("sum"), F.coalesce(a["x"], F.when(p["u"] < sum_, at)).alias("x"),
            )

        def start(q: Column) -> Column:
            acc = F.struct(m.alias("up"), q.alias("p_up"), m.alias("down"), q.alias("p_down"), q.alias("sum"), F.when(p["u"] < q, m).alias("x"))
            return F.when(steps > 0, F.coalesce(F.aggregate(F.sequence(F.lit(1), steps), acc, step, lambda a: a["x"]), m)).otherwise(lo)

        return let(F.exp(log), start).cast("long")

    mode = F.least(hi, F.greatest(lo, F.floor((n + 1) * ((k + 1) / (t + 2))).cast("double")))
    given = F.struct(lo.alias("lo"), hi.alias("hi"), n.alias("n"), k.alias("k"), t.alias("t"), mode.alias("m"), u.alias("u"))
    return F.when(hi <= lo, lo.cast("long")).otherwise(let(given, walk))


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """quotas: _key, _units. Returns _key, _shard, _q, _from: each source's units dealt exactly over the shards, and how many of them go to
    shards before.

    A tree of ceil(log2(shards)) levels. A node holds how many units of each source go to its range of shards; it draws the left
    half's counts from the multivariate hypergeometric distribution (source after source, each a hypergeometric draw from what is left) and
    leaves the rest to the right half. Every level is one projection over the nodes, dealt over the tasks again as they become many;
    their quotas sum to the same totals at every level.
    """
    zero = F.lit(0).cast("long")
    sources = F.sort_array(F.collect_list(F.struct(F.col("_key").alias("key"), F.col("_units").cast("long").alias("q"), zero.alias("at"))))
    nodes = quotas.agg(sources.alias("qs")).select(F.lit(1).cast("long").alias("node"), F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "qs")
    # the expressions of a level, made once for all levels
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    total = F.aggregate("qs", zero, lambda a, s: a + s["q"])
    places = F.floor(F.col("total") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
    empty = F.array().cast("array<struct<key:string,q:bigint,at:bigint>>")

    def draw(acc, s):
        u = F.pmod(F.xxhash64(F.lit(seed), F.col("node"), s["key"]), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
        return let(
            hypergeometric(u, acc["total"], s["q"], acc["places"]),
            lambda x: F.struct((acc["total"] - s["q"]).alias("total"), (acc["places"] - x).alias("places"), F.concat(acc["xs"], F.array(F.struct(s["key"].alias("key"), x.alias("q"), s["at"].alias("at")))).alias("xs")),
        )

    start = F.struct(F.col("total").alias("total"), F.col("places").alias("places"), empty.alias("xs"))
    left = F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("qs", start, draw, lambda a: a["xs"]))
    rest = F.zip_with("qs", "left", lambda s, x: F.struct(s["key"].alias("key"), (s["q"] - x["q"]).alias("q"), (s["at"] + x["q"]).alias("at")))

    def half(node, lo, hi, qs):
        return F.struct(node.alias("node"), lo.alias("lo"), hi.alias("hi"), qs.alias("qs"))

    node = F.col("node")
    kids = F.when(F.col("left").isNull(), F.array(half(node * 2, F.col("lo"), F.col("hi"), F.col("qs")))).otherwise(
        F.array(half(node * 2, F.col("lo"), F.col("mid"), F.col("left")), half(node * 2 + 1, F.col("mid"), F.col("hi"), rest))
    )
    for level in range(max(0, math.ceil(math.log2(max(1, shards))))):
        if level and level % 10 == 0:
            nodes = nodes.repartition("node")
        nodes = nodes.withColumn("mid", mid).withColumn("total", total).withColumn("places", places).withColumn("left", left).select(F.inline(kids))
    return nodes.select(F.col("lo").alias("_shard"), F.inline("qs")).select(F.col("key").alias("_key"), "_shard", F.col("q").alias("_q"), F.col("at").alias("_from"))


def running(rows: DataFrame, hashed: Column, ties: list[str], value: Column, name: str, each: int = 5_000) -> DataFrame:
    """rows (with _key and _n, about how many a source has) plus ``name``: the sum of ``value`` over the rows of the same source before, by
    ``hashed``, then ``ties``. A source is cut along the hash into ranges of about ``each`` rows: a window inside the range plus the sum of
    the ranges before it, so no task sorts all rows of one source."""
    many = F.greatest(F.lit(1), F.ceil(F.col("_n") / each))
    share = F.shiftrightunsigned(hashed.bitwiseXOR(F.lit(-(1 << 63))), 11).cast("double") / F.lit(float(1 << 53))
    rows = rows.withColumn("_value", value).withColumn("_hash", hashed).withColumn("_range", F.floor(share * many).cast("long"))
    sums = rows.groupBy("_key", "_range").agg(F.sum("_value").alias("_sum"))
    sums = sums.withColumn("_first", F.sum("_sum").over(Window.partitionBy("_key").orderBy("_range")) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy("_key", "_range").orderBy("_hash", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(sums, ["_key", "_range"])
    return rows.withColumn(name, F.col("_first") + F.col("_before")).drop("_value", "_hash", "_range", "_first", "_before")


def mix(docs: DataFrame, size: Column | None = None, source: str = "source", weights=(3, 1, 2), share=1.5, most=2.0, block_words=250_000, block_docs=4_000, shard_words=500_000, seed: int = SEED) -> DataFrame:
    """The mix, a row a document: all columns of docs, then _words, _source_words, _target, _taken and _shards (one output shard a copy taken).

    Every source is cut by a hash of its rows into blocks of about ``block_words`` words and ``block_docs`` rows, so that a source with a
    third of all rows is spread over many tasks. A source whose target is c whole passes and a rest takes c copies of each block, then
    blocks in permuted order until the rest is met; of the block where it is met, documents in hash order that still fit. What stays open
    is less than the smallest document not taken there. Those units (block copies) are dealt over output shards of about ``shard_words``
    words by split_quotas: each shard gets a disjoint run of each source's permuted units. A shard is ordered inside by a hash (``emit``).

    Null text and empty text count 0 words (taken 0); a null source is a source of its own; equal rows are rows of their own; an empty
    table gives an empty result; columns whose names clash with the added ones keep their names, the added ones get "_" appended.
    """
    cols = docs.columns
    names = spare(docs, "_words", "_source_words", "_target", "_taken", "_shards")
    size = count_words(F.col("text")) if size is None else size
    own = F.struct(*[F.col(f"`{c}`") for c in cols]) if cols else F.struct(F.lit(0))
    rows = docs.select(own.alias("_row"), size.alias("_size"), source_key(F.col(source)).alias("_key"), F.col(source).alias("_source"))
    # over all columns, so that rows with one id (or none) do not meet in a block; rows that are equal throughout do
    ident = [F.col(f"_row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), *ident, F.col("_key"), F.col("_size")))
    targets = stored(source_targets(rows.groupBy("_key").agg(F.first("_source").alias("_source"), F.sum("_size").alias("_words"), F.count("*").alias("_docs")), weights, share, most))
    copies = F.when(F.col("_words") > 0, F.least(F.floor(F.col("_target") / F.col("_words") + F.lit(1e-9)), F.lit(math.floor(most)))).otherwise(F.lit(0)).cast("int")
    plan = targets.withColumn("_copies", copies).withColumn("_rest", F.greatest(F.lit(0.0), F.col("_target") - F.col("_copies") * F.col("_words")))
    plan = plan.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_words") / block_words), F.ceil(F.col("_docs") / block_docs)).cast("long"))
    plan = plan.select("_key", "_words", "_target", "_copies", "_rest", "_n")

    small = F.broadcast(plan)  # a row a source: names of sources, not data; the check below keeps it so
    if plan.count() > 200_000:
        small = plan
    dealt = rows.join(small, "_key").withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_h")), F.col("_n")))
    blocks = dealt.groupBy("_key", "_block").agg(F.sum("_size").alias("_bw"), F.first("_copies").alias("_copies"), F.first("_rest").alias("_rest"), F.first("_n").alias("_n"))
    blocks = (
        running(blocks, F.xxhash64(F.lit(seed + 2), "_key", "_block"), ["_block"], F.col("_bw"), "_passed")
        .withColumn("_open", F.col("_rest") - F.col("_passed"))
        .withColumn("_part", F.when(F.col("_open") <= 0, F.lit(0)).otherwise(F.when(F.col("_open") >= F.col("_bw"), F.lit(2)).otherwise(F.lit(1))))
        .withColumn("_units", F.col("_copies") + (F.col("_part") > 0).cast("int"))
    )
    blocks = stored(blocks.select("_key", "_block", "_bw", "_open", "_part", "_copies", "_units", "_n"))
    words = blocks.agg(F.sum(F.col("_bw") * F.col("_units"))).first()[0] or 0
    shards = max(1, round(words / shard_words))

    # a unit's number in its source's permuted order, and the runs of numbers that the tree gives to each shard
    units = blocks.filter("_units > 0").select("_key", "_n", "_block", F.explode(F.sequence(F.lit(1), F.col("_units"))).alias("_copy"))
    units = running(units, F.xxhash64(F.lit(seed + 3), "_key", "_block", "_copy"), ["_block", "_copy"], F.lit(1).cast("long"), "_u")
    runs = stored(split_quotas(blocks.groupBy("_key").agg(F.sum("_units").alias("_units")), shards, seed + 4).filter("_q > 0"))
    runs = runs.select("_key", "_shard", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_q") - 1)).alias("_u"))
    drawn = units.join(runs, ["_key", "_u"]).groupBy("_key", "_block").agg(F.sort_array(F.collect_list(F.struct("_copy", "_shard"))).alias("_drawn"))
    drawn = blocks.join(drawn, ["_key", "_block"], "left").select("_key", "_block", "_open", "_part", "_copies", F.transform("_drawn", lambda d: d["_shard"]).alias("_to"))

    members = dealt.groupBy("_key", "_block").agg(F.first("_words").alias("_words"), F.first("_target").alias("_target"), F.sort_array(F.collect_list(F.struct("_h", "_size", "_row"))).alias("_members"))
    members = members.join(drawn, ["_key", "_block"])
    # only in the block where the rest is met: documents in hash order, each if it still fits
    fits = F.aggregate(
        F.transform("_members", lambda m: m["_size"]),
        F.struct(F.col("_open").alias("open"), F.array().cast("array<boolean>").alias("in")),
        lambda a, s: F.struct((a["open"] - F.when(s <= a["open"], s).otherwise(F.lit(0))).alias("open"), F.concat(a["in"], F.array(s <= a["open"])).alias("in")),
        lambda a: a["in"],
    )
    members = members.withColumn("_in", F.when(F.col("_part") == 1, fits))
    out = members.select("_words", "_target", "_to", "_copies", "_in", "_part", F.posexplode("_members").alias("_at", "_m"))
    whole = F.coalesce(F.slice("_to", F.lit(1), F.col("_copies")), F.array().cast("array<int>"))
    last = (F.col("_part") == 2) | ((F.col("_part") == 1) & F.coalesce(F.get("_in", F.col("_at")), F.lit(False)))
    shards_of = F.when(last, F.concat(whole, F.slice("_to", F.col("_copies") + 1, 1))).otherwise(whole)
    out = out.select(*[F.col(f"_m._row.`{c}`").alias(c) for c in cols], F.col("_m._size").alias(names[0]), F.col("_words").cast("long").alias(names[1]), F.col("_target").alias(names[2]), shards_of.alias(names[4]))
    return out.withColumn(names[3], F.col(names[0]) * F.size(names[4])).select(*cols, *names)


def emit(mixed: DataFrame, docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed corpus itself: docs' columns and rows, each row as often as it was taken, by output shard and shuffled inside each shard.

    ``mixed`` is the result of ``mix`` on ``docs``. Rows that are taken no time go; null and empty texts count no words and go along with
    their block; equal rows are rows of their own; an empty table gives an empty result; a caller's columns may have any names.
    """
    shards = mixed.columns[len(docs.columns) + 4]
    shard, copy, order = spare(mixed, "_shard", "_copy_no", "_order")
    rows = mixed.select(*docs.columns, F.posexplode(shards).alias(copy, shard))
    rows = rows.withColumn(order, place(F.col(shard), F.col(copy), [F.col("doc_id")] if "doc_id" in docs.columns else [], seed))
    return rows.repartition(F.col(shard)).sortWithinPartitions(shard, order).select(*docs.columns)


def place(shard: Column, copy: Column, ident: list[Column], seed: int = SEED) -> Column:
    """What a shard is sorted by: the local shuffle."""
    return F.xxhash64(F.lit(seed + 5), shard, *ident, copy)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a row each: sizes, targets, words taken, and for each copy taken its shard and its place in the shard's shuffled order."""
    docs = table(spark, sf_dir, "documents")
    docs = stored(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")))
    mixed = mix(docs, size=F.col("size"))
    places = F.transform("_shards", lambda s, i: place(s, i, [F.col("doc_id")]))
    return mixed.select("doc_id", "size", F.col("_source_words").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.col("_shards").alias("shards"), places.alias("places"))


def pipeline_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, mixed to the sources' targets; a row for each copy taken."""
    return emit(mix(docs), docs)


QUERIES = {"op1_mix": op1_mix}
ORACLES: dict[str, str] = {}

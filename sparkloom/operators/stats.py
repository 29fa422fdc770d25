"""Resampling and tests as grouped plans. Draws come from md5 of (seed, repetition, draw), so every engine can make the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_draw(seed: str, *parts: Column) -> Column:
    """A number below 2^32 from md5 of the seed and the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers from 0 in the order of a key, over a table that is already one row a cluster."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)).cast("long") - 1)


def bootstrap(clusters: DataFrame, key: str, sums: list[str], reps: int, seed: str) -> DataFrame:
    """clusters: one row a cluster with its sums and ``n``. rep and for each sum its mean in that resample of whole clusters.

    Clusters are drawn with replacement, as many as there are. Only (rep, draw) pairs and sums per cluster take part, never single rows.
    """
    spark = clusters.sparkSession
    total = clusters.count()
    draws = spark.range(reps * total).select(F.floor(F.col("id") / total).alias("rep"), (F.col("id") % total).alias("draw"))
    draws = draws.withColumn("at", hash_draw(seed, F.col("rep"), F.col("draw")) % total)
    picked = draws.join(F.broadcast(numbered(clusters, key, "at")) if total <= 200_000 else numbered(clusters, key, "at"), "at")
    return picked.groupBy("rep").agg(*(((F.sum(s) / F.sum("n")).alias(s)) for s in sums))


def interval(values: Column, digits: int = 6) -> list[Column]:
    low, high = (F.percentile(values, F.lit(q)) for q in (0.025, 0.975))
    return [F.round(low, digits).alias("low"), F.round(high, digits).alias("high")]


def bootstrap_numpy(df: DataFrame, value: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean with NumPy's own generator, one task: for parity with published numbers on small inputs; n < 2 gives NaN."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        x = pdf[value].to_numpy(float)
        if len(x) < 2:
            return pd.DataFrame({"low": [np.nan], "high": [np.nan]})
        means = x[np.random.default_rng(seed).integers(0, len(x), (reps, len(x)))].mean(1)
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({"low": [low], "high": [high]})

    return df.select(value, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, "low double, high double")


def mcnemar(b: Column, c: Column, empty: float | None = 1.0) -> Column:
    """Exact two-sided p for b against c discordant pairs; ``empty`` where there are none. The tail is summed in logs by a fold that carries
    the last binomial coefficient."""
    n, k = b + c, F.least(b, c)

    def step(acc, i):
        logc = acc["logc"] + F.log((n - i + 1) / i)
        return F.struct(logc.alias("logc"), (acc["sum"] + F.exp(logc - n * F.log(F.lit(2.0)))).alias("sum"))

    start = F.struct(F.lit(0.0).alias("logc"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    counted = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(counted, start, step, lambda a: a["sum"])
    return F.when(n == 0, F.lit(empty).cast("double")).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(df: DataFrame, p: str = "p", order: str = "pair", *keys: str) -> DataFrame:
    """Step-down adjusted p: the running maximum of (m - i) p over ascending p, at most 1."""
    by = Window.partitionBy(*(keys or (F.lit(0),)))
    up = by.orderBy(p, order)
    scaled = (F.count("*").over(by) - F.row_number().over(up) + 1) * F.col(p)
    return df.withColumn("_s", scaled).withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(up.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def midranks(df: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """Ranks from 1, ties at their mean. Values are counted first, so windows run over distinct values."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(value)
    ranks = counts.withColumn(name, F.sum("_c").over(w) - (F.col("_c") - 1) / 2).drop("_c")
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """rho by midranks; null under three rows."""
    ranked = midranks(midranks(df, x, "_rx", *keys), y, "_ry", *keys)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(F.corr("_rx", "_ry"), 6)).alias("rho"))


def auc(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Area under the curve (Mann-Whitney, midranks); null if a class is empty."""
    pos = F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0))
    neg = F.sum(F.when(F.col(label) == 0, 1.0).otherwise(0.0))
    ranked = midranks(df.filter(F.col(label).isin(0, 1)), score, "_r", *keys)
    u = F.sum(F.when(F.col(label) == 1, F.col("_r")).otherwise(0.0)) - pos * (pos + 1) / 2
    return ranked.groupBy(*keys).agg(pos.cast("long").alias("n_pos"), neg.cast("long").alias("n_neg"), F.when((pos > 0) & (neg > 0), F.round(u / (pos * neg), 6)).alias("auc"))


def wilson(k: Column, n: Column, z: float = 1.96, digits: int = 6) -> list[Column]:
    """Share and its Wilson interval; null for n = 0."""
    p = k / n
    mid, half, over = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return [F.when(n > 0, F.round(v, digits)).alias(a) for a, v in (("share", p), ("low", (mid - half) / over), ("high", (mid + half) / over))]


def cohens_d(x: str) -> Column:
    """Mean over sample deviation; null for one row or no spread."""
    sd = F.stddev_samp(x)
    return F.when((F.count(x) > 1) & (sd > 0), F.round(F.avg(x) / sd, 6))


def keep_fraction(scored: DataFrame, fraction: float, score: str = "score") -> DataFrame:
    """Rows at or above the (1 - fraction) quantile of all scores (linear); everything scored for 1; unscored rows go."""
    if not 0 < fraction <= 1:
        raise ValueError(f"fraction {fraction} is not in (0, 1]")
    kept = scored.filter(F.col(score).isNotNull())
    if fraction == 1:
        return kept
    bar = kept.agg(F.percentile(score, F.lit(1 - fraction)).alias("_bar"))
    return kept.crossJoin(F.broadcast(bar)).filter(F.col(score) >= F.col("_bar")).drop("_bar")

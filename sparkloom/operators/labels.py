"""Label logs, annotation samples and cross-tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import hash_draw


def latest(log: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the order given, later ones breaking ties: an aggregate with partial sums, not a window over whole keys."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def round_robin(df: DataFrame, bucket: str, arm: str, key: str, quota: int, seed: str) -> DataFrame:
    """A sampling operator: per bucket up to ``quota`` rows, taken from its arms in turn, each arm in hash order. Only the first ``quota`` of
    each arm can be taken, so an arm is cut to them before arms meet."""
    own = Window.partitionBy(bucket, arm).orderBy(hash_draw(seed, F.col(key)), key)
    cut = df.withColumn("round", F.row_number().over(own)).filter(F.col("round") <= quota)
    turn = Window.partitionBy(bucket).orderBy("round", arm)
    return cut.withColumn("place", F.row_number().over(turn)).filter(F.col("place") <= quota)


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column with a total a row and one row 'all'; rows without any count do not occur."""
    c = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    c = c.select(row, *(F.coalesce(v, F.lit(0)).alias(v) for v in values)).withColumn("total", sum((F.col(v) for v in values), F.lit(0)))
    return c.unionByName(c.agg(F.lit("all").alias(row), *(F.sum(v).alias(v) for v in [*values, "total"])))


def passages(records: DataFrame, chunks: DataFrame, ids: str = "ids") -> DataFrame:
    """records with an array of chunk ids: the ids' texts in order, a fixed text where one is missing."""
    e = records.select(*[c for c in records.columns if c != ids], F.posexplode(ids).alias("at", "chunk_id"))
    j = e.join(chunks, "chunk_id", "left").withColumn("text", F.coalesce("text", F.lit("(chunk text not found)")))
    keep = [c for c in records.columns if c != ids]
    return j.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("at", "chunk_id", "text"))).alias("passages"))


def todo(sample: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return sample.join(done.select(key), key, "left_anti")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(100 * part / whole, digits))

"""Helpers that the training-data operators share."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Worker functions travel inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: What counts as a word in every contract: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a local session (as in tests) gets a temporary one; a
    cluster's executors would not see that, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/sparkloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(df: DataFrame) -> DataFrame:
    """df, after asking the driver to collect its garbage: Spark deletes the shuffle files of a plan once the plan is collected, which would
    else be at some later time, and those of tables already written would fill the disks until then."""
    import gc

    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often and in whatever lambda use() refers to it."""
    return F.transform(F.array(value), use)[0]


def running_sums(values: Column, width: int = 32, levels: int = 3) -> Column:
    """For an array of numbers: the sum of all before each, as array of long. Linear but for the last level.

    A fold that appends to an array copies it at every step, so only blocks of ``width`` are folded; where blocks start is the running sum
    of their totals, one level up. After three levels of 32 the top fold is over a thousandth of the items.
    """

    def fold(xs: Column, start: Column) -> Column:
        acc = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, acc, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def sums(xs: Column, level: int) -> Column:
        if level == 1:
            return fold(xs, F.lit(0).cast("bigint"))
        places = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(width))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(places, lambda i: F.slice(xs, i, width))

        def inside(bs: Column) -> Column:
            totals = F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
            return let(let(totals, lambda t: sums(t, level - 1)), lambda starts: F.flatten(F.transform(bs, lambda b, i: fold(b, F.get(starts, i)))))

        return let(blocks, inside)

    return let(values.cast("array<bigint>"), lambda xs: sums(xs, levels))


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(flat, " "), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, close to the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hex_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def lean_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """df, with Arrow batches of its session cut to so many rows: rows here hold whole texts, and the usual 10,000 of them at once, on both
    sides of the pipe and as Python strings, would be most of an executor's memory. Spark bounds batches by rows, so this is per session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= rows:
        conf.set(key, str(rows))
    return df


def released(run):
    """A worker function over batches that gives freed memory back to the system when its task ends. Python workers outlive their tasks, and
    what they keep for reuse would add up over an executor's workers."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not the GNU C library
                pass

    return wrapped

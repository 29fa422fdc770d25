"""The label log as a stream: appended records, and a table of the latest label of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.labels import latest


def keep_latest(log: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Each batch's records, without those delivered twice, are folded into the table at ``path``; a restart goes on where it stopped. The
    table is written anew beside the old one and named in a pointer file of one row, so a reader never sees half of it."""
    spark = log.sparkSession
    unique = log.withWatermark(order, late).dropDuplicatesWithinWatermark([*keys, order])

    def fold(batch: DataFrame, number: int) -> None:
        new = latest(batch, keys, order)
        if (old := current(spark, path)) is not None:
            new = latest(old.unionByName(new), keys, order)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")
        spark.createDataFrame([(number,)], "version long").write.mode("append").parquet(f"{path}/versions")

    return unique.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        version = spark.read.schema("version long").parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    return None if version is None else spark.read.parquet(f"{path}/v{version}")

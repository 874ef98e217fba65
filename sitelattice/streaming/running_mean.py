"""Mean per (entity, item) kept up to date over arriving event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def running_item_means(spark: SparkSession, source: str, state: str, key: str, item: str, value: str,
                       schema: str, files_per_batch: int = 2) -> DataFrame:
    """Read all files waiting in ``source`` as a stream; return means over everything seen.

    Each micro-batch adds its (sum, count) partials as one more folder, so a batch costs its
    own rows only and a replayed batch overwrites its own folder. Sums and counts are
    associative: the means are one aggregate over the partials.
    """
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
              .where(F.col(value).isNotNull()))

    def add(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(key, item).agg(F.sum(value).alias("s"), F.count(value).alias("n")).write.mode(
            "overwrite").parquet(f"{state}/partials/batch={epoch}")

    q = (stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{state}/offsets")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    p = spark.read.parquet(f"{state}/partials")
    return p.groupBy(key, item).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))

"""A folder that new manifest files land in, processed as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], keys: list[str]) -> StreamingQuery:
    """Append the transformed rows of new Parquet files whose keys the output does not hold yet.

    Each batch is anti-joined with what is there, so files delivered twice add nothing. A batch writes its own folder
    `batch=<number>`, which a restarted batch writes over and does not look at, so nothing is written twice. A read that fails ends the stream.
    """

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = transform(batch).dropDuplicates(keys)
        place = session._jvm.org.apache.hadoop.fs.Path(out)
        if place.getFileSystem(session._jsc.hadoopConfiguration()).exists(place):
            held = session.read.parquet(out).where(F.col("batch") != number).select(*keys)
            fresh = fresh.join(held, keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

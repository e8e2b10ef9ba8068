"""A restartable download as a file-source stream.

Requests arrive as Parquet files; each key is fetched once, whatever is restarted: what was fetched
before is what lies in the output, so the stream itself keeps no state. One run works through what is
there and ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.fetch import fetched


def requests(spark: SparkSession, path: str, schema: str = "url string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run(spark: SparkSession, inbox: str, out: str, checkpoint: str, source) -> None:
    """Fetch all that is new in the inbox into `out`, exactly once by batch."""

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["url"])
        if number:
            done = batch.sparkSession.read.schema("url string, batch long").parquet(out)
            new = new.join(done.where(F.col("batch") < number).select("url"), "url", "left_anti")
        # the batch's own folder is overwritten if it is run again
        fetched(new, source).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = requests(spark, inbox).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

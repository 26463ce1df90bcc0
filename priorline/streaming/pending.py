"""Stream semantics: results held back until a cutoff, and late captures kept but not eligible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.session import work_dir

def running_totals(events: DataFrame) -> DataFrame:
    """Per user the running count, total and last event: a streaming aggregate, whose state has a row for each user."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total_value"), F.max("event_id").alias("last_event"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and type. In append mode a window comes out once, when the watermark has passed its
    end, and its state goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_available(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a streaming query over what is there now and gives the rows it wrote, with their batch."""
    import uuid

    spark: SparkSession = stream.sparkSession
    base = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # A batch that runs again writes the same folder again.
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")

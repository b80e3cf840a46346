"""Incremental ingest: new files once, whatever else happened, and monthly rates of what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, version: str) -> None:
    """Takes the files that the checkpoint hasn't seen and keeps the last version of each key, by month.

    A batch is merged with what the target holds of its months and of the months its keys stood in before, and these
    months are replaced as a whole, so a key delivered again never stands twice and a batch that is done again changes
    nothing.
    """
    from refloom.operators.match import newest
    from refloom.session import cut

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        rows = newest(batch, key, version)
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.schema(schema).parquet(target)
            again = held.join(rows.select(key), key, "left_semi").select("month").distinct()
            # Months are few, of the calendar.
            months = rows.select("month").unionByName(again).distinct()
            old = held.join(F.broadcast(months), "month", "left_semi")
            rows = newest(old.select(*rows.columns).unionByName(rows), key, version)
            emptied = months.join(rows.select("month").distinct(), "month", "left_anti")
            rows, gone = cut(rows), [r["month"] for r in emptied.collect()]
            for month in gone:
                folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/month={month}")
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, width: str = "30 days", late: str = "7 days") -> DataFrame:
    """Counts by window; events later than the watermark are left out.  Works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")

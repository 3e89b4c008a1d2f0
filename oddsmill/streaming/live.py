"""

Books arrive as files (or from any source of the same columns). Event time is ``event_time``; a book later than the watermark is
dropped. State is what the watermark keeps: keys of books not yet out of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import books as B, tables

BOOKS = f"platform string, market_id string, ts bigint, bids {B.LEVELS}, asks {B.LEVELS}"


def book_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """[S10, S11] Arriving book files, bounded per micro-batch; empty books are left out."""
    raw = spark.readStream.schema(BOOKS).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return raw.where((F.size("bids") > 0) | (F.size("asks") > 0)).withColumn("event_time", F.timestamp_seconds("ts"))


def captured(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """[D3, B14] One snapshot per (platform, market_id, ts): the first to arrive within the watermark."""
    first = stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["platform", "market_id", "ts"])
    return B.snapshots(first)


def monitored(stream: DataFrame, width: str = "1 hour", late: str = "1 day", event_time: str = "event_time", value: str = "price") -> DataFrame:
    """Rows and mean of a value per platform and window of event time."""
    w = F.window(event_time, width)
    out = stream.withWatermark(event_time, late).groupBy(w, "platform").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), "platform", "n", "total")


def paper_signals(batch: DataFrame, pairs: DataFrame) -> DataFrame:
    """[J16, B15] Signals of the pairs that have a book on both venues in this micro-batch; of several books the newest counts."""
    newest = batch.groupBy("platform", "market_id").agg(F.max(F.struct("ts", "bids", "asks")).alias("b")).select("platform", "market_id", "b.*")
    one = newest.where("platform = 'pm'").select(F.col("market_id").alias("pm_id"), F.col("ts").alias("pm_ts"), F.col("bids").alias("pm_bids"), F.col("asks").alias("pm_asks"))
    two = newest.where("platform = 'k'").select(F.col("market_id").alias("k_id"), F.col("ts").alias("k_ts"), F.col("bids").alias("k_bids"), F.col("asks").alias("k_asks"))
    both = pairs.select("pm_id", "k_id", "category").join(one, "pm_id").join(two, "k_id").withColumn("ts", F.greatest("pm_ts", "k_ts"))
    return B.evaluate(both).where("touch_cost is not null")


def trade_on_paper(stream: DataFrame, pairs: DataFrame, sink: str, checkpoint: str, interval: str = "15 minutes", once: bool = False):
    """[B15, D4, S2] Each micro-batch of books becomes signals in a folder of its own batch number, so a batch that runs again replaces itself."""

    def sweep(batch: DataFrame, number: int) -> None:
        paper_signals(batch, pairs).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.foreachBatch(sweep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def recorded_signals(spark: SparkSession, sink: str) -> DataFrame:
    """[D4] All signals, one per pair and time."""
    rows = spark.read.parquet(sink).drop("batch")
    return tables.insert_ignore(rows.limit(0), rows, ["pm_id", "k_id", "ts"], required=("touch_cost",))


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything there is now, through the stream, as a table beside the checkpoint; a batch that runs again replaces its own part.

    In complete mode each batch holds the whole result, and the last one counts.
    """
    out = f"{checkpoint}-{name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    try:
        rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    except AnalysisException:  # nothing has arrived yet
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")
    return rows.drop("batch")


def per_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

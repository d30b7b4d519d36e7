"""The incremental runs as streams: landed messages merged in, late replies joined, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from askbook.sources import messages as M


def landed(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def merge_stream(stream: DataFrame, store: str, checkpoint: str, now: str) -> StreamingQuery:
    """Each micro-batch upserted into the table at `store`, which is a folder of versions and a pointer row to the last.

    A version is named by its batch, so a batch that runs again after a failure writes the same version anew and is applied once.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        held = current(spark, store, before=number)
        if held is None:
            held = spark.createDataFrame([], M.SCHEMA)
        done = M.upserted(held, M.newest_read(batch), now).drop("action")
        done.write.mode("overwrite").parquet(f"{store}/version={number:012d}")
        spark.range(1).select(F.lit(number).alias("version")).write.mode("append").json(f"{store}/_pointer")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str, before: int | None = None) -> DataFrame | None:
    """The last whole version (of a batch before the given one), None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        told = spark.read.schema("version bigint").json(f"{store}/_pointer")
    except AnalysisException:
        return None
    last = (told if before is None else told.where(F.col("version") < before)).agg(F.max("version")).first()[0]
    return None if last is None else spark.read.schema(M.SCHEMA).parquet(f"{store}/version={last:012d}")


def sold_stream(replies: DataFrame, listings: DataFrame, days: int = 365) -> DataFrame:
    """Streams of SOLD replies (channel, reply_to, sold_at) and listings (channel, message_id, listed_at) joined within so many days.

    Watermarks on both sides let old state go.
    """
    r = replies.withWatermark("sold_at", "1 day").alias("r")
    m = listings.withWatermark("listed_at", "1 day").alias("m")
    within = (F.col("sold_at") >= F.col("listed_at")) & (F.col("sold_at") <= F.col("listed_at") + F.expr(f"INTERVAL {days} DAYS"))
    return r.join(m, (F.col("r.channel") == F.col("m.channel")) & (F.col("r.reply_to") == F.col("m.message_id")) & within).select("m.channel", "m.message_id", "listed_at", "sold_at")


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start, event_type, n, total over event time; on a stream, rows later than the watermark are dropped by it."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")

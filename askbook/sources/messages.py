"""The table of raw messages: schema, migration, upsert, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askbook.config import DEFAULT, Config

KEY = ["channel", "message_id"]
_KINDS = {"id": T.LongType, "message_id": T.LongType, "photos_count": T.IntegerType, "views": T.LongType, "reply_to": T.LongType, "edit_count": T.IntegerType}
SCHEMA = T.StructType([
    T.StructField(name, _KINDS.get(name, T.StringType)())
    for name in ("id", "channel", "message_id", "posted_at", "message_text", "photos_count", "views", "scraped_at", "reply_to", "first_seen_at", "text_updated_at", "edit_count")
])


def registry(spark: SparkSession, channels: dict[str, int]) -> DataFrame:
    """channel, subscribers of the channels to read: configuration, a row for each."""
    return spark.createDataFrame(sorted(channels.items()), "channel string, subscribers bigint")


def write(messages: DataFrame, path: str) -> None:
    """Stored by month, clustered by channel, so date and channel predicates skip files."""
    messages.withColumn("month", F.substring("posted_at", 1, 7)).repartition("month", "channel").sortWithinPartitions("channel", "posted_at").write.mode("overwrite").partitionBy("month").parquet(path)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, since: str | None = None) -> DataFrame:
    """Chosen columns; `since` compares the text of posted_at, and the month it names prunes partitions."""
    rows = spark.read.parquet(path)
    if since:
        rows = rows.where((F.col("month") >= since[:7]) & (F.col("posted_at") >= since))
    return rows.select(*(columns or [c for c in rows.columns if c != "month"]))


def migrate(messages: DataFrame) -> DataFrame:
    """Columns that older tables lack, added; first_seen_at filled from scraped_at. Rows stay as many as they were."""
    out = messages
    for f in SCHEMA.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(0 if f.name == "edit_count" else None).cast(f.dataType))
    return out.withColumn("first_seen_at", F.coalesce("first_seen_at", "scraped_at")).withColumn("edit_count", F.coalesce("edit_count", F.lit(0)))


def newest_read(batch: DataFrame) -> DataFrame:
    """One row a message: of several reads of it the last by read_at, with the first reply link that any of them had."""
    other = [c for c in batch.columns if c not in (*KEY, "reply_to")]
    order = F.struct(*[F.col(c) for c in (["read_at"] if "read_at" in batch.columns else []) + ["posted_at", "message_text"]])
    told = batch.groupBy(*KEY).agg(F.max_by(F.struct(*other), order).alias("r"), F.min_by("reply_to", F.when(F.col("reply_to").isNotNull(), order)).alias("reply_to"))
    return told.select(*KEY, "r.*", "reply_to")


def upserted(held: DataFrame, batch: DataFrame, now: str) -> DataFrame:
    """The held messages with the batch's: action is insert, update, or null where nothing changed.

    A text that changed counts an edit and stamps it. A reply link is filled in, never cleared. Rows without a timestamp are
    skipped. One full outer join on the key; the result is a new version of the table, to be swapped in as a whole.
    """
    new = batch.where(F.col("posted_at").isNotNull() & (F.col("posted_at") != "")).select(*KEY, *[F.col(c).alias(f"n_{c}") for c in ("posted_at", "message_text", "photos_count", "views", "reply_to")], F.lit(True).alias("_new"))
    both = held.withColumn("_old", F.lit(True)).join(new, KEY, "full")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"n_{c}"))
    fresh = F.col("_old").isNull()
    text = differs("message_text")
    gained = F.col("n_reply_to").isNotNull() & F.col("reply_to").isNull()
    changed = ~fresh & F.col("_new").isNotNull() & (text | gained | differs("views") | differs("photos_count"))
    edited = changed & text
    take = fresh | changed
    pick = lambda c: F.when(take, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    own = {
        "posted_at": F.coalesce("posted_at", "n_posted_at"), "message_text": pick("message_text"), "photos_count": pick("photos_count"), "views": pick("views"),
        "reply_to": F.when(take, F.coalesce("n_reply_to", "reply_to")).otherwise(F.col("reply_to")), "first_seen_at": F.when(fresh, now).otherwise(F.col("first_seen_at")),
        "text_updated_at": F.when(edited, now).otherwise(F.col("text_updated_at")), "edit_count": F.when(fresh, 0).otherwise(F.col("edit_count") + edited.cast("int")),
    }
    return both.select(*[own[c].alias(c) if c in own else F.col(c) for c in held.columns], F.when(fresh, "insert").when(changed, "update").alias("action"))


def upsert_counts(done: DataFrame) -> DataFrame:
    return done.agg(F.count_if(F.col("action") == "insert").alias("inserted"), F.count_if(F.col("action") == "update").alias("updated"))


def high_water(messages: DataFrame) -> DataFrame:
    """channel, latest_id, oldest_id, total: the state that an incremental scan starts from."""
    return messages.groupBy("channel").agg(F.max("message_id").alias("latest_id"), F.min("message_id").alias("oldest_id"), F.count(F.lit(1)).alias("total"))


def incremental(pages: DataFrame, state: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Of read pages (channel, page from 0, message_id): all of the newest pages, for edits, and from deeper ones what is newer than the state.

    Pages beyond the cap are left out, which is a limit of the scan.
    """
    told = pages.where(F.col("page") < c.incremental_pages).join(state.select("channel", "latest_id"), "channel", "left")
    return told.where((F.col("page") < c.recheck_pages) | (F.col("message_id") > F.coalesce("latest_id", F.lit(-1)))).drop("latest_id").dropDuplicates(KEY)


def gap_warning(pages: DataFrame, state: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """channel of those whose deepest allowed page is still newer than the state: messages between are missing."""
    deep = pages.where(F.col("page") < c.incremental_pages).groupBy("channel").agg(F.min("message_id").alias("least"), F.max("page").alias("page"))
    return deep.join(state, "channel").where((F.col("page") == c.incremental_pages - 1) & (F.col("least") > F.col("latest_id"))).select("channel")


def next_before(html: Column) -> Column:
    """The cursor to the page before: the load-more mark, else the link to the previous page."""
    cursor = lambda p: F.regexp_extract(html, p, 1).try_cast("bigint")
    return F.coalesce(cursor(r'data-before="(\d+)"'), cursor(r'<link rel="prev" href="/s/[^/]+/\?before=(\d+)"'))

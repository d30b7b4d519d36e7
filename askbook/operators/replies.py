"""Sales told by replies: a SOLD message answers its listing, directly or through other SOLD messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askbook.config import DEFAULT, Config
from askbook.functions.numbers import distribution_of, floor_days


def sold_chain(messages: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """channel, sold_id, listing_id, sold_at: for each SOLD reply the first message up its chain that isn't SOLD.

    messages: channel, message_id, reply_to, posted_at, sold. A chain is followed over at most max_hops
    messages and dropped if it ends, or a parent is missing, before. Each hop is an equi-join on the unique (channel, message_id).
    """
    parents = messages.select(F.col("channel").alias("c"), F.col("message_id").alias("m"), F.col("sold").alias("p_sold"), F.col("reply_to").alias("p_reply"))
    start = messages.where(F.col("sold") & F.col("reply_to").isNotNull()).select("channel", F.col("message_id").alias("sold_id"), F.col("posted_at").alias("sold_at"), F.col("reply_to").alias("target"), F.lit(None).cast("bigint").alias("listing_id"))
    for _ in range(c.max_hops):
        met = start.join(parents, (F.col("channel") == F.col("c")) & (F.col("target") == F.col("m")), "left")
        found = F.coalesce("listing_id", F.when(~F.col("p_sold"), F.col("target")))
        onward = F.when(found.isNull() & F.col("p_sold"), F.col("p_reply"))
        start = met.select("channel", "sold_id", "sold_at", onward.alias("target"), found.alias("listing_id"))
    return start.where("listing_id IS NOT NULL").select("channel", "sold_id", "listing_id", "sold_at")


def sales(chain: DataFrame, listings: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The chain's sales of known listings with days_to_sell within bounds; listings: channel, message_id, posted_at and what else to keep."""
    own = listings.withColumnRenamed("message_id", "listing_id")
    told = chain.join(own, ["channel", "listing_id"])
    return told.withColumn("days_to_sell", floor_days(F.col("posted_at"), F.col("sold_at"))).where(F.col("days_to_sell").between(0, c.max_sell_days))


def removals(chain: DataFrame, messages: DataFrame, listings: DataFrame, artefact_from: str, artefact_to: str) -> DataFrame:
    """channel, listing_id, strategy: listings sold by reply, else by an edit that made them SOLD outside a migration's time window.

    messages need edit_count and text_updated_at (text) besides.
    """
    ids = listings.select("channel", F.col("message_id").alias("listing_id")).distinct()
    replied = chain.select("channel", "listing_id").distinct().join(ids, ["channel", "listing_id"], "left_semi").withColumn("strategy", F.lit("reply_link"))
    artefact = F.coalesce(F.substring("text_updated_at", 1, 16).between(artefact_from, artefact_to), F.lit(False))
    edited = messages.where((F.col("edit_count") > 0) & F.col("sold") & ~artefact).select("channel", F.col("message_id").alias("listing_id")).distinct()
    edited = edited.join(ids, ["channel", "listing_id"], "left_semi").join(replied, ["channel", "listing_id"], "left_anti").withColumn("strategy", F.lit("edited"))
    return replied.unionByName(edited)


def removal_stats(removed: DataFrame, sold: DataFrame) -> DataFrame:
    """Counts by strategy and quantiles of the days to sell (position n*p); counts by value, not sales, are gathered for them."""
    counts = removed.agg(F.count(F.lit(1)).alias("total_removed"), F.count_if(F.col("strategy") == "reply_link").alias("reply_link"), F.count_if(F.col("strategy") == "edited").alias("edited"))
    told = sold.groupBy("channel", "listing_id").agg(F.min_by("days_to_sell", "sold_id").alias("d")).agg(*distribution_of("d")).withColumnRenamed("n", "samples")
    return counts.join(told)  # one row each


def prefer_fresh(fresh: DataFrame, past: DataFrame, keys: list[str]) -> DataFrame:
    """Union of removals, with the fresh reason where both have one."""
    return fresh.unionByName(past.join(fresh, keys, "left_anti"))


def speed_by_brand(sold: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """brand, n, published, median, p25, p75: the latter null where too few sales are known."""
    told = sold.groupBy("brand").agg(*distribution_of("days_to_sell"))
    out = F.col("n") >= c.brand_sales_min
    return told.select("brand", "n", out.alias("published"), *[F.when(out, F.col(x)).alias(x) for x in ("median", "p25", "p75")])


def speed_overall(sold: DataFrame) -> DataFrame:
    """n, median, p25, p75 of the days to sell over all sales."""
    return sold.agg(*distribution_of("days_to_sell"))


def withheld(sold: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """brand and n of the brands whose sales are too few to be told."""
    return speed_by_brand(sold, c).where("NOT published").select("brand", "n")

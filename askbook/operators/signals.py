"""Market signals: price moves while listed, inventory inflation, attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askbook.config import DEFAULT, Config
from askbook.functions.numbers import distribution_of
from askbook.operators.dedupe import sized


def price_movement(summaries: DataFrame) -> DataFrame:
    """From summaries of groups: how many were listed again, cut or raised, and by how much at the median."""
    again = summaries.where("times_listed > 1")
    cut = F.col("price_change_pct") < 0
    return again.agg(
        F.count(F.lit(1)).alias("reposted"), F.count_if(cut).alias("price_cuts"), F.count_if(F.col("price_change_pct") > 0).alias("price_rises"),
        F.round(F.median(F.when(cut, F.col("price_change_pct"))), 2).alias("median_cut_pct"), F.median("days_listed").cast("int").alias("median_days_listed"),
        F.min(F.when(cut, F.col("price_change_pct"))).alias("biggest_cut_pct"),
        F.min_by("group_id", F.when(cut, F.struct("price_change_pct", "group_id"))).alias("biggest_cut_group"),
    )


def inventory(grouped: DataFrame) -> DataFrame:
    """From records with group_id, or from items, how much more listings there are than items."""
    raw = sized(grouped).agg(*_stock())
    return raw.withColumn("apparent_inflation_pct", _inflation())


def moves_and_stock(items: DataFrame) -> DataFrame:
    """price_cuts of price_movement and apparent_inflation_pct of inventory, by one look at the items."""
    raw = items.agg(*_stock(), F.count_if((F.col("times_listed") > 1) & (F.col("price_change_pct") < 0)).alias("price_cuts"))
    return raw.select("price_cuts", _inflation().alias("apparent_inflation_pct"))


def _stock() -> list[Column]:
    return [F.coalesce(F.sum("times_listed"), F.lit(0)).alias("raw_listings"), F.count(F.lit(1)).alias("unique_items")]


def _inflation() -> Column:
    return F.when(F.col("unique_items") > 0, F.round((F.col("raw_listings") / F.col("unique_items") - 1) * 100, 1)).otherwise(0.0)


def attention(viewed: DataFrame, c: Config = DEFAULT, top: int = 10) -> DataFrame:
    """brand, attention: the median of views relative to the channel's median, of brands with enough views; the highest first.

    viewed: channel, brand, views. The channels' medians are joined back, not windowed, so no channel is gathered.
    """
    some = viewed.where(F.col("views") > 0)
    middle = some.groupBy("channel").agg(F.median("views").alias("middle"))
    told = some.join(middle, "channel").groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(F.col("views") / F.col("middle")), 2).alias("attention"))
    return told.where(F.col("n") >= c.attention_min).orderBy(F.desc("attention"), "brand").limit(top).select("brand", "attention")


def distributions(values: DataFrame, key: str, value: str, kind: str = "bigint") -> DataFrame:
    """key, n, median, p25 and p75 by nearest rank."""
    return values.groupBy(key).agg(*distribution_of(value, kind))


def fastest(sold: DataFrame, top: int = 5) -> DataFrame:
    return sold.orderBy("days_to_sell", "channel", "sold_id").limit(top)


def coverage(sold: DataFrame, unique_items: int) -> DataFrame:
    """How much of the market the sales describe, and which channels tell them."""
    told = sold.agg(F.count(F.lit(1)).alias("confirmed"), F.sort_array(F.collect_set("channel")).alias("channels"))
    pct = F.round(F.col("confirmed") * 100.0 / unique_items, 1) if unique_items else F.lit(0.0)
    return told.select("confirmed", F.lit(unique_items).cast("bigint").alias("unique_items"), pct.alias("pct"), "channels")

"""Matching units: the finest group of listings that is common enough to be priced on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askbook.config import DEFAULT, Config
from askbook.functions.numbers import array_median


def bounded(listings: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Listings with a brand and a price within bounds, dated from the epoch on."""
    return listings.where(F.col("brand").isNotNull() & F.col("price").between(c.price_low, c.price_high) & (F.col("date") >= c.epoch))


def assign_units(listings: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """tier and unit_key: the reference if it has enough listings, else the model if it has, else the brand.

    Counts are aggregated and joined back, so a common key is summed where it is read and a skewed join can be split. The listings meet
    the common references, at most an eighth as many, in hash joins that need no sort of them; models have a row each.
    """
    refs = listings.where("ref IS NOT NULL").groupBy("brand", "ref").agg(F.count(F.lit(1)).alias("_n_ref")).where(F.col("_n_ref") >= c.unit_ref_min)
    models = listings.where("model IS NOT NULL").groupBy("brand", "model").agg(F.count(F.lit(1)).alias("_n_model")).where(F.col("_n_model") >= c.unit_model_min)
    told = listings.join(refs.hint("shuffle_hash"), ["brand", "ref"], "left").join(F.broadcast(models), ["brand", "model"], "left")
    return told.select(*listings.columns, *_unit())


def _unit() -> list[Column]:
    """tier and unit_key, told by which counts there are."""
    tier = F.when(F.col("_n_ref").isNotNull(), "ref").when(F.col("_n_model").isNotNull(), "model").otherwise("brand")
    key = F.when(F.col("_n_ref").isNotNull(), F.col("ref")).when(F.col("_n_model").isNotNull(), F.col("model")).otherwise(F.lit(""))
    return [tier.alias("tier"), key.alias("unit_key")]


def unit_sizes(listings: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """tier, brand, unit_key, volume: the units that assign_units gives and how many listings each has.

    All is told by counts of brand, reference and model, so the listings are read once and no row of them is moved. Nulls are met as
    values and dropped after: a filter on either branch would be moved below the counts and have them made twice.
    """
    own = listings.groupBy("brand", "ref", "model").agg(F.count(F.lit(1)).alias("n"))
    refs = own.withColumn("_n_ref", F.sum("n").over(Window.partitionBy("brand", "ref")))  # a row for each model of a reference
    models = own.groupBy(F.col("brand").alias("_brand"), F.col("model").alias("_model")).agg(F.sum("n").alias("_n_model"))
    told = refs.join(F.broadcast(models), F.col("brand").eqNullSafe(F.col("_brand")) & F.col("model").eqNullSafe(F.col("_model")), "left")
    enough = lambda k, least: F.when(F.col(k).isNotNull() & (F.col(f"_n_{k}") >= least), F.col(f"_n_{k}")).alias(f"_n_{k}")
    told = told.select("brand", "ref", "model", "n", enough("ref", c.unit_ref_min), enough("model", c.unit_model_min))
    return told.select("brand", "n", *_unit()).groupBy(*UNIT).agg(F.sum("n").alias("volume"))


UNIT = ["tier", "brand", "unit_key"]


def baselines(listings: DataFrame, keys: list[str], c: Config = DEFAULT, volume: DataFrame | None = None) -> DataFrame:
    """keys, baseline, excluded, volume: the median of each group's first prices by date, without outliers.

    Prices outside the outlier bounds of the raw median are left out if enough others remain. Groups with
    too few prices have no row. First rows per group are found with a rank limit, which Spark applies before the shuffle.
    volume: keys and volume, where they are known.
    """
    first = Window.partitionBy(*keys).orderBy("date", "id")
    head = listings.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= c.baseline_rows)
    raw = head.groupBy(*keys).agg(F.median("price").alias("raw"), F.collect_list("price").alias("prices")).where(F.size("prices") >= c.baseline_min)
    inside = F.filter("prices", lambda p: (p >= F.col("raw") * c.outlier_low) & (p <= F.col("raw") * c.outlier_high))
    raw = raw.withColumn("inside", inside).withColumn("_enough", F.size("inside") >= c.baseline_min)
    told = raw.select(*keys, F.when(F.col("_enough"), array_median(F.col("inside"))).otherwise(F.col("raw")).alias("baseline"), F.when(F.col("_enough"), F.size("prices") - F.size("inside")).otherwise(0).cast("bigint").alias("excluded"))
    if volume is None:
        volume = listings.groupBy(*keys).agg(F.count(F.lit(1)).alias("volume"))
    return told.join(volume, keys)


def brand_weights(listings: DataFrame, as_of: str, c: Config = DEFAULT) -> DataFrame:
    """brand, recent, weight: square roots of the shares of recent listings, scaled to sum to one."""
    since = F.date_format(F.date_sub(F.lit(as_of).cast("date"), c.weight_days), "yyyy-MM-dd")
    counts = listings.groupBy("brand").agg(F.count_if(F.col("date") >= since).alias("recent"))
    every = Window.partitionBy()  # a row for each brand
    share = F.sqrt(F.col("recent") / F.greatest(F.sum("recent").over(every), F.lit(1)))
    counts = counts.withColumn("_s", share)
    total = F.sum("_s").over(every)
    return counts.select("brand", "recent", (F.col("_s") / F.when(total > 0, total).otherwise(1.0)).alias("weight"))


def price_outliers(listings: DataFrame, brand_baselines: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Listings priced outside the bounds around their brand's baseline; told, not dropped."""
    told = listings.join(brand_baselines.select("brand", "baseline"), "brand")
    ratio = F.col("price") / F.col("baseline")
    return told.where((ratio < c.outlier_low) | (ratio > c.outlier_high)).select("date", "brand", "price", "baseline", F.round(ratio, 2).alias("ratio"))

"""Price cards: what an exact reference, a family of references or a model asks for."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askbook.config import DEFAULT, Config
from askbook.functions.numbers import distribution_of, rank_of


def ref_family(brand: Column, ref: Column) -> Column:
    """The part of a reference that its variants share, for the brands that write it so; null if it is all of it."""
    parts = F.split(ref, r"\.")
    family = (
        F.when(brand == "Audemars Piguet", F.substring_index(ref, ".", 1))
        .when((brand == "Omega") & (F.size(parts) >= 5), F.substring_index(ref, ".", 4))
        .when((brand == "Hublot") & (F.size(parts) >= 3), F.substring_index(ref, ".", 2))
    )
    return F.when(family != ref, family)


def slug(brand: Column, ref: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.concat_ws("-", brand, ref)), "[^a-z0-9]+", "-"), F.lit("-"))


def with_grain(listings: DataFrame, as_of: str, c: Config = DEFAULT, family: Column | None = None) -> DataFrame:
    """The listings with card_key and grain: the most specific of reference, family and model with enough recent listings.

    Counts are taken over recent listings before any is assigned, each from the listings alone; groups with enough of them are a
    small part of the recent listings and are sent to all tasks, so the listings aren't moved. Three-digit references count as none; what has neither
    reference nor model is left out. A reference without any publishable group keeps its own.
    """
    since = F.date_format(F.date_sub(F.lit(as_of).cast("date"), c.recent_days), "yyyy-MM-dd")
    own = listings.withColumn("ref", F.when(~F.col("ref").rlike(r"^\d{3}$"), F.col("ref"))).where("ref IS NOT NULL OR model IS NOT NULL")
    own = own.withColumn("family", ref_family(F.col("brand"), F.col("ref")) if family is None else family).withColumn("recent", F.col("date") >= since)
    base = own
    for k in ("ref", "family", "model"):
        enough = base.where(F.col("recent") & F.col(k).isNotNull()).groupBy("brand", k).agg(F.count(F.lit(1)).alias(f"_{k}")).where(F.col(f"_{k}") >= c.card_limited)
        own = own.join(F.broadcast(enough), ["brand", k], "left")
    grain = F.when(F.col("_ref").isNotNull(), "reference").when(F.col("_family").isNotNull(), "family").when(F.col("_model").isNotNull(), "model").when(F.col("ref").isNotNull(), "reference")
    key = F.when(grain == "family", F.col("family")).when(grain == "model", F.col("model")).otherwise(F.col("ref"))
    return own.withColumn("grain", grain).withColumn("card_key", key).where("grain IS NOT NULL").drop("_ref", "_family", "_model")


def cards(grained: DataFrame, as_of: str, c: Config = DEFAULT) -> DataFrame:
    """A row for each publishable card: recent prices' median, quartiles and range, history, channels, variants, confidence."""
    keys = ["brand", "card_key", "grain"]
    # Quantiles are of recent prices alone, a small part; apart from them, all else of the history is counted without sorting it.
    asked = grained.where("recent").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_recent"), F.median("price").alias("med"), rank_of("price", 0.25).alias("q1"), rank_of("price", 0.75).alias("q3"), F.min("price").alias("low"), F.max("price").alias("high"))
    asked = asked.where(F.col("n_recent") >= c.card_limited)
    history = grained.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n_total"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.count_distinct("channel").alias("channels"), F.count_distinct("ref").alias("refs"))
    told = asked.join(history, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    q1, q3 = F.col("q1"), F.col("q3")
    spread = (q3 - q1) / F.col("med") * 100
    return told.select(
        slug(F.col("brand"), F.col("card_key")).alias("slug"), "brand", "card_key", "grain", F.when(F.col("grain") == "reference", 0).otherwise(F.col("refs")).cast("bigint").alias("variants"),
        F.when(F.col("n_recent") >= c.card_full, "full").otherwise("limited").alias("confidence"), "n_recent", "n_total", F.col("med").cast("int").alias("median"), q1.alias("fair_low"), q3.alias("fair_high"),
        F.round(spread, 1).alias("spread_pct"), (spread > c.wide_spread_pct).alias("wide_spread"), "low", "high",
        "first_seen", "last_seen", F.date_diff(F.lit(as_of).cast("date"), F.col("last_seen").cast("date")).alias("days_since_last_seen"), "channels",
    )


def monthly(grained: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """brand, card_key, month, median, n of months with enough listings, over the whole history."""
    told = grained.groupBy("brand", "card_key", F.substring("date", 1, 7).alias("month")).agg(F.median("price").cast("int").alias("median"), F.count(F.lit(1)).alias("n"))
    return told.where(F.col("n") >= c.card_month_min)


def by_year(grained: DataFrame, year: str = "year", c: Config = DEFAULT) -> DataFrame:
    """brand, card_key, year, median, n of stated years with enough recent listings."""
    told = grained.where(F.col("recent") & F.col(year).isNotNull()).groupBy("brand", "card_key", F.col(year).alias("year")).agg(F.median("price").cast("int").alias("median"), F.count(F.lit(1)).alias("n"))
    return told.where(F.col("n") >= c.card_year_min)


def consensus(grained: DataFrame, field: str, keys: list[str]) -> DataFrame:
    """keys, value, n, of: the most frequent stated value, the first seen on ties."""
    told = grained.where(F.col(field).isNotNull()).groupBy(*keys, F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("date", "id")).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", "value"))
    return told.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("of")).select(*keys, F.col("b.value").alias("value"), (-F.col("b.n")).alias("n"), "of")


def sales_of_cards(sold: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """brand, ref, sales_observed, and the distribution of days to sell where enough are known."""
    told = sold.where("ref IS NOT NULL").groupBy("brand", "ref").agg(F.count(F.lit(1)).alias("sales_observed"), *distribution_of("days_to_sell"))
    return told.select("brand", "ref", "sales_observed", F.when(F.col("sales_observed") >= c.card_sales_min, F.struct("n", "median", "p25", "p75")).alias("time_to_sell"))


def cuts_of_cards(items: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """brand, ref, reposted, cut, median_cut_pct, median_days_listed of references listed again often enough, from items whose newest record keeps brand and ref."""
    cut = F.col("price_change_pct") < 0
    again = items.where("times_listed > 1").select("newest.*", "price_change_pct", "days_listed").where("ref IS NOT NULL")
    told = again.groupBy("brand", "ref").agg(F.count(F.lit(1)).alias("reposted"), F.count_if(cut).alias("cut"), F.round(F.round(F.median(F.when(cut, F.col("price_change_pct"))), 4), 1).alias("median_cut_pct"), F.median("days_listed").cast("int").alias("median_days_listed"))
    return told.where(F.col("reposted") >= c.card_reposts_min)


def without_leftovers(found: DataFrame, grained: DataFrame) -> DataFrame:
    """Cards less the models, names compared by letters and digits, that are priced at a finer grain already."""
    plain = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    fine = found.where("grain <> 'model'").select("brand", "card_key", "grain").join(grained.where("model IS NOT NULL"), ["brand", "card_key", "grain"]).select(F.col("brand").alias("b"), plain("model").alias("m")).distinct()
    return found.join(fine, (F.col("grain") == "model") & (F.col("brand") == F.col("b")) & (plain("card_key") == F.col("m")), "left_anti")


def ordered(found: DataFrame) -> DataFrame:
    """The cards with the most recent listings first, with their position: a row for each card."""
    order = Window.partitionBy().orderBy(F.desc("n_recent"), "slug")
    return found.withColumn("position", F.row_number().over(order)).orderBy("position")


def card_coverage(found: DataFrame) -> DataFrame:
    """brand and its number of cards, and slugs shared by several cards (expected to be none)."""
    shared = found.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slug").withColumn("clash", F.lit(1))
    return found.join(shared, "slug", "left").groupBy("brand").agg(F.count(F.lit(1)).alias("cards"), F.count("clash").alias("clashes"))

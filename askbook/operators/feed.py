"""The listings feed: cleaning, filters, order, counts, and the tables made for sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askbook.config import DEFAULT, Config


def cleaned(listings: DataFrame, least: int = 100) -> DataFrame:
    """Rows with text that doesn't say SOLD, a brand, and a price of at least `least`."""
    return listings.where(F.col("text").isNotNull() & (F.col("text") != "") & ~F.col("text").rlike(r"(?i)\bsold\b") & F.col("brand").isNotNull() & (F.col("price") >= least))


def first_of_each(listings: DataFrame, keys: tuple[str, ...] = ("date", "brand", "price"), order: tuple[str, ...] = ("id",)) -> DataFrame:
    """The first row of each key in the given order: a partial aggregate, not a sort of the group."""
    told = listings.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in listings.columns]), F.struct(*order)).alias("r"))
    return told.select("r.*")


def filtered(listings: DataFrame, brand: str | None = None, condition: str = "all", model: str | None = None, ref: str | None = None, has_photos: bool = False) -> DataFrame:
    """Filters of the feed: brand without regard to case, condition, model within model or title, reference or what begins with it and a point."""
    out = listings
    if brand:
        out = out.where(F.lower("brand") == brand.lower())
    if condition != "all":
        out = out.where(F.col("cond") == condition)
    if model:
        held = F.lower("model").contains(model.lower())
        out = out.where(F.coalesce(held, F.lit(False)) | F.coalesce(F.lower("title").contains(model.lower()), F.lit(False)) if "title" in out.columns else held)
    if ref:
        out = out.where((F.upper("ref") == ref.upper()) | F.upper("ref").startswith(ref.upper() + "."))
    return out.where(F.col("photos") > 0) if has_photos else out


def page(listings: DataFrame, sort: str = "newest", limit: int = 200) -> DataFrame:
    order = {"newest": [F.desc("date"), "id"], "cheapest": ["price", "id"], "expensive": [F.desc("price"), "id"]}[sort]
    return listings.orderBy(*order).limit(limit)


def card_filter(cards: DataFrame, slug: str | None = None, brand: str | None = None, q: str | None = None, confidence: str | None = None) -> DataFrame:
    out = cards
    for name, value in (("slug", slug), ("brand", brand), ("confidence", confidence)):
        if value:
            out = out.where(F.lower(name) == value.lower())
    if q:
        out = out.where(F.lower(F.concat_ws(" ", *[c for c in ("card_key", "model", "brand") if c in out.columns])).contains(q.lower()))
    return out


def expired(listings: DataFrame, as_of: str, c: Config = DEFAULT) -> DataFrame:
    """Listings not older than the expiry: a comparison of text dates, which reaches the scan."""
    return listings.where(F.col("date") >= F.date_format(F.date_sub(F.lit(as_of).cast("date"), c.expiry_days), "yyyy-MM-dd"))


def to_probe(listings: DataFrame, as_of: str, c: Config = DEFAULT) -> DataFrame:
    """The listings whose links are to be probed: old enough, the oldest first, no more than the cap, which is the feature."""
    return listings.where(F.col("date") < F.date_format(F.date_sub(F.lit(as_of).cast("date"), c.link_age_days), "yyyy-MM-dd")).orderBy("date", "id").limit(c.link_cap)


def link_alive(status, body):
    """Whether a fetched page shows a live post: an error status or a page too short or without its widget is dead; no status (unreachable) keeps it."""
    return F.when(status.isNull(), True).when(status >= 400, False).otherwise((F.length(body) >= 5000) & body.contains("tgme_widget_message"))


def live(listings: DataFrame, removed: DataFrame, probes: DataFrame) -> DataFrame:
    """The listings without those removed (id) and those whose link was found dead (id, alive)."""
    return listings.join(removed.select("id"), "id", "left_anti").join(probes.where(~F.col("alive")).select("id"), "id", "left_anti")


def counts(listings: DataFrame, key: str) -> DataFrame:
    """The key and n, the most frequent first."""
    return listings.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def channel_stats(listings: DataFrame) -> DataFrame:
    return listings.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")).orderBy(F.desc("n"), "channel")


def brand_sheet(live: DataFrame, weights: DataFrame) -> DataFrame:
    """brand, live count and prices joined to weights; brands that have either."""
    told = live.groupBy("brand").agg(F.count(F.lit(1)).alias("live_listings"), F.median("price").cast("int").alias("median_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    return told.join(weights, "brand", "full").select("brand", F.coalesce("live_listings", F.lit(0)).alias("live_listings"), "median_price", "min_price", "max_price", F.coalesce("recent", F.lit(0)).alias("recent"), "weight")


def history_sheet(composite: DataFrame, conditions: DataFrame, available: DataFrame) -> DataFrame:
    """A row for each date: composite, whether carried, brands, pool, condition indices, availability."""
    by = lambda x, name: conditions.where(F.col("cond") == x).select("date", F.col("value").alias(name))
    told = composite.select("date", F.col("value").alias("composite"), F.col("stale").alias("is_carried_forward"), "brands_tracked", "total_listings")
    return told.join(by("p", "preowned_index"), "date", "left").join(by("n", "new_index"), "date", "left").join(available.select("date", F.col("value").alias("availability_score")), "date", "left")


def one_day_changes(subindices: DataFrame) -> DataFrame:
    """brand, current, change_1d of each brand's series' last two points."""
    order = Window.partitionBy("brand").orderBy("date")
    told = subindices.withColumn("_p", F.lag("value").over(order))
    return told.groupBy("brand").agg(F.max_by("value", "date").alias("current"), F.max_by("_p", "date").alias("before")).select("brand", "current", F.round(F.col("current") - F.col("before"), 4).alias("change_1d"))

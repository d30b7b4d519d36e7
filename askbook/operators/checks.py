"""Checks of data and results: anomalies, invariants of cards, differences between two results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askbook.config import DEFAULT, Config


def unbranded(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count_if(F.col("brand").isNull()).alias("unbranded"))


def index_alerts(change: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """alert: a day's swing or staleness beyond the thresholds."""
    told = F.array(F.when(F.abs("change_1d_pct") > c.swing_alert_pct, "swing"), F.when(F.col("days_since_fresh") >= c.stale_alert_days, "stale"))
    return change.select(F.explode(F.array_compact(told)).alias("alert"))


def tracer_alert(stats: DataFrame) -> DataFrame:
    return stats.where("total_removed = 0").select(F.lit("nothing removed").alias("alert"))


def signals_line(speed: DataFrame, market: DataFrame) -> DataFrame:
    """line: sales and their median days, price cuts, and how much deeper the inventory looks than it is. market: see signals.moves_and_stock."""
    both = speed.select("n", "median").join(market.select("price_cuts", "apparent_inflation_pct"))  # one row each
    days = F.coalesce(F.col("median").cast("string"), F.lit("-"))
    return both.select(F.concat_ws("", F.col("n"), F.lit(" confirmed sales (median "), days, F.lit("d), "), F.col("price_cuts"), F.lit(" price cuts, inventory looks "), F.col("apparent_inflation_pct"), F.lit("% deeper than it is")).alias("line"))


def no_cards(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no cards").alias("alert"))


def card_alerts(cards: DataFrame, old_days: int = 60) -> DataFrame:
    """slug, alert of cards with a wide spread or not seen for long."""
    told = F.array_compact(F.array(F.when(F.col("wide_spread"), "wide"), F.when(F.col("days_since_last_seen") > old_days, "old")))
    return cards.select("slug", F.explode(told).alias("alert"))


def broken_cards(cards: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """slug, rule of each broken invariant: named, fair range around the median, enough listings, slug of its own."""
    shared = cards.groupBy("slug").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    told = cards.join(shared, "slug", "left")
    rules = F.array_compact(F.array(
        F.when(F.col("brand").isNull() | F.col("card_key").isNull(), "unnamed"), F.when(~((F.col("fair_low") <= F.col("median")) & (F.col("median") <= F.col("fair_high"))), "fair range"),
        F.when(F.col("n_recent") < c.card_limited, "few listings"), F.when(F.col("_n").isNotNull(), "shared slug"),
    ))
    return told.select("slug", F.explode(rules).alias("rule"))


def contract(rows: DataFrame, required: dict[str, str]) -> list[str]:
    """What the schema lacks of the required names and types."""
    have = dict(rows.dtypes)
    return [f"{name}: {have.get(name, 'absent')} instead of {kind}" for name, kind in required.items() if have.get(name) != kind]


def paths(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, value: every column of every row as text."""
    own = [c for c in rows.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in own])
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.path", "p.value")


def drift(left: DataFrame, right: DataFrame, keys: list[str], most: int = 40) -> DataFrame:
    """keys, path, left and right value where two results differ; at most so many, which is the report's size."""
    a, b = paths(left, keys).withColumnRenamed("value", "left_value").withColumn("_l", F.lit(1)), paths(right, keys).withColumnRenamed("value", "right_value").withColumn("_r", F.lit(1))
    both = a.join(b, [*keys, "path"], "full")
    differ = F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))
    return both.where(differ).select(*keys, "path", "left_value", "right_value").orderBy(*keys, "path").limit(most)


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """side, and the rows that only one of two results has."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def run_steps(steps: list) -> list[tuple[str, object]]:
    """(name, result) of named steps one after the other; the first error ends it."""
    return [(name, step()) for name, step in steps]


def rejections(classified: DataFrame) -> DataFrame:
    """reason, n, share of all: a histogram of rejections, with the passed under "passed", the most frequent first."""
    told = classified.groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return told.join(told.agg(F.sum("n").alias("_all"))).select("reason", "n", F.round(F.col("n") * 100.0 / F.col("_all"), 1).alias("pct")).orderBy(F.desc("n"), "reason")


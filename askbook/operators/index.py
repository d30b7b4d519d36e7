"""Rolling pooled medians and the indices built from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askbook.config import DEFAULT, Config
from askbook.functions import pools
from askbook.operators.units import UNIT
from askbook.shipping import ship

#: Observed dates that one task pools for one key; a common key's dates are spread over tasks.
SPAN = 512


def date_index(listings: DataFrame) -> DataFrame:
    """date, i (from 0) and last: the observed dates in order; as many rows as there are days."""
    dates = listings.select("date").distinct()
    order = Window.partitionBy().orderBy("date")
    return dates.select("date", (F.row_number().over(order) - 1).cast("bigint").alias("i"), (F.count(F.lit(1)).over(Window.partitionBy()) - 1).alias("last"))


def rolling_medians(listings: DataFrame, dates: DataFrame, keys: list[str], width: int, least: int) -> DataFrame:
    """keys, i, n, median over each key's prices of the last `width` observed dates, where there are at least `least`.

    Values are told for dates without a listing of the key, too, as long as the pool of the dates before holds enough. Prices
    are counted by key and date first, so a pool is a histogram: what a task holds is as large as the price range, not as the listings are many.
    Runs of SPAN dates are pooled apart, and a run gets the dates before it that its pools reach back to, so all is done within one
    exchange by key and run, and no key is one task. Spark's windows would gather and sort each date's pool anew, in rows of arrays; here a
    task slides one histogram along its run.
    """
    ship(listings.sparkSession)
    daily = listings.groupBy(*keys, "date", "price").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(dates), "date")  # dates: a row for each day
    run = F.floor(F.col("i") / SPAN)
    late = F.col("i") >= (run + 1) * SPAN - (width - 1)
    dealt = daily.withColumn("run", F.explode(F.when(late, F.array(run, run + 1)).otherwise(F.array(run)))).where(F.col("run") * SPAN <= F.col("last"))
    # A group is told by 64 bits of its key and run, which sort faster than text.
    ordered = dealt.repartition(*keys, "run").withColumn("group", F.xxhash64(*keys, "run")).sortWithinPartitions("group", "i", "price")
    own = [listings.schema[k] for k in keys]
    out = T.StructType([*own, T.StructField("i", T.LongType()), T.StructField("n", T.LongType()), T.StructField("median", T.DoubleType())])
    told = ordered.select(*keys, "run", "i", "last", F.col("price").cast("double").alias("price"), "n", "group")
    return told.mapInArrow(_slide(len(keys), width, least, SPAN), out)


def _slide(n_keys: int, width: int, least: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def told(rows: pa.Table, starts: list[int]) -> pa.RecordBatch | None:
            """Of the groups of rows; starts: where each begins, and where the last ends."""
            run, i, last, price, n = (rows.column(n_keys + j).to_numpy()[: starts[-1]] for j in range(5))
            kept = np.flatnonzero(pools.filled(i, n, np.array(starts[:-1], np.int64), width, least)).tolist()
            groups = [(starts[g], starts[g + 1]) for g in kept]
            made = [pools.rolling(i[a:b], price[a:b], n[a:b], int(run[a]) * span, min((int(run[a]) + 1) * span - 1, int(last[a])), width, least) for a, b in groups]
            of = np.repeat([a for a, _ in groups], [len(m[0]) for m in made]) if groups else np.zeros(0, np.int64)
            own = rows.select(list(range(n_keys))).take(pa.array(of.astype(np.int64)))
            parts = [np.concatenate([m[j] for m in made]) if made else np.zeros(0) for j in range(3)]
            whole = own.append_column("i", pa.array(parts[0].astype(np.int64))).append_column("n", pa.array(parts[1].astype(np.int64))).append_column("median", pa.array(parts[2].astype(np.float64)))
            return whole.combine_chunks().to_batches()[0] if len(whole) else None

        for b in batches:
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            group = rows.column("group").to_numpy()
            edges = np.flatnonzero(group[1:] != group[:-1]) + 1 if len(group) else np.zeros(0, np.int64)
            starts = [0, *edges.tolist()]
            held = rows.slice(starts[-1])  # the last group may go on
            done = told(rows, starts)
            if done is not None:
                yield done
        if held is not None and len(held):
            done = told(held, [0, len(held)])
            if done is not None:
                yield done

    return run


def brand_ratios(medians: DataFrame, unit_baselines: DataFrame) -> DataFrame:
    """brand, i, ratio, listings: each brand's level against its own units' baselines, weighted by the units' volumes."""
    told = medians.join(unit_baselines.select(*UNIT, "baseline", "volume"), UNIT)
    return told.groupBy("brand", "i").agg((F.sum(F.col("volume") * F.col("median") / F.col("baseline")) / F.sum("volume")).alias("ratio"), F.sum("n").alias("listings"))


def filled(series: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Gaps filled with the last value before them and flagged stale; a leading gap stays null and isn't."""
    order = Window.partitionBy(*(keys or [])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(value, ignorenulls=True).over(order)
    return series.withColumn("_carried", carried).withColumn("stale", F.col(value).isNull() & F.col("_carried").isNotNull()).withColumn(value, F.col("_carried")).drop("_carried")


def composite(ratios: DataFrame, weights: DataFrame, dates: DataFrame, pool_sizes: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """date, value, stale, brands_tracked, total_listings for every observed date."""
    told = ratios.join(weights, "brand").groupBy("i").agg(F.count(F.lit(1)).alias("brands_tracked"), F.sum(F.col("weight") * F.col("ratio")).alias("num"), F.sum("weight").alias("den"))
    value = F.when((F.col("brands_tracked") >= c.min_brands) & (F.col("den") > 0), F.round(F.col("num") / F.col("den"), 4))
    series = dates.join(told, "i", "left").join(pool_sizes, "i", "left")
    series = series.select("date", value.alias("value"), F.coalesce("brands_tracked", F.lit(0)).alias("brands_tracked"), F.coalesce("total_listings", F.lit(0)).alias("total_listings"))
    return filled(series)


def pool_sizes(listings: DataFrame, dates: DataFrame, width: int) -> DataFrame:
    """i, total_listings: how many listings the pool of each date holds."""
    daily = listings.groupBy("date").agg(F.count(F.lit(1)).alias("n")).join(dates, "date")
    window = Window.partitionBy().orderBy("i").rowsBetween(-(width - 1), 0)  # a row for each date
    return daily.select("i", F.sum("n").over(window).alias("total_listings"))


def condition_indices(listings: DataFrame, dates: DataFrame, brand_baselines: DataFrame, weights: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """cond (n or p), date, value, stale: brand medians within a condition against the brands' baselines."""
    own = listings.where(F.col("cond").isin("n", "p")).join(brand_baselines.select("brand"), "brand", "left_semi")
    medians = rolling_medians(own, dates, ["cond", "brand"], c.cond_window_dates, c.min_cond_per_brand)
    told = medians.join(brand_baselines.select("brand", "baseline"), "brand").join(weights, "brand")
    told = told.groupBy("cond", "i").agg(F.count(F.lit(1)).alias("brands"), F.sum(F.col("weight") * F.col("median") / F.col("baseline")).alias("num"), F.sum("weight").alias("den"))
    value = F.when((F.col("brands") >= c.min_cond_brands) & (F.col("den") > 0), F.round(F.col("num") / F.col("den"), 4))
    every = dates.select("i", "date", F.explode(F.array(F.lit("n"), F.lit("p"))).alias("cond"))
    return filled(every.join(told, ["cond", "i"], "left").select("cond", "date", value.alias("value")), ["cond"])


def condition_spread(indices: DataFrame) -> DataFrame:
    """spread: the new index less the pre-owned one, at the last date; null if either is missing or zero."""
    last = indices.groupBy("cond").agg(F.max_by("value", "date").alias("v"))
    new, old = F.max(F.when(F.col("cond") == "n", F.col("v"))), F.max(F.when(F.col("cond") == "p", F.col("v")))
    return last.agg(F.when((new != 0) & (old != 0), F.round(new - old, 4)).alias("spread"))


def availability(listings: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """date, value: the day's listings in percent of the most on any day of the trailing calendar window."""
    daily = listings.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    day = F.date_diff(F.col("date").cast("date"), F.lit("1970-01-01").cast("date"))
    window = Window.partitionBy().orderBy("_day").rangeBetween(-(c.availability_days - 1), 0)  # a row for each date
    return daily.withColumn("_day", day).select("date", F.bround(F.col("n") / F.max("n").over(window) * 100).cast("bigint").alias("value"))


def brand_subindices(ratios: DataFrame, weights: DataFrame, brand_baselines: DataFrame, dates: DataFrame, top: int = 5) -> DataFrame:
    """brand, date, value, stale of the brands with the most recent listings that have a baseline."""
    best = weights.orderBy(F.desc("recent"), "brand").limit(top).join(brand_baselines.select("brand"), "brand", "left_semi").select("brand")
    every = best.crossJoin(F.broadcast(dates)).select("brand", "i", "date")  # at most `top` rows by as many as there are days
    return filled(every.join(ratios, ["brand", "i"], "left").select("brand", "date", F.round("ratio", 4).alias("value")), ["brand"])


def anchor_date(listings: DataFrame, brand_baselines: DataFrame) -> DataFrame:
    """anchor_date: the first date by which half of the brands with a baseline have been listed."""
    first = listings.join(brand_baselines.select("brand"), "brand", "left_semi").groupBy("brand").agg(F.min("date").alias("date"))
    so_far, every = F.count(F.lit(1)).over(Window.partitionBy().orderBy("date")), F.count(F.lit(1)).over(Window.partitionBy())  # a row for each brand
    return first.withColumn("_share", so_far / every).where("_share >= 0.5").agg(F.min("date").alias("anchor_date"))


def as_of_value(target: Column, name: str = "value") -> Column:
    """The aggregate that gives the value at the last date up to the target."""
    return F.max_by(F.when(F.col("date") <= target, F.col(name)), F.when(F.col("date") <= target, F.col("date")))


def changes(series: DataFrame, as_of: str) -> DataFrame:
    """current, stale, change_1d (against the last observed date), change_7d, 30d and 90d (as-of look-ups) and percents, and freshness."""
    order = Window.partitionBy().orderBy("date")
    told = series.withColumn("_prev", F.lag("value").over(order))
    back = {d: F.date_format(F.date_sub(F.lit(as_of).cast("date"), d), "yyyy-MM-dd") for d in (7, 30, 90)}
    fresh = ~F.col("stale")
    last_fresh = F.coalesce(F.max(F.when(fresh, F.col("date"))), F.lit(""))
    row = told.agg(
        F.max("date").alias("date"), F.max_by("value", "date").alias("current"), F.max_by("stale", "date").alias("stale"), F.max_by("_prev", "date").alias("v1"),
        *[as_of_value(t).alias(f"v{d}") for d, t in back.items()], last_fresh.alias("last_fresh"),
        F.min(F.when(fresh & F.col("value").isNotNull(), F.col("date"))).alias("first_computed"),
        F.sort_array(F.collect_list(F.when(F.col("stale"), F.col("date")))).alias("stale_dates"),
    )
    diff = lambda v: F.round(F.col("current") - F.col(v), 4)
    out = [F.col("date"), F.col("current"), F.col("stale"), F.coalesce(F.when(F.col("v1") != 0, diff("v1")), F.lit(0.0)).alias("change_1d"), F.coalesce(F.when(F.col("v1") != 0, F.round(diff("v1") / F.col("v1") * 100, 2)), F.lit(0.0)).alias("change_1d_pct")]
    for d in back:
        v = F.col(f"v{d}")
        out += [F.when(v != 0, diff(f"v{d}")).alias(f"change_{d}d"), F.when(v != 0, F.round((F.col("current") - v) / v * 100, 2)).alias(f"change_{d}d_pct")]
    behind = F.size(F.filter("stale_dates", lambda x: x > F.col("last_fresh"))).cast("bigint")
    return row.select(*out, behind.alias("days_since_fresh"), "first_computed")


def contributions(ratios: DataFrame, weights: DataFrame, dates: DataFrame) -> DataFrame:
    """brand, contribution of each brand priced on the last two dates; brand null: the effect of brands that came, went or changed weight."""
    last = dates.select("last").limit(1)
    two = ratios.join(F.broadcast(last), F.col("i") >= F.col("last") - 1).join(weights, "brand")
    per = two.groupBy("brand").agg(F.max(F.when(F.col("i") == F.col("last"), F.col("ratio"))).alias("t"), F.max(F.when(F.col("i") < F.col("last"), F.col("ratio"))).alias("y"), F.max("weight").alias("w"))
    every = Window.partitionBy()  # a row for each brand
    total = lambda x, on: F.sum(F.when(on, x)).over(every)
    t, y, w = F.col("t"), F.col("y"), F.col("w")
    per = per.withColumn("wt", F.coalesce(total(w, t.isNotNull()), F.lit(1.0))).withColumn("wy", F.coalesce(total(w, y.isNotNull()), F.lit(1.0)))
    per = per.withColumn("c", F.when(t.isNotNull() & y.isNotNull(), w / F.col("wt") * (t - y)))
    move = F.coalesce(F.sum(w * t / F.col("wt")), F.lit(0.0)) - F.coalesce(F.sum(w * y / F.col("wy")), F.lit(0.0))
    rest = per.agg((move - F.coalesce(F.sum("c"), F.lit(0.0))).alias("contribution")).select(F.lit(None).cast("string").alias("brand"), "contribution")
    return per.where("c IS NOT NULL").select("brand", F.col("c").alias("contribution")).unionByName(rest)


def insight(contribs: DataFrame, change: DataFrame) -> DataFrame:
    """sentence: the day's direction and up to three brands that led it or stood against it."""
    pct = F.col("change_1d_pct")
    word = F.when(pct > 0, "rose").when(pct < 0, "fell").otherwise("held steady")
    sign = F.when(pct < 0, -1).otherwise(1)
    ranked = contribs.where("brand IS NOT NULL").crossJoin(F.broadcast(change.select("change_1d_pct")))  # one row
    named = lambda side: F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col("contribution") * sign * side > 0, F.struct(-F.abs("contribution"), "brand")))), lambda x: x["brand"]), 1, 3)
    told = ranked.groupBy("change_1d_pct").agg(named(1).alias("lead"), named(-1).alias("against"))
    text = F.concat(F.lit("Index "), word, F.when(F.size("lead") > 0, F.concat(F.lit(", led by "), F.array_join("lead", ", "))).otherwise(""), F.when(F.size("against") > 0, F.concat(F.lit("; against it "), F.array_join("against", ", "))).otherwise(""))
    return told.select(text.alias("sentence"))

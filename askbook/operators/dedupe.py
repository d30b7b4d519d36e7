"""Sightings of one item collapse to its newest, with a summary of its history.

An item is told by its dealer's stock code, else by dealer, brand, reference and price: among prices in order, one
more than the tolerance above the least of its cluster begins the next. Clusters are found from a bucket's distinct
prices, so a bucket of any number of rows folds over no more values than the price range has, and yields few anchors.
`groups` has the rows look them up; `items` needs no rows, as it counts by price first and joins nothing back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askbook.config import DEFAULT, Config
from askbook.functions.numbers import calendar_days

BUCKET = ["channel", "brand", "ref"]


def _anchors(prices: Column, tolerance: float) -> Column:
    """The least price of each cluster, from sorted distinct prices."""
    near = lambda low, p: (p - low) / low * 100 <= F.lit(tolerance)
    step = lambda acc, p: F.when((F.size(acc) > 0) & near(F.try_element_at(acc, F.lit(-1)), p), acc).otherwise(F.array_append(acc, p))
    return F.aggregate(prices, F.expr("cast(array() as array<int>)"), step)


def _kinds(c: str = "stock_code") -> tuple[Column, Column]:
    """Whether a record is told by its stock code, and whether by the cluster of its price; neither is null."""
    coded = F.coalesce(F.col(c).isNotNull() & (F.col(c) != ""), F.lit(False))
    return coded, F.coalesce(~coded & F.col("ref").isNotNull() & (F.col("ref") != "") & (F.coalesce("price", F.lit(0)) > 0), F.lit(False))


def _text(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[F.coalesce((F.lit(x) if isinstance(x, str) else x).cast("string"), F.lit("")) for x in parts])


def groups(records: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The records with group_id: equal for sightings of one item."""
    coded, bucketed = _kinds()
    dealt = records.withColumn("_b", bucketed)
    anchors = dealt.where("_b").groupBy(*BUCKET).agg(F.sort_array(F.collect_set("price")).alias("p")).select(*[F.col(k).alias(f"_{k}") for k in BUCKET], _anchors(F.col("p"), c.tolerance_pct).alias("_anchors"))
    same = F.col("_b")
    for k in BUCKET:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    told = dealt.join(anchors, same, "left")
    anchor = F.array_max(F.filter("_anchors", lambda a: a <= F.col("price")))
    group = F.when(coded, _text("code", F.col("channel"), F.col("stock_code"))).when(F.col("_b"), _text("ref", *map(F.col, BUCKET), anchor)).otherwise(_text("one", F.col("id")))
    return told.withColumn("group_id", group).select(*records.columns, "group_id")


_KEYS = ["_hash", "_kind", "_k1", "_k2", "_k3"]


def items(records: DataFrame, c: Config = DEFAULT, keep: Sequence[str] = (), history: bool = True) -> DataFrame:
    """A row for each item: what `summaries` tells of its group and, as newest, the kept columns of its newest record; history=False: group_id and times_listed alone.

    Records are counted by bucket and price, a stock code or a record of its own having one entry whatever its prices; entries are then gathered by
    bucket, of which there are no more than the price range has, and cut into clusters there. So rows are neither read twice nor joined. With their history
    the records of a bucket are sorted by one task, on disk if they are many; without it they are summed where they are read. Keys begin with their hash, by
    which sorts tell nearly all of them apart. A null in a key is a value of its own.
    """
    coded, bucketed = _kinds()
    pick = lambda code, ref, one: F.when(coded, code).when(bucketed, ref).otherwise(one)
    none = F.lit(None).cast("string")
    key = {"_kind": pick(F.lit("code"), F.lit("ref"), F.lit("one")), "_k1": pick(F.col("channel"), F.col("channel"), none), "_k2": pick(F.col("stock_code"), F.col("brand"), F.col("id").cast("string")), "_k3": pick(none, F.col("ref"), none)}
    dealt = records.withColumns(key).withColumn("_hash", F.xxhash64(*_KEYS[1:])).withColumn("_price", F.when(bucketed, F.col("price")))
    told = [F.count(F.lit(1)).alias("n")]
    if history:
        at, priced = F.struct("date", "id", "price"), F.coalesce("price", F.lit(0)) != 0
        row = F.struct("date", "id", "price", *([F.struct(*keep).alias("kept")] if keep else []))
        mapped = any("map<" in t or "variant" in t for k, t in records.dtypes if k in keep)  # such can't be compared
        newest = F.max_by(row, F.struct("date", "id")) if mapped else F.max(row)
        # In a bucket all are priced, so that its last price is its newest record's.
        told += [F.min("date").alias("since"), F.min(F.when(priced, at)).alias("first"), F.max(F.when(priced & F.col("_price").isNull(), at)).alias("last"), newest.alias("newest")]
    if history:  # nearly every record is an entry, with its texts: dealt once by bucket, both counts find theirs together
        dealt = dealt.repartition(*_KEYS)
    entries = dealt.groupBy(*_KEYS, "_price").agg(*told)
    gathered = entries.groupBy(*_KEYS).agg(F.collect_list(F.struct(*[x for x in entries.columns if x not in _KEYS])).alias("_all"))
    anchors = _anchors(F.sort_array(F.transform("_all", lambda x: x["_price"])), c.tolerance_pct)
    gathered = gathered.withColumn("_anchors", F.when(F.size("_all") > 1, anchors))
    within = lambda x, a, i: (x["_price"] >= a) & F.coalesce(x["_price"] < F.get("_anchors", i + 1), F.lit(True))
    clusters = F.when(F.size("_all") == 1, F.array("_all")).otherwise(F.transform("_anchors", lambda a, i: F.filter("_all", lambda x: within(x, a, i))))
    return _told(gathered.select(*_KEYS[1:], F.explode(clusters).alias("_e")), history, bool(keep))


def _told(clusters: DataFrame, history: bool, keep: bool) -> DataFrame:
    """From the entries _e of each cluster what they tell together."""
    e, one = F.col("_e"), F.size("_e") == 1
    every = lambda name, merge: F.when(one, e[0][name]).otherwise(merge(F.transform(e, lambda x: x[name])))
    group = F.when(F.col("_kind") == "code", _text("code", F.col("_k1"), F.col("_k2"))).when(F.col("_kind") == "ref", _text("ref", F.col("_k1"), F.col("_k2"), F.col("_k3"), every("_price", F.array_min))).otherwise(_text("one", F.col("_k2")))
    times = every("n", lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("times_listed")
    if not history:
        return clusters.select(group.alias("group_id"), times)
    later = lambda a, x: F.when(F.struct(x["date"], x["id"]) > F.struct(a["date"], a["id"]), x).otherwise(a)
    newest = every("newest", lambda v: F.aggregate(v, v[0], later))
    told = clusters.select(group.alias("group_id"), times, every("since", F.array_min).alias("first_seen"), newest.alias("newest"), every("first", F.array_min)["price"].alias("first_price"), e[0]["last"]["price"].alias("_last"), (F.col("_kind") == "ref").alias("_ref"))
    told = told.select("group_id", "times_listed", "first_seen", F.col("newest.date").alias("last_seen"), "first_price", F.when(F.col("_ref"), F.col("newest.price")).otherwise(F.col("_last")).alias("last_price"), *([F.col("newest.kept").alias("newest")] if keep else []))
    return _moved(told)


def summaries(grouped: DataFrame) -> DataFrame:
    """group_id, times_listed, first and last date and price, price_change_pct (null if none), days_listed."""
    at = F.struct("date", "id")
    priced = F.when(F.coalesce("price", F.lit(0)) != 0, at)
    told = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("times_listed"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.min_by("price", priced).alias("first_price"), F.max_by("price", priced).alias("last_price"))
    return _moved(told)


def _moved(told: DataFrame) -> DataFrame:
    change = F.when(F.col("first_price") != F.col("last_price"), F.round((F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100, 2))
    return told.withColumn("price_change_pct", change).withColumn("days_listed", calendar_days(F.col("first_seen"), F.col("last_seen")))


def survivors(grouped: DataFrame) -> DataFrame:
    """The newest record of each group."""
    own = [c for c in grouped.columns if c != "group_id"]
    return grouped.groupBy("group_id").agg(F.max_by(F.struct(*own), F.struct("date", "id")).alias("r")).select("r.*", "group_id")


def deduped(records: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Survivors, with the summary of those that were seen more than once as dup."""
    told = items(records, c, keep=records.columns)
    return told.select("newest.*", F.when(F.col("times_listed") > 1, F.struct(*[x for x in told.columns if x not in ("group_id", "newest")])).alias("dup"))


def dedupe_stats(grouped: DataFrame) -> DataFrame:
    """From records with group_id, or from items, how many records are repeats."""
    told = sized(grouped).agg(F.coalesce(F.sum("times_listed"), F.lit(0)).alias("input"), F.count(F.lit(1)).alias("output"), F.count_if(F.col("times_listed") > 1).alias("groups_with_repeats"))
    removed = F.col("input") - F.col("output")
    return told.select("input", "output", removed.alias("removed"), "groups_with_repeats", F.when(F.col("input") > 0, F.bround(removed * 100.0 / F.col("input"), 1)).otherwise(0.0).alias("removed_pct"))


def sized(grouped: DataFrame) -> DataFrame:
    """Items as they are; of records with group_id, a row with times_listed for each group."""
    return grouped if "times_listed" in grouped.columns else grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("times_listed"))

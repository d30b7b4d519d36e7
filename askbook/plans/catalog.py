"""Index, dedupe, card, signal and feed queries over the test tables, each with its DuckDB SQL."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askbook.config import DEFAULT
from askbook.operators import cards, dedupe, feed, index, replies, signals, units
from askbook.sources.adapters import AS_OF, EPOCH, LISTINGS_SQL, listings, table

C = replace(DEFAULT, epoch=EPOCH)
_KEPT = ["id", "brand", "date", "cond", "price"]


@dataclass
class Market:
    """What the index queries share; each part is a plan, built when asked for.

    Queries with many branches over the listings pass shared=True: the bounded listings with their units are then kept by the executors, in
    memory or on disk, from first use on, and read from there in each branch. Blocks lost with an executor are made anew. Spark keeps one copy for
    all queries of a session whose plan is the same. Of the columns those are kept that an index is made of; units=False: without units, for
    queries that only look at brands.
    """

    spark: SparkSession
    sf_dir: str
    shared: bool = False
    units: bool = True

    @cached_property
    def records(self) -> DataFrame:
        own = units.assign_units(units.bounded(listings(self.spark, self.sf_dir), C), C)
        return own.select(*_KEPT, "tier", "unit_key").persist(StorageLevel.MEMORY_AND_DISK) if self.shared else own

    @cached_property
    def plain(self) -> DataFrame:
        if self.shared and self.units:
            return self.records.drop("tier", "unit_key")
        own = units.bounded(listings(self.spark, self.sf_dir), C)
        return own.select(*_KEPT).persist(StorageLevel.MEMORY_AND_DISK) if self.shared else own

    @cached_property
    def dates(self) -> DataFrame:
        return index.date_index(self.plain)

    @cached_property
    def unit_sizes(self) -> DataFrame:
        return units.unit_sizes(self.plain, C)

    @cached_property
    def unit_baselines(self) -> DataFrame:
        return units.baselines(self.records, units.UNIT, C, None if self.shared else self.unit_sizes)

    @cached_property
    def brand_baselines(self) -> DataFrame:
        return units.baselines(self.plain, ["brand"], C)

    @cached_property
    def weights(self) -> DataFrame:
        return units.brand_weights(self.plain, AS_OF, C)

    @cached_property
    def medians(self) -> DataFrame:
        return index.rolling_medians(self.records, self.dates, units.UNIT, C.window_dates, C.min_per_unit)

    @cached_property
    def ratios(self) -> DataFrame:
        return index.brand_ratios(self.medians, self.unit_baselines)

    @cached_property
    def composite(self) -> DataFrame:
        return index.composite(self.ratios, self.weights, self.dates, index.pool_sizes(self.plain, self.dates, C.window_dates), C)

    @cached_property
    def conditions(self) -> DataFrame:
        return index.condition_indices(self.plain, self.dates, self.brand_baselines, self.weights, C)

    @cached_property
    def grouped(self) -> DataFrame:
        return dedupe.groups(self.plain, C)

    def items(self, keep: tuple[str, ...] = (), history: bool = True) -> DataFrame:
        return dedupe.items(self.plain, C, keep, history)

    @cached_property
    def grained(self) -> DataFrame:
        return cards.with_grain(self.plain, AS_OF, C, family=F.substring_index("ref", "-", 1))

    @cached_property
    def messages(self) -> DataFrame:
        m = table(self.spark, self.sf_dir, "conversations").groupBy(F.col("conv_id").alias("channel"), F.col("turn").alias("message_id")).agg(F.first("role").alias("role"))
        posted = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("message_id") * 100_000 + F.col("channel") % 7 * 5_000)
        return m.select("channel", "message_id", F.when(F.col("message_id") > 0, F.col("message_id") - 1).alias("reply_to"), posted.alias("posted_at"))


def _chain(m: Market, least: int) -> DataFrame:
    return replies.sold_chain(m.messages.withColumn("sold", F.col("message_id") >= least), C)


def _sold(m: Market) -> DataFrame:
    own = m.messages.where("message_id < 2").select("channel", "message_id", "posted_at", F.concat(F.lit("B"), F.col("channel") % 5).alias("brand"))
    return replies.sales(_chain(m, 2), own, C)


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("channel"), (F.col("user_id") % 12).cast("string").alias("brand"), F.floor(F.col("value") * 100).cast("bigint").alias("views"))


_M = Market


def _S(spark: SparkSession, sf_dir: str, units: bool = True) -> Market:
    return Market(spark, sf_dir, shared=True, units=units)


SPARK = {
    "brand_level": lambda s, d: _brand_level(_M(s, d)),
    "unit_assignment": lambda s, d: _M(s, d).unit_sizes.withColumnRenamed("volume", "n"),
    "tier_counts": lambda s, d: _M(s, d).unit_sizes.groupBy("tier").agg(F.sum("volume").alias("n")),
    "baseline_median": lambda s, d: _M(s, d).unit_baselines,
    "brand_baseline": lambda s, d: _M(s, d).brand_baselines,
    "rolling_unit_median": lambda s, d: (lambda m: m.medians.join(m.dates.select("i", "date"), "i").select(*units.UNIT, "date", "n", "median"))(_S(s, d)),
    "rolling_model_median": lambda s, d: (lambda m: index.rolling_medians(m.plain, m.dates, ["brand", "model"], C.window_dates, C.min_per_unit))(_M(s, d)),
    "brand_weights": lambda s, d: _M(s, d).weights.withColumn("weight", F.round("weight", 6)),
    "brand_ratios": lambda s, d: (lambda m: m.ratios.join(m.dates.select("i", "date"), "i").select("brand", "date", F.round("ratio", 6).alias("ratio"), "listings"))(_S(s, d)),
    "composite": lambda s, d: _S(s, d).composite,
    "condition_indices": lambda s, d: _S(s, d, units=False).conditions,
    "condition_spread": lambda s, d: index.condition_spread(_S(s, d, units=False).conditions),
    "availability": lambda s, d: index.availability(_M(s, d).plain, C),
    "brand_subindices": lambda s, d: (lambda m: index.brand_subindices(m.ratios, m.weights, m.brand_baselines, m.dates))(_S(s, d)),
    "subindex_changes": lambda s, d: (lambda m: feed.one_day_changes(index.brand_subindices(m.ratios, m.weights, m.brand_baselines, m.dates)))(_S(s, d)),
    "anchor_date": lambda s, d: (lambda m: index.anchor_date(m.plain, m.brand_baselines))(_M(s, d)),
    "index_changes": lambda s, d: index.changes(_S(s, d).composite, AS_OF),
    "contributions": lambda s, d: (lambda m: index.contributions(m.ratios, m.weights, m.dates).withColumn("contribution", F.round("contribution", 6)))(_S(s, d)),
    "price_outliers": lambda s, d: (lambda m: units.price_outliers(m.plain, m.brand_baselines, C))(_M(s, d)),
    "history_sheet": lambda s, d: (lambda m: feed.history_sheet(m.composite, m.conditions, index.availability(m.plain, C)))(_S(s, d)),
    "dedupe_groups": lambda s, d: _M(s, d).grouped.select("id", "date", "group_id"),
    "dedupe_survivors": lambda s, d: _M(s, d).items(("id", "date", "price")).select("newest.*", "group_id"),
    "dup_summary": lambda s, d: _M(s, d).items().where("times_listed > 1"),
    "dedupe_stats": lambda s, d: dedupe.dedupe_stats(_M(s, d).items(history=False)),
    "price_movement": lambda s, d: signals.price_movement(_M(s, d).items()),
    "inventory": lambda s, d: signals.inventory(_M(s, d).items(history=False)),
    "attention": lambda s, d: signals.attention(_views(s, d), C),
    "nearest_rank_dist": lambda s, d: signals.distributions(_views(s, d), "channel", "views"),
    "sold_chain": lambda s, d: _chain(_M(s, d), 2).select("channel", "sold_id", "listing_id").unionByName(_chain(_M(s, d), 1).select((F.col("channel") + 1_000_000_000).alias("channel"), "sold_id", "listing_id")),
    "time_to_sell": lambda s, d: replies.speed_by_brand(_sold(_M(s, d)), C),
    "sold_removed": lambda s, d: (lambda m: replies.removal_stats(replies.removals(_chain(m, 2), m.messages.withColumn("sold", F.col("message_id") >= 2).withColumn("edit_count", (F.col("channel") % 3).cast("int")).withColumn("text_updated_at", F.lit("2026-09-01T10:00")), m.messages, "2026-08-03T15:00", "2026-08-03T16:00"), _sold(m)))(_M(s, d)),
    "fastest_sales": lambda s, d: signals.fastest(_sold(_M(s, d))).select("channel", "sold_id", "listing_id", "days_to_sell"),
    "sales_coverage": lambda s, d: signals.coverage(_sold(_M(s, d)), _M(s, d).messages.count()).select("confirmed", "unique_items", "pct", F.size("channels").alias("channels")),
    "card_sales": lambda s, d: cards.sales_of_cards(_sold(_M(s, d)).withColumn("ref", (F.col("channel") % 40).cast("string")), C).select("brand", "ref", "sales_observed", "time_to_sell.*"),
    "ref_cards": lambda s, d: cards.cards(_M(s, d).grained, AS_OF, C),
    "card_monthly": lambda s, d: cards.monthly(_M(s, d).grained, C),
    "card_by_year": lambda s, d: cards.by_year(_M(s, d).grained.withColumn("year", F.substring("date", 1, 4).cast("int") - F.col("price") % 3), "year", C),
    "card_consensus": lambda s, d: cards.consensus(_M(s, d).grained, "cond", ["brand", "card_key"]),
    "card_cuts": lambda s, d: cards.cuts_of_cards(dedupe.items(_M(s, d).plain.withColumn("ref", F.substring_index("ref", "-", 1)), C, keep=("brand", "ref")), C),
    "model_leftovers": lambda s, d: (lambda g: cards.without_leftovers(cards.cards(g, AS_OF, C), g).select("brand", "card_key", "grain"))(_M(s, d).grained),
    "card_coverage": lambda s, d: cards.card_coverage(cards.cards(_M(s, d).grained, AS_OF, C)),
    "feed_filter": lambda s, d: feed.page(feed.filtered(_M(s, d).plain, brand="BRAND#12", condition="n", model="prom"), "cheapest", 50).select("id", "brand", "model", "price", "date"),
    "feed_distinct": lambda s, d: feed.first_of_each(_M(s, d).plain, ("date", "brand"), ("price", "id")).select("id", "date", "brand", "price"),
    "feed_expiry": lambda s, d: feed.expired(_M(s, d).plain, AS_OF, C).select("id", "date"),
    "link_candidates": lambda s, d: feed.to_probe(_M(s, d).plain, AS_OF, C).select("id", "date"),
    "channel_stats": lambda s, d: feed.channel_stats(_M(s, d).plain),
    "brand_sheet": lambda s, d: (lambda m: feed.brand_sheet(feed.expired(m.plain, AS_OF, C), m.weights).withColumn("weight", F.round("weight", 6)))(_M(s, d)),
}


def _brand_level(m: Market) -> DataFrame:
    """Each brand's median price of every month against its own baseline."""
    monthly = m.plain.groupBy("brand", F.substring("date", 1, 7).alias("month")).agg(F.median("price").alias("median"), F.count(F.lit(1)).alias("n"))
    return monthly.join(m.brand_baselines, "brand").select("brand", "month", "n", F.round(F.col("median") / F.col("baseline"), 4).alias("ratio"))


def _baseline_sql(name: str, source: str, keys: str) -> str:
    return f"""{name}_head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date, id) AS rn FROM {source}) WHERE rn <= 30),
{name}_raw AS (SELECT {keys}, median(price) AS raw, count(*) AS n FROM {name}_head GROUP BY {keys} HAVING count(*) >= 3),
{name}_in AS (SELECT {keys}, any_value(raw) AS raw, any_value(n) AS n, median(price) FILTER (WHERE price BETWEEN raw * 0.2 AND raw * 5) AS inside, count(*) FILTER (WHERE price BETWEEN raw * 0.2 AND raw * 5) AS k
  FROM {name}_head JOIN {name}_raw USING ({keys}) GROUP BY {keys}),
{name} AS (SELECT {keys}, CASE WHEN k >= 3 THEN inside ELSE raw END AS baseline, CASE WHEN k >= 3 THEN n - k ELSE 0 END AS excluded, volume
  FROM {name}_in JOIN (SELECT {keys}, count(*) AS volume FROM {source} GROUP BY {keys}) USING ({keys}))"""


_U = "tier, brand, unit_key"
_UNITS = """counted AS (SELECT *, count(*) OVER (PARTITION BY brand, ref) AS n_ref, count(*) OVER (PARTITION BY brand, model) AS n_model FROM records),
units AS (SELECT * EXCLUDE (n_ref, n_model), CASE WHEN n_ref >= 8 THEN 'ref' WHEN n_model >= 3 THEN 'model' ELSE 'brand' END AS tier, CASE WHEN n_ref >= 8 THEN ref WHEN n_model >= 3 THEN model ELSE '' END AS unit_key FROM counted)"""
_DATES = "dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () - 1 AS last FROM (SELECT DISTINCT date FROM records))"


def _rolling_sql(name: str, source: str, keys: str, width: int, least: int) -> str:
    qual = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    return f"""{name}_dated AS (SELECT r.*, d.i AS ri FROM {source} r JOIN dates d USING (date)),
{name} AS (SELECT {qual}, d.i, count(*) AS n, median(r.price) AS median FROM {name}_dated r JOIN dates d ON r.ri BETWEEN d.i - {width - 1} AND d.i GROUP BY {qual}, d.i HAVING count(*) >= {least})"""


_W = f"""recent AS (SELECT brand, count(*) FILTER (WHERE date >= strftime(DATE '{AS_OF}' - INTERVAL 180 DAY, '%Y-%m-%d')) AS recent FROM records GROUP BY brand),
shares AS (SELECT *, sqrt(recent / greatest(sum(recent) OVER (), 1)) AS s FROM recent),
weights AS (SELECT brand, recent, s / CASE WHEN sum(s) OVER () > 0 THEN sum(s) OVER () ELSE 1 END AS weight FROM shares)"""
_MEDIANS = ", ".join([_DATES, _UNITS, _rolling_sql("medians", "units", _U, 21, 3)])
_RATIOS = ", ".join([_MEDIANS, _baseline_sql("unit_base", "units", _U), f"ratios AS (SELECT brand, i, sum(volume * median / baseline) / sum(volume) AS ratio, CAST(sum(n) AS BIGINT) AS listings FROM medians JOIN unit_base USING ({_U}) GROUP BY brand, i)"])
_FILL = "last_value(value IGNORE NULLS) OVER ({part} ORDER BY date ROWS UNBOUNDED PRECEDING)"


def _filled_sql(name: str, source: str, part: str = "", extra: str = "") -> str:
    carried = _FILL.format(part=part)
    return f"{name} AS (SELECT * EXCLUDE (value), {carried} AS value, value IS NULL AND {carried} IS NOT NULL AS stale{extra} FROM {source})"


_COMPOSITE = ", ".join([
    _RATIOS, _W,
    "sums AS (SELECT i, count(*) AS brands_tracked, sum(weight * ratio) AS num, sum(weight) AS den FROM ratios JOIN weights USING (brand) GROUP BY i)",
    "sizes AS (SELECT d.i, CAST(sum(x.n) OVER (ORDER BY d.i ROWS 20 PRECEDING) AS BIGINT) AS total_listings FROM dates d JOIN (SELECT date, count(*) AS n FROM records GROUP BY date) x USING (date))",
    "comp_raw AS (SELECT date, CASE WHEN brands_tracked >= 3 AND den > 0 THEN round(num / den, 4) END AS value, coalesce(brands_tracked, 0) AS brands_tracked, coalesce(total_listings, 0) AS total_listings FROM dates LEFT JOIN sums USING (i) LEFT JOIN sizes USING (i))",
    _filled_sql("comp", "comp_raw"),
])
_BRAND_BASE = _baseline_sql("brand_base", "records", "brand")
_COND = ", ".join([
    _BRAND_BASE, "conds AS (SELECT * FROM records WHERE cond IN ('n', 'p') AND brand IN (SELECT brand FROM brand_base))", _rolling_sql("cond_medians", "conds", "cond, brand", 28, 2),
    "cond_sums AS (SELECT cond, i, count(*) AS brands, sum(weight * median / baseline) AS num, sum(weight) AS den FROM cond_medians JOIN brand_base USING (brand) JOIN weights USING (brand) GROUP BY cond, i)",
    "cond_raw AS (SELECT c.cond, date, CASE WHEN brands >= 2 AND den > 0 THEN round(num / den, 4) END AS value FROM dates CROSS JOIN (VALUES ('n'), ('p')) c(cond) LEFT JOIN cond_sums s ON s.cond = c.cond AND s.i = dates.i)",
    _filled_sql("conditions", "cond_raw", "PARTITION BY cond"),
])
_AVAIL = "daily AS (SELECT CAST(date AS DATE) AS d, date, count(*) AS n FROM records GROUP BY ALL), avail AS (SELECT date, CAST(round_even(n / max(n) OVER (ORDER BY d RANGE INTERVAL 59 DAY PRECEDING) * 100, 0) AS BIGINT) AS value FROM daily)"
_SUB = ", ".join([
    _RATIOS, _W, _BRAND_BASE, "best AS (SELECT brand FROM (SELECT brand FROM weights ORDER BY recent DESC, brand LIMIT 5) WHERE brand IN (SELECT brand FROM brand_base))",
    "sub_raw AS (SELECT b.brand, date, round(ratio, 4) AS value FROM dates CROSS JOIN best b LEFT JOIN ratios r ON r.brand = b.brand AND r.i = dates.i)", _filled_sql("sub", "sub_raw", "PARTITION BY brand"),
])
_GROUPS = """priced AS (SELECT *, stock_code IS NULL AND ref IS NOT NULL AND price > 0 AS b FROM records),
prices AS (SELECT channel, brand, ref, price, row_number() OVER (PARTITION BY channel, brand, ref ORDER BY price) AS k FROM (SELECT DISTINCT channel, brand, ref, price FROM priced WHERE b)),
walk AS (SELECT channel, brand, ref, price, k, price AS anchor FROM prices WHERE k = 1
  UNION ALL SELECT p.channel, p.brand, p.ref, p.price, p.k, CASE WHEN CAST(p.price - w.anchor AS DOUBLE) / w.anchor * 100 <= 10 THEN w.anchor ELSE p.price END
  FROM walk w JOIN prices p ON p.channel = w.channel AND p.brand = w.brand AND p.ref = w.ref AND p.k = w.k + 1),
grouped AS (SELECT r.*, CASE WHEN stock_code IS NOT NULL THEN concat_ws('|', 'code', r.channel, stock_code) WHEN b THEN concat_ws('|', 'ref', r.channel, r.brand, r.ref, w.anchor) ELSE 'one|' || id END AS group_id
  FROM priced r LEFT JOIN walk w ON r.b AND w.channel = r.channel AND w.brand = r.brand AND w.ref = r.ref AND w.price = r.price),
summaries AS (SELECT group_id, count(*) AS times_listed, min(date) AS first_seen, max(date) AS last_seen, arg_min(price, date || id) AS first_price, arg_max(price, date || id) AS last_price FROM grouped GROUP BY group_id),
told AS (SELECT *, CASE WHEN first_price <> last_price THEN round(CAST(last_price - first_price AS DOUBLE) / first_price * 100, 2) END AS price_change_pct, CAST(date_diff('day', CAST(first_seen AS DATE), CAST(last_seen AS DATE)) AS INT) AS days_listed FROM summaries)"""
_SINCE = f"strftime(DATE '{AS_OF}' - INTERVAL 90 DAY, '%Y-%m-%d')"
_GRAIN = f"""own AS (SELECT *, split_part(ref, '-', 1) AS family, date >= {_SINCE} AS recent FROM records),
counts AS (SELECT *, count(*) FILTER (WHERE recent) OVER (PARTITION BY brand, ref) AS a, count(*) FILTER (WHERE recent) OVER (PARTITION BY brand, family) AS b, count(*) FILTER (WHERE recent) OVER (PARTITION BY brand, model) AS c FROM own),
grained AS (SELECT *, CASE WHEN a >= 10 THEN 'reference' WHEN b >= 10 THEN 'family' WHEN c >= 10 THEN 'model' ELSE 'reference' END AS grain,
  CASE WHEN a >= 10 THEN ref WHEN b >= 10 THEN family WHEN c >= 10 THEN model ELSE ref END AS card_key FROM counts)"""
_CARDS = f"""agg AS (SELECT brand, card_key, grain, count(*) FILTER (WHERE recent) AS n_recent, count(*) AS n_total, median(price) FILTER (WHERE recent) AS med, list_sort(list(price) FILTER (WHERE recent)) AS p,
  min(date) AS first_seen, max(date) AS last_seen, count(DISTINCT channel) AS channels, count(DISTINCT ref) AS refs FROM grained GROUP BY ALL HAVING count(*) FILTER (WHERE recent) >= 10),
q AS (SELECT *, p[n_recent // 4 + 1] AS q1, p[3 * n_recent // 4 + 1] AS q3 FROM agg),
cards AS (SELECT trim(regexp_replace(lower(brand || '-' || card_key), '[^a-z0-9]+', '-', 'g'), '-') AS slug, brand, card_key, grain, CASE WHEN grain = 'reference' THEN 0 ELSE refs END AS variants,
  CASE WHEN n_recent >= 20 THEN 'full' ELSE 'limited' END AS confidence, n_recent, n_total, CAST(trunc(med) AS INT) AS median, q1 AS fair_low, q3 AS fair_high, round((q3 - q1) / med * 100, 1) AS spread_pct, (q3 - q1) / med * 100 > 60 AS wide_spread,
  p[1] AS low, p[n_recent] AS high, first_seen, last_seen, CAST(date_diff('day', CAST(last_seen AS DATE), DATE '{AS_OF}') AS INT) AS days_since_last_seen, channels FROM q)"""
_MSGS = "msgs AS (SELECT DISTINCT conv_id AS channel, turn AS m FROM conversations)"
_SOLD = """chain AS (SELECT channel, m AS sold_id, 1 AS listing_id FROM msgs WHERE m BETWEEN 2 AND 7 AND (channel, 1) IN (SELECT channel, m FROM msgs)),
sold AS (SELECT channel, sold_id, 'B' || channel % 5 AS brand, CAST(floor((sold_id - 1) * 100000 / 86400) AS INT) AS days FROM chain)"""
_VIEWS = "views AS (SELECT event_type AS channel, CAST(user_id % 12 AS VARCHAR) AS brand, CAST(floor(value * 100) AS BIGINT) AS views FROM events)"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts)


_L = LISTINGS_SQL
_DIST = "len(v) AS n, v[len(v) // 2 + 1] AS median, v[len(v) // 4 + 1] AS p25, v[3 * len(v) // 4 + 1] AS p75"

SQL = {
    "brand_level": _with(_L, _BRAND_BASE) + " SELECT brand, month, n, round(med / baseline, 4) AS ratio FROM (SELECT brand, date[1:7] AS month, median(price) AS med, count(*) AS n FROM records GROUP BY ALL) JOIN brand_base USING (brand)",
    "unit_assignment": _with(_L, _UNITS) + f" SELECT {_U}, count(*) AS n FROM units GROUP BY ALL",
    "tier_counts": _with(_L, _UNITS) + " SELECT tier, count(*) AS n FROM units GROUP BY ALL",
    "baseline_median": _with(_L, _UNITS, _baseline_sql("b", "units", _U)) + " SELECT * FROM b",
    "brand_baseline": _with(_L, _BRAND_BASE) + " SELECT * FROM brand_base",
    "rolling_unit_median": _with(_L, _MEDIANS) + f" SELECT {_U}, date, n, median FROM medians JOIN dates USING (i)",
    "rolling_model_median": _with(_L, _DATES, _rolling_sql("m", "records", "brand, model", 21, 3)) + " SELECT * FROM m",
    "brand_weights": _with(_L, _W) + " SELECT brand, recent, round(weight, 6) AS weight FROM weights",
    "brand_ratios": _with(_L, _RATIOS) + " SELECT brand, date, round(ratio, 6) AS ratio, listings FROM ratios JOIN dates USING (i)",
    "composite": _with(_L, _COMPOSITE) + " SELECT date, value, stale, brands_tracked, total_listings FROM comp",
    "condition_indices": _with(_L, _DATES, _W, _COND) + " SELECT cond, date, value, stale FROM conditions",
    "condition_spread": _with(_L, _DATES, _W, _COND) + ", ends AS (SELECT cond, arg_max(value, date) AS v FROM conditions GROUP BY cond) SELECT round(max(v) FILTER (WHERE cond = 'n') - max(v) FILTER (WHERE cond = 'p'), 4) AS spread FROM ends",
    "availability": _with(_L, _AVAIL) + " SELECT date, value FROM avail",
    "brand_subindices": _with(_L, _SUB) + " SELECT brand, date, value, stale FROM sub",
    "subindex_changes": _with(_L, _SUB) + " SELECT brand, current, round(current - before, 4) AS change_1d FROM (SELECT brand, value AS current, lag(value) OVER (PARTITION BY brand ORDER BY date) AS before, row_number() OVER (PARTITION BY brand ORDER BY date DESC) AS r FROM sub) WHERE r = 1",
    "anchor_date": _with(_L, _BRAND_BASE) + ", f AS (SELECT brand, min(date) AS date FROM records WHERE brand IN (SELECT brand FROM brand_base) GROUP BY brand), s AS (SELECT date, count(*) OVER (ORDER BY date) / count(*) OVER () AS share FROM f) SELECT min(date) AS anchor_date FROM s WHERE share >= 0.5",
    "index_changes": _with(_L, _COMPOSITE) + ", z AS (SELECT *, lag(value) OVER (ORDER BY date) AS v1 FROM comp), o AS (SELECT max(date) AS date, arg_max(value, date) AS current, arg_max(stale, date) AS stale, arg_max(v1, date) AS v1, "
    + ", ".join(f"(SELECT arg_max(value, date) FROM comp WHERE date <= strftime(DATE '{AS_OF}' - INTERVAL {n} DAY, '%Y-%m-%d')) AS v{n}" for n in (7, 30, 90))
    + ", (SELECT count(*) FROM comp WHERE stale AND date > coalesce((SELECT max(date) FROM comp WHERE NOT stale), '')) AS days_since_fresh, (SELECT min(date) FROM comp WHERE NOT stale AND value IS NOT NULL) AS first_computed FROM z) SELECT date, current, stale, coalesce(round(current - v1, 4), 0) AS change_1d, coalesce(round(round(current - v1, 4) / v1 * 100, 2), 0) AS change_1d_pct, "
    + ", ".join(f"round(current - v{n}, 4) AS change_{n}d, round((current - v{n}) / v{n} * 100, 2) AS change_{n}d_pct" for n in (7, 30, 90))
    + ", days_since_fresh, first_computed FROM o",
    "contributions": _with(_L, _RATIOS, _W)
    + """, two AS (SELECT brand, weight AS w, max(ratio) FILTER (WHERE i = (SELECT max(last) FROM dates)) AS t, max(ratio) FILTER (WHERE i < (SELECT max(last) FROM dates)) AS y
  FROM ratios JOIN weights USING (brand) WHERE i >= (SELECT max(last) - 1 FROM dates) GROUP BY ALL), k AS (SELECT *, sum(w) FILTER (WHERE t IS NOT NULL) OVER () AS wt, sum(w) FILTER (WHERE y IS NOT NULL) OVER () AS wy FROM two)
SELECT brand, round(w / wt * (t - y), 6) AS contribution FROM k WHERE t IS NOT NULL AND y IS NOT NULL
UNION ALL SELECT NULL, round(coalesce(sum(w * t / wt), 0) - coalesce(sum(w * y / wy), 0) - coalesce(sum(w / wt * (t - y)), 0), 6) FROM k""",
    "price_outliers": _with(_L, _BRAND_BASE) + " SELECT date, brand, price, baseline, round(price / baseline, 2) AS ratio FROM records JOIN brand_base USING (brand) WHERE price / baseline < 0.2 OR price / baseline > 5",
    "history_sheet": _with(_L, _COMPOSITE, _COND, _AVAIL) + " SELECT c.date, c.value AS composite, c.stale AS is_carried_forward, brands_tracked, total_listings, p.value AS preowned_index, n.value AS new_index, a.value AS availability_score FROM comp c LEFT JOIN conditions p ON p.date = c.date AND p.cond = 'p' LEFT JOIN conditions n ON n.date = c.date AND n.cond = 'n' LEFT JOIN avail a ON a.date = c.date",
    "dedupe_groups": _with(_L, _GROUPS) + " SELECT id, date, group_id FROM grouped",
    "dedupe_survivors": _with(_L, _GROUPS) + " SELECT id, date, price, group_id FROM grouped QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY date DESC, id DESC) = 1",
    "dup_summary": _with(_L, _GROUPS) + " SELECT * FROM told WHERE times_listed > 1",
    "dedupe_stats": _with(_L, _GROUPS) + " SELECT CAST(sum(times_listed) AS BIGINT) AS input, count(*) AS output, CAST(sum(times_listed) - count(*) AS BIGINT) AS removed, count(*) FILTER (WHERE times_listed > 1) AS groups_with_repeats, round_even((sum(times_listed) - count(*)) * 100.0 / sum(times_listed), 1) AS removed_pct FROM told",
    "price_movement": _with(_L, _GROUPS) + " SELECT count(*) AS reposted, count(*) FILTER (WHERE price_change_pct < 0) AS price_cuts, count(*) FILTER (WHERE price_change_pct > 0) AS price_rises, round(median(price_change_pct) FILTER (WHERE price_change_pct < 0), 2) AS median_cut_pct, CAST(trunc(median(days_listed)) AS INT) AS median_days_listed, min(price_change_pct) FILTER (WHERE price_change_pct < 0) AS biggest_cut_pct, (SELECT group_id FROM told WHERE times_listed > 1 AND price_change_pct < 0 ORDER BY price_change_pct, group_id LIMIT 1) AS biggest_cut_group FROM told WHERE times_listed > 1",
    "inventory": _with(_L, _GROUPS) + " SELECT CAST(sum(times_listed) AS BIGINT) AS raw_listings, count(*) AS unique_items, round((sum(times_listed) / count(*) - 1) * 100, 1) AS apparent_inflation_pct FROM told",
    "attention": _with(_VIEWS) + ", m AS (SELECT channel, median(views) AS middle FROM views WHERE views > 0 GROUP BY channel), a AS (SELECT brand, count(*) AS n, round(median(views / middle), 2) AS attention FROM views JOIN m USING (channel) WHERE views > 0 GROUP BY brand) SELECT brand, attention FROM a WHERE n >= 10 ORDER BY attention DESC, brand LIMIT 10",
    "nearest_rank_dist": _with(_VIEWS) + f" SELECT channel, {_DIST} FROM (SELECT channel, list_sort(list(views)) AS v FROM views GROUP BY channel)",
    "sold_chain": _with(_MSGS) + ", c AS (SELECT channel, m AS sold_id, 1 AS listing_id FROM msgs WHERE m BETWEEN 2 AND 7 UNION ALL SELECT channel + 1000000000, m, 0 FROM msgs WHERE m BETWEEN 1 AND 6) SELECT * FROM c",
    "time_to_sell": _with(_MSGS, _SOLD) + ", g AS (SELECT brand, count(*) AS n, list_sort(list(days)) AS v FROM sold GROUP BY brand) SELECT brand, n, n >= 8 AS published, CASE WHEN n >= 8 THEN v[len(v) // 2 + 1] END AS median, CASE WHEN n >= 8 THEN v[len(v) // 4 + 1] END AS p25, CASE WHEN n >= 8 THEN v[3 * len(v) // 4 + 1] END AS p75 FROM g",
    "sold_removed": _with(_MSGS, _SOLD) + """, r AS (SELECT DISTINCT channel, listing_id FROM chain), e AS (SELECT channel, m FROM msgs WHERE channel % 3 > 0 AND m >= 2),
  d AS (SELECT channel, arg_min(days, sold_id) AS d FROM sold GROUP BY channel), v AS (SELECT list_sort(list(d)) AS v FROM d)
  SELECT (SELECT count(*) FROM r) + (SELECT count(*) FROM e) AS total_removed, (SELECT count(*) FROM r) AS reply_link, (SELECT count(*) FROM e) AS edited, len(v) AS samples, v[len(v) // 2 + 1] AS median, v[len(v) // 4 + 1] AS p25, v[3 * len(v) // 4 + 1] AS p75 FROM v""",
    "fastest_sales": _with(_MSGS, _SOLD) + " SELECT channel, sold_id, 1 AS listing_id, days AS days_to_sell FROM sold ORDER BY days, channel, sold_id LIMIT 5",
    "sales_coverage": _with(_MSGS, _SOLD) + " SELECT count(*) AS confirmed, (SELECT count(*) FROM msgs) AS unique_items, round(count(*) * 100.0 / (SELECT count(*) FROM msgs), 1) AS pct, CAST(count(DISTINCT channel) AS INT) AS channels FROM sold",
    "card_sales": _with(_MSGS, _SOLD) + ", g AS (SELECT brand, CAST(channel % 40 AS VARCHAR) AS ref, count(*) AS sales_observed, list_sort(list(days)) AS v FROM sold GROUP BY ALL) SELECT brand, ref, sales_observed, CASE WHEN sales_observed >= 3 THEN len(v) END AS n, CASE WHEN sales_observed >= 3 THEN v[len(v) // 2 + 1] END AS median, CASE WHEN sales_observed >= 3 THEN v[len(v) // 4 + 1] END AS p25, CASE WHEN sales_observed >= 3 THEN v[3 * len(v) // 4 + 1] END AS p75 FROM g",
    "ref_cards": _with(_L, _GRAIN, _CARDS) + " SELECT * FROM cards",
    "card_monthly": _with(_L, _GRAIN) + " SELECT brand, card_key, date[1:7] AS month, CAST(trunc(median(price)) AS INT) AS median, count(*) AS n FROM grained GROUP BY ALL HAVING count(*) >= 3",
    "card_by_year": _with(_L, _GRAIN) + " SELECT brand, card_key, CAST(date[1:4] AS INT) - price % 3 AS year, CAST(trunc(median(price)) AS INT) AS median, count(*) AS n FROM grained WHERE recent GROUP BY ALL HAVING count(*) >= 3",
    "card_consensus": _with(_L, _GRAIN) + ", v AS (SELECT brand, card_key, cond AS value, count(*) AS n, min(date || '|' || id) AS first FROM grained GROUP BY ALL) SELECT brand, card_key, value, n, of FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY brand, card_key) AS BIGINT) AS of, row_number() OVER (PARTITION BY brand, card_key ORDER BY n DESC, first) AS r FROM v) WHERE r = 1",
    "card_cuts": _with(_L.replace("concat_ws('-', l_partkey, l_linenumber) AS ref", "CAST(l_partkey AS VARCHAR) AS ref"), _GROUPS) + ", l AS (SELECT group_id, arg_max(brand, date || id) AS brand, arg_max(ref, date || id) AS ref FROM grouped GROUP BY group_id) SELECT brand, ref, count(*) AS reposted, count(*) FILTER (WHERE price_change_pct < 0) AS cut, round(round(median(price_change_pct) FILTER (WHERE price_change_pct < 0), 4), 1) AS median_cut_pct, CAST(trunc(median(days_listed)) AS INT) AS median_days_listed FROM told JOIN l USING (group_id) WHERE times_listed > 1 GROUP BY ALL HAVING count(*) >= 5",
    "model_leftovers": _with(_L, _GRAIN, _CARDS) + ", fine AS (SELECT DISTINCT g.brand, regexp_replace(lower(g.model), '[^a-z0-9]', '', 'g') AS m FROM cards c JOIN grained g USING (brand, card_key, grain) WHERE c.grain <> 'model') SELECT brand, card_key, grain FROM cards c WHERE grain <> 'model' OR NOT EXISTS (SELECT 1 FROM fine f WHERE f.brand = c.brand AND f.m = regexp_replace(lower(c.card_key), '[^a-z0-9]', '', 'g'))",
    "card_coverage": _with(_L, _GRAIN, _CARDS) + " SELECT brand, count(*) AS cards, count(*) FILTER (WHERE n > 1) AS clashes FROM cards JOIN (SELECT slug, count(*) AS n FROM cards GROUP BY slug) USING (slug) GROUP BY brand",
    "feed_filter": _with(_L) + " SELECT id, brand, model, price, date FROM records WHERE lower(brand) = 'brand#12' AND cond = 'n' AND lower(model) LIKE '%prom%' ORDER BY price, id LIMIT 50",
    "feed_distinct": _with(_L) + " SELECT id, date, brand, price FROM records QUALIFY row_number() OVER (PARTITION BY date, brand ORDER BY price, id) = 1",
    "feed_expiry": _with(_L) + f" SELECT id, date FROM records WHERE date >= strftime(DATE '{AS_OF}' - INTERVAL 14 DAY, '%Y-%m-%d')",
    "link_candidates": _with(_L) + f" SELECT id, date FROM records WHERE date < strftime(DATE '{AS_OF}' - INTERVAL 2 DAY, '%Y-%m-%d') ORDER BY date, id LIMIT 300",
    "channel_stats": _with(_L) + " SELECT channel, count(*) AS n, min(date) AS first, max(date) AS last FROM records GROUP BY channel",
    "brand_sheet": _with(_L, _W) + f", live AS (SELECT brand, count(*) AS live_listings, CAST(trunc(median(price)) AS INT) AS median_price, min(price) AS min_price, max(price) AS max_price FROM records WHERE date >= strftime(DATE '{AS_OF}' - INTERVAL 14 DAY, '%Y-%m-%d') GROUP BY brand) SELECT brand, coalesce(live_listings, 0) AS live_listings, median_price, min_price, max_price, coalesce(recent, 0) AS recent, round(weight, 6) AS weight FROM weights FULL JOIN live USING (brand)",
}

"""Queries that run operators one after the other, as the daily run does: from posts to prices, from listings to the live feed, from cards to reports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askbook.functions import text
from askbook.operators import cards, checks, dedupe, feed, replies, signals, units
from askbook.plans.catalog import _CARDS, _GRAIN, _GROUPS, _L, _MSGS, _SOLD, _M, C, _chain, _sold, _with
from askbook.plans.posts import _POSTS, posts
from askbook.sources import documents, pages
from askbook.sources.adapters import AS_OF, listings, table


def posts_to_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts classified, those that pass read, bounded, freed from repeats, and priced by brand."""
    passed = posts(spark, sf_dir).transform(text.with_reason).where("reason IS NULL").drop("reason")
    read = text.with_listing(passed).select(F.col("id").cast("string").alias("id"), F.lit("c").alias("channel"), "brand", "model", "ref", "price", "cond", F.lit(AS_OF).alias("date"), "attributes.stock_code")
    # Repeats take two branches over the listings; from memory or disk, each post is read once, and filters on what it says stay above.
    read = read.persist(StorageLevel.MEMORY_AND_DISK)
    items = dedupe.survivors(dedupe.groups(units.bounded(read, C), C))
    return items.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.median("price").alias("median"))


def _removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What this run found sold (listings in neither condition) and what an earlier one had (those with a stock code)."""
    own = _M(spark, sf_dir).plain
    fresh, past = own.where("cond = 'u'").select("id", F.lit("reply_link").alias("reason")), own.where("stock_code IS NOT NULL").select("id", F.lit("carried").alias("reason"))
    return replies.prefer_fresh(fresh, past, ["id"])


def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings less those sold and those whose links are dead (of the oldest ones probed, the dearer ones)."""
    own = _M(spark, sf_dir).plain
    status, body = F.when(F.col("price") >= 50_000, 404).otherwise(200), F.concat(F.lit("tgme_widget_message"), F.repeat(F.lit("x"), 5000))
    probes = feed.to_probe(own, AS_OF, C).select("id", feed.link_alive(status, body).alias("alive"))
    return feed.live(own, _removals(spark, sf_dir), probes).select("id", "date", "brand", "price")


def channel_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages read from a channel page made of each part."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    html = F.concat(
        F.lit('<div class="tgme_widget_message_wrap"><div class="tgme_widget_message" data-post="c/'), k, F.lit('">'),
        F.when(k % 2 == 0, F.concat(F.lit('<a class="tgme_widget_message_reply" href="https://t.me/c/'), k + 7, F.lit('"><div class="tgme_widget_message_text js-message_reply_text">quoted</div></a>'))).otherwise(""),
        F.lit('<div class="tgme_widget_message_text">'), F.col("p_name"), F.lit("<br>$"), F.floor("p_retailprice"), F.lit(' &amp; up</div><span class="tgme_widget_message_views">'), (F.col("p_size") / 10).cast("decimal(10,1)"),
        F.lit('K</span><a class="tgme_widget_message_photo_wrap"></a><time datetime="2026-01-01T00:00:00"></time></div></div>'),
    )
    return pages.parse_messages(p.select(F.col("p_brand").alias("channel"), html.alias("html")))


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _M(spark, sf_dir).plain.withColumn("text", F.when(F.col("cond") == "u", F.concat(F.col("id"), F.lit(" is SOLD!"))).otherwise(F.col("id")))


SPARK = {
    "posts_to_prices": posts_to_prices,
    "live_feed": live_feed,
    "removal_union": lambda s, d: _removals(s, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    "channel_messages": channel_messages,
    "clean_feed": lambda s, d: feed.first_of_each(feed.cleaned(_worded(s, d))).select("id", "date", "brand", "price"),
    "card_lookup": lambda s, d: feed.card_filter(cards.cards(_M(s, d).grained, AS_OF, C), brand="BRAND#12", q="PROMO").select("slug", "confidence", "n_recent"),
    "cards_ordered": lambda s, d: cards.ordered(cards.cards(_M(s, d).grained, AS_OF, C)).select("position", "slug", "n_recent"),
    "brand_counts": lambda s, d: feed.counts(_M(s, d).plain, "brand"),
    "unbranded": lambda s, d: checks.unbranded(listings(s, d).withColumn("brand", F.when(F.col("cond") != "u", F.col("brand")))),
    "tracer_alert": lambda s, d: (lambda m: checks.tracer_alert(replies.removal_stats(replies.removals(_chain(m, 1 << 40), m.messages.withColumn("sold", F.lit(False)).withColumn("edit_count", F.lit(1)).withColumn("text_updated_at", F.lit("2026-09-01T10:00")), m.messages, "2026-08-03T15:00", "2026-08-03T16:00"), _sold(m))))(_M(s, d)),
    "sell_speed_overall": lambda s, d: replies.speed_overall(_sold(_M(s, d))),
    "sell_speed_withheld": lambda s, d: replies.withheld(_sold(_M(s, d)).withColumn("brand", F.concat("brand", F.col("channel") % 97)), C),
    "signals_line": lambda s, d: (lambda m: checks.signals_line(replies.speed_overall(_sold(m)), signals.moves_and_stock(m.items())))(_M(s, d)),
    "listing_documents": lambda s, d: documents.as_document(_M(s, d).plain, "id", "price", "stock_code").select(F.get_json_object("document", "$.id").alias("id"), F.size(F.map_keys(F.from_json("document", "map<string,string>"))).alias("fields")),
    "no_cards": lambda s, d: checks.no_cards(cards.cards(cards.with_grain(_M(s, d).plain, "2100-01-01", C), "2100-01-01", C)),
}

_MOVES = "(SELECT count(*) FILTER (WHERE price_change_pct < 0) FROM told WHERE times_listed > 1)"
_INFLATION = "(SELECT round((sum(times_listed) / count(*) - 1) * 100, 1) FROM told)"
_OVERALL = "(SELECT list_sort(list(days)) AS v FROM sold)"

SQL = {
    "posts_to_prices": f"WITH {_POSTS} SELECT brand, count(*) AS n, median(price) AS median FROM posts GROUP BY brand",
    "live_feed": _with(_L) + f""", probed AS (SELECT * FROM records WHERE date < strftime(DATE '{AS_OF}' - INTERVAL 2 DAY, '%Y-%m-%d') ORDER BY date, id LIMIT 300)
  SELECT id, date, brand, price FROM records WHERE cond <> 'u' AND stock_code IS NULL AND id NOT IN (SELECT id FROM probed WHERE price >= 50000)""",
    "removal_union": _with(_L) + " SELECT CASE WHEN cond = 'u' THEN 'reply_link' ELSE 'carried' END AS reason, count(*) AS n FROM records WHERE cond = 'u' OR stock_code IS NOT NULL GROUP BY ALL",
    "channel_messages": "SELECT p_brand AS channel, p_partkey AS message_id, '2026-01-01T00:00:00' AS posted_at, p_name || chr(10) || '$' || CAST(floor(p_retailprice) AS BIGINT) || ' & up' AS message_text, 1 AS photos_count, CAST(p_size * 100 AS BIGINT) AS views, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 7 END AS reply_to FROM part",
    "clean_feed": _with(_L) + " SELECT id, date, brand, price FROM records WHERE cond <> 'u' QUALIFY row_number() OVER (PARTITION BY date, brand, price ORDER BY id) = 1",
    "card_lookup": _with(_L, _GRAIN, _CARDS) + " SELECT slug, confidence, n_recent FROM cards WHERE lower(brand) = 'brand#12' AND contains(lower(card_key || ' ' || brand), 'promo')",
    "cards_ordered": _with(_L, _GRAIN, _CARDS) + " SELECT CAST(row_number() OVER (ORDER BY n_recent DESC, slug) AS INT) AS position, slug, n_recent FROM cards",
    "brand_counts": _with(_L) + " SELECT brand, count(*) AS n FROM records GROUP BY brand ORDER BY n DESC, brand",
    "unbranded": _with(_L) + " SELECT count(*) FILTER (WHERE cond = 'u') AS unbranded FROM listings",
    "tracer_alert": _with(_MSGS) + " SELECT 'nothing removed' AS alert WHERE NOT EXISTS (SELECT 1 FROM msgs WHERE m >= 1099511627776)",
    "sell_speed_overall": _with(_MSGS, _SOLD) + f" SELECT len(v) AS n, v[len(v) // 2 + 1] AS median, v[len(v) // 4 + 1] AS p25, v[3 * len(v) // 4 + 1] AS p75 FROM {_OVERALL}",
    "sell_speed_withheld": _with(_MSGS, _SOLD) + " SELECT brand || (channel % 97) AS brand, count(*) AS n FROM sold GROUP BY ALL HAVING count(*) < 8",
    "signals_line": _with(_L, _GROUPS, _MSGS, _SOLD) + f" SELECT len(v) || ' confirmed sales (median ' || v[len(v) // 2 + 1] || 'd), ' || {_MOVES} || ' price cuts, inventory looks ' || {_INFLATION} || '% deeper than it is' AS line FROM {_OVERALL}",
    "listing_documents": _with(_L) + " SELECT id, CAST(CASE WHEN stock_code IS NULL THEN 2 ELSE 3 END AS INT) AS fields FROM records",
    "no_cards": "SELECT 'no cards' AS alert",
}

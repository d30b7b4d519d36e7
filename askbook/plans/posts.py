"""Text, ingest and check queries. The test tables have no dealer posts, so posts are written from their columns and read back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askbook.functions import numbers, text
from askbook.operators import cards as card_ops
from askbook.operators import checks, dedupe, index
from askbook.plans.catalog import _CARDS, _COMPOSITE, _GRAIN, _GROUPS, _L, _M, _S, C, _with
from askbook.plans.catalog import SQL as _CATALOG_SQL
from askbook.sources import messages, pages
from askbook.sources.adapters import AS_OF, dealt, table
from askbook.streaming import ingest

NAMES = [("Rolex", "Submariner"), ("Omega", "Speedmaster"), ("Tudor", "Black Bay"), ("Cartier", "Santos"), ("Panerai", "Luminor")]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text: a listing written for each part."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(f"{b} {m}") for b, m in NAMES]), (k % 5 + 1).cast("int"))
    ref = F.when(k % 5 == 3, F.concat(F.lit("WSSA"), F.lpad((k % 9000).cast("string"), 4, "0"))).when(k % 5 == 4, F.concat(F.lit("PAM "), (k % 900 + 100).cast("string"))).otherwise(F.concat((k % 90000 + 10000).cast("string"), F.lit("LN")))
    cond = F.element_at(F.array(F.lit("BNIB"), F.lit("Pre-owned"), F.lit("Rare")), (k % 3 + 1).cast("int"))
    price = F.format_number(F.floor("p_retailprice"), 0)
    body = F.concat(cond, F.lit(" "), name, F.lit(" "), ref, F.lit("\nCase size : "), (F.col("p_size") % 30 + 25).cast("string"), F.lit("mm\nOur Ref: Z"), (k % 90000 + 10000).cast("string"), F.lit("\nPrice: SGD $"), price, F.lit("\nHSBC installment plan accepted"))
    return dealt(p.select(k.alias("id"), body.alias("text")))  # reading a post costs far more than moving it


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = text.with_listing(posts(spark, sf_dir))
    return told.select("id", "brand", "model", "ref", "price", "cond", "attributes.case_size_mm", "attributes.stock_code", "title")


_POSTS = """posts AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Rolex' WHEN 1 THEN 'Omega' WHEN 2 THEN 'Tudor' WHEN 3 THEN 'Cartier' ELSE 'Panerai' END AS brand,
  CASE p_partkey % 5 WHEN 0 THEN 'Submariner' WHEN 1 THEN 'Speedmaster' WHEN 2 THEN 'Black Bay' WHEN 3 THEN 'Santos' ELSE 'Luminor' END AS model,
  CASE p_partkey % 5 WHEN 3 THEN 'WSSA' || lpad(CAST(p_partkey % 9000 AS VARCHAR), 4, '0') WHEN 4 THEN 'PAM00' || (p_partkey % 900 + 100) ELSE (p_partkey % 90000 + 10000) || 'LN' END AS ref,
  CAST(floor(p_retailprice) AS INT) AS price, CASE p_partkey % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'p' ELSE 'u' END AS cond, CAST(p_size % 30 + 25 AS INT) AS case_size_mm, 'Z' || (p_partkey % 90000 + 10000) AS stock_code FROM part)"""

#: Endings of posts and the reason for which each is rejected.
KINDS = [
    ("Rolex Submariner 126610LN Price: SGD $16,800", None), ("Rolex Submariner RM53,800", "not_singapore"), ("Rolex Submariner SGD $9,000 SOLD", "noise_pattern"),
    ("Crystal only Omega Case Diameter: 30mm Price: $500", "accessory_no_anatomy"), ("Hello to all of you, only $500", "no_brand_or_terms"), ("Rolex Submariner, ask for details", "no_price"),
    ("  ", "empty"), ("HSBC installment plan", "empty_after_noise_strip"),
]


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.element_at(F.array(*[F.lit(t) for t, _ in KINDS]), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    return dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), made.alias("text"))).transform(text.with_reason).select("id", "reason")


_KINDS = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {'NULL' if r is None else repr(r)}" for i, (_, r) in enumerate(KINDS)) + " END"


def batch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    head = F.concat(F.lit("[WATCH DEALS today]\n✅\n(AVAILABLE)\n✅\n(1) Rolex "), F.col("p_partkey"), F.lit("\nS$17,700\n❌\nSOLD\n❌\n(2) Omega "), F.col("p_size"), F.lit("\n✅(AVAILABLE)✅ (3)  Tudor\n\n"))
    told = p.select(F.col("p_partkey").alias("message"), F.explode(text.batch_items(head)).alias("i"))
    return told.select(text.listing_key(F.lit("c"), F.col("message"), F.col("i.item_number")).alias("key"), "i.available", "i.body")


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each event."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("channel"), n.alias("message_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("posted_at"), F.concat(F.lit("text "), F.col("user_id")).alias("message_text"),
        F.lit(1).alias("photos_count"), (F.col("user_id") * 10).alias("views"), F.when(n % 4 == 0, n - 1).alias("reply_to"),
    )


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping reads of the messages: what is held, and a later batch of which some texts, views and replies differ."""
    n = F.col("message_id")
    own = _own(spark, sf_dir)
    held = own.where(n % 10 < 8).withColumn("first_seen_at", F.lit("old")).withColumn("text_updated_at", F.lit(None).cast("string")).withColumn("edit_count", F.lit(0))
    batch = own.where(n % 10 >= 2).withColumn("message_text", F.when(n % 3 == 0, F.concat("message_text", F.lit("!"))).otherwise(F.col("message_text"))).withColumn("views", F.when(n % 5 == 0, F.col("views") + 1).otherwise(F.col("views"))).withColumn("reply_to", F.when(n % 8 == 0, F.lit(None)).otherwise(F.coalesce("reply_to", F.when(n % 7 == 0, n - 2))))
    return held, batch.withColumn("posted_at", F.when(n % 50 == 9, F.lit(None)).otherwise(F.col("posted_at")))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.upserted(*_versions(spark, sf_dir), "now").drop("posted_at", "photos_count")


_VERSIONS = """own AS (SELECT event_type AS channel, event_id AS message_id, 'text ' || user_id AS message_text, user_id * 10 AS views, CASE WHEN event_id % 4 = 0 THEN event_id - 1 END AS reply_to FROM events),
held AS (SELECT * FROM own WHERE message_id % 10 < 8),
batch AS (SELECT channel, message_id, message_text || CASE WHEN message_id % 3 = 0 THEN '!' ELSE '' END AS message_text, views + CASE WHEN message_id % 5 = 0 THEN 1 ELSE 0 END AS views,
  CASE WHEN message_id % 8 = 0 THEN NULL ELSE coalesce(reply_to, CASE WHEN message_id % 7 = 0 THEN message_id - 2 END) END AS reply_to FROM own WHERE message_id % 10 >= 2 AND message_id % 50 <> 9),
met AS (SELECT coalesce(h.channel, b.channel) AS channel, coalesce(h.message_id, b.message_id) AS message_id, h.message_id IS NULL AS fresh, b.message_id IS NOT NULL AS new, h.message_text AS t0, b.message_text AS t1, h.views AS v0, b.views AS v1, h.reply_to AS r0, b.reply_to AS r1
  FROM held h FULL JOIN batch b ON h.channel = b.channel AND h.message_id = b.message_id),
said AS (SELECT *, NOT fresh AND new AND (t0 <> t1 OR v0 <> v1 OR (r1 IS NOT NULL AND r0 IS NULL)) AS changed FROM met)"""

SPARK = {
    "post_extraction": extracted,
    "classify_reasons": classified,
    "rejection_histogram": lambda s, d: checks.rejections(classified(s, d)),
    "batch_split": batch_split,
    "price_forms": lambda s, d: _price_forms(s, d),
    "page_parse": lambda s, d: pages.parse_pages(table(s, d, "pages")),
    "page_cursor": lambda s, d: table(s, d, "pages").select("page_id", messages.next_before(F.concat_ws("", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<link rel="prev" href="/s/c/?before='), F.col("page_id"), F.lit('">'))), F.col("html"), F.when(F.col("page_id") % 2 == 1, F.concat(F.lit('<a data-before="'), F.col("page_id"), F.lit('">'))))).alias("before")),
    "upsert": upsert,
    "upsert_counts": lambda s, d: messages.upsert_counts(messages.upserted(*_versions(s, d), "now")),
    "high_water": lambda s, d: messages.high_water(_own(s, d)),
    "incremental_scan": lambda s, d: messages.incremental(_versions(s, d)[0].withColumn("page", (F.lit(30) - F.col("message_id") % 31).cast("int")), messages.high_water(_versions(s, d)[0].where("message_id % 100 = 1"))).select("channel", "message_id", "page"),
    "event_windows": lambda s, d: ingest.event_windows(table(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total")),
    "event_sessions": lambda s, d: ingest.sessions(table(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "user_id", "n"),
    "drift": lambda s, d: checks.drift(table(s, d, "nation"), table(s, d, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 7 == 0, F.upper(F.reverse("n_name"))).otherwise(F.col("n_name"))), ["n_nationkey"]),
    "set_differences": lambda s, d: checks.set_differences(table(s, d, "customer").select("c_nationkey"), table(s, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))).groupBy("c_nationkey", "side").agg(F.count(F.lit(1)).alias("n")),
    "card_invariants": lambda s, d: checks.broken_cards(_damaged(card_ops.cards(_M(s, d).grained, AS_OF, C)), replace(C, card_limited=11)),
    "card_alerts": lambda s, d: checks.card_alerts(card_ops.cards(_M(s, d).grained, AS_OF, C)),
    "index_alerts": lambda s, d: checks.index_alerts(index.changes(_S(s, d).composite, AS_OF), replace(C, swing_alert_pct=0.01, stale_alert_days=0)),
    "asof_lookup": lambda s, d: _S(s, d).composite.agg(*[index.as_of_value(F.lit(t)).alias(n) for n, t in (("a", "1995-06-30"), ("b", "2000-01-01"), ("c", "1990-01-01"))]),
    "ref_family": lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id"), card_ops.ref_family(F.element_at(F.array(F.lit("Omega"), F.lit("Hublot"), F.lit("Audemars Piguet"), F.lit("Rolex")), (F.col("p_partkey") % 4 + 1).cast("int")), F.concat_ws(".", F.lit("310"), F.lit("32"), F.lit("42"), F.lit("50"), F.col("p_partkey"))).alias("family")),
    "insight": lambda s, d: (lambda m: index.insight(index.contributions(m.ratios, m.weights, m.dates), index.changes(m.composite, AS_OF)))(_S(s, d)),
    "price_changes_sheet": lambda s, d: _price_changes(s, d),
    "view_counts": lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id"), numbers.view_count(F.concat((F.col("p_size") / 10).cast("decimal(10,1)"), F.lit("K"))).alias("views"), numbers.view_count(F.concat((F.col("p_size") / 10).cast("decimal(10,1)"), F.lit("K")), compat=True).alias("compat")),
}


def _damaged(made: DataFrame) -> DataFrame:
    """Cards with each of their invariants broken by some of them."""
    told = made.withColumn("slug", F.when(F.col("confidence") == "full", F.lower("grain")).otherwise(F.col("slug"))).withColumn("brand", F.when(F.col("wide_spread"), F.col("brand")))
    return told.withColumn("fair_low", F.when(F.col("channels") > 6, F.col("high") + 1).otherwise(F.col("fair_low")))


def _price_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.floor("p_retailprice").cast("int").alias("v"))
    shown = F.format_number("v", 0)
    forms = [F.concat(F.lit("Asking price: $"), shown), F.concat(F.lit("S$ "), shown), F.concat(F.lit("$"), shown, F.lit("/-")), F.concat(F.lit("Priced at\n💲\n"), F.col("v") + 10_000), F.concat(shown, F.lit("/-")), F.concat(F.lit("$"), (F.col("p_partkey") % 90 + 10), F.lit(".5k")), F.concat(F.lit("$13x,"), shown), F.concat(F.lit("only SGD$"), F.col("v"))]
    made = F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), text.price(made).alias("price"))


def _price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _M(spark, sf_dir).items(("id", "brand", "price")).where("times_listed > 1 AND price_change_pct IS NOT NULL")
    return told.select("newest.*", "first_price", "price_change_pct", "days_listed", "times_listed").orderBy("price_change_pct", "id")


SQL = {
    "post_extraction": f"WITH {_POSTS} SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'BNIB' WHEN 1 THEN 'Pre-owned' ELSE 'Rare' END || ' ' || brand || ' ' || model || ' ' || CASE p_partkey % 5 WHEN 4 THEN 'PAM ' || (p_partkey % 900 + 100) ELSE ref END AS title FROM posts JOIN (SELECT p_partkey FROM part) ON id = p_partkey".replace("SELECT *, CASE", "SELECT posts.*, CASE"),
    "classify_reasons": f"SELECT p_partkey AS id, {_KINDS} AS reason FROM part",
    "rejection_histogram": f"WITH c AS (SELECT coalesce({_KINDS}, 'passed') AS reason FROM part) SELECT reason, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM c), 1) AS pct FROM c GROUP BY reason",
    "batch_split": "SELECT 'c-' || p_partkey || '-' || i AS key, i <> 2 AS available, CASE i WHEN 1 THEN 'Rolex ' || p_partkey || chr(10) || 'S$17,700' WHEN 2 THEN 'Omega ' || p_size ELSE 'Tudor' END AS body FROM part, range(1, 4) r(i)",
    "price_forms": "SELECT p_partkey AS id, CAST(CASE p_partkey % 8 WHEN 3 THEN floor(p_retailprice) + 10000 WHEN 4 THEN CASE WHEN p_retailprice >= 1000 THEN floor(p_retailprice) END WHEN 5 THEN (p_partkey % 90 + 10) * 1000 + 500 WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE floor(p_retailprice) END AS INT) AS price FROM part",
    "page_cursor": "SELECT page_id, page_id AS before FROM pages",
    "upsert": f"WITH {_VERSIONS} SELECT channel, message_id, CASE WHEN fresh OR changed THEN t1 ELSE t0 END AS message_text, CASE WHEN fresh OR changed THEN v1 ELSE v0 END AS views, CASE WHEN fresh OR changed THEN coalesce(r1, r0) ELSE r0 END AS reply_to, CASE WHEN fresh THEN 'now' ELSE 'old' END AS first_seen_at, CASE WHEN changed AND t0 <> t1 THEN 'now' END AS text_updated_at, CASE WHEN changed AND t0 <> t1 THEN 1 ELSE 0 END AS edit_count, CASE WHEN fresh THEN 'insert' WHEN changed THEN 'update' END AS action FROM said",
    "upsert_counts": f"WITH {_VERSIONS} SELECT count(*) FILTER (WHERE fresh) AS inserted, count(*) FILTER (WHERE changed) AS updated FROM said",
    "high_water": f"WITH {_VERSIONS} SELECT channel, max(message_id) AS latest_id, min(message_id) AS oldest_id, count(*) AS total FROM own GROUP BY channel",
    "incremental_scan": f"WITH {_VERSIONS}, s AS (SELECT channel, max(message_id) AS latest FROM held WHERE message_id % 100 = 1 GROUP BY channel) SELECT channel, message_id, CAST(30 - message_id % 31 AS INT) AS page FROM held LEFT JOIN s USING (channel) WHERE 30 - message_id % 31 < 25 AND (30 - message_id % 31 < 3 OR message_id > coalesce(latest, -1))",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS \"end\", user_id, count(*) AS n FROM g GROUP BY user_id, k",
    "drift": "SELECT n_nationkey, 'n_name' AS path, n_name AS left_value, upper(reverse(n_name)) AS right_value FROM nation WHERE n_nationkey % 7 = 0 AND upper(reverse(n_name)) <> n_name ORDER BY n_nationkey LIMIT 40",
    "set_differences": "WITH a AS (SELECT c_nationkey FROM customer), b AS (SELECT s_nationkey AS c_nationkey FROM supplier) SELECT c_nationkey, side, count(*) AS n FROM (SELECT c_nationkey, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT c_nationkey, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY ALL",
    "card_invariants": _with(_L, _GRAIN, _CARDS) + """, damaged AS (SELECT * REPLACE (CASE WHEN confidence = 'full' THEN lower(grain) ELSE slug END AS slug, CASE WHEN wide_spread THEN brand END AS brand, CASE WHEN channels > 6 THEN high + 1 ELSE fair_low END AS fair_low) FROM cards),
  clash AS (SELECT slug AS s FROM damaged GROUP BY slug HAVING count(*) > 1)
  SELECT slug, 'unnamed' AS rule FROM damaged WHERE brand IS NULL UNION ALL SELECT slug, 'fair range' FROM damaged WHERE NOT (fair_low <= median AND median <= fair_high)
  UNION ALL SELECT slug, 'few listings' FROM damaged WHERE n_recent < 11 UNION ALL SELECT slug, 'shared slug' FROM damaged WHERE slug IN (SELECT s FROM clash)""",
    "card_alerts": _with(_L, _GRAIN, _CARDS) + " SELECT slug, 'wide' AS alert FROM cards WHERE wide_spread UNION ALL SELECT slug, 'old' FROM cards WHERE days_since_last_seen > 60",
    "index_alerts": f"WITH c AS ({_CATALOG_SQL['index_changes']}) SELECT 'swing' AS alert FROM c WHERE abs(change_1d_pct) > 0.01 UNION ALL SELECT 'stale' FROM c WHERE days_since_fresh >= 0",
    "insight": f"""WITH ch AS ({_CATALOG_SQL['index_changes']}), c AS ({_CATALOG_SQL['contributions']}),
  s AS (SELECT brand, contribution * CASE WHEN change_1d_pct < 0 THEN -1 ELSE 1 END AS v, change_1d_pct AS pct FROM c, ch WHERE brand IS NOT NULL),
  t AS (SELECT max(pct) AS pct, (SELECT string_agg(brand, ', ' ORDER BY v DESC, brand) FROM (SELECT * FROM s WHERE v > 0 ORDER BY v DESC, brand LIMIT 3)) AS l, (SELECT string_agg(brand, ', ' ORDER BY v, brand) FROM (SELECT * FROM s WHERE v < 0 ORDER BY v, brand LIMIT 3)) AS a FROM s)
  SELECT 'Index ' || CASE WHEN pct > 0 THEN 'rose' WHEN pct < 0 THEN 'fell' ELSE 'held steady' END || coalesce(', led by ' || l, '') || coalesce('; against it ' || a, '') AS sentence FROM t""",
    "page_parse": """SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS title, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS links, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INT) AS paragraphs FROM pages""",
    "asof_lookup": _with(_L, _COMPOSITE) + " SELECT (SELECT arg_max(value, date) FROM comp WHERE date <= '1995-06-30') AS a, (SELECT arg_max(value, date) FROM comp WHERE date <= '2000-01-01') AS b, (SELECT arg_max(value, date) FROM comp WHERE date <= '1990-01-01') AS c",
    "ref_family": "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '310.32.42.50' WHEN 1 THEN '310.32' WHEN 2 THEN '310' END AS family FROM part",
    "price_changes_sheet": _with(_L, _GROUPS) + " SELECT g.id, g.brand, g.price, t.first_price, t.price_change_pct, t.days_listed, t.times_listed FROM told t JOIN (SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY date DESC, id DESC) = 1) g USING (group_id) WHERE times_listed > 1 AND price_change_pct IS NOT NULL",
    "view_counts": "SELECT p_partkey AS id, CAST(p_size * 100 AS BIGINT) AS views, CAST(p_size * 1000 AS BIGINT) AS compat FROM part",
}

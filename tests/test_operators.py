import datetime as dt
import os
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from askbook.config import Config
from askbook.functions import numbers, pools
from askbook.operators import cards, checks, dedupe, feed, index, replies, units
from askbook.sources import messages, pages
from askbook.streaming import ingest

RECORD = "id string, channel string, brand string, price int, date string, ref string, stock_code string"


def groups(spark, rows):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], RECORD)
    found = {}
    for r in dedupe.groups(df).collect():
        found.setdefault(r.group_id, set()).add(int(r.id))
    return sorted(map(sorted, found.values()))


@pytest.mark.parametrize("rows,want", [
    ([("a", "B", 100, "2026-01-01", "R", "Z1"), ("a", "B", 900, "2026-01-02", "Q", "Z1")], [[0, 1]]),
    ([("a", "B", 1000, "2026-01-01", "R", None), ("b", "B", 1000, "2026-01-02", "R", None)], [[0], [1]]),
    ([("a", "B", 1000, "2026-01-01", None, None), ("a", "B", 1000, "2026-01-02", None, None)], [[0], [1]]),
    ([("a", "B", 1000, "2026-01-01", "R", None), ("a", "B", 1100, "2026-01-02", "R", None), ("a", "B", 1101, "2026-01-02", "R", None)], [[0, 1], [2]]),
    ([("a", "B", p, "2026-01-01", "R", None) for p in (1280, 1000, 1180, 1090)], [[0, 2], [1, 3]]),
    ([("a", "B", 0, "2026-01-01", "R", None), ("a", "B", None, "2026-01-02", "R", None), ("a", "B", 0, "2026-01-03", "R", None)], [[0], [1], [2]]),
    ([(None, "B", 500, "2026-01-01", "R", None), (None, "B", 500, "2026-01-02", "R", None)], [[0, 1]]),
])
def test_groups(spark, rows, want):
    assert groups(spark, rows) == want


def test_deduped_keeps_newest_with_history(spark):
    rows = [("1", "a", "B", 1000, "2026-01-01", "R", "Z1"), ("2", "a", "B", 900, "2026-01-11", "R", "Z1"), ("3", "a", "B", 5000, "2026-01-05", "S", None)]
    df = spark.createDataFrame(rows, RECORD)
    got = {r.id: r for r in dedupe.deduped(df).collect()}
    assert set(got) == {"2", "3"} and got["3"].dup is None
    d = got["2"].dup
    assert (d.times_listed, d.first_price, d.last_price, d.price_change_pct, d.days_listed) == (2, 1000, 900, -10.0, 10)
    s = dedupe.dedupe_stats(dedupe.groups(df)).first()
    assert (s.input, s.output, s.removed, s.groups_with_repeats, s.removed_pct) == (3, 2, 1, 1, 33.3)
    assert dedupe.dedupe_stats(dedupe.groups(df.limit(0))).first().input == 0


def test_items_are_the_groups_told_from_one_reading(spark):
    r = np.random.default_rng(5)
    pick = lambda *values: values[int(r.integers(0, len(values)))]
    rows = [(str(int(i)), pick("a", "b", None), pick("B", "C", None), pick(None, 0, *range(1000, 2000, 45)), pick("2026-01-01", "2026-01-05", "2026-02-09", None), pick("R", "Q", "", None), pick(None, None, None, "", "Z1", "Z2")) for i in r.permutation(600)]
    df = spark.createDataFrame(rows, RECORD).repartition(3)
    grouped = dedupe.groups(df)
    want = {x.group_id: x.asDict() for x in dedupe.summaries(grouped).collect()}
    newest = {x.group_id: x.id for x in dedupe.survivors(grouped).collect()}
    got = dedupe.items(df, keep=("id",)).collect()
    assert {x.group_id: {k: v for k, v in x.asDict().items() if k != "newest"} for x in got} == want and len(got) == len(want)
    assert {x.group_id: x.newest.id for x in got} == newest
    sizes = dedupe.items(df, history=False)
    assert {x.group_id: x.times_listed for x in sizes.collect()} == {k: v["times_listed"] for k, v in want.items()}
    assert dedupe.dedupe_stats(sizes).collect() == dedupe.dedupe_stats(grouped).collect()
    assert dedupe.items(df.withColumn("m", F.create_map("id", "id")), keep=("id", "m")).count() == len(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name,moves", [("card_cuts", 3), ("price_changes_sheet", 3), ("dedupe_stats", 4), ("signals_line", 11)])  # with the moves of its reply chains
def test_queries_on_repeats_read_and_move_listings_once(spark, name, moves):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("lineitem.parquet") == 1
    assert len(re.findall(r"Exchange (?:hash|range|Single)", plan)) <= moves


def test_baseline_leaves_out_outliers(spark):
    own = lambda prices: spark.createDataFrame([(str(i), "B", f"2026-01-{i + 1:02d}", p) for i, p in enumerate(prices)], "id string, brand string, date string, price int")
    base = lambda prices: [(r.baseline, r.excluded) for r in units.baselines(own(prices), ["brand"]).collect()]
    assert base([16000, 16100, 15900, 16200, 500]) == [(16050.0, 1)]
    assert base([100, 200]) == []
    assert base([10, 1000, 100000]) == [(1000.0, 0)]


def test_fill_and_freshness(spark):
    s = spark.createDataFrame([("2026-01-01", None), ("2026-01-02", 1.0), ("2026-01-03", None), ("2026-01-04", None)], "date string, value double")
    got = index.filled(s).orderBy("date").collect()
    assert [(r.value, r.stale) for r in got] == [(None, False), (1.0, False), (1.0, True), (1.0, True)]
    c = index.changes(index.filled(s), "2026-01-04").first()
    assert (c.current, c.days_since_fresh, c.first_computed, c.change_1d, c.change_7d) == (1.0, 2, "2026-01-02", 0.0, None)


@pytest.mark.parametrize("small", [False, True])
def test_rolling_pools_count_observed_dates(spark, monkeypatch, small):
    monkeypatch.setattr(index, "SPAN", 4)
    days = [f"2026-{m:02d}-01" for m in range(1, 12)]
    rows = [("A", days[0], 10), ("A", days[0], 20), ("A", days[2], 30), ("A", days[9], 50)] + [("B", d, 1) for d in days]
    df = spark.createDataFrame(rows, "brand string, date string, price int")
    df = df.unionByName(df.where("date = '2026-01-01' AND price = 20")) if small else df
    rows = rows + [("A", days[0], 20)] if small else rows
    got = {(r.brand, r.i): (r.n, r.median) for r in index.rolling_medians(df, index.date_index(df), ["brand"], 3, 1).collect()}
    want = {}
    for b in "AB":
        for i in range(len(days)):
            pool = sorted(p for x, d, p in rows if x == b and i - 2 <= days.index(d) <= i)
            if pool:
                n = len(pool)
                want[b, i] = (n, (pool[(n - 1) // 2] + pool[n // 2]) / 2)
    assert got == want


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("small", [0, 128])
def test_sliding_pools_by_brute_force(monkeypatch, seed, small):
    monkeypatch.setattr(pools, "SMALL", small)
    r = np.random.default_rng(seed)
    rows = sorted({(int(d), float(p)): int(n) for d, p, n in zip(r.integers(0, 40, 60), r.integers(1, 15, 60), r.integers(1, 4, 60))}.items())
    date, price, n = np.array([k[0] for k, _ in rows]), np.array([k[1] for k, _ in rows]), np.array([v for _, v in rows])
    first, last, width, least = int(r.integers(0, 20)), int(r.integers(20, 45)), int(r.integers(1, 9)), int(r.integers(1, 5))
    got = list(zip(*[x.tolist() for x in pools.rolling(date, price, n, first, last, width, least)]))
    want = []
    for t in range(first, last + 1):
        pool = [p for (d, p), k in rows if t - width < d <= t for _ in range(k)]
        if len(pool) >= least:
            want.append((t, len(pool), statistics.median(pool)))
    assert got == want


def test_weights_sum_to_one_and_contributions_reconcile(spark):
    rows = [(str(i), b, f"2026-01-{1 + i % 9:02d}", 1000 + 37 * i % 400, "n", None, None) for i in range(300) for b in ("A", "B", "C", "D")[: 1 + i % 4]]
    df = spark.createDataFrame(rows, "id string, brand string, date string, price int, cond string, ref string, model string")
    w = units.brand_weights(df, "2026-01-09")
    assert sum(r.weight for r in w.collect()) == pytest.approx(1)
    own, dates = units.assign_units(df), index.date_index(df)
    ratios = index.brand_ratios(index.rolling_medians(own, dates, units.UNIT, 21, 3), units.baselines(own, units.UNIT))
    comp = index.composite(ratios, w, dates, index.pool_sizes(df, dates, 21)).orderBy("date").collect()
    moved = sum(r.contribution for r in index.contributions(ratios, w, dates).collect())
    assert moved == pytest.approx(comp[-1].value - comp[-2].value, abs=2e-4)


def msgs(spark, rows):
    own = [(c, m, dt.datetime(2026, 7, d), t, r) for c, m, d, t, r in rows]
    return spark.createDataFrame(own, "channel string, message_id bigint, posted_at timestamp, text string, reply_to bigint").withColumn("sold", F.col("text").rlike(r"(?i)\bsold\b"))


@pytest.mark.parametrize("rows,want", [
    ([("d", 100, 1, "listing", None), ("d", 200, 5, "SOLD!", 100)], [(100, 4)]),
    ([("d", 100, 1, "listing", None), ("d", 150, 2, "SOLD", 100), ("d", 200, 5, "SOLD", 150)], [(100, 1), (100, 4)]),
    ([("d", 150, 2, "SOLD", None), ("d", 200, 5, "SOLD", 150)], []),
    ([("d", 100, 1, "listing", None), ("o", 200, 5, "SOLD", 100)], []),
    ([("d", 1, 1, "listing", None)] + [("d", i, i, "SOLD", i - 1) for i in range(2, 9)], [(1, i) for i in range(1, 7)]),
])
def test_sold_chains(spark, rows, want):
    m = msgs(spark, rows)
    sold = replies.sales(replies.sold_chain(m), m.where("not sold").select("channel", "message_id", "posted_at"))
    assert sorted((r.listing_id, r.days_to_sell) for r in sold.collect()) == want


def test_removals_by_reply_then_edit(spark):
    m = msgs(spark, [("d", 100, 1, "listing", None), ("d", 200, 5, "SOLD", 100), ("d", 300, 1, "item SOLD", None), ("d", 400, 1, "x SOLD", None)])
    m = m.withColumn("edit_count", F.lit(1)).withColumn("text_updated_at", F.when(F.col("message_id") == 400, "2026-08-03T15:20:00").otherwise("2026-09-01T00:00:00"))
    got = replies.removals(replies.sold_chain(m), m, m.select("channel", "message_id"), "2026-08-03T15:00", "2026-08-03T16:00").collect()
    assert sorted((r.listing_id, r.strategy) for r in got) == [(100, "reply_link"), (200, "edited"), (300, "edited")]


def test_ref_family_and_slug(spark):
    rows = [("Audemars Piguet", "15510ST.OO.1320ST.06", "15510ST"), ("Omega", "310.32.42.50.02.001", "310.32.42.50"), ("Hublot", "411.NM.1170.RX", "411.NM"), ("Rolex", "126610LN", None), ("Omega", "310.32", None)]
    df = spark.createDataFrame(rows, "brand string, ref string, want string").withColumn("got", cards.ref_family(F.col("brand"), F.col("ref")))
    assert all(r.got == r.want for r in df.collect())
    assert spark.range(1).select(cards.slug(F.lit("A. Lange & Sohne"), F.lit("Lange 1"))).first()[0] == "a-lange-sohne-lange-1"


def test_cards_take_the_finest_grain_and_keep_invariants(spark):
    rows = [(f"{i}", "c", "Hublot", "542.NX.7170.LR" if i < 12 else f"542.NX.{1000 + i}.XX", "Fusion", "2026-06-01", 6000 + i) for i in range(30)] + [(f"m{i}", "c", "Rolex", None, "Explorer", "2026-06-01", 7000) for i in range(11)] + [("t", "c", "Rolex", "900", None, "2026-06-01", 1)]
    g = cards.with_grain(spark.createDataFrame(rows, "id string, channel string, brand string, ref string, model string, date string, price int"), "2026-06-20")
    made = cards.cards(g, "2026-06-20")
    got = {(r.card_key, r.grain): (r.n_recent, r.confidence) for r in made.collect()}
    assert got == {("542.NX.7170.LR", "reference"): (12, "limited"), ("542.NX", "family"): (18, "limited"), ("Explorer", "model"): (11, "limited")}
    assert checks.broken_cards(made).count() == 0


def test_numbers(spark):
    r = spark.range(1).select(
        numbers.array_median(F.array(F.lit(1), F.lit(4), F.lit(2), F.lit(3))).alias("m"), 
        numbers.floor_days(F.lit(dt.datetime(2026, 1, 2, 12)), F.lit(dt.datetime(2026, 1, 2))).alias("f"), numbers.calendar_days(F.lit("2026-01-01"), F.lit("x")).alias("c"),
        numbers.view_count(F.lit("1.2K")).alias("v"), numbers.view_count(F.lit("3M")).alias("w"), numbers.view_count(F.lit("1.2K"), True).alias("x"),
    ).first()
    assert tuple(r) == (2.5, -1, 0, 1200, 3_000_000, 12000)
    for n in range(0, 14):
        values = sorted(7 * i % 13 for i in range(n))
        got = spark.createDataFrame([(v,) for v in values[::-1]], "v int").agg(*numbers.distribution_of("v")).first()
        assert tuple(got) == (n, *[values[n * k // 4] if n else None for k in (2, 1, 3)])


REPLY = """<div class="tgme_widget_message_wrap"><div class="tgme_widget_message" data-post="c/500"><a class="tgme_widget_message_reply" href="https://t.me/c/412"><div class="tgme_widget_message_text js-message_reply_text">quoted 126610LN</div></a>
<div class="tgme_widget_message_text">SOLD!<br>Thanks</div><span class="tgme_widget_message_views">1.2K</span><a class="tgme_widget_message_photo_wrap"></a><time datetime="2026-08-01T10:00:00+00:00"></time></div></div>
<div class="tgme_widget_message_wrap"><div class="tgme_widget_message" data-post="broken"></div></div><div class="tgme_widget_message_wrap"><div class="tgme_widget_message" data-post="c/501"><div class="tgme_widget_message_text">plain &amp; simple</div></div></div>"""


def test_pages(spark):
    got = [tuple(r) for r in pages.parse_messages(spark.createDataFrame([("c", REPLY), ("d", None)], "channel string, html string")).collect()]
    assert got == [("c", 500, "2026-08-01T10:00:00+00:00", "SOLD!\nThanks", 1, 1200, 412), ("c", 501, None, "plain & simple", 0, None, None)]
    fetch = lambda c, before: None if c == "gone" else f'<a data-before="{before - 1}">' if before else '<a data-before="3">'
    assert pages.read_channel_pages(fetch, spark.createDataFrame([("c",), ("gone",)], "channel string"), 5).count() == 5
    links = spark.createDataFrame([("a", "ok"), ("b", "short"), ("c", "err")], "id string, url string")

    def check(url):
        if url == "err":
            raise OSError
        return 200, "tgme_widget_message" + "x" * (6000 if url == "ok" else 1)

    assert {r.id: r.alive for r in pages.probe_links(links, check).collect()} == {"a": True, "b": False, "c": True}


def test_only_terminated_references_of_a_page_are_read(spark):
    html = ['<title>a &lt;b&gt; &amp; c &amp</title><p>x<a href="/u?a=1&copy=2">l</a>', "<title>&amp;lt; &#65; &amp;&ampx; &nosuch; R&D</title>", None]
    got = [tuple(r) for r in pages.parse_pages(spark.createDataFrame(list(enumerate(html)), "page_id bigint, html string")).orderBy("page_id").collect()]
    assert got == [(0, "a <b> & c &amp", ["/u?a=1&copy=2"], 1), (1, "&lt; A &&ampx; &nosuch; R&D", [], 0), (2, None, [], 0)]


def test_upsert_sequence(spark):
    batch = lambda text, views, reply: spark.createDataFrame([("c", 1, "2026-01-01", text, 0, views, reply), ("c", 2, None, "x", 0, 0, None)], "channel string, message_id bigint, posted_at string, message_text string, photos_count int, views bigint, reply_to bigint")
    held, told = spark.createDataFrame([], messages.SCHEMA), []
    for now, args in enumerate([("a", 1, None), ("a", 1, None), ("b", 1, None), ("b", 9, 7), ("b", 9, None)]):
        done = messages.upserted(held, batch(*args), str(now))
        told.append(tuple(messages.upsert_counts(done).first()))
        held = spark.createDataFrame(done.drop("action").collect(), messages.SCHEMA)
    assert told == [(1, 0), (0, 0), (0, 1), (0, 1), (0, 0)]
    r = held.first()
    assert (held.count(), r.edit_count, r.text_updated_at, r.reply_to, r.views, r.first_seen_at) == (1, 1, "2", 7, 9, "0")


def test_migrate_and_store(spark, tmp_path):
    old = spark.createDataFrame([("c", 1, "2026-01-05T00:00", "s")], "channel string, message_id bigint, posted_at string, scraped_at string")
    new = messages.migrate(old)
    assert set(messages.SCHEMA.names) <= set(new.columns) and new.first().first_seen_at == "s" and new.first().edit_count == 0
    messages.write(new.unionByName(new.withColumn("posted_at", F.lit("2026-02-05T00:00"))), str(tmp_path / "m"))
    got = messages.scan(spark, str(tmp_path / "m"), ["channel", "posted_at"], since="2026-02-01")
    assert got.count() == 1 and "PartitionFilters: [isnotnull(month" in got._jdf.queryExecution().executedPlan().toString()


def test_merge_stream(spark, tmp_path):
    kinds = "channel string, message_id bigint, posted_at string, message_text string, photos_count int, views bigint, reply_to bigint"
    for n, text in enumerate(["a", "b"]):
        spark.createDataFrame([("c", 1, "2026-01-01", text, 0, 1, None), ("c", 10 + n, "2026-01-01", "x", 0, 1, None)], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.merge_stream(ingest.landed(spark, str(tmp_path / "in"), kinds), str(tmp_path / "store"), str(tmp_path / "cp"), f"run {n}").awaitTermination()
    got = {r.message_id: (r.message_text, r.edit_count) for r in ingest.current(spark, str(tmp_path / "store")).collect()}
    assert got == {1: ("b", 1), 10: ("x", 0), 11: ("x", 0)}


def test_feed(spark):
    rows = [("1", "Rolex", "Sub", "126610.X", "n", 900, "2026-01-01", "fine"), ("2", "rolex", "Date", "126610", "p", 50, "2026-01-01", "SOLD"), ("3", "Tudor", None, None, "n", 900, "2026-01-01", "ok")]
    df = spark.createDataFrame(rows, "id string, brand string, model string, ref string, cond string, price int, date string, text string")
    assert [r.id for r in feed.cleaned(df).orderBy("id").collect()] == ["1", "3"]
    assert [r.id for r in feed.filtered(df, brand="ROLEX", ref="126610").orderBy("id").collect()] == ["1", "2"]
    assert [r.id for r in feed.filtered(df, model="su").collect()] == ["1"]
    assert [r.id for r in feed.page(df, "cheapest", 1).collect()] == ["2"]
    assert feed.first_of_each(df).count() == 3


def test_drift(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    assert [tuple(r) for r in checks.drift(a, b, ["k"]).collect()] == [(2, "v", "y", None), (3, "v", None, "z")]
    assert checks.contract(a, {"k": "int", "v": "int", "w": "int"}) == ["v: string instead of int", "w: absent instead of int"]


def test_config_is_the_one_place():
    assert Config(window_dates=7).window_dates == 7


def test_unit_sizes_are_those_of_the_assigned_units(spark):
    rows = [("A", "r1", "m")] * 8 + [("A", "r2", "m")] * 2 + [("A", None, "m")] + [("B", "r1", "n")] * 5 + [("B", "r1", "o")] * 3 + [("C", None, None)] * 4 + [("C", "r9", None), ("C", None, "q")]
    own = spark.createDataFrame(rows, "brand string, ref string, model string")
    want = own.transform(units.assign_units).groupBy(*units.UNIT).count().collect()
    assert sorted(map(tuple, units.unit_sizes(own).collect())) == sorted(map(tuple, want)) == [("brand", "C", "", 6), ("model", "A", "m", 3), ("ref", "A", "r1", 8), ("ref", "B", "r1", 8)]
    plan = units.assign_units(own)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_groups_without_a_pool_of_enough_prices_are_told_apart():
    rng = np.random.default_rng(3)
    for width, least in ((21, 3), (5, 2), (1, 1), (3, 4)):
        groups = [(np.sort(rng.choice(60, size, replace=False)), rng.integers(1, 3, size)) for size in rng.integers(1, 9, 80)]
        date, n = (np.concatenate([g[j] for g in groups]) for j in range(2))
        starts = np.concatenate([[0], np.cumsum([len(g[0]) for g in groups])])[:-1]
        want = [len(pools.rolling(d, d.astype(float), k, 0, 60 + width, width, least)[0]) > 0 for d, k in groups]
        assert pools.filled(date, n, starts, width, least).tolist() == want


def test_grain_counts_each_key_from_the_listings_alone(spark):
    own = spark.createDataFrame([("1", "A", "r-1", "m", "2001-11-01", 900)], "id string, brand string, ref string, model string, date string, price int")
    plan = cards.with_grain(own, "2001-11-04", family=F.substring_index("ref", "-", 1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 4 and plan.count("strategy=broadcast") == 3


def test_cards_sort_recent_prices_alone(spark):
    own = spark.createDataFrame([("A", "r", "reference", i < 12, 100 + i, "2001-11-01", str(i % 3), "r") for i in range(20)] + [(None, "r", "reference", True, 7, "2001-11-01", "c", None)] * 10, "brand string, card_key string, grain string, recent boolean, price int, date string, channel string, ref string")
    made = cards.cards(own, "2001-11-04")
    assert sorted((r.brand or "", r.n_recent, r.n_total, r.median, r.fair_low, r.fair_high, r.low, r.high, r.channels) for r in made.collect()) == [("", 10, 10, 7, 7, 7, 7, 7, 1), ("A", 12, 20, 105, 103, 109, 100, 111, 3)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any("percentile" in line and "channel" in line for line in plan.splitlines() if "Aggregate" in line)

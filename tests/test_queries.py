import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from askbook.plans import catalog, path, posts, wording

SF = "/root/testdata/sf0.001"
CHEAP = ["brand_level", "unit_assignment", "baseline_median", "rolling_model_median", "composite", "availability", "dedupe_survivors", "dup_summary", "ref_cards", "time_to_sell", "feed_distinct", "classify_reasons", "batch_split", "upsert", "drift", "posts_to_prices", "live_feed", "channel_messages", "signals_line", "set_differences", "high_water", "card_invariants", "index_alerts", "page_parse", "insight", *wording.SPARK]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CHEAP)
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    told = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in told.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.SQL) == set(catalog.SPARK) and set(path.SQL) == set(path.SPARK) and set(posts.SQL) == set(posts.SPARK) and set(wording.SQL) == set(wording.SPARK)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0

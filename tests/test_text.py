import random

import pytest
from pyspark.sql import functions as F

from askbook.functions import rules as R
from askbook.functions import text as X
from askbook.plans import posts, wording


def run(spark, rows, make, plain=False):
    """What make(column) gives for each text."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    if plain:
        df = df.withColumn("plain", X.nfkc(F.col("text")))
    return [r.v for r in df.withColumn("v", make(F.col("plain" if plain else "text"))).orderBy("i").collect()]


def check(spark, cases, make, plain=False):
    assert dict(zip([c[0] for c in cases], run(spark, [c[0] for c in cases], make, plain))) == dict(cases)


def test_reasons(spark):
    cases = [
        ("Rolex Submariner 126610LN Price: SGD $16,800 BNIB full set", None),
        ("Mint Rolex Daytona Oysterflex 126515LN\nPrice: $57,800\nCase Diameter: 40mm", None),
        ("New Hublot Classic Fusion Strap 542.NX.7170.LR\nPrice: $6,700\nCase Diameter: 45mm", None),
        ("Rolex Datejust 41\nCase size : 41mm\nPriced at\n💲\n22300\nHSBC installment payment plan, 24 months", None),
        ("Rolex Lady Datejust 179160\nPrice: SGD $8,500\nShop at watchdistrict.store", None),
        ("Rolex 'Fluted' cufflinks\nPrice: $4,500", "noise_pattern"), ("Omega Seamaster, SOLD, $4,500", "noise_pattern"), ("Price on request: Rolex", "noise_pattern"),
        ("Crystal Only Patek Philippe Price: $500 Case Diameter: 20mm", "accessory_no_anatomy"), ("Rolex Desk Clock\nPrice: $17,950\nCase Diameter: 80mm", "accessory_no_anatomy"),
        ("Crystal replacement for a quartz chronograph, $300 Tudor", None),
        ("Rolex Submariner RM53,800", "not_singapore"), ("Rolex Submariner 🇲🇾 Price 88,800", "not_singapore"), ("Rolex in Johor", "not_singapore"), ("Rolex USD $14,400", "not_singapore"),
        ("", "empty"), (None, "empty"), (" \n\t", "empty"), ("interest free payment plan", "empty_after_noise_strip"), ("What a lovely day, $500", "no_brand_or_terms"), ("Rolex Submariner, come and see", "no_price"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
    got = [r.reason for r in X.with_reason(df).orderBy("i").collect()]
    assert [(c[0], g) for c, g in zip(cases, got)] == cases


def test_price(spark):
    check(spark, [
        ("SGD $17,950", 17950), ("Price: $8,700", 8700), ("$16.8k", 16800), ("16,800/-", 16800), ("Only SGD$500/month", None), ("Prices are subject to change", None),
        ("Priced at\n💲\n22300", 22300), ("• Model : 126331\n• Case size : 41mm", None), ("Rolex Daytona $13x,800", None), ("price-increase-2025-confirmed", None), ("SGD $2,025", 2025),
        ("https://x.com/news/rolex-price-2026-daytona/", None), ("RRP: $15,000 selling price: $12,000", 12000), ("$30 then SGD $9,000", 9000), ("$100 off everything, $5,000", None),
        ("Priced at 2️⃣2️⃣3️⃣0️⃣0️⃣", 22300), ("$9,000,000,000", None), ("", None), (None, None), ("Price: $12,500.50", 12500),
    ], X.price)


def test_brand(spark):
    check(spark, [
        ("𝐑𝐨𝐥𝐞𝐱 𝐃𝐚𝐲𝐭𝐨𝐧𝐚", "Rolex"), ("Rolex Daytona, as a Vacheron Constantin Overseas", "Rolex"), ("Grand Seiko Heritage", "Grand Seiko"), ("F.P. Journe Chronometre", "FP Journe"), ("GLASHÜTTE original", "Glashutte Original"),
        ("Jacob & Co. Epic X", "Jacob & Co"), ("Carl F. Bucherer", "Carl F. Bucherer"), ("AP Royal Oak", "Audemars Piguet"), ("snap it up", None), ("RM 011 Felipe", "Richard Mille"), ("Price RM14x,800", None), ("RM53,800", None),
        ("jaeger   lecoultre", "Jaeger-LeCoultre"), ("authorised dealer", "Oris"), ("", None), (None, None),
    ], X.brand, plain=True)


@pytest.mark.parametrize("text,brand,model,ref", [
    ("Omega Speedmaster Moonwatch 310.32.42.50.02.001 $9,900", "Omega", "Speedmaster", "310.32.42.50.02.001"), ("Cartier Santos WSSA0062 $8,900", "Cartier", "Santos", "WSSA0062"), ("IWC Portugieser IW371604", "IWC", "Portugieser", "IW371604"),
    ("Hublot Big Bang 411.NM.1170.RX", "Hublot", "Big Bang", "411.NM.1170.RX"), ("Audemars Piguet Royal Oak 15510ST.OO.1320ST.06", "Audemars Piguet", "Royal Oak", "15510ST.OO.1320ST.06"), ("Panerai Luminor Pam 104 $7,500", "Panerai", "Luminor", "PAM00104"),
    ("Rolex GMT Master II 126710BLNR $23,400", "Rolex", "GMT Master", "126710BLNR"), ("Rolex 126334 without a line", "Rolex", None, None), ("Cartier Santos Large $8,900", "Cartier", "Santos", None), ("Seiko ref 6105", "Seiko", None, "6105"), ("Seiko 6105", "Seiko", None, None), ("Seiko 2024 ref", "Seiko", None, None),
])
def test_model_and_ref(spark, text, brand, model, ref):
    got = run(spark, [text], lambda t: X.model_and_ref(t, F.lit(brand)))[0]
    assert (got.model, got.ref) == (model, ref)


def test_condition(spark):
    check(spark, [("Rolex BNIB", "n"), ("LNIB May 2025", "n"), ("brand new, full set", "n"), ("box and papers", "p"), ("Papers and box", "p"), ("Rolex full set", "p"), ("Datejust", "u")], X.condition, plain=True)


def test_attributes(spark):
    text = "New Jun 2026 Hublot Classic Fusion Strap\nBlue Dial\nOur Ref: Z25924\nCase Diameter: 42mm\nMaterial: Titanium\nOriginal Box: Yes\nOriginal Cert/Papers: Yes"
    a, b, c, d, e = run(spark, [text, "Rolex steel & rose gold, watch only, root beer", "Ploprof 1200M, 55mm, warranty till 2027", "Rolex $17,700", "year 1850 (Mar 1999) oyster perpetual on jubilee"], X.attributes, plain=True)
    assert a.asDict() == {"case_size_mm": 42, "case_material": "titanium", "bracelet": "strap", "box_papers": "box + papers", "warranty": None, "year": 2026, "dial_nickname": None, "dial_colour": "blue", "stock_code": "Z25924"}
    assert (b.case_material, b.box_papers, b.dial_nickname) == ("two-tone", "watch only", "Root Beer")
    assert (c.case_size_mm, c.warranty) == (55, "2027")
    assert not any(d.asDict().values())
    assert (e.year, e.bracelet) == (1999, "jubilee")


def test_batch_and_title(spark):
    post = "[WATCH DEALS]\n✅\n(AVAILABLE)\n✅\n(1) Rolex Submariner\n126610LN\n❌\nSOLD\n❌\n(2) Tudor\n✅(AVAILABLE)✅ (3) Omega  \n"
    got = run(spark, [post, "Rolex ✅ (AVAILABLE) ✅ (1) x", None], X.batch_items)
    assert [tuple(x) for x in got[0]] == [(1, True, "Rolex Submariner\n126610LN"), (2, False, "Tudor"), (3, True, "Omega")]
    assert got[1] == got[2] == []
    check(spark, [("🔥 hot\nhttp://x.y\nJoin us now\nhey\n  Rolex Daytona  \nmore", "Rolex Daytona"), ("abc", "abc"), ("", ""), (None, ""), ("x" * 200, "x" * 120)], X.title)


def test_a_text_is_made_once_for_all_patterns(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    own = spark.createDataFrame([("Rolex Submariner, Price: $9,000",)], "text string")
    assert plan(own.select(X.price(F.col("text")).alias("p"))).count("https?://") == 1
    assert plan(own.select(X.brand(F.col("text")).alias("b"))).count("[-\\s]+") == 1
    passed = plan(X.with_reason(own.repartition(3)).where("reason IS NULL"))
    assert passed.index("Filter") < passed.index("Repartition") and passed.count("linktree") == 1


def test_rows_to_read_are_dealt_over_the_cores(spark, tmp_path):
    spark.createDataFrame([(k, 10, 900.0) for k in range(40)], "p_partkey bigint, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("classify_reasons", "rejection_histogram", "post_extraction"):
        assert "Repartition" in posts.SPARK[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert posts.classified(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_brand_is_the_first_and_longest_of_all_names(spark):
    r, spellings = random.Random(12), [(X._normal(v), name) for name, others in R.BRANDS.items() for v in [name, *others]]
    names = [v for v, _ in spellings]
    texts = [*names, *["".join(r.choice([a, a[: r.randrange(len(a) + 1)]]) + r.choice([" ", "", " & co "]) for a in r.choices(names, k=r.randrange(1, 6))) for _ in range(500)]]

    def want(text):
        flat = X._normal(text)
        return min(((flat.find(v), -len(v), name) for v, name in spellings if v in flat), default=(0, 0, None))[2]

    check(spark, [(t, want(t)) for t in texts], X.brand, plain=True)


def test_brand_models_looks_once_for_brands_and_once_for_models(spark, tmp_path):
    spark.createDataFrame([(k, 10) for k in range(40)], "p_partkey bigint, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = wording.brand_models(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert " instr(" not in plan  # brands: no search of its own for each spelling
    assert plan.count("Submariner|") == 1 and R.REF_EXACT not in plan  # models: not made anew for a null check, and no references

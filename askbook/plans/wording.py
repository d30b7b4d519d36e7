"""Queries that meet every fixed word of the rules: each brand and its spellings, each model, each noise pattern, each attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askbook.functions import rules as R
from askbook.functions import text
from askbook.sources.adapters import dealt, table

#: Each way to write a brand, and the brand.
SPELLINGS = [(v, name) for name, others in R.BRANDS.items() for v in [name, *others]] + [("AP", "Audemars Piguet"), ("JLC", "Jaeger-LeCoultre"), ("GS", "Grand Seiko"), ("RM 35-02", "Richard Mille")]
#: Each model, and its brand.
MODELS = [(m.replace(".", " "), name) for name, pattern in R.MODELS.items() for m in pattern[len("(?:") : pattern.index(")")].split("|")]
#: A message for each noise pattern, in their order, and one that is a listing.
NOISE = [
    "Seiko giveaway, worth $500", "Flash sale!", "Thank you all for your support, Seiko $500", "Follow us!", "Seiko $500, opening hours ten to six", "Daily update!", "Seiko $500 from our service centre", "Seiko travel case $500",
    "Rubber strap, fits Seiko, $50", "https://vt.tiktok.com/abc", "Seiko $500 or price on request", "Seiko $500 SOLD", "Seiko $500 with watch protective film", "Seiko $500, best price", "Seiko 42mm $500",
]
SETS = [("complete set", "full set"), ("watch only", "watch only"), ("papers here, its box there", "box + papers"), ("with box", "box only"), ("with papers", "papers only"), ("as shown", None)]
COLOURS = ["black", "white", "blue", "green", "silver", "champagne", "salmon", "grey", "brown", "slate", "olive"]


def _sql(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _of(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size")))


def brand_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("For sale: "), _of([v for v, _ in SPELLINGS], F.col("id")), F.lit(" with date"))
    return _parts(spark, sf_dir).withColumn("plain", text.nfkc(made)).select("id", text.brand(F.col("plain")).alias("brand"))


def brand_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(_of([name for _, name in MODELS], F.col("id")), F.lit(" "), _of([m for m, _ in MODELS], F.col("id")), F.lit(" for sale"))
    told = _parts(spark, sf_dir).withColumn("text", made).withColumn("brand", text.brand(F.col("text")))
    return told.select("id", "brand", text.model(F.col("text"), F.col("brand")).alias("model"))


def noise_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).withColumn("text", _of(NOISE, F.col("id"))).transform(text.with_reason).select("id", "reason")


def post_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    bracelet = F.regexp_replace(_of([b for b, _ in R.BRACELETS], k), "^integrated$", "integrated bracelet")
    made = F.concat_ws(
        "\n", F.concat(F.col("p_size") % 30 + 25, F.lit("mm")), _of([m for m, _ in R.MATERIALS], k), bracelet, _of([s for s, _ in SETS], k), F.concat(F.lit("warranty ends "), k % 10 + 2024), F.concat(F.lit("Year: "), k % 90 + 1935),
        F.lower(_of(R.NICKNAMES[:10], k)), F.concat(_of(COLOURS, k), F.lit(" dial")), F.concat(F.lit("Stock code: ab"), k % 9000 + 1000),
    )
    return _parts(spark, sf_dir).withColumn("text", made).select("id", text.attributes(F.col("text")).alias("a")).select("id", "a.*")


def _pick(values: list[str | None]) -> str:
    return f"({_sql(values)})[p_partkey % {len(values)} + 1]"


SPARK = {"brand_spellings": brand_spellings, "brand_models": brand_models, "noise_patterns": noise_patterns, "post_attributes": post_attributes}

SQL = {
    "brand_spellings": f"SELECT p_partkey AS id, {_pick([name for _, name in SPELLINGS])} AS brand FROM part",
    "brand_models": f"SELECT p_partkey AS id, {_pick([name for _, name in MODELS])} AS brand, {_pick([m for m, _ in MODELS])} AS model FROM part",
    "noise_patterns": f"SELECT p_partkey AS id, CASE WHEN p_partkey % {len(NOISE)} < {len(R.MESSAGE_NOISE)} THEN 'noise_pattern' END AS reason FROM part",
    "post_attributes": f"""SELECT p_partkey AS id, CAST(p_size % 30 + 25 AS INT) AS case_size_mm, {_pick([m for m, _ in R.MATERIALS])} AS case_material, {_pick([b for b, _ in R.BRACELETS])} AS bracelet, {_pick([s for _, s in SETS])} AS box_papers,
  CAST(p_partkey % 10 + 2024 AS VARCHAR) AS warranty, CAST(p_partkey % 90 + 1935 AS INT) AS year, {_pick(R.NICKNAMES[:10])} AS dial_nickname, {_pick(COLOURS)} AS dial_colour, 'AB' || (p_partkey % 9000 + 1000) AS stock_code FROM part""",
}

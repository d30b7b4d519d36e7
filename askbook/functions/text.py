"""What a post says, as Column expressions: class, price, condition, brand, model, reference, attributes, title."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askbook.functions import rules as R


def nfkc(text: Column) -> Column:
    """Compatibility forms folded. Spark has no function for it; of text of ASCII alone no more than a null is sent to Python.

    As a Python function it cannot stand inside the expressions below, which take folded text as `plain`. It is sent by value
    and needs nothing but the standard library, so workers don't need this package for it. Spark takes it for not deterministic, so that
    a filter on what is read from the text isn't moved below it, where each mention of the text would be made anew.
    """

    def fold(t: pd.Series) -> pd.Series:
        return t.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return F.coalesce(F.pandas_udf(fold, "string").asNondeterministic()(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with the value made once for a row: written out, each mention of it in conditions and lambdas would make it anew."""
    return F.transform(F.array(value), make)[0]


def _java(pattern: str) -> str:
    return "(?Uid)" + pattern


def found(text: Column, pattern: str) -> Column:
    return text.rlike(_java(pattern))


def any_found(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [found(text, p) for p in patterns])


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group in the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, _java(pattern), group), F.lit(""))


def first_label(text: Column, table: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(found(text, p), name) for name, p in table])


def keycaps(text: Column) -> Column:
    return F.regexp_replace(text, r"([0-9])\x{FE0F}?\x{20E3}", "$1")


def currency_sign(text: Column) -> Column:
    return F.replace(text, F.lit("\U0001f4b2"), F.lit("$"))


def without_noise_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~any_found(line, R.LINE_NOISE)), "\n")


def home_market(text: Column, plain: Column) -> Column:
    """Whether an item can be bought on the home market; text that says nothing can."""
    return F.coalesce(~(text.contains(R.FOREIGN_FLAG) | any_found(plain, R.HOME_EXCLUDED) | found(plain, R.FOREIGN_CURRENCY)), F.lit(True))


def _normal(name: str) -> str:
    return re.sub(r"[-\s]+", " ", unicodedata.normalize("NFKC", name).lower().replace(".", "")).strip()


def normal_brand(plain: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(plain), F.lit("."), F.lit("")), r"(?U)[-\s]+", " "))


def _trie(words: set[str]) -> str:
    """A pattern that finds of the words the one that begins first (the longest on ties), by one look at each place of a text."""
    after = {c: _trie({w[1:] for w in words if w[:1] == c}) for c in sorted({w[0] for w in words if w})}
    parts = [re.escape(c) + rest for c, rest in after.items()] + [""] * ("" in words)
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def brand(plain: Column) -> Column:
    """The brand named first (the longest name on ties), by full names anywhere in the text, else by abbreviations."""
    names = {_normal(v): name for name, others in R.BRANDS.items() for v in [name, *others]}
    full = F.regexp_extract(normal_brand(plain), _trie(set(names)), 0)
    short = lambda p: F.array(*[F.struct(F.regexp_instr(p, F.lit("(?U)" + s)).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (s, name) in enumerate(R.SHORT_BRANDS_EXACT)])
    least = lambda hits: F.array_min(F.filter(hits, lambda x: x["at"] > 0))["name"]
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair]), full), once(F.upper(plain), lambda p: least(short(p))))


def says_terms(text: Column) -> Column:
    return any_found(text, R.TERMS)


def says_price(text: Column) -> Column:
    return once(F.translate(currency_sign(text), "\n|", "  "), lambda flat: any_found(flat, [*R.STATED, R.LABELLED_BARE]))


def anatomy_signals(text: Column) -> Column:
    """How many signs of a movement or case there are: a diameter, and each distinct mechanism."""
    mechanisms = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_java(R.MECHANISM)), F.lit(1)), F.lower))
    return found(text, R.CASE_DIAMETER).cast("int") + F.size(mechanisms)


def with_reason(posts: DataFrame, text: str = "text", out: str = "reason") -> DataFrame:
    """The posts with the reason why each is no listing, null if it is one; the first check that fails tells."""
    t = keycaps(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    told = posts.withColumn("_t", t).withColumn("_kept", without_noise_lines(F.col("_t")))
    told = told.withColumns({"_plain": nfkc(F.col("_t")), "_named": nfkc(F.col("_kept"))})
    return told.withColumn(out, _reason(F.col(text), F.col("_t"), F.col("_plain"), F.col("_kept"), F.col("_named"))).drop("_t", "_kept", "_plain", "_named")


def _reason(text: Column, t: Column, plain: Column, kept: Column, named: Column) -> Column:
    return (
        F.when(text.isNull() | ~text.rlike(r"(?U)\S"), "empty")
        .when(~home_market(t, plain), "not_singapore")
        .when(~kept.rlike(r"(?U)\S"), "empty_after_noise_strip")
        .when(any_found(kept, R.MESSAGE_NOISE), "noise_pattern")
        .when(found(kept, R.ACCESSORY) & (anatomy_signals(kept) < 2), "accessory_no_anatomy")
        .when(brand(named).isNull() & ~says_terms(kept), "no_brand_or_terms")
        .when(~says_price(kept), "no_price")
    )


def price(text: Column) -> Column:
    """The asking price, null if none is told. Each pattern counts by its first match alone; what lies out of bounds leaves it to the next."""
    lines = keycaps(currency_sign(without_noise_lines(F.regexp_replace(text, r"(?U)https?://\S+", " "))))
    return once(lines, lambda own: once(_flat(own), lambda flat: _price(own, flat)))


def _flat(lines: Column) -> Column:
    flat = F.replace(F.replace(lines, F.lit("\n"), F.lit(" ")), F.lit("\\n"), F.lit(" "))
    return F.regexp_replace(flat, _java(R.RETAIL), " ")


def _price(lines: Column, flat: Column) -> Column:
    def number(source: Column, pattern: str, factor: int = 1, low: int = 50) -> Column:
        n = F.replace(first(source, pattern), F.lit(","), F.lit("")).try_cast("double") * factor
        return once(n, lambda x: F.when(x.between(low, 5_000_000), x.cast("int")))

    bare = once(number(lines, R.LABELLED_BARE, low=500), lambda n: F.when(~(n.between(1990, 2035) & ~found(lines, R.CURRENCY_MARK)), n))
    told = F.coalesce(*[number(flat, p) for p in R.PRICES], number(flat, R.THOUSANDS, 1000), bare, number(flat, R.DASHED))
    return F.when(~(found(flat, R.MASKED) | any_found(flat, R.UNPRICED)), told)


def condition(plain: Column) -> Column:
    return F.when(found(plain, R.NEW), "n").when(found(plain, R.USED), "p").otherwise("u")


def is_junk_ref(ref: Column) -> Column:
    return ref.rlike(r"^\d{3}$")


def _generic_refs(text: Column) -> Column:
    every = F.regexp_extract_all(text, F.lit("(?U)" + R.REF_EXACT), F.lit(1))
    return F.filter(every, lambda r: ~r.rlike(R.YEAR_EXACT) & ~is_junk_ref(r))


def generic_ref(text: Column) -> Column:
    return F.try_element_at(_generic_refs(text), F.lit(1))


def brand_ref(text: Column, named: Column) -> Column:
    """A reference in the brand's own format, written one way."""
    out = F.lit(None).cast("string")
    for name, pattern in R.BRAND_REFS_EXACT.items():
        raw = F.nullif(F.regexp_extract(text, "(?U)" + pattern, 0), F.lit(""))
        digits = F.regexp_replace(raw, r"\D", "")
        if name == "Panerai":
            value = F.concat(F.lit("PAM"), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))
        elif name == "IWC":
            value = F.concat(F.lit("IW"), digits)
        else:
            value = F.upper(F.regexp_replace(raw, r"\s+", ""))
        out = F.when(named == name, value).otherwise(out)
    return out


def model(text: Column, named: Column) -> Column:
    """The first of the brand's models that the text names."""
    raw = reduce(lambda out, x: out.when(named == x[0], F.regexp_extract(text, _java(x[1]), 0)), R.MODELS.items(), F)
    return once(raw, lambda m: F.nullif(m, F.lit("")))


def model_and_ref(text: Column, named: Column) -> Column:
    """struct(model, ref). A brand with models but none of them in the text has neither; others have a reference by format."""
    dotted = F.filter(_generic_refs(text), lambda r: r.contains(".") | found(text, r"\b(ref|model)\b"))
    none = F.struct(F.lit(None).cast("string").alias("model"), F.try_element_at(dotted, F.lit(1)).alias("ref"))
    told = lambda m: F.struct(m.alias("model"), F.when(m.isNotNull(), F.coalesce(brand_ref(text, named), generic_ref(text))).alias("ref"))
    return F.when(named.isin(*R.MODELS), once(model(text, named), told)).otherwise(none)


def attributes(t: Column) -> Column:
    """What is stated beside price and model; null is "not stated"."""
    box, papers = found(t, R.BOX), found(t, R.PAPERS)
    sets = F.when(found(t, R.FULL_SET), "full set").when(found(t, R.WATCH_ONLY), "watch only").when(box & papers, "box + papers").when(box, "box only").when(papers, "papers only")
    warranty = F.coalesce(*[first(t, p) for p in R.WARRANTY_DATES], F.when(found(t, R.UNDER_WARRANTY), "stated"))
    years = [first(t, p).try_cast("int") for p in R.YEARS]
    nick = first(t, r"\b(" + "|".join(map(re.escape, R.NICKNAMES)) + r")\b")
    return F.struct(
        first(t, R.CASE_SIZE).try_cast("int").alias("case_size_mm"), first_label(t, R.MATERIALS).alias("case_material"), first_label(t, R.BRACELETS).alias("bracelet"), sets.alias("box_papers"),
        warranty.alias("warranty"), F.coalesce(*[F.when(y.between(1900, 2035), y) for y in years]).alias("year"), F.initcap(nick).alias("dial_nickname"), F.lower(first(t, R.DIAL_COLOUR)).alias("dial_colour"),
        F.upper(first(t, R.STOCK_CODE)).alias("stock_code"),
    )


def batch_items(text: Column) -> Column:
    """array of struct(item_number, available, body) of a post that lists several items; empty for others."""
    part = lambda g: F.regexp_extract_all(text, F.lit(R.BATCH_ITEM_EXACT), F.lit(g))
    items = F.arrays_zip(part(1).alias("status"), part(2).alias("number"), part(3).alias("body"))
    made = F.transform(items, lambda x: F.struct(x["number"].cast("int").alias("item_number"), x["status"].contains("AVAILABLE").alias("available"), F.regexp_replace(x["body"], r"(?U)^\s+|\s+$", "").alias("body")))
    return F.when(found(text, R.BATCH_HEAD), made).otherwise(F.expr("cast(array() as array<struct<item_number:int,available:boolean,body:string>>)"))


def with_listing(posts: DataFrame, text: str = "text") -> DataFrame:
    """The posts with brand, model, ref, price, cond, attributes and title."""
    told = posts.withColumn("_plain", nfkc(F.col(text))).withColumn("brand", brand(F.col("_plain"))).withColumn("_m", model_and_ref(F.col(text), F.col("brand")))
    told = told.withColumn("model", F.col("_m.model")).withColumn("ref", F.col("_m.ref")).withColumn("price", price(F.col(text))).withColumn("cond", condition(F.coalesce("_plain", F.lit(""))))
    return told.withColumn("attributes", attributes(F.col("_plain"))).withColumn("title", title(F.col(text))).drop("_plain", "_m")


def listing_key(channel: Column, message: Column, item: Column | None = None) -> Column:
    return F.concat_ws("-", channel, message, *([item] if item is not None else []))


def title(text: Column, size: int = 120) -> Column:
    """The first line that says something, cut to size; the first line at all if none does."""
    lines = F.transform(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    good = F.filter(lines, lambda x: (F.length(x) >= 5) & ~any_found(x, R.TITLE_SKIPPED))
    return F.coalesce(F.substring(F.coalesce(F.try_element_at(good, F.lit(1)), F.try_element_at(lines, F.lit(1))), 1, size), F.lit(""))

"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Toxic documents go; lines that recur across documents go; one document of each group
of near-duplicates stays (the one with the smallest doc_id, and of rows that share it the one with the least fingerprint, then the
least text, so rows of one doc_id with unlike texts stay each; a row without a doc_id stays if it is so the first of a group in which no row has one);
personal data and secrets get surrogates, under the key of spark.askbook.piiKey where that is set; what is left is packed into sequences. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askbook.llm import line_dedup, packing, pii, simhash, toxicity
from askbook.llm._util import checkpointed, free_name
from askbook.llm.queries import PII_KEY, table, tokenizer


def _as_documents(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, n_chars counted anew where the text isn't null."""
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(line_dedup.line_dedup(docs), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = simhash.components(docs)
    # component_id is null where no row of a component has an id.
    stay = told.where("doc_id <=> component_id").groupBy("component").agg(F.min(F.struct("doc_id", F.col("fp").alias("fp"))).alias("one")).select("one.*")
    # Keys without nulls, so that the rows that stay are dealt out once, for the join and for the choice among equals.
    fp, at, none = (free_name(docs.columns, n) for n in ("fp", "at_id", "no_id"))
    keys = [F.coalesce("doc_id", F.lit(0)).cast("bigint").alias(at), F.col("doc_id").isNull().alias(none)]
    named = simhash.with_fingerprint(docs, fp).select("*", *keys).join(stay.select(*keys, F.col("fp").alias(fp)), [at, none, fp], "left_semi")
    return named.groupBy(at, none, fp).agg(F.min_by(F.struct(*docs.columns), F.struct("text")).alias("one")).select("one.*")


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(pii.pseudonymise(docs, (spark.conf.get("spark.askbook.piiKey", None) or PII_KEY.decode()).encode()), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", one_of_each), ("pii", replace_personal), ("packing", pack)]

#: SQL cannot express the classifier, the fingerprints, the surrogates or the packing; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

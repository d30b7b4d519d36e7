"""Near-duplicates by 64-bit SimHash, found with deletion-variant signatures.

A fingerprint has 64 bits; links join those that differ in at most three. Cut in two segments of 32
bits, one of the segments of a linked pair differs in at most one bit. So each distinct fingerprint
is indexed under 64 one-wildcard variants (a segment with one bit deleted), an equality on the
variant brings every linked pair together, and the full 64 bits verify it.

Variants held by two fingerprints give their pair from the group's minimum and maximum alone.
Variants held by up to `bucket` fingerprints become one row and are joined by a spanning forest,
never by all pairs. Larger ones are cut again: the other segment into two of 16 bits, and if need
be the rest into two of 8, with one wildcard each, after which a bucket cannot hold more than 2**11
fingerprints. No link is lost at any step.

Equal fingerprints meet once, as a class: copies are never compared. Null and empty texts have
fingerprint zero and link like any other. Rows with a null doc_id take part but name no component
unless no other row of it has an id (then component_id is null). Input columns named fingerprint
or component_id are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askbook.llm._util import checkpointed, map_rows, replaced, slices, with_fields
from askbook.llm.components import connected_components

MAX_BITS = 3
#: Fingerprints to a task that makes their variants.
FAN_OUT = 1 << 16
#: The bits set in each value of a byte, least significant first.
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
BYTE_AT = np.arange(8) * 256


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits set in over half of the hashes of the text's word shingles (XXH64, seed 42)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, 42)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())], np.uint64)
    held = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + BYTE_AT).ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    return int.from_bytes(np.packbits(held.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return map_rows(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, "doc_id bigint, fp bigint")


def _bits_apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _variants(distinct: DataFrame) -> DataFrame:
    """key, seg_bit (the deleted bit's place among the 64) and fp: 64 rows for each fingerprint."""
    v = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("seg_bit"))
    masked = F.expr("shiftrightunsigned(fp, if(seg_bit >= 32, 32, 0)) & 4294967295L & ~shiftleft(1L, seg_bit % 32)")
    return v.select("fp", "seg_bit", (F.expr("shiftleft(cast(seg_bit as bigint), 32)").bitwiseOR(masked)).alias("key"))


def _forest(buckets: DataFrame) -> DataFrame:
    """Links a, b that join what is joined within each row's array of fingerprints, fewer than its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            left, right = [], []
            for fps in b.column(0).to_pylist():
                rest = np.unique(np.array(fps, np.int64)).view(np.uint64)
                while len(rest) > 1:
                    todo, rest = [rest[-1]], rest[:-1]
                    while todo and len(rest):
                        x = todo.pop()
                        near = np.bitwise_count(rest ^ x) <= MAX_BITS
                        if near.any():
                            found = rest[near]
                            todo.extend(found)
                            left.append(np.full(len(found), x))
                            right.append(found)
                            rest = rest[~near]
            pair = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (left, right)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["a", "b"])

    return map_rows(buckets.select("fps"), run, "a bigint, b bigint")


def _cut_again(crowded: DataFrame, width: int) -> DataFrame:
    """Rows key, fp, first (where the 2*width bits that are still free begin) under one-wildcard variants of either half.

    The new key is a hash: a collision only adds candidates, which are verified.
    """
    v = crowded.select("key", "fp", "first", F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))).alias("i"))
    half = F.expr(f"first + if(i >= {width}, {width}, 0)")
    v = v.withColumn("half", half)
    masked = F.expr(f"shiftrightunsigned(fp, half) & {(1 << width) - 1}L & ~shiftleft(1L, i % {width})")
    return v.select(F.xxhash64("key", "i", masked).alias("key"), "fp", F.expr(f"if(half = first, first + {width}, first)").alias("first"))


def links(distinct: DataFrame, bucket: int = 256) -> DataFrame:
    """Links a, b among distinct fingerprints fp: enough of them to join all that are linked, directly or not."""
    # Each row becomes 64: dealt out first, so that a few small files don't make a few large tasks.
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // FAN_OUT))
    variants = _variants(distinct.repartition(tasks))
    stats = variants.groupBy("key").agg(F.first("seg_bit").alias("seg_bit"), F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_or("fp").alias("some"), F.bit_and("fp").alias("every")).where("n > 1")
    # Members that agree in the whole segment meet under each of its bits; the segment's first bit stands for all.
    stats = checkpointed(stats.where("seg_bit % 32 = 0 OR (shiftrightunsigned(some ^ every, seg_bit) & 1L) = 1"))
    pairs = stats.where("n = 2").where(_bits_apart("a", "b") <= MAX_BITS).select("a", "b")
    # Crowded keys grow with the corpus: never broadcast, at any size.
    many = variants.join(stats.where("n > 2").select("key", "n").hint("merge"), "key")
    few = many.where(F.col("n") <= bucket)
    found = pairs.unionByName(_forest(few.groupBy("key").agg(F.collect_list("fp").alias("fps"))))
    if stats.where(F.col("n") > bucket).limit(1).count():
        crowded = many.where(F.col("n") > bucket).select("key", "fp", F.expr("if(seg_bit >= 32, 0, 32)").alias("first"))
        for width in (16, 8):
            finer = checkpointed(_cut_again(crowded, width))
            sizes = finer.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            if width == 16:
                sizes = checkpointed(sizes)
                small = sizes.where(F.col("n") <= bucket)
                crowded = finer.join(sizes.where(F.col("n") > bucket).select("key"), "key")
            else:
                small = sizes
            found = found.unionByName(_forest(finer.join(small.select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))))
    return found.distinct()


def with_fingerprint(docs: DataFrame, name: str, text: str = "text", words: int = 3) -> DataFrame:
    """The rows with the fingerprint's bits as a bigint of that name."""
    schema = with_fields(docs.schema, (name, "bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, words) for t in b.column(b.schema.names.index(text)).to_pylist()], np.uint64).view(np.int64)
            yield replaced(b, schema, {name: pa.array(fp)})

    return map_rows(docs, run, schema)


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, bucket: int = 256) -> DataFrame:
    """doc_id, fp, component (a fingerprint that stands for what is linked) and component_id, which two components share if their ids repeat."""
    prints = checkpointed(fingerprints(docs, text, doc_id, words))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(classes.select("fp"), bucket))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(roots, "component").select("fp", "component", "component_id"), "fp")


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, bucket: int = 256) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links)."""
    told = components(docs, text, doc_id, words, bucket)
    return told.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

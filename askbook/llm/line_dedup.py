"""Lines that recur across documents go, by probing a sharded minimal perfect hash.

One pass over the documents counts each distinct line key within tasks and sends key, documents and the largest doc_id among
them. Keys are 128-bit hashes, so no line travels. Sorted by hash, all distinct keys of a partition become shards of bounded size, each a
minimal perfect hash of levelled bit arrays whose ranks index three arrays: a fingerprint, a document count, into which the
tasks' counts are summed, and the document that keeps the line. What the count array holds decides which keys are frequent. These alone can
drop a line, so they alone are sent on, again as shards of such arrays, and a second pass over the documents probes them.

Keys that meet the threshold and hold a share of at least 1/HOT_KEYS of all sightings of frequent keys can be no more
than HOT_KEYS in number, so their index always fits a broadcast. If all frequent keys together
number no more than `broadcast_keys`, they are one index. Otherwise the rest stay in shards: hashes of lines that the broadcast index does not know
go to their shard and probe its arrays, and only decisions to drop come back. Shards are as many as keep both the keys and the sightings in each
bounded; what is dealt to them holds no hot key.

Null text counts as one empty line. Each row is a document; rows that share a doc_id count separately
but stand or fall together. A row with a null doc_id counts but never keeps a line, and a key that
only such rows hold is left alone. An input column named n_lines or n_dropped is replaced;
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askbook.llm._util import checkpointed, free_name, map_rows, replaced, ship, slices, with_fields

SPACE = " \t\n\x0b\x0c\r"
HOT_KEYS = 1 << 20
SHARD_KEYS = 1 << 16
SHARD_SIGHTINGS = 1 << 20
#: Sightings that a task combines before it sends them.
COMBINED = 1 << 18
LEVELS = 48
GAMMA = 2


def line_keys(text: str | None, min_chars: int) -> tuple[list[str], list[int], bytes]:
    """The text's lines, the places of those that have a key, and these keys' 16-byte hashes."""
    lines = (text or "").split("\n")
    at, out = [], []
    for i, line in enumerate(lines):
        key = line.strip(SPACE)
        if len(key) >= min_chars:
            at.append(i)
            out.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))
    return lines, at, b"".join(out)


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """An independent 64-bit hash of the keys for each level."""
    with np.errstate(over="ignore"):
        x = (h1 ^ (h2 * np.uint64(2 * level + 1))) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_shard(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes in bits of the levels, the bits (64 to a word, each level from a new word) and the keys' places by rank.

    At each level a key that is alone at its position sets the bit there; the others go to the next.
    """
    left, sizes, words, order = np.arange(len(h1)), [], [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = -(-max(64, GAMMA * len(left)) // 64) * 64
        at = (_mixed(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        sizes.append(size)
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        order.append(left[alone][np.argsort(at[alone], kind="stable")])
        left = left[~alone]
    if len(left):
        raise ValueError("two keys have the same 128 bits")
    return sizes, np.concatenate(words) if words else np.zeros(0, np.uint64), np.concatenate(order) if order else left


class LineIndex:
    """Shards set one after the other: the rank of a key's bit among all bits is its place in the arrays."""

    def __init__(self, blobs: list[dict], shards: int):
        self.shards, self.first = shards, np.zeros((LEVELS, shards), np.int64)
        self.size = np.zeros((LEVELS, shards), np.int64)
        at, words, arrays = 0, [], {"fingerprint": [], "count": [], "keeper": []}
        for b in sorted(blobs, key=lambda b: b["shard"]):
            for level, size in enumerate(b["sizes"]):
                self.first[level, b["shard"]], self.size[level, b["shard"]] = at, size
                at += size
            words.append(np.frombuffer(b["words"], np.uint64))
            for name, kind in (("fingerprint", np.uint64), ("count", np.int64), ("keeper", np.int64)):
                arrays[name].append(np.frombuffer(b[name], kind))
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.fingerprint, self.count, self.keeper = (np.concatenate(x) if x else np.zeros(0, np.uint64 if n == "fingerprint" else np.int64) for n, x in arrays.items())
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def drops(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, null: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Which sightings go (their key's count is at least `least` and another document keeps it), and which keys are known."""
        place = self.probe(h1, h2)
        known = place >= 0
        gone = known.copy()
        gone[known] = (self.count[place[known]] >= least) & ((self.keeper[place[known]] != ids[known]) | null[known])
        return gone, known

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each key's place, or -1 where the fingerprint tells that it is no member."""
        out = np.full(len(h1), -1, np.int64)
        if not len(self.words):
            return out
        left, shard = np.arange(len(h1)), shard_of(h1, self.shards)
        for level in range(LEVELS):
            left = left[self.size[level, shard[left]] > 0]
            if not len(left):
                break
            s = shard[left]
            at = self.first[level, s] + (_mixed(h1[left], h2[left], level) % self.size[level, s].astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            rank = self.before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            ours = np.zeros(len(left), bool)
            ours[hit] = self.fingerprint[rank[hit]] == h2[left[hit]]
            out[left[ours]] = rank[ours]
            left = left[~hit]
        return out


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


BLOB = "shard bigint, sizes array<bigint>, words binary, fingerprint binary, count binary, keeper binary"


def _shard_blob(frame: pd.DataFrame) -> dict:
    h1, h2 = (frame[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    sizes, words, order = build_shard(h1, h2)
    return {"shard": int(frame["shard"].iloc[0]), "sizes": sizes, "words": words.tobytes(), "fingerprint": h2[order].tobytes(), "count": frame["n"].to_numpy(np.int64)[order].tobytes(), "keeper": frame["keeper"].to_numpy(np.int64)[order].tobytes()}


def _blobs(frequent: DataFrame, shards: int) -> DataFrame:
    """A row for each shard; shards are even since keys are hashes."""
    dealt = frequent.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 40), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(lambda f: pd.DataFrame([_shard_blob(f)]), BLOB)


def _combined(h1: np.ndarray, h2: np.ndarray, n: np.ndarray, keeper: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, their counts summed, the largest of their keepers."""
    order = np.lexsort((h2, h1))
    h1, h2, n, keeper = h1[order], h2[order], n[order], keeper[order]
    first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, np.int64)
    return h1[first], h2[first], np.add.reduceat(n, first) if len(first) else n, np.maximum.reduceat(keeper, first) if len(first) else keeper


NO_ID = -(1 << 63)


def sightings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 40, combined: int = COMBINED) -> DataFrame:
    """h1, h2, n (documents that hold the key) and keeper (their largest id, NO_ID if none has one), combined within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in held]) if held else np.zeros((0, 2), np.int64)
            ids = np.concatenate([x for _, x in held]) if held else np.zeros(0, np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _combined(h[:, 0], h[:, 1], np.ones(len(h), np.int64), ids)], names=["h1", "h2", "n", "keeper"])

        for b in slices(batches):
            ids, rows, sizes = np.asarray(b.column(1).fill_null(NO_ID)), [], []
            for t in b.column(0).to_pylist():
                raw = line_keys(t, min_chars)[2]
                own = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                rows.extend(own)
                sizes.append(len(own))
            held.append((np.frombuffer(b"".join(rows), np.int64).reshape(-1, 2), np.repeat(ids, sizes)))
            size += len(rows)
            if size >= combined:
                yield out()
                size = 0
        yield out()

    return map_rows(docs.select(F.col(text).alias("text"), F.col(doc_id).cast("bigint").alias("id")), run, "h1 bigint, h2 bigint, n bigint, keeper bigint")


def frequent_keys(seen: DataFrame, min_docs: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """h1, h2, n, keeper of the keys whose count is at least min_docs, and one row without a key for each shard: n is its sightings.

    A task streams its keys in order and holds a shard of them at a time, whatever their number.
    """

    def shard(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        h1, h2, first = rows[:, 0].view(np.uint64), rows[:, 1].view(np.uint64), np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
        blob = _arrays(h1[first], h2[first])
        index = LineIndex([blob], 1)
        place = index.probe(h1, h2)
        np.add.at(index.count, place, rows[:, 2])
        np.maximum.at(index.keeper, place, rows[:, 3])
        at = place[first]
        often = (index.count[at] >= min_docs) & (index.keeper[at] != NO_ID)
        told, key = at[often], first[often]
        return pa.RecordBatch.from_arrays([
            pa.array([*rows[key, 0].tolist(), None], pa.int64()), pa.array([*rows[key, 1].tolist(), None], pa.int64()),
            pa.array(np.append(index.count[told], index.count.sum())), pa.array(np.append(index.keeper[told], 0)),
        ], names=["h1", "h2", "n", "keeper"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            rows = np.stack([np.asarray(c) for c in b.columns], 1)
            while len(rows):
                take = max(0, shard_keys - size)
                if take >= len(rows):
                    held.append(rows)
                    size += len(rows)
                    break
                # Up to the end of the key at the edge, so that no key is split.
                edge = rows[take - 1, :2] if take else held[-1][-1, :2]
                rest = np.flatnonzero((rows[take:, :2] != edge).any(1))
                cut = take + (int(rest[0]) if len(rest) else len(rows) - take)
                if cut:
                    held.append(rows[:cut])
                    size += cut
                rows = rows[cut:]
                if len(rows):
                    yield shard(held)
                    held, size = [], 0
        if held:
            yield shard(held)

    tasks = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = seen.repartition(tasks, F.shiftrightunsigned("h1", 44)).sortWithinPartitions("h1", "h2")
    return map_rows(dealt, run, "h1 bigint, h2 bigint, n bigint, keeper bigint")


def _arrays(h1: np.ndarray, h2: np.ndarray) -> dict:
    """A shard of distinct keys: bit arrays and fingerprints; counts zero, keepers none."""
    sizes, words, order = build_shard(h1, h2)
    return {"shard": 0, "sizes": sizes, "words": words.tobytes(), "fingerprint": h2[order].tobytes(), "count": bytes(8 * len(h1)), "keeper": np.full(len(h1), NO_ID).tobytes()}


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 40, min_docs: int = 5, broadcast_keys: int = 1 << 21) -> DataFrame:
    """The documents with repeated lines dropped from text, and n_lines and n_dropped."""
    spark = docs.sparkSession
    ship(spark)
    told = checkpointed(frequent_keys(sightings(docs, text, doc_id, min_chars), min_docs))
    frequent, often = told.where("h1 IS NOT NULL"), F.col("h1").isNotNull()
    held, sighted, every = told.agg(F.count("h1"), F.coalesce(F.sum(F.when(often, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~often, F.col("n"))), F.lit(0))).first()
    hot, cold = frequent, None
    if held > broadcast_keys:
        edge = -(-sighted // min(HOT_KEYS, broadcast_keys))
        hot, cold = frequent.where(F.col("n") >= edge), frequent.where(F.col("n") < edge)
    shards = max(1, -(-min(held, broadcast_keys) // SHARD_KEYS))
    index = spark.sparkContext.broadcast(LineIndex([r.asDict() for r in _blobs(hot, shards).collect()], shards))  # at most broadcast_keys entries of 24 bytes
    source, schema = docs, with_fields(docs.schema, ("n_lines", "bigint"), ("n_dropped", "bigint"))
    more_column = free_name(docs.columns, "more_drops")
    if cold is not None:
        drops = _cold_drops(docs, cold, max(-(-held // SHARD_KEYS), -(-every // SHARD_SIGHTINGS)), index, text, doc_id, min_chars, min_docs)
        key_column = free_name([*docs.columns, more_column], "drop_id")
        source = docs.join(drops.toDF(key_column, more_column), docs[doc_id].eqNullSafe(F.col(key_column)), "left").drop(key_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for b in slices(batches):
            names = b.schema.names
            ids = b.column(names.index(doc_id)).cast(pa.int64())
            got = [line_keys(t, min_chars) for t in b.column(names.index(text)).to_pylist()]
            h, per = np.frombuffer(b"".join(raw for _, _, raw in got), np.uint64).reshape(-1, 2), [len(at) for _, at, _ in got]
            drop, _ = found.drops(h[:, 0], h[:, 1], np.repeat(np.asarray(ids.fill_null(0)), per), np.repeat(np.asarray(ids.is_null()), per), min_docs)
            drops = b.column(names.index(more_column)).to_pylist() if more_column in names else None
            out, counts, at_key = [], [], 0
            for i, (lines, at, raw) in enumerate(got):
                gone = {at[j] for j in np.flatnonzero(drop[at_key : at_key + len(at)])}
                at_key += len(at)
                if drops and drops[i]:
                    more = set(drops[i])
                    gone.update(at[j] for j in range(len(at)) if raw[16 * j : 16 * j + 16] in more)
                out.append("\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else "\n".join(lines))
                counts.append((len(lines), len(gone)))
            n = np.array(counts, np.int64).reshape(-1, 2)
            yield replaced(b, schema, {text: pa.array(out, pa.string()), "n_lines": pa.array(n[:, 0]), "n_dropped": pa.array(n[:, 1])})

    return map_rows(source, run, schema)


def _cold_drops(docs: DataFrame, cold: DataFrame, shards: int, hot, text: str, doc_id: str, min_chars: int, min_docs: int) -> DataFrame:
    """For each doc_id the hashes of its lines that go, found by probing within the shards of a large index.

    A shard's group holds its arrays and the hashes dealt to it; keys of the hot index are told already and aren't dealt.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [line_keys(t, min_chars)[2] for t in b.column(0).to_pylist()]
            h = np.frombuffer(b"".join(got), np.uint64).reshape(-1, 2)
            row = np.repeat(np.arange(len(got)), [len(x) // 16 for x in got]).astype(np.int64)
            new = hot.value.probe(h[:, 0], h[:, 1]) < 0
            h, ids = h[new], b.column(1).take(pa.array(row[new]))
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(h[:, 0], shards)), pa.array(h[:, 0].astype(np.int64)), pa.array(h[:, 1].astype(np.int64)), ids], names=["shard", "h1", "h2", "id"])

    def meet(asked: pd.DataFrame, blob: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(blob):
            return pd.DataFrame({"id": pd.Series([], "Int64"), "h": []})
        one = blob.iloc[0].to_dict()
        found = LineIndex([one | {"sizes": list(one["sizes"])}], shards)
        h1, h2 = (asked[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        ids = asked["id"].astype("Int64")
        gone, _ = found.drops(h1, h2, ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy(bool), min_docs)
        raw = np.stack([h1[gone], h2[gone]], 1)
        return pd.DataFrame({"id": ids[gone].array, "h": [r.tobytes() for r in raw]})

    asked = map_rows(docs.select(F.col(text).alias("text"), F.col(doc_id).cast("bigint").alias("id")), keys, "shard bigint, h1 bigint, h2 bigint, id bigint")
    found = asked.groupBy("shard").cogroup(_blobs(cold, shards).groupBy("shard")).applyInPandas(meet, "id bigint, h binary")
    return found.groupBy("id").agg(F.collect_set("h").alias("drops"))

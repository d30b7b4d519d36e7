"""Document quality: random-indexing word vectors, pooled, then a two-layer network with calibrated output.

Words (runs of letters and digits, or of other signs) fall in `buckets` hash buckets. Each bucket
has a fixed sparse index vector of signs; one pass over all documents adds up, for each bucket, the
index vectors of the words up to two places away. Rows of these sums are scaled to length one. A
document is pooled into the mean and the deviation of its words' vectors, the mean product of
neighbouring words' vectors, shares of kinds of words and its length. The network (one hidden layer,
numpy, fixed seed) learns from at most `most_rows` labelled rows outside the held-out fold; a fifth
of them sets the temperature by which its output becomes a probability. Of rows that share an id in the sample one is learned from, so what
reaches the driver is bounded by `most_rows`.

All word statistics cover all documents. Null or empty texts pool to zeros and are scored so. If the learning rows
lack one of the labels, every score is the share of label 1 (0.5 without rows). Input columns of the names that are
added are replaced. Rows with a null doc_id are scored and not held out.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askbook.llm._util import checkpointed, map_rows, replaced, ship, slices, with_fields
from askbook.llm.labels import fold, labelled, learning_sample

WORD = re.compile(r"\w+|[^\w\s]+")
DIM, NONZERO, SPAN = 48, 2, 2
KEPT_KEYS = 500_000
SHAPES = 8
_BUCKETS: dict[str, int] = {}


def index_vectors(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places of its NONZERO signs and the signs."""
    r = np.random.default_rng(7)
    return r.integers(0, DIM, (buckets, NONZERO)), r.choice([-1.0, 1.0], (buckets, NONZERO))


def bucket_ids(words: list[str], buckets: int) -> np.ndarray:
    held = _BUCKETS
    if len(held) > KEPT_KEYS:
        held.clear()
    out = []
    for w in words:
        h = held.get(w)
        if h is None:
            h = held[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, np.int64) % buckets


def contexts(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """bucket and v (DIM sums) over all documents; a task adds up before it sends."""
    places, signs = index_vectors(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets * DIM)
        for b in slices(batches, 1024):
            parts = []
            for t in b.column(0).to_pylist():
                ids = bucket_ids(WORD.findall((t or "").lower()), buckets)
                parts += [ids, np.full(SPAN, -1)]
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            for gap in range(1, SPAN + 1):
                left, right = ids[:-gap], ids[gap:]
                whole = (left >= 0) & (right >= 0)
                for word, near in ((left[whole], right[whole]), (right[whole], left[whole])):
                    for j in range(NONZERO):
                        total += np.bincount(word * DIM + places[near, j], signs[near, j], buckets * DIM)
        rows = total.reshape(buckets, DIM)
        used = np.flatnonzero(rows.any(1))
        for at in range(0, len(used), 4096):
            some = used[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.FixedSizeListArray.from_arrays(pa.array(rows[some].astype(np.float32).ravel()), DIM).cast(pa.list_(pa.float32()))], names=["bucket", "v"])

    told = map_rows(docs.select(F.col(text).alias("text")), run, "bucket bigint, v array<float>")
    return told.groupBy("bucket").agg(F.array(*[F.sum(F.col("v")[i].cast("double")) for i in range(DIM)]).alias("v"))


def word_vectors(docs: DataFrame, buckets: int, text: str = "text") -> np.ndarray:
    """The buckets' vectors, of length one (zero where no word fell). Their size doesn't depend on the data's."""
    out = np.zeros((buckets, DIM), np.float32)
    got = contexts(docs, buckets, text).toPandas()
    if len(got):
        out[got["bucket"].to_numpy()] = np.stack(got["v"].to_list())
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@lru_cache(1)
def letter_kinds() -> np.ndarray:
    """For each code point 1 if it is a letter, and 2 more if it is a capital."""
    return np.array([c.isalpha() + 2 * c.isupper() for c in map(chr, range(sys.maxunicode + 1))], np.uint8)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean, deviation, mean product of neighbours, shapes."""
    words = WORD.findall((text or "").lower())
    out = np.zeros(3 * DIM + SHAPES, np.float32)
    if not words:
        return out
    v = vectors[bucket_ids(words, len(vectors))]
    mean = v.mean(0)
    out[:DIM], out[DIM : 2 * DIM] = mean, np.sqrt(np.maximum((v * v).mean(0) - mean * mean, 0))
    if len(v) > 1:
        out[2 * DIM : 3 * DIM] = (v[1:] * v[:-1]).mean(0)
    n, size = len(words), len(text)
    lines = text.count("\n") + 1
    kinds = letter_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letters, capitals = np.count_nonzero(kinds & 1), np.count_nonzero(kinds & 2)
    out[3 * DIM :] = (
        len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(not w[0].isalnum() for w in words) / n, sum(w[0].isdigit() for w in words) / n,
        sum(map(len, words)) / n / 10, letters / size, capitals / size, np.log1p(n) / 10 + lines / size * 0.1,
    )
    return out


@dataclass
class Network:
    vectors: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))

    def learn(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, seed: int = 11) -> None:
        """Adam on the log-loss of four fifths of the rows; the rest chooses the temperature."""
        r = np.random.default_rng(seed)
        order = r.permutation(len(x))
        held, own = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-3
        z = (x - self.mean) / self.scale
        w = [r.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(())]
        first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        size = min(256, max(16, len(own) // 8))
        for epoch in range(rounds):
            rate = 3e-3 * (1 - epoch / rounds) + 1e-4
            for at in range(0, len(own), size):
                rows = own[r.permutation(len(own))[:size]] if at + size > len(own) else own[at : at + size]
                a = z[rows] @ w[0] + w[1]
                h = np.maximum(a, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
                d = (p - y[rows]) / len(rows)
                dh = np.outer(d, w[2]) * (a > 0)
                step += 1
                for i, g in enumerate((z[rows].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], d.sum())):
                    first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                    w[i] = w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            own = own[r.permutation(len(own))]
        self.weights = tuple(w)
        if len(held):
            logits, truth = self.logits(x[held]), y[held]
            loss = lambda t: np.mean(np.logaddexp(0, np.where(truth > 0, -logits, logits) / t))
            self.temperature = float(min(np.geomspace(0.5, 10, 61), key=loss))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 2, folds: int = 4, text: str = "text", doc_id: str = "doc_id", most_rows: int = 20_000, buckets: int = 1 << 15) -> Network:
    """Word vectors of all documents and the network of the labelled rows outside the held-out fold."""
    ship(docs.sparkSession)
    network = Network(word_vectors(docs, buckets, text))
    rows = labelled(docs, checkpointed(learning_sample(labels, label, held_out, folds, most_rows)), text, doc_id)
    shared = docs.sparkSession.sparkContext.broadcast(network.vectors)  # buckets * DIM numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [pooled(t, shared.value).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], names=["id", "label", "x"])

    told = map_rows(rows.select("_id", "_text", "_label"), run, "id bigint, label int, x binary")
    got = told.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.*").toPandas().sort_values("id")
    y = (got["label"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        network.constant = float(y.mean()) if len(y) else 0.5
    else:
        network.learn(np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(y), -1).astype(float), y)
    return network


def score(docs: DataFrame, network: Network, text: str = "text", threshold: float = 0.7) -> DataFrame:
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = with_fields(docs.schema, ("score", "double"), ("predicted", "int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in slices(batches):
            p = net.scores(np.stack([pooled(t, net.vectors) for t in b.column(b.schema.names.index(text)).to_pylist()]).astype(float))
            yield replaced(b, schema, {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    return map_rows(docs, run, schema)


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", held_out: int = 2, folds: int = 4, **learning) -> DataFrame:
    """The documents with held_out, score and predicted."""
    network = fit(docs, labels, held_out=held_out, folds=folds, text=text, doc_id=doc_id, **learning)
    return score(docs, network, text).withColumn("held_out", F.coalesce(fold(doc_id, folds) == held_out, F.lit(False)))

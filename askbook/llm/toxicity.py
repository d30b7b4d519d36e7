"""Toxic passages as maximum-scoring segments of token log-odds.

Learning counts, over labelled documents, in how many toxic and other documents each feature (a
word, or its first four or five letters) occurs. A feature's log-odds ratio is taken under a Dirichlet
prior proportional to its frequency in both. It is its score where it leans to toxic documents and stands out by `min_z` (the root of
its likelihood ratio) and `min_ratio`; where it leans away and `min_docs` documents hold it, it is added to DEFAULT, which is also what a
feature that tells nothing scores. A token scores as its word, else as its beginnings; a word that
follows itself tells nothing new. A linear scan (Ruzzo and Tompa's) gives all maximal segments of a text. A
segment of score S among n tokens is as surprising as lambda S - ln(K n), where lambda solves
E[exp(lambda s)] = 1 over tokens of non-toxic documents and K is fitted to their segments, by the theory of extreme
values of such segments. What exceeds zero is summed over the text's segments, and a logistic curve
fitted to the learning rows makes it a probability.

Labels are taken from at most `most_rows` labelled ids outside the held-out fold; ids, languages and sources
are never inputs. What calibration needs is summed on the executors; the driver sees counts by feature and by bin. The model has no
more features than the learning rows' distinct words and beginnings in `min_docs` documents, whatever the size of the corpus, as arrays of 12 bytes each.
Null or empty texts have no segments and the score of a text without any. If no labelled row
is toxic or none is not, every score is the share of toxic ones (0.5 without rows). Input columns of the names
that are added are replaced. Rows with a null doc_id are scored and not held out.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askbook.llm._util import checkpointed, map_rows, replaced, ship, slices, with_fields
from askbook.llm.labels import fold, labelled, learning_sample

WORD = re.compile(r"\w+")
BEGINNINGS = (5, 4)
DEFAULT, LEAST = -1.0, -5.0
KEPT_KEYS = 300_000
#: Scores fall in bins of 1/BINS_A_UNIT from LOWEST on, for the sums of calibration.
BINS_A_UNIT, LOWEST = 32, DEFAULT + LEAST


def features(word: str) -> Iterator[str]:
    """The word, then its beginnings, the longest first."""
    yield word
    for n in BEGINNINGS:
        if len(word) > n:
            yield "^" + word[:n]


def key(feature: str) -> int:
    """64 bits that stand for a feature (signed); 0 is kept for the documents' own counts."""
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) - (1 << 63) or 1


def log_odds(toxic: Column, other: Column, toxic_docs: int, other_docs: int, prior: float = 10.0) -> Column:
    """A feature's log-odds ratio, `prior` pseudo-documents shared out to it by its overall frequency."""
    weight = (toxic + other) * F.lit(prior / (toxic_docs + other_docs))
    a, b = toxic + weight, other + weight
    return F.log(a / (F.lit(toxic_docs + prior) - a)) - F.log(b / (F.lit(other_docs + prior) - b))


def standing_out(toxic: Column, other: Column, toxic_docs: int, other_docs: int) -> Column:
    """The root of the likelihood ratio: in standard deviations how far counts are from those of a feature without leaning."""
    share = toxic_docs / (toxic_docs + other_docs)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (part(toxic, (toxic + other) * share) + part(other, (toxic + other) * (1 - share)))))


def segments(score: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal segments (score, first token, last token) of the tokens' scores.

    Keeps a list of segments, each with the cumulative sums left of it and at its end, and the nearest one before it that begins
    lower. A new one joins that of its own, if it ends lower than the new one does. The search for it goes along these links, so
    no segment is passed twice.
    """
    sums = np.concatenate([[0.0], np.cumsum(score)])
    at = np.flatnonzero(score > 0)
    lows, highs, firsts, lasts, links = [], [], [], [], []
    for low, high, first in zip(sums[at].tolist(), sums[at + 1].tolist(), at.tolist()):
        last, j = first, len(lows) - 1
        while True:
            while j >= 0 and lows[j] >= low:
                j = links[j]
            if j < 0 or highs[j] >= high:
                break
            low, first, before = lows[j], firsts[j], links[j]
            for held in (lows, highs, firsts, lasts, links):
                del held[j:]
            j = before
        for held, value in ((lows, low), (highs, high), (firsts, first), (lasts, last), (links, j)):
            held.append(value)
    return [(high - low, a, b) for low, high, a, b in zip(lows, highs, firsts, lasts)]


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of features, rising
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    rate: float = 1.0  # lambda
    k: float = 0.1
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None
    known: dict[str, float] = field(default_factory=dict)

    def token(self, word: str) -> float:
        s = self.known.get(word)
        if s is None:
            s = DEFAULT
            for f in features(word):
                k = key(f)
                i = int(self.keys.searchsorted(k))
                if i < len(self.keys) and self.keys[i] == k:
                    s = float(self.values[i])
                    break
            if len(self.known) >= KEPT_KEYS:
                self.known.clear()
            self.known[word] = s
        return s

    def scan(self, text: str | None) -> tuple[np.ndarray, list[tuple[float, int, int]]]:
        """The tokens' scores and the maximal segments."""
        words = WORD.findall((text or "").lower())
        known, token = self.known, self.token
        s = np.array([known[w] if w in known else token(w) for w in words], np.float64)
        again = [i for i in np.flatnonzero(s > 0).tolist() if i and words[i] == words[i - 1]]
        s[again] = DEFAULT
        return s, segments(s)

    def surprise(self, n: int, found: list[float]) -> float:
        """What the segments' normalised scores exceed zero by, summed."""
        edge = math.log(max(self.k * n, 1.0))
        return sum(max(0.0, self.rate * s - edge) for s in found)

    def score(self, n: int, found: list[float]) -> float:
        if self.constant is not None:
            return self.constant
        x = self.slope * math.log1p(self.surprise(n, found)) + self.offset
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def _counts(rows: DataFrame) -> DataFrame:
    """key (0: documents), toxic, other: in how many documents of either kind; counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, list[int]] = defaultdict(lambda: [0, 0])

        def out() -> pa.RecordBatch:
            keys = np.array([key(f) if f else 0 for f in held], np.int64)
            seen = np.array(list(held.values()), np.int64).reshape(-1, 2)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(seen[:, 1]), pa.array(seen[:, 0])], names=["key", "toxic", "other"])

        for b in slices(batches):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                label = 1 if label else 0
                held[""][label] += 1
                for f in {f for w in set(WORD.findall((text or "").lower())) for f in features(w)}:
                    held[f][label] += 1
                if len(held) >= KEPT_KEYS:
                    yield out()
        yield out()

    told = map_rows(rows.select("_text", "_label"), run, "key bigint, toxic bigint, other bigint")
    return told.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def scores(counts: DataFrame, toxic_docs: int, other_docs: int, min_docs: int = 4, min_z: float = 5.5, min_ratio: float = 2.0) -> DataFrame:
    """key and score of the features that tell something."""
    toxic, other = F.col("toxic"), F.col("other")
    ratio = log_odds(toxic, other, toxic_docs, other_docs)
    leads = (toxic >= min_docs) & (ratio >= min_ratio) & (standing_out(toxic, other, toxic_docs, other_docs) >= min_z)
    told = F.when(leads, ratio).when((ratio < 0) & (toxic + other >= min_docs), F.greatest(ratio, F.lit(LEAST)) + DEFAULT)
    return counts.where("key <> 0").select("key", told.cast("float").alias("score")).where("score IS NOT NULL")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: int = 0, folds: int = 5, text: str = "text", doc_id: str = "doc_id", most_rows: int = 120_000, **choice) -> Model:
    """The model of the labelled rows outside the held-out fold; choice: what `scores` takes."""
    spark = docs.sparkSession
    ship(spark)
    rows = labelled(docs, checkpointed(learning_sample(labels, label, held_out, folds, most_rows)), text, doc_id)
    counts = checkpointed(_counts(rows))
    whole = counts.where("key = 0").first()
    toxic_docs, other_docs = (whole["toxic"], whole["other"]) if whole else (0, 0)
    if not toxic_docs or not other_docs:
        return Model(constant=toxic_docs / (toxic_docs + other_docs) if toxic_docs + other_docs else 0.5)
    got = scores(counts, toxic_docs, other_docs, **choice).toArrow()
    keys, values = np.asarray(got.column("key")), np.asarray(got.column("score"))
    order = np.argsort(keys)
    return _calibrated(Model(keys[order], values[order]), rows)


def _calibrated(model: Model, rows: DataFrame) -> Model:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            n, found, bins = [], [], np.zeros(1, np.int64)
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s, f = m.scan(text)
                n.append(len(s))
                found.append([x for x, _, _ in f])
                if not label:
                    own = np.bincount(np.rint((s - LOWEST) * BINS_A_UNIT).astype(np.int64))
                    bins = own + np.pad(bins, (0, len(own) - len(bins))) if len(own) > len(bins) else bins + np.pad(own, (0, len(bins) - len(own)))
            used = np.flatnonzero(bins)
            none = lambda k, kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.float64())), none(len(n), pa.int32()), none(len(n), pa.int64())], names=["label", "n", "segments", "bin", "tokens"])
            yield pa.RecordBatch.from_arrays([none(len(used), pa.int32()), none(len(used), pa.int64()), none(len(used), pa.list_(pa.float64())), pa.array(used.astype(np.int32)), pa.array(bins[used])], names=["label", "n", "segments", "bin", "tokens"])

    told = checkpointed(map_rows(rows.select("_text", "_label"), run, "label int, n bigint, segments array<double>, bin int, tokens bigint"))
    bins = told.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("tokens").alias("n")).toPandas()  # as many rows as there are bins
    model.rate = _rate(bins["bin"].to_numpy(float) / BINS_A_UNIT + LOWEST, bins["n"].to_numpy(float))
    docs = told.where("bin IS NULL")
    clean = docs.where("label = 0").agg(F.sum("n").alias("tokens"), F.sum(F.size(F.filter("segments", lambda x: x >= 3.0))).alias("found")).first()
    model.k = min(1.0, (clean["found"] + 1) / (max(1, clean["tokens"]) * math.exp(-3.0 * model.rate)))
    edge = F.log(F.greatest(F.lit(model.k) * F.col("n"), F.lit(1.0)))
    surprise = F.aggregate("segments", F.lit(0.0), lambda acc, x: acc + F.greatest(F.lit(0.0), F.lit(model.rate) * x - edge))
    x = docs.groupBy("label", F.round(F.log1p(surprise) * 256).alias("x")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # a logarithm: some thousand bins at most
    model.slope, model.offset = _logistic(x["x"].to_numpy(float) / 256, x["label"].to_numpy(float), x["n"].to_numpy(float))
    return model


def _rate(scores: np.ndarray, n: np.ndarray) -> float:
    """The lambda above zero at which the mean of exp(lambda s) over the tokens is one, within 0.05 and 3."""
    low, high = 0.05, 3.0
    mean = lambda r: (n * np.exp(r * scores)).sum() / max(1.0, n.sum())
    if mean(low) > 1:
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) <= 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve of rows that count n times, slightly drawn to a flat one so that separable rows have one."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows with score, predicted and passages: significant segments' first and last token and normalised score."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the learning rows
    schema = with_fields(docs.schema, ("score", "double"), ("predicted", "int"), ("passages", "array<struct<first:int,last:int,surprise:double>>"))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("surprise", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            scores, passages = [], []
            for t in b.column(b.schema.names.index(text)).to_pylist():
                tokens, found = m.scan(t)
                n = len(tokens)
                edge = math.log(max(m.k * n, 1.0))
                scores.append(m.score(n, [s for s, _, _ in found]))
                passages.append([{"first": i, "last": j, "surprise": m.rate * s - edge} for s, i, j in found if m.rate * s > edge])
            p = np.array(scores)
            yield replaced(b, schema, {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32)), "passages": pa.array(passages, kind)})

    return map_rows(docs, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", held_out: int = 0, folds: int = 5, **learning) -> DataFrame:
    """The documents with held_out, score, predicted and passages."""
    model = fit(docs, labels, held_out=held_out, folds=folds, text=text, doc_id=doc_id, **learning)
    return score(docs, model, text).withColumn("held_out", F.coalesce(fold(doc_id, folds) == held_out, F.lit(False)))

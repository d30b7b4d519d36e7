import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest

from askbook.llm import toxicity as X

BAD = ["vile", "grubby", "odious", "blighter", "rottenish", "rottenest"]


def brute_segments(s):
    """Maximal segments by their definition: positive, all proper beginnings and ends positive, and maximal among such."""
    n, c = len(s), np.concatenate([[0], np.cumsum(s)])
    good = [(i, j) for i, j in itertools.combinations(range(n + 1), 2) if all(c[k] > c[i] for k in range(i + 1, j + 1)) and all(c[k] < c[j] for k in range(i, j))]
    return sorted((i, j - 1) for i, j in good if not any((a, b) != (i, j) and a <= i and j <= b for a, b in good))


@pytest.mark.parametrize("seed", range(60))
def test_segments(seed):
    r = random.Random(seed)
    s = np.array([r.choice([r.uniform(-3, -0.2)] * r.randint(1, 3) + [r.uniform(0.1, 4)]) for _ in range(r.randint(1, 40))])
    found = X.segments(s)
    assert sorted((a, b) for _, a, b in found) == brute_segments(s)
    for v, a, b in found:
        assert v == pytest.approx(s[a : b + 1].sum())


@pytest.mark.parametrize("apart", [1, 2, 5])
@pytest.mark.parametrize("slope", [-0.3, 0.0, 0.3])
def test_scan_is_linear(apart, slope):
    s = np.full(apart * 1_000_000, X.DEFAULT)
    s[::apart] = apart - 1 + slope + np.linspace(0, 0.2, 1_000_000)
    began = time.perf_counter()
    X.segments(s)
    assert time.perf_counter() - began < 30


def test_log_odds_and_scores(spark):
    rows = [(X.key("vile"), 30, 2), (X.key("mild"), 2, 60), (X.key("rare"), 3, 0), (X.key("even"), 10, 40), (X.key("once"), 0, 1), (0, 100, 400)]
    got = {r.key: r.score for r in X.scores(spark.createDataFrame(rows, "key bigint, toxic bigint, other bigint"), 100, 400).collect()}

    def ratio(t, o):
        a, b = t + 10 * (t + o) / 500, o + 10 * (t + o) / 500
        return math.log(a / (110 - a)) - math.log(b / (410 - b))

    assert got == {X.key("vile"): pytest.approx(ratio(30, 2), rel=1e-5), X.key("mild"): pytest.approx(ratio(2, 60) + X.DEFAULT, rel=1e-5)}


def corpus(n, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choices(["ta", "ri", "mo", "en", "ul", "ske"], k=r.randint(1, 4))) for _ in range(r.randint(3, 120))]
        toxic = r.random() < 0.2
        for _ in range(r.randint(2, 5) if toxic else 0):
            words.insert(r.randrange(len(words) + 1), r.choice(BAD))
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(toxic)))
    return docs, labels, {i for i, t in docs if any(b in t.split() for b in BAD)}


def test_learns_and_holds_out(spark):
    docs, labels, toxic = corpus(1500)
    extra = [(9001, None), (9002, ""), (None, "vile odious grubby"), (9003, "ta ri " * 40000 + "vile odious vile grubby"), (3, docs[3][1])]
    frame = spark.createDataFrame([(d, t, 0.5) for d, t in docs + extra], "doc_id bigint, text string, Score double")
    done = X.toxicity(frame, spark.createDataFrame(labels + [(None, 1), (7777, None)], "doc_id bigint, toxic int"))
    assert done.columns == ["doc_id", "text", "score", "predicted", "passages", "held_out"]
    rows = done.collect()
    assert len(rows) == len(docs) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [(r.doc_id in toxic) == r.predicted for r in rows if r.doc_id is not None and r.doc_id < 9000]
    assert np.mean(right) > 0.98
    by = {r.doc_id: r for r in rows}
    assert by[9001].predicted == by[9002].predicted == 0 and by[9001].passages == []
    assert by[None].predicted == 1 and by[9003].predicted == 1
    p = by[9003].passages[0]
    assert 80000 <= p["first"] <= p["last"] <= 80003


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert X.toxicity(docs, none).first().score == 0.5
    assert X.toxicity(docs, spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")).first().score in (0.0, 0.5)
    assert X.toxicity(docs.limit(0), none).count() == 0

import random
import zlib

import numpy as np

from askbook.llm import quality as Q


def corpus(n, seed=1):
    r = random.Random(seed)
    docs, labels, good = [], [], set()
    for i in range(n):
        words = ["".join(r.choices(["ta", "ri", "mo", "en", "ul", "ske"], k=r.randint(1, 4))) for _ in range(r.randint(10, 120))]
        kind = r.choice(["good"] * 5 + ["signs", "again"])
        if kind == "signs":
            words = [w + r.choice(["$$$", "###"]) for w in words]
        elif kind == "again":
            words = [w for w in words[:6] for _ in range(9)]
        else:
            good.add(i)
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(kind == "good")))
    return docs, labels, good


def test_contexts_by_brute_force(spark):
    texts = ["a b c a", "b b", None, "", "solo"]
    buckets = 64
    got = {r.bucket: np.array(r.v) for r in Q.contexts(spark.createDataFrame([(t,) for t in texts], "text string"), buckets).collect()}
    places, signs = Q.index_vectors(buckets)
    want = np.zeros((buckets, Q.DIM))
    for t in texts:
        w = [zlib.crc32(x.encode()) % buckets for x in (t or "").split()]
        for i in range(len(w)):
            for j in range(len(w)):
                if 0 < abs(i - j) <= Q.SPAN:
                    np.add.at(want[w[i]], places[w[j]], signs[w[j]])
    for k in range(buckets):
        assert np.allclose(want[k], got.get(k, 0))


def test_letters_and_capitals_of_the_whole_text():
    r = random.Random(4)
    for text in ["A", "aB1 é²Ⓐǅ漢🙂", "x" * 1999 + "AB" + "x" * 9000, "A234 " * 4000, "".join(chr(r.choice([r.randint(32, 0x2FFF), r.randint(0x10000, 0x1FFFF)])) for _ in range(9000))]:
        got = Q.pooled(text, np.ones((64, Q.DIM), np.float32))[3 * Q.DIM + 5 : 3 * Q.DIM + 7]
        want = [sum(map(str.isalpha, text)) / len(text), sum(map(str.isupper, text)) / len(text)]
        assert got.tolist() == np.array(want, np.float32).tolist()


def test_learns_and_holds_out(spark):
    docs, labels, good = corpus(1200)
    extra = [(9001, None), (9002, ""), (None, "ta ri mo en"), (9003, "ta ri mo ul " * 30000), (3, docs[3][1])]
    frame = spark.createDataFrame([(d, t, 0.5) for d, t in docs + extra], "doc_id bigint, text string, Predicted double")
    done = Q.quality(frame, spark.createDataFrame(labels + [(None, 1), (7777, None)], "doc_id bigint, quality int"))
    assert done.columns == ["doc_id", "text", "score", "predicted", "held_out"]
    rows = done.collect()
    assert len(rows) == len(docs) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = [(r.doc_id in good) == r.predicted for r in rows if r.held_out and r.doc_id < 9000]
    assert np.mean(right) > 0.97


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert Q.quality(docs, none).first().score == 0.5
    assert Q.quality(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).first().score in (1.0, 0.5)
    assert Q.quality(docs.limit(0), none).count() == 0


def test_temperature_softens_what_is_too_sure():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 5))
    y = (x[:, 0] + r.normal(size=600) * 2 > 0).astype(float)
    net = Q.Network(np.zeros((1, 1)))
    net.learn(x, y, rounds=200)
    assert net.temperature > 1

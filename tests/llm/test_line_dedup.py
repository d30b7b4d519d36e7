import hashlib
from collections import defaultdict

import numpy as np
import pytest

from askbook.llm import line_dedup as L


def plain(rows, min_chars=40, min_docs=5):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held, last = defaultdict(int), {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k] += 1
            if d is not None:
                last[k] = max(d, last.get(k, d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and held[key(x)] >= min_docs and key(x) in last and last[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LONG = "This line is long enough to be counted é"
ROWS = [(i, f"{LONG}\nown {i}\n\t{LONG.upper().replace('É', 'é')} \nshort") for i in range(4)]
ROWS += [(9, LONG), (7, None), (8, ""), (10, "x" * 40 + "\n" + "y" * 39), (None, LONG), (11, "\n".join(["z" * 50] * 9)), (9, LONG)]
ROWS += [(20 + i, "q" * 45 + "\n" + "y" * 39 + "\n" + "r" * (41 + i % 3)) for i in range(18)]
ROWS += [(40, ("word " * 40000) + "\n" + LONG)]


@pytest.mark.parametrize("bound", [1 << 21, 2])
def test_matches_plain(spark, bound):
    docs = spark.createDataFrame([(d, t, 1, "h", 5, 6, 7) for d, t in ROWS], "doc_id bigint, text string, n_lines int, shard string, more_drops int, drop_id int, _drops int").repartition(5)
    done = L.line_dedup(docs, broadcast_keys=bound)
    assert done.columns == ["doc_id", "text", "shard", "more_drops", "drop_id", "_drops", "n_lines", "n_dropped"]
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in done.collect()], key=repr) == plain(ROWS)


def test_empty(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_hash_is_minimal_perfect_and_rejects_strangers():
    raw = [hashlib.md5(str(i).encode()).digest() for i in range(30000)]
    h = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2)
    members, shards, blobs = h[:20000], 3, []
    dealt = L.shard_of(members[:, 0], shards)
    for s in range(shards):
        own = members[dealt == s]
        sizes, words, order = L.build_shard(own[:, 0], own[:, 1])
        one = np.zeros(len(own), np.int64)
        blobs.append({"shard": s, "sizes": sizes, "words": words.tobytes(), "fingerprint": own[order, 1].tobytes(), "count": one.tobytes(), "keeper": one.tobytes()})
    place = L.LineIndex(blobs, shards).probe(h[:, 0], h[:, 1])
    assert sorted(place[:20000]) == list(range(20000))
    assert (place[20000:] == -1).all()


@pytest.mark.parametrize("seed", range(8))
def test_counts_of_all_distinct_keys(spark, seed):
    r = np.random.default_rng(seed)
    h = {a: np.frombuffer(hashlib.md5(str(a).encode()).digest(), np.int64).tolist() for a in range(-40, 40)}
    rows = [(*h[int(a)], int(n), int(k)) for a, n, k in zip(r.integers(-40, 40, 600), r.integers(1, 4, 600), r.integers(0, 99, 600))]
    want = defaultdict(lambda: [0, 0])
    for a, _, n, k in rows:
        want[a] = [want[a][0] + n, max(want[a][1], k)]
    got = L.frequent_keys(spark.createDataFrame(rows, "h1 bigint, h2 bigint, n bigint, keeper bigint").repartition(3), 15, 16).collect()
    assert {x.h1: [x.n, x.keeper] for x in got if x.h1 is not None} == {a: v for a, v in want.items() if v[0] >= 15}
    assert sum(x.n for x in got if x.h1 is None) == sum(n for _, _, n, _ in rows)


def test_sightings_are_combined_in_parts(spark):
    docs = spark.createDataFrame([(d, t) for d, t in ROWS], "doc_id bigint, text string").repartition(2)
    whole, parts = L.sightings(docs), L.sightings(docs, combined=2)
    assert parts.count() >= whole.count()
    total = lambda x: {(r.h1, r.h2): (r.n, r.k) for r in x.groupBy("h1", "h2").agg({"n": "sum", "keeper": "max"}).toDF("h1", "h2", "n", "k").collect()}
    assert total(whole) == total(parts)

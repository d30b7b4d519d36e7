import random
import re

import pytest
import xxhash

from askbook.llm import simhash as S


def plain_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """(doc_id, fp) -> doc_id: smallest doc_id reachable."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "A b", "a b c", "Ab c d É e\x0bf", "x " * 5000, "The cat sat on the mat. " * 3 + "É"])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def crowd(seed, n, centre_bits):
    """Fingerprints around a few centres, many within three bits of others."""
    r, out = random.Random(seed), set()
    centres = [r.getrandbits(64) for _ in range(centre_bits)]
    while len(out) < n:
        x = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, 6)):
            x ^= 1 << b
        out.add(x)
    return [(i, x) for i, x in enumerate(out)]


@pytest.mark.parametrize("bucket", [256, 4])
def test_links_join_what_brute_force_joins(spark, bucket):
    rows = crowd(1, 220, 3)
    signed = [(x - (1 << 64) if x >> 63 else x,) for _, x in rows]
    found = S.links(spark.createDataFrame(signed, "fp bigint"), bucket).collect()
    name = {s[0]: i for (i, _), s in zip(rows, signed)}
    ends = {i: i for i in range(len(rows))}

    def find(x):
        while ends[x] != x:
            x = ends[x]
        return x

    for r in found:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3
        x, y = find(name[r.a]), find(name[r.b])
        ends[max(x, y)] = min(x, y)
    assert {i: find(i) for i in ends} == plain_components(rows)


def test_groups(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [base, base, base.upper(), base + " tail", None, "", " ", "a", "b", base.replace("w7 ", "w8 ")] + [" ".join(random.Random(i).choices("abcdefghijklmnop", k=30)) for i in range(40)]
    docs = spark.createDataFrame([(100 - i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, fp int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_groups(docs).collect()}
    rows = [(100 - i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    want = plain_components(rows)
    assert got == {d: (f"{x:016x}", want[d]) for d, x in rows}


def test_empty(spark):
    assert S.simhash_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "x y z"), (3, "x y z"), (3, "x y z"), (None, "solo text here now")], "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.component_id is None, r.component_id or 0) for r in S.simhash_groups(docs).collect())
    assert got == [(False, False, 3), (False, False, 3), (True, False, 3), (True, True, 0)]

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from askbook.llm import packing as P

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


def brute_cost(places, costs, length):
    at, best = [0, *places], [0] + [None] * len(places)
    for j in range(1, len(at)):
        best[j] = min(best[i] + length - (at[j] - at[i]) + costs[j - 1] for i in range(j) if at[j] - at[i] <= length)
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cut_is_cheapest(seed):
    r = random.Random(seed)
    length = r.choice([8, 20, 64])
    gaps = [r.randint(1, length if r.random() < 0.2 else max(1, length // 4)) for _ in range(r.randint(1, 120))]
    places = np.cumsum(gaps)
    costs = np.array([r.choice([0, 3, 12]) for _ in gaps])
    ends = P.cut(places, costs, length, open_end=False)
    assert ends[-1] == places[-1] and set(ends) <= set(places.tolist())
    cost_of = dict(zip(places.tolist(), costs.tolist()))
    sizes = np.diff([0, *ends])
    assert sizes.max() <= length
    assert sum(length - n for n in sizes) + sum(cost_of[e] for e in ends) == brute_cost(places.tolist(), costs.tolist(), length)
    ends = P.cut(places, costs, length)
    last = ends[-1] if ends else 0
    assert 0 <= places[-1] - last < length
    told = sum(length - n + cost_of[e] for n, e in zip(np.diff([0, *ends]), ends))
    assert told == min(brute_cost(places[:k].tolist(), costs[:k].tolist(), length) or 0 for k in range(len(places) + 1) if places[-1] - (places[k - 1] if k else 0) < length)


def test_encoder_is_the_librarys():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    encode, _ = P.load(PATH)
    for t in ["", " a", "Hello  world\n\n x's", "é ñ 漢字   x", "<|endoftext|> and <|endoftext|>", "a" * 5000, "12345 %%% \t\t", "don't we'll I'M"]:
        assert encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "x" + " \t" * 300_000 + "y", "ab  \n" * 200_000, "é" * 300_000, "!1" * 300_000, "z" + " " * (P.LONG_SPACE - 1) + "z"])
def test_very_long_runs(text):
    from tokenizers import Tokenizer

    assert P.load(PATH)[0](text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_pieces_of_long_space(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "one")], "doc_id bigint, text string")
    assert {(r.doc_id, r.doc_tokens) for r in P.pack(docs, PATH).collect()} == {(1, len(P.load(PATH)[0](" " * 1_000_000)) + 1), (2, len(P.load(PATH)[0]("one")) + 1)}


@pytest.mark.parametrize("block", [3000, 1 << 20])
def test_pieces(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK_IDS", block)
    r = random.Random(2)
    texts = [None, "", "one", "x" * 9000] + [" ".join(r.choices(["alpha", "beta.", "gamma\n", "delta", "q" * 30], k=r.randint(1, 900))) for _ in range(60)]
    texts += ["same text. " * 50] * 5 + ["word " * 60000]
    docs = spark.createDataFrame([(i if i != 7 else None, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, length int").coalesce(2)
    rows = P.pack(docs, PATH, with_ids=True).collect()
    encode, _ = P.load(PATH)
    own, seq = defaultdict(list), defaultdict(list)
    for x in rows:
        own[x.doc_id].append(x)
        seq[x.sequence_id].append(x)
        assert x.ids_crc32 == zlib.crc32(bytes(x.ids)) and len(x.ids) == 4 * x.length
    for i, t in enumerate(texts):
        got = sorted(own[i if i != 7 else None], key=lambda x: x.start)
        want = np.append(encode(t or ""), 0).astype("<u4")
        assert b"".join(bytes(x.ids) for x in got) == want.tobytes()
        assert [x.start for x in got] == [sum(y.length for y in got[:k]) for k in range(len(got))]
        assert all(x.doc_tokens == len(want) for x in got)
    padded = total = 0
    for xs in seq.values():
        xs.sort(key=lambda x: x.offset)
        assert [x.offset for x in xs] == [sum(y.length for y in xs[:k]) for k in range(len(xs))]
        n = sum(x.length for x in xs)
        assert 0 < n <= 1024
        total += n
        padded += 0 if n & (n - 1) == 0 else 1024 - n
    assert padded < 0.03 * total
    told = P.padding(spark.createDataFrame([(x.sequence_id, x.length) for x in rows], "sequence_id bigint, length bigint")).first()
    assert (told.sequences, told.ids, told.padded) == (len(seq), total, padded)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0

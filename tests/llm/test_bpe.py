import itertools
import random

import numpy as np
import pytest

from askbook.llm import bpe as B

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def plain_bpe(symbols, merges):
    """Merges one after the other, each from left to right."""
    ids = list(symbols)
    for u, v, w in merges:
        i = 0
        while i < len(ids) - 1:
            if ids[i] == u and ids[i + 1] == v:
                ids[i : i + 2] = [w]
            i += 1
    return ids


@pytest.mark.parametrize("seed", range(20))
def test_automaton_accepts_only_what_bpe_produces(seed):
    r = random.Random(seed)
    base, merges, spelled = [0, 1, 2], [], {0: "a", 1: "b", 2: "c"}
    while len(merges) < 9:
        u, v = r.choice(list(spelled)), r.choice(list(spelled))
        if spelled[u] + spelled[v] not in spelled.values():
            w = len(spelled)
            spelled[w] = spelled[u] + spelled[v]
            merges.append((u, v, w))
    made = B.compile_merges(base, merges, len(spelled), set())
    accepts = lambda ids: all(made["arcs"][t, s >> 3] >> (s & 7) & 1 for s, t in zip([0, *(int(made["after"][t]) for t in ids)], ids))
    for n in range(1, 8):
        for word in itertools.product(base, repeat=n):
            assert accepts(plain_bpe(word, merges)), word
    for n in range(1, 4):
        for ids in itertools.product(spelled, repeat=n):
            text = ["abc".index(c) for t in ids for c in spelled[t]]
            assert accepts(ids) == (plain_bpe(text, merges) == list(ids)), ids


def texts():
    r = random.Random(4)
    out = ["", " ", "a", "Hello World, it's   we'll don't", "ÀÉÎ é é ñ ß ẞ İstanbul ΣΑΣ ς", "漢字かな 한국어 🙂🙂 عربي", "<|endoftext|>x<|startoftext|> <|endoftext", "12345 1.5e10 ½ ² ٣", "a" * 700, "!!!???...---", "\x1c\x1d a\x85b\xa0c​d　e", "tab\there\nnew\rline\x0bvt\x0cff", "'s't 'RE x'm", "hahahahahahaha lalalala mississippi", "� ퟿ ", "zzzzzzzzzzzzzzzzz ooooooooo"]
    out += ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(1, 30))) for _ in range(1500)]
    out += [" ".join("".join(r.choices(["th", "er", "ing", "on", "re", "é", "ü", "qu", "e"], k=r.randint(1, 6))) for _ in range(400)) for _ in range(10)]
    out += ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x370, 0x5FF), r.randint(0x900, 0x9FF), r.randint(0x3040, 0x30FF)])) for _ in range(80)) for _ in range(60)]
    return out


def test_matches_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    automaton, labels = B.Automaton(B.compiled(PATH)), B.Labels(B.compiled(PATH)["tokens"])
    wrong = []
    for t in texts():
        want = lib.encode(t, add_special_tokens=False).ids
        got = automaton.encode(t)
        if got != want or labels.decode(np.array(got, np.int64)) != lib.decode(want, skip_special_tokens=False):
            wrong.append(t)
    assert not wrong, wrong[:5]


def test_every_token_that_bpe_can_make_is_one_arc():
    from tokenizers import Tokenizer

    lib, automaton = Tokenizer.from_file(PATH), B.Automaton(B.compiled(PATH))
    words = sorted(k.decode() for k in automaton.last if k.isascii() and k.isalpha() and k.islower())
    got = [x.ids for x in lib.encode_batch(words, add_special_tokens=False)]
    assert [automaton.word(w.encode()) for w in words] == got


def test_dataframe(spark):
    rows = [(i, t, 5) for i, t in enumerate([None, "", "Hello there", "x " * 100000, "Hello there"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, IDS int")
    done = B.decode(B.encode(docs, PATH), PATH)
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    got = {r.doc_id: r for r in done.collect()}
    assert got[0].ids == got[1].ids == [] and got[0].decoded == ""
    assert got[2].decoded == "hello</w> there</w>" and got[2].ids == got[4].ids
    assert len(got[3].ids) == 100000
    odd = spark.createDataFrame([(1, [None, -5, 10**6]), (2, None)], "k int, ids array<int>")
    assert {r.k: r.decoded for r in B.decode(odd, PATH).collect()} == {1: "", 2: None}
    assert B.encode(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0

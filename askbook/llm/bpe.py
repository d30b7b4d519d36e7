"""BPE encoding by a deterministic automaton over tokens, decoding by its arc labels.

`compile_merges` starts from an automaton that reads any base symbols and adds a gadget for each merge
u, v -> w in order of priority: every state with an arc u gets an arc w to the state after v, and the
state after u loses its arc v (split off first if other tokens end there, too). Of all token
sequences the result accepts exactly those that BPE produces. Which arcs a state has is one bit for
each state and token, so a transition is a table look-up. A word's encoding is the one accepted path
that spells it; since a correct sequence's beginnings are correct, each place in the word is reached
by at most one path, and the walk never goes back.

Texts are normalised and split as the tokenizer's file says (NFC, white space, lower case; pieces of
letters, single digits, other signs; special tokens found in the raw text first). Null text counts as
empty, which has no ids. Ids that the tokenizer doesn't have decode to nothing, null ids to null. Input
columns of the names that an operator adds are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from askbook.llm._util import map_rows, replaced, ship, slices, with_fields

CACHED_WORDS = 200_000
START, END_OF_WORD = 0, "</w>"
UNKNOWN = regex.compile(r"\p{Cn}")
# White space as Unicode has it: what the tokenizer's pattern means by \s.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The usual pattern of such files, and the same for text of Latin letters in the faster standard library.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+"
QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\t-\r \w]+(?:_+[^\t-\r \w]*)*|_+(?:[^\t-\r \w]+_*)*")
NOT_LATIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")
_COMPILED: dict[str, dict] = {}
_OPENED: dict[type, tuple[object, object]] = {}


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable ones themselves, others from U+0100 on."""
    plain, out, extra = {*range(33, 127), *range(161, 173), *range(174, 256)}, [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def compile_merges(base: list[int], merges: list[tuple[int, int, int]], tokens: int, final: set[int]) -> dict:
    """arcs (a row of bits over states for each token) and after (the state after each token, -1 after a word's last).

    base: ids of single symbols; merges: (left, right, result) in order; final: ids that end a word.
    """
    arcs, after = np.zeros((tokens, 64), np.uint8), np.full(tokens, -1, np.int64)
    members, states = [0, 0], 2  # state 0: a word's start; state 1: after any base symbol
    for t in base:
        arcs[t, 0] |= 3
        if t not in final:
            after[t] = 1
            members[1] += 1
    for u, v, w in merges:
        s = int(after[u])
        if not arcs[v, s >> 3] >> (s & 7) & 1:  # the pair never stands together by now
            if w not in final:
                after[w] = after[v]
                members[after[v]] += 1
            continue
        arcs[w] = arcs[u]
        old = s
        if members[s] > 1 or u == v:
            new, states = states, states + 1
            if new >> 3 >= arcs.shape[1]:
                arcs = np.concatenate([arcs, np.zeros_like(arcs[:, : max(64, arcs.shape[1] // 4)])], 1)
            members.append(1)
            members[s] -= 1
            after[u] = new
            bit = (arcs[:, s >> 3] >> (s & 7)) & 1
            arcs[:, new >> 3] |= bit << np.uint8(new & 7)
            s = new
        clear = np.uint8(255 ^ (1 << (s & 7)))
        arcs[v, s >> 3] &= clear
        if u == v:
            arcs[w, s >> 3] &= clear  # of three in a row the first two merge
        if w not in final:
            after[w] = old if u == v else after[v]
            members[after[w]] += 1
    return {"arcs": np.ascontiguousarray(arcs[:, : (states + 7) >> 3]), "after": after, "states": states}


class Automaton:
    def __init__(self, spec: dict):
        self.inner: dict[bytes, int] = spec["inner"]
        self.last: dict[bytes, int] = spec["last"]
        self.special: dict[str, int] = spec["special"]
        self.after: list[int] = spec["after"]
        self.width: int = spec["width"]
        arcs = np.frombuffer(zlib.decompress(spec["arcs"]), np.uint8).reshape(-1, self.width).copy()
        for w, u in spec["merged"]:
            arcs[w] ^= arcs[u]
        self.arcs = memoryview(arcs.reshape(-1))
        self.step: dict[int, int] = {}  # a tree of the tokens' bytes: node and byte to node
        self.inner_at, self.last_at = [-1], [-1]
        for tokens, at in ((self.inner, self.inner_at), (self.last, self.last_at)):
            for raw, t in tokens.items():
                node = 0
                for byte in raw:
                    found = self.step.setdefault(node << 8 | byte, len(self.inner_at))
                    if found == len(self.inner_at):
                        self.inner_at.append(-1)
                        self.last_at.append(-1)
                    node = found
                at[node] = t
        self.pattern = regex.compile(spec["pattern"])
        self.quick = QUICK if spec["pattern"] == SPLIT else None
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, list[int]] = {}
        self.path, self.lib, self.letters = spec["path"], None, {c: b for b, c in enumerate(byte_letters())}

    def word(self, raw: bytes) -> list[int]:
        """The ids of a pre-split word: the one path through the automaton that spells it."""
        n, step, arcs, width, after = len(raw), self.step.get, self.arcs, self.width, self.after
        inner, last = self.inner_at, self.last_at
        state, back = [-1] * (n + 1), [(0, 0)] * (n + 1)
        state[0] = START
        for i in range(n):
            s = state[i]
            if s < 0:
                continue
            byte, bit, node = s >> 3, s & 7, 0
            for j in range(i, n):
                node = step(node << 8 | raw[j])
                if node is None:
                    break
                t = inner[node] if j + 1 < n else last[node]
                if t >= 0 and arcs[t * width + byte] >> bit & 1:
                    state[j + 1], back[j + 1] = after[t] if j + 1 < n else START, (i, t)
        if state[n] < 0:
            raise ValueError("no path spells the word")
        out = []
        while n:
            n, t = back[n]
            out.append(t)
        return out[::-1]

    def _newer(self, text: str, out: list[int]) -> None:
        """Where text has characters that Python's tables don't know yet, the library's own normalising and splitting."""
        if self.lib is None:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(self.path)
        for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text)):
            out += self.word(bytes(self.letters[c] for c in w))

    def _plain(self, text: str, out: list[int]) -> None:
        if not text.isascii() and UNKNOWN.search(text):
            self._newer(text, out)
            return
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words = self.words
        for w in (self.pattern if self.quick is None or NOT_LATIN.search(text) else self.quick).findall(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= CACHED_WORDS:
                    words.clear()
                ids = self.word(w.encode("utf-8", "surrogatepass"))
                if len(w) < 64:
                    words[w] = ids
            out += ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text and self.marks is not None and any(m in text for m in self.special):
            for i, part in enumerate(self.marks.split(text)):
                if i & 1:
                    out.append(self.special[part])
                else:
                    self._plain(part, out)
        elif text:
            self._plain(text, out)
        return out


class Labels:
    """The labels of an automaton's arcs."""

    def __init__(self, tokens: list[str]):
        self.labels, self.complete = np.array([*tokens, ""], object), all(tokens)

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs with these ids, joined as by a tokenizer without decoder."""
        n = len(self.labels) - 1
        if self.complete and len(ids) and ids.min() >= 0 and ids.max() < n:
            return " ".join(self.labels[ids].tolist())
        return " ".join(x for x in self.labels[ids[(ids >= 0) & (ids < n)]].tolist() if x)


def compiled(path: str) -> dict:
    """The automaton of a tokenizer file with word ends, made once in a process; a few MB, bounded by the vocabulary.

    A merge's row of arcs is told by how it differs from its left part's, which is little.
    """
    if path in _COMPILED:
        return _COMPILED[path]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, normal, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
    assert model["type"] == "BPE" and model["end_of_word_suffix"] == END_OF_WORD and spec["decoder"] is None, "another kind of tokenizer"
    assert [x["type"] for x in normal["normalizers"]] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"], "another kind of tokenizer"
    vocab, special = model["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    names = [""] * size
    for t, i in [*vocab.items(), *special.items()]:
        names[i] = t
    letters = {c: b for b, c in enumerate(byte_letters())}
    raw = lambda t: bytes(letters[c] for c in t)
    ordinary = {t: i for t, i in vocab.items() if t not in special}
    last = {raw(t[: -len(END_OF_WORD)]): i for t, i in ordinary.items() if t.endswith(END_OF_WORD)}
    inner = {raw(t): i for t, i in ordinary.items() if not t.endswith(END_OF_WORD)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    final = set(last.values())
    base = [i for k, i in [*last.items(), *inner.items()] if len(k) == 1]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    assert len({w for _, _, w in merges}) == len(merges), "two merges make the same token"
    made = compile_merges(base, merges, size, final)
    arcs = made["arcs"]
    differs = arcs.copy()
    for u, _, w in merges:
        differs[w] ^= arcs[u]
    split = pre["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACES)
    _COMPILED[path] = {"path": path, "tokens": names, "inner": inner, "last": last, "special": special, "after": made["after"].tolist(), "width": arcs.shape[1], "merged": [(w, u) for u, _, w in merges], "arcs": zlib.compress(differs.tobytes(), 6), "pattern": split}
    return _COMPILED[path]


def _opened(shared: Broadcast, kind: type) -> object:
    """What the broadcast's value opens to, kept by the worker process from task to task."""
    value = shared.value
    held = _OPENED.get(kind)
    if held is None or held[0] is not value:
        held = _OPENED[kind] = (value, kind(value))
    return held[1]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """The rows with the ids of their text, special tokens in it included, none added."""
    ship(docs.sparkSession)
    schema = with_fields(docs.schema, (out, "array<int>"))
    shared = docs.sparkSession.sparkContext.broadcast(compiled(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _opened(shared, Automaton)
        for b in slices(batches, 256):
            ids = [automaton.encode(t) for t in b.column(b.schema.names.index(text)).to_pylist()]
            yield replaced(b, schema, {out: pa.array(ids, pa.list_(pa.int32()))})

    return map_rows(docs, run, schema)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the text that their ids stand for, special tokens kept."""
    ship(rows.sparkSession)
    schema = with_fields(rows.schema, (out, "string"))
    shared = rows.sparkSession.sparkContext.broadcast(compiled(tokenizer)["tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _opened(shared, Labels)
        for b in slices(batches, 256):
            held = b.column(b.schema.names.index(ids))
            texts = [labels.decode(np.asarray(x.values.drop_null() if x.values.null_count else x.values)) if x.is_valid else None for x in held]
            yield replaced(b, schema, {out: pa.array(texts, pa.string())})

    return map_rows(rows, run, schema)

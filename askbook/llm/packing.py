"""Order-preserving packing of tokenized documents into bounded sequences.

Documents keep the order of their partition. Their ids, each document's followed by an end id, form
one stream, which is cut into windows of at most `length` ids. Cuts may fall at document ends (free),
at sentence ends (a small penalty) and, where a sentence runs long, inside it (a larger one). The cuts
minimise padding plus penalties, exactly within each block of BLOCK_IDS ids that a task holds at a time: f(j) = penalty(j) + min over windows (i, j] of
f(i) + length - (p(j) - p(i)), where the minimum over the window slides along and is kept in a
monotone queue, so the work is linear in the number of places. With the default costs a cut inside a sentence costs little more than one at
its end, and less than the padding it saves: little padding comes first, as the contract wants it. The last, partial window of a partition
is split into powers of two, which need no padding.

Nothing is shuffled: a partition is packed as it is read, a block of the stream at a time, and what
a block's last window holds is carried over. Sequence ids are the partition's number and a count.
Null or empty text is a document of the end id alone; repeated rows are packed each; doc_id is only
carried, so it may be null. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askbook.llm._util import map_rows, slices
from askbook.llm.bpe import byte_letters

SENTENCE_COST, INSIDE_COST, STRIDE = 8, 12, 8
BLOCK_IDS = 1 << 20
LONG_SPACE = 20_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_LOADED: dict[str, tuple[Callable[[str], np.ndarray], np.ndarray]] = {}


def load(path: str) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """An encoder for a byte-level BPE tokenizer file, and for each id whether it ends a sentence.

    Where ids are merge ranks, the file's vocabulary is run by tiktoken, which gives the same ids
    several times as fast; the tokenizers library runs the file otherwise, and for any text with white space
    in a row of LONG_SPACE or more, on which tiktoken's pattern would run out of stack.
    """
    if path in _LOADED:
        return _LOADED[path]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab, merges = {c: b for b, c in enumerate(byte_letters())}, spec["model"]["vocab"], spec["model"]["merges"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    raw = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    pre = spec["pre_tokenizer"] or {}
    ranked = sorted(raw.values()) == list(range(len(raw))) and [vocab[a + b] for a, b in pairs] == list(range(len(raw) - len(pairs), len(raw)))
    simple = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    encode = plain = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
    if ranked and simple:
        import tiktoken

        run = tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=raw, special_tokens=special)
        spaced = re.compile(r"\s{%d}" % LONG_SPACE)
        encode = lambda text: plain(text) if len(text) >= LONG_SPACE and spaced.search(text) else run.encode_to_numpy(text, allowed_special="all")
    ends = np.zeros(max([*raw.values(), *special.values(), 0]) + 1, bool)
    for token, i in raw.items():
        ends[i] = b"\n" in token or token.rstrip(b"\"')").endswith((b".", b"!", b"?"))
    _LOADED[path] = encode, ends
    return _LOADED[path]


def cut(places: np.ndarray, costs: np.ndarray, length: int, open_end: bool = True) -> list[int]:
    """Which places (rising, after a start at 0, gaps of at most length) end a window in a cheapest division up to the last.

    With open_end the last window, of less than `length`, is left out: it costs nothing, whatever its size.
    """
    at, cost = [0, *places.tolist()], [0, *costs.tolist()]
    best, back = [0] * len(at), [0] * len(at)
    queue, value = deque([0]), [0] * len(at)  # places that may begin a window; value: best + place, rising along the queue
    for j in range(1, len(at)):
        p = at[j]
        while p - at[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        f = best[j] = cost[j] + length - p + value[i]
        v = value[j] = f + p
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    if open_end:
        first = int(np.searchsorted(places, at[-1] - length, side="right")) + 1 if at[-1] >= length else 0
        j = first + int(np.argmin(best[first:]))
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut and what each cut costs."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    cost[1:][ends[ids]] = SENTENCE_COST
    cost[doc_ends] = 0
    known = np.flatnonzero(cost[1:] >= 0) + 1
    gaps = np.diff(known, prepend=0)
    for i in np.flatnonzero(gaps > STRIDE):
        cost[known[i] - gaps[i] + STRIDE : known[i] : STRIDE] = INSIDE_COST
    known = np.flatnonzero(cost[1:] >= 0) + 1
    return known, cost[known]


class Packer:
    """Takes documents' ids in order, gives pieces (document's place, start, length, sequence, offset, ids)."""

    def __init__(self, length: int, ends: np.ndarray):
        self.length, self.ends, self.sequence = length, ends, 0
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []  # a document's number, its first id here, its ids here
        self.held = 0

    def add(self, number: int, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.docs.append((number, 0, len(ids)))
        self.held += len(ids)

    def flush(self, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pieces as rows (number, start, length, sequence, offset, place in ids) and the ids they point into."""
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        doc_ends = np.cumsum([n for _, _, n in self.docs]) if self.docs else np.zeros(0, np.int64)
        windows: list[int] = []
        if len(ids):
            places, costs = cut_places(ids, doc_ends, self.ends)
            windows = cut(places, costs, self.length)
            first = windows[-1] if windows else 0
            rest = len(ids) - first if last else 0
            while rest:
                first += 1 << (rest.bit_length() - 1)
                rest -= 1 << (rest.bit_length() - 1)
                windows.append(first)
        upto = windows[-1] if windows else 0
        inner = doc_ends[doc_ends <= upto]
        edges = np.unique(np.concatenate([[0], windows, inner])).astype(np.int64)
        begin, size = edges[:-1], np.diff(edges)
        doc = np.searchsorted(doc_ends, begin, side="right")
        window = np.searchsorted(np.array(windows, np.int64), begin, side="right")
        starts = np.array([0, *windows], np.int64)
        told = np.array(self.docs, np.int64).reshape(-1, 3)
        doc_first = doc_ends - told[:, 2] if len(told) else doc_ends
        rows = np.stack([told[doc, 0], told[doc, 1] + begin - doc_first[doc], size, self.sequence + window, begin - starts[window], begin], 1) if len(begin) else np.zeros((0, 6), np.int64)
        self.sequence += len(windows)
        left = [(int(n), int(f + max(0, upto - b)), int(k - max(0, upto - b))) for (n, f, k), b in zip(told, doc_first) if b + k > upto]
        self.docs, self.parts, self.held = left, [ids[upto:]] if left else [], len(ids) - upto
        return rows, ids


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", length: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document in a sequence; with_ids adds the piece's ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = load(tokenizer)
        packer, base = Packer(length, ends), TaskContext.get().partitionId() << 36
        told: dict[int, tuple[int | None, int]] = {}
        number, end = 0, np.array([end_id], np.uint32)

        def out(last: bool) -> pa.RecordBatch:
            rows, ids = packer.flush(last)
            owner = [told[n] for n in rows[:, 0].tolist()]
            raw, spans = ids.astype("<u4").tobytes(), [(4 * a, 4 * (a + n)) for n, a in rows[:, [2, 5]].tolist()]
            arrays = [pa.array([x[0] for x in owner], pa.int64()), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array([zlib.crc32(memoryview(raw)[a:b]) for a, b in spans], pa.int64()), pa.array([x[1] for x in owner], pa.int64()), pa.array(rows[:, 3] + base), pa.array(rows[:, 4])]
            if with_ids:
                arrays.append(pa.array([raw[a:b] for a, b in spans], pa.binary()))
            kept = {n for n, _, _ in packer.docs}
            for n in [n for n in told if n not in kept]:
                del told[n]
            return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

        for b in slices(batches, 64):
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.concatenate([encode(t or ""), end])
                told[number] = key, len(ids)
                packer.add(number, ids)
                number += 1
                if packer.held >= BLOCK_IDS:
                    yield out(False)
        yield out(True)

    schema = PIECES + ", ids binary" * with_ids
    return map_rows(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, schema)


def padding(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """sequences, ids and padded: what padding to `length`, except at a power of two, adds."""
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    short = F.when(F.expr("n & (n - 1)") == 0, 0).otherwise(length - F.col("n"))
    return full.agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids"), F.coalesce(F.sum(short), F.lit(0)).alias("padded"))

"""Exact top-k by inner product over a vector-approximation file.

Components become whole numbers floor(scale * x). The index cuts each dimension's range into cells of
equal width and holds a byte for each cell; exact vectors lie in a column of their own. Since cells of a dimension are
equally wide, a query's product with a cell's lower corners bounds its score from both sides: what is missing lies
between the sums of (width - 1) times the query's negative and positive components. A search scans the cells
twice, without the exact vectors: once for each query's kth lower bound over all rows, below which no upper bound need
be looked at, and once to read exact vectors in the order of their bounds until the next bound is below the kth exact
score found so far. A group of some 4,096 exact vectors is read when one of them is asked for. Ties go to the smaller
vec_id, so a bound equal to the kth score is still read.

Queries go to the vectors in blocks of bounded size, each broadcast with its floors, so a task sends on only what can
still be among the best. The index is a Parquet table in the shared checkpoint folder, deleted when the result is kept.
Where tasks can't open that folder's files themselves (a scheme that pyarrow doesn't know), the second scan
reads both columns.

Rows with a null vec_id, and vectors that are null or hold null or non-finite components, take no part. Vectors
shorter than others count as followed by zeros. Rows that repeat a vec_id are candidates each; as a query such an id is
asked once, with the least of its vectors. A query's candidates are all rows of other ids. Scores that may pass 64 bits
are an error. A query without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyarrow import fs

from askbook.llm._util import checkpointed, deleted, map_rows, ship, slices, written

CELLS = 64
QUERY_BLOCK = 16_384
ROWS, QUERIES = 4096, 512


def whole_numbers(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (array<bigint>) of the vectors that take part."""
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(usable).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            x = b.column(1)
            v = np.floor(np.asarray(x.flatten()) * scale)
            if len(v) and np.abs(v).max() >= 2**62:
                raise ValueError("a component passes 62 bits")
            sizes = np.append(0, np.cumsum(np.asarray(pc.list_value_length(x)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(sizes), pa.array(v.astype(np.int64)))], names=["vec_id", "v"])

    return map_rows(rows, run, "vec_id bigint, v array<bigint>")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column, padded with zeros to dim components."""
    sizes = np.asarray(pc.list_value_length(column)).astype(np.int64)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(column.flatten())
    return out


def grid(whole: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Each dimension's least value and cell width; two numbers a dimension reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = np.zeros(0, np.int64)
        for b in slices(batches, ROWS):
            sizes = np.asarray(pc.list_value_length(b.column(0)))
            dim = max(len(low), int(sizes.max()) if len(sizes) else 0)
            x = _matrix(b.column(0), dim)
            low, high = np.pad(low, (0, dim - len(low))), np.pad(high, (0, dim - len(high)))
            low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))  # zero is within, for padding
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    got = map_rows(whole.select("v"), run, "d bigint, low bigint, high bigint").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values("d")
    low, high = got["low"].to_numpy(np.int64), got["high"].to_numpy(np.int64)
    return low, np.maximum(1, -(-(high - low + 1) // CELLS))


def va_index(whole: DataFrame, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """The vector-approximation file: vec_id, cells (a byte a dimension) and exact (64 bits a dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            x = _matrix(b.column(1), len(low))
            cells = ((x - low) // width).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in cells], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "cells", "exact"])

    return map_rows(whole, run, "vec_id bigint, cells binary, exact binary")


class Exact:
    """The exact vectors of a block of the index's rows, read a row group at a time and only when asked for."""

    def __init__(self) -> None:
        self.path, self.groups, self.groups_read = None, {}, 0

    def rows(self, path: str, index: np.ndarray) -> Exact:
        """The block of these rows of a file, in the order of the file."""
        if path != self.path:
            where, name = fs.FileSystem.from_uri(path)
            self.path, self.file, self.groups = path, pq.ParquetFile(where.open_input_file(name)), {}
            told = self.file.metadata
            self.starts = np.cumsum([0] + [told.row_group(g).num_rows for g in range(told.num_row_groups)])
        self.index, self.own = index, np.searchsorted(self.starts, index, "right") - 1
        self.groups = {g: v for g, v in self.groups.items() if g >= self.own[0]}
        return self

    def __getitem__(self, i: int) -> pa.Buffer:
        g = int(self.own[i])
        if g not in self.groups:
            self.groups[g] = self.file.read_row_group(g, columns=["exact"]).column(0).combine_chunks()
            self.groups_read += 1
        return self.groups[g][int(self.index[i] - self.starts[g])].as_buffer()


class Search:
    """The k best of the vectors seen so far for each query."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, low: np.ndarray, width: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.low, self.width = ids, k, low, width
        most = np.abs(queries).max(initial=1).astype(float) * float(max(np.abs(low).max(initial=1), np.abs(low + width * CELLS).max(initial=1))) * max(1, queries.shape[1])
        if most >= 2**63:
            raise ValueError("scores may pass 64 bits")
        self.queries, self.exact_floats = queries, most < 2**52
        self.floats = queries.astype(np.float64)
        self.base, self.steps = self.floats @ low, self.floats * width
        self.above = np.maximum(self.floats, 0) @ (width - 1)
        self.below = np.minimum(self.floats, 0) @ (width - 1)
        self.kth = floor.astype(np.float64)  # the least score that may still count
        self.slack = 0.0 if self.exact_floats else 2.0**12  # what sums of doubles may be off beyond 53 bits
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), the best first
        self.read = self.seen = 0

    def _lower(self, own: slice, corner: np.ndarray, vec_ids: np.ndarray) -> np.ndarray:
        """For each query the k greatest lower bounds of rows of other ids (all, if fewer), the least of k first."""
        lower = np.where(self.ids[own, None] == vec_ids, -np.inf, corner)
        if lower.shape[1] > self.k:
            lower = np.partition(lower, lower.shape[1] - self.k, axis=1)[:, lower.shape[1] - self.k :]
        return lower + self.below[own, None] - 3 * self.slack

    def _corner(self, own: slice, codes: np.ndarray) -> np.ndarray:
        return self.steps[own] @ codes.T + self.base[own, None]

    def bounds(self, best: np.ndarray, vec_ids: np.ndarray, cells: np.ndarray) -> None:
        """Takes a block into the k greatest lower bounds of each query."""
        codes = cells.astype(np.float64)
        for at in range(0, len(self.ids), QUERIES):
            own = slice(at, at + QUERIES)
            both = np.concatenate([best[own], self._lower(own, self._corner(own, codes), vec_ids)], axis=1)
            best[own] = np.partition(both, both.shape[1] - self.k, axis=1)[:, both.shape[1] - self.k :]

    def block(self, vec_ids: np.ndarray, cells: np.ndarray, exact: Exact | list[memoryview]) -> None:
        codes = cells.astype(np.float64)
        for at in range(0, len(self.ids), QUERIES):
            own = slice(at, at + QUERIES)
            corner = self._corner(own, codes)
            upper = corner + self.above[own, None] + self.slack
            if self.slack:
                upper += np.abs(upper) * 2.0**-45
            kth = self.kth[own]
            if np.isneginf(kth).any() and upper.shape[1] >= self.k:  # no floor is known
                kth = np.maximum(kth, self._lower(own, corner, vec_ids).min(1))
            may = upper >= kth[:, None]
            self.seen += may.size
            for q in np.flatnonzero(may.any(1)).tolist():
                self._visit(at + q, np.flatnonzero(may[q]), upper[q], vec_ids, exact)

    def _visit(self, q: int, rows: np.ndarray, upper: np.ndarray, vec_ids: np.ndarray, exact: Exact | list[memoryview]) -> None:
        rows = rows[np.argsort(-upper[rows], kind="stable")]
        bound, query, size = upper[rows], self.queries[q], 2 * self.k + 2
        at = 0
        while at < len(rows) and bound[at] >= self.kth[q]:
            some = rows[at : at + size]
            some = some[vec_ids[some] != self.ids[q]]
            at += size
            size *= 2
            self.read += len(some)
            if not len(some):
                continue
            x = np.frombuffer(b"".join([exact[i] for i in some.tolist()]), np.int64).reshape(len(some), -1)
            score = (x.astype(np.float64) @ query.astype(np.float64)).astype(np.int64) if self.exact_floats else x @ query
            keep = score >= self.kth[q] if self.exact_floats else np.ones(len(score), bool)
            got = self.best[q] + list(zip((-score[keep]).tolist(), vec_ids[some[keep]].tolist()))
            got.sort()
            self.best[q] = got[: self.k]
            if len(got) >= self.k:
                self.kth[q] = max(self.kth[q], float(-self.best[q][-1][0]) - (0 if self.exact_floats else abs(self.best[q][-1][0]) * 2.0**-50 + 1))


def _cells(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(b.column(0)), np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)


def _floors(index: DataFrame, block: dict, low: np.ndarray, width: np.ndarray, k: int) -> np.ndarray:
    """The kth lower bound of each query over all cells; a number a query reaches the driver."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        s = Search(own["ids"], own["queries"], low, width, k, own["floor"])
        best = np.full((len(s.ids), k), -np.inf)
        for b in slices(batches, ROWS):
            s.bounds(best, *_cells(b))
        for at in range(0, len(best), ROWS):
            some = best[at : at + ROWS]
            q, bound = np.repeat(s.ids[at : at + ROWS], k), some.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(q[bound > -np.inf]), pa.array(bound[bound > -np.inf])], names=["query_id", "bound"])

    every = map_rows(index.select("vec_id", "cells"), run, "query_id bigint, bound double")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound")))).where(F.col("rank") == k)
    reached = ranked.select("query_id", "bound").toPandas().set_index("query_id")["bound"]
    shared.unpersist()
    return reached.reindex(block["ids"]).astype(float).fillna(-np.inf).to_numpy()


def _runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut where the file changes or rows of one file don't follow each other."""
    path, row = pc.dictionary_encode(b.column(2)).indices.to_numpy(), np.asarray(b.column(3))
    cuts = np.flatnonzero((np.diff(path) != 0) | (np.diff(row) < 0)) + 1
    for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
        yield b.slice(at, to - at)


def _found(index: DataFrame, apart: bool, block: dict, low: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id and score of each task's best. Apart: exact vectors are read from the files, not by the scan."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        s, files = Search(own["ids"], own["queries"], low, width, k, own["floor"]), Exact()
        for b in slices(batches, ROWS):
            if apart:
                for r in _runs(b):
                    s.block(*_cells(r), files.rows(r.column(2)[0].as_py(), np.asarray(r.column(3))))
            else:
                s.block(*_cells(b), [x.as_buffer() for x in b.column(2)])
        for at in range(0, len(own["ids"]), ROWS):
            rows = [(q, v, -n) for q, best in zip(own["ids"][at : at + ROWS].tolist(), s.best[at : at + ROWS]) for n, v in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    read = index.select("vec_id", "cells", "_metadata.file_path", "_metadata.row_index") if apart else index.select("vec_id", "cells", "exact")
    return map_rows(read, run, "query_id bigint, vec_id bigint, score bigint")


def _opened(paths: list[str]) -> bool:
    """Whether files of the index can be opened from Python."""
    try:
        for path in paths[:1]:
            where, name = fs.FileSystem.from_uri(path)
            where.open_input_file(name).close()
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row that the condition names, the k best of the other rows."""
    spark = vectors.sparkSession
    ship(spark)
    whole = whole_numbers(vectors, scale, vec_id, embedding)
    low, width = grid(whole)
    # Row groups of about ROWS rows, so that few exact vectors come with one that is asked for.
    folder = written(va_index(whole, low, width), {"parquet.block.size": str(ROWS * (9 * len(low) + 16))})
    index = spark.read.schema("vec_id bigint, cells binary, exact binary").parquet(folder)
    apart = _opened(index.inputFiles())
    asked = checkpointed(whole_numbers(vectors.where(queries), scale, vec_id, embedding).groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks, found = max(1, -(-asked.count() // query_block)), []
    for i in range(blocks):
        # Blocks by hash: about query_block queries each, whatever their number.
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").toArrow()
        if not got.num_rows:
            continue
        ids, q = np.asarray(got.column(0)), _matrix(got.column(1).combine_chunks(), len(low))
        block = {"ids": ids, "queries": q, "floor": np.full(len(ids), -np.inf)}
        block["floor"] = _floors(index, block, low, width, k)
        every = _found(index, apart, block, low, width, k)
        ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
        found.append(checkpointed(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
    deleted(spark, folder)
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from askbook.llm import topk as K


def plain(rows, k, scale=256, every=3):
    whole = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in whole if i % every == 0}:
        own = min(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def rows(seed, n, dim=16):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.2) for _ in range(dim)] for _ in range(5)]
    out = [(i, [c + r.gauss(0, 0.05) for c in r.choice(centres)]) for i in range(n)]
    out += [(n + i, out[i][1]) for i in range(0, n, 7)]  # ties
    out += [(5000, None), (5001, [None] * dim), (5004, [float("nan")] * dim), (None, [1.0] * dim), (5007, [float("inf")] + [0.0] * (dim - 1)), (6, out[8][1]), (9, out[9][1]), (5010, []), (5013, [0.5])]
    return out


@pytest.mark.parametrize("seed,block,rows_read,apart", [(1, 10, 4096, True), (2, 16_384, 25, True), (3, 16_384, 4096, False)])
def test_matches_brute_force(spark, monkeypatch, seed, block, rows_read, apart):
    monkeypatch.setattr(K, "ROWS", rows_read)
    if not apart:
        monkeypatch.setattr(K, "_opened", lambda paths: False)
    data = rows(seed, 200)
    frame = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id bigint, embedding array<double>, score int").repartition(3)
    got = K.top_k(frame, F.col("vec_id") % 3 == 0, k=5, query_block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(data, 5)


@pytest.mark.parametrize("copies", [6, 12])
def test_many_rows_of_the_query_take_no_others_place(spark, copies):
    r = random.Random(copies)
    data = [(i, [r.gauss(0, 0.1) for _ in range(16)]) for i in range(300)]
    data += [(i, [x * 1.01 for x in data[i][1]]) for i in range(0, 300, 3) for _ in range(copies)]
    got = K.top_k(spark.createDataFrame(data, "vec_id bigint, embedding array<double>").coalesce(1), F.col("vec_id") % 3 == 0)
    assert sorted(map(tuple, got.collect())) == plain(data, 5)


def test_few_rows_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert K.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 3 == 0).count() == 0
    assert K.top_k(spark.createDataFrame([(3, [1.0])], schema), F.col("vec_id") % 3 == 0).count() == 0
    assert K.top_k(spark.createDataFrame([(1, [1.0]), (2, [2.0])], schema), F.col("vec_id") % 3 == 0).count() == 0
    assert K.top_k(spark.createDataFrame([(3, [1.0]), (2, [2.0])], schema), F.col("vec_id") % 3 == 0).collect() == [(3, 1, 2, 256 * 512)]


def test_large_numbers_are_exact(spark):
    data = [(i, [float(2**20 + i * 3), float(-(2**19) + i)]) for i in range(30)]
    got = K.top_k(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 3 == 0)
    assert sorted(map(tuple, got.collect())) == plain(data, 5)
    with pytest.raises(Exception, match="64 bits|62 bits"):
        K.top_k(spark.createDataFrame([(0, [1e18]), (3, [1e18])], "vec_id bigint, embedding array<double>"), F.col("vec_id") % 3 == 0).collect()


def test_reads_few_exact_vectors():
    r = np.random.default_rng(0)
    x = np.floor(r.normal(0, 32, (4000, 64))).astype(np.int64)
    low, high = x.min(0), x.max(0)
    width = np.maximum(1, -(-(high - low + 1) // K.CELLS))
    s = K.Search(np.arange(20), x[:20], low, width, 5, np.full(20, -np.inf))
    s.block(np.arange(4000), ((x - low) // width).astype(np.uint8), [v.tobytes() for v in x])
    assert s.read < 0.1 * s.seen


def test_reads_few_row_groups(spark, tmp_path):
    r = np.random.default_rng(1)
    x = np.floor(r.normal(0, 8, (20_000, 16)) + np.repeat(r.normal(0, 60, (20, 16)), 1000, 0)).astype(np.int64)  # a run of rows for each of 20 centres
    whole = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, v array<bigint>").coalesce(1)
    low, width = K.grid(whole)
    K.va_index(whole, low, width).write.option("parquet.block.size", 1000 * (9 * 16 + 16)).parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    block = {"ids": np.arange(0, 3), "queries": x[:3], "floor": np.full(3, -np.inf)}
    floor = K._floors(index, block, low, width, 5)
    best = np.sort(x @ x[:3].T, axis=0)[-6:]
    assert (floor <= best[1]).all() and (floor > best[1] - 2 * np.abs(x[:3]) @ width).all()
    s, files = K.Search(block["ids"], block["queries"], low, width, 5, floor), K.Exact()
    got = index.select("vec_id", "cells", "_metadata.file_path", "_metadata.row_index").toArrow()
    for b in got.to_batches(max_chunksize=500):
        for run in K._runs(b):
            s.block(*K._cells(run), files.rows(run.column(2)[0].as_py(), np.asarray(run.column(3))))
    assert 0 < files.groups_read < len(files.starts) / 2

"""Searches by the pivot index send blocks in passes and keep no more than they need."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reqscope.operators import neighbors as NB


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(31)
    rows = [(int(i), [float(np.float32(v)) for v in rng.normal(size=4)]) for i in rng.permutation(300)]
    return spark.createDataFrame(rows, "id long, vec array<float>")


def test_passes_give_the_same_neighbours_and_one_index_serves_both_searches(points, monkeypatch):
    made, stored, blocks = [], NB.stored, []
    monkeypatch.setattr(NB, "PASS_BYTES", 1)
    monkeypatch.setattr(NB, "BLOCK_ROWS", 16)
    monkeypatch.setattr(NB, "AGAINST", 2)
    monkeypatch.setattr(NB, "TOGETHER", 2)
    monkeypatch.setattr(NB, "stored", lambda df, name: made.append(name) or stored(df, name))
    inner = NB._blocks
    monkeypatch.setattr(NB, "_blocks", lambda rows, pivots, size: blocks.append(size) or inner(rows, pivots, size))
    a = {r.qid: r.lof for r in NB.lof(points, points.where("id % 3 > 0"), 5).collect()}
    b = {r.qid: r.lof for r in NB.lof(points, points.where("id % 3 > 0"), 5, broadcast_rows=0).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert len(blocks) == 3  # references once, and the queries of two searches
    assert made.count("knn-first") > 2 and made.count("knn-more") > 2
    kept = inner(points, np.zeros((1, 4)), 16)
    assert kept.select(F.sum(F.octet_length("vecs"))).first()[0] == 300 * 4 * 4  # floats stay floats


def test_a_unit_returns_no_more_than_k_rows_of_a_query():
    rng = np.random.default_rng(32)
    q, r = rng.normal(size=(6, 3)), rng.normal(size=(40, 3))
    block = lambda b, ids, v: {"block": b, "n": len(v), "ids": np.array(ids, np.int64).tobytes(), "vecs": v.tobytes()}
    asked = [{**block(9, range(100, 106), q), "wanted": [0, 1, 2, 3], "limits": np.full(6, np.inf).tobytes()}]
    refs = [block(k, range(10 * k, 10 * k + 10), r[10 * k:10 * k + 10]) for k in range(4)]
    got = NB._search_rest(5, False)(pa.Table.from_pylist(asked), pa.Table.from_pylist(refs)).to_pylist()
    want = np.argsort(((q[:, None] - r) ** 2).sum(2), axis=1)[:, :5]
    assert sorted((x["qid"], x["rid"]) for x in got) == sorted((100 + i, int(j)) for i in range(6) for j in want[i])

"""Exact kNN / LOF (J8, M8) vs NumPy brute force; isolation forest (M7) properties; E9."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqscope.operators import embed as E
from reqscope.operators import neighbors as NB
from reqscope.operators.iforest import IsolationForest


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    x[:10] += 6.0
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    return x, spark.createDataFrame(rows, "id long, vec array<float>")


def _brute_knn(q, r, k, exclude_self):
    d = ((q[:, None, :].astype(np.float64) - r[None, :, :]) ** 2).sum(-1)
    if exclude_self:
        np.fill_diagonal(d, np.inf)
    idx = np.argsort(d, axis=1, kind="stable")[:, :k]
    return idx, np.sqrt(np.take_along_axis(d, idx, 1))


def test_knn_exact_and_block_independent(points):
    x, df = points
    a = NB.knn(df, df, 5, exclude_self=True).collect()
    b = NB.knn(df, df, 5, exclude_self=True, broadcast_rows=0, block=37).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) or \
        sorted((r.qid, r.rank, r.rid) for r in a) == sorted((r.qid, r.rank, r.rid) for r in b)
    idx, dist = _brute_knn(x, x.astype(np.float64), 5, True)
    got = {(r.qid, r.rank): (r.rid, r.dist) for r in a}
    for i in range(len(x)):
        for j in range(5):
            rid, dd = got[(i, j + 1)]
            assert dd == pytest.approx(dist[i, j], rel=1e-9)


def test_knn_merges_reference_blocks(points):
    x, df = points
    a = {(r.qid, r.rank, r.rid) for r in NB.knn(df, df, 4, exclude_self=True).collect()}
    b = {(r.qid, r.rank, r.rid) for r in NB.knn(df, df, 4, exclude_self=True, broadcast_rows=0, block=23).collect()}
    assert a == b


def test_pivot_index_skips_pairs_and_survives_copies(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 30
    x = np.concatenate([c + rng.normal(size=(60, 8)) for c in centres] + [np.repeat(centres[:1], 300, 0)])  # a third are copies
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "id long, vec array<double>").repartition(3)
    work: dict = {}
    got = {(r.qid, r.rank): (r.rid, r.dist) for r in NB.knn(df, df, 6, exclude_self=True, broadcast_rows=0, block=64, work=work).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, 1, kind="stable")[:, :6]
    for i in range(len(x)):
        for j in range(6):
            assert got[i, j + 1][1] == pytest.approx(np.sqrt(d[i, order[i, j]]), rel=1e-9, abs=1e-12)
    assert [got[800, j + 1][0] for j in range(6)] == order[800].tolist()  # ties by id
    assert 0 < work["opened"] < 0.5 * work["pairs"]


def test_later_blocks_return_only_what_is_within_a_rows_own_kth(points):
    import pyarrow as pa

    x, _ = points
    v, ids = x.astype(np.float64), np.arange(len(x))
    block = lambda k, at: {"block": k, "n": len(at), "ids": ids[at].tobytes(), "vecs": v[at].tobytes()}
    q, near, far = np.arange(5, 60), np.arange(0, 150), np.arange(150, 300)
    first = NB._search_homes(4, True)(pa.Table.from_pylist([block(7, q)]), pa.Table.from_pylist([block(1, near)])).to_pylist()[0]
    asked = pa.Table.from_pylist([{**block(7, q), "wanted": [2], "limits": first["limits"]}])
    more = NB._search_rest(4, True)(asked, pa.Table.from_pylist([block(2, far), block(3, near)])).to_pylist()
    d = np.sqrt(((v[q][:, None] - v[None]) ** 2).sum(-1))
    d[np.arange(len(q)), q] = np.inf
    kth = np.sort(d[:, near], 1)[:, 3]
    want = {(int(i), int(j)) for a, i in enumerate(q) for j in sorted(far, key=lambda j: (d[a, j], j))[:4] if d[a, j] <= kth[a]}
    assert {(r["qid"], r["rid"]) for r in more} == want and 0 < len(want) < 4 * len(q)
    assert all(r["dist"] == pytest.approx(d[r["qid"] - 5, r["rid"]], rel=1e-12) for r in more)


def test_pivot_index_sends_a_block_once_for_several_pairs(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(640, 6)))], "id long, vec array<double>")
    work: dict = {}
    got = {(r.qid, r.rank, r.rid) for r in NB.knn(df, df, 3, exclude_self=True, broadcast_rows=0, block=16, work=work).collect()}
    assert got == {(r.qid, r.rank, r.rid) for r in NB.knn(df, df, 3, exclude_self=True).collect()}
    assert work["sent"] < 0.25 * work["opened"]


def test_pivot_index_with_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, vec array<double>")
    got = sorted(map(tuple, NB.knn(df, df, 5, exclude_self=True, broadcast_rows=0).collect()))
    assert got == [(1, 1, 2, 5.0), (2, 1, 1, 5.0)]
    assert NB.knn(df, df.limit(0), 5).count() == 0 and NB.knn(df.limit(0), df, 5, broadcast_rows=0).count() == 0


def test_lof_is_the_same_by_either_way(points):
    _, df = points
    a, b = ({r.qid: r.lof for r in NB.lof(df, df.where(F.col("id") >= 10), 10, "vec", broadcast_rows=n).collect()} for n in (0, 1000))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


def test_lof_matches_brute_force(points):
    x, df = points
    k = 10
    got = {r.qid: r.lof for r in NB.lof(df, df.where(F.col("id") >= 10), k, "vec").collect()}
    ref = x[10:].astype(np.float64)
    d = ((ref[:, None] - ref[None]) ** 2).sum(-1) ** 0.5
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, 1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, nn, 1)[:, -1]
    lrd = 1 / (np.maximum(kd[nn], np.take_along_axis(d, nn, 1)).mean(1) + 1e-10)
    q = x.astype(np.float64)
    dq = ((q[:, None] - ref[None]) ** 2).sum(-1) ** 0.5
    nq = np.argsort(dq, 1, kind="stable")[:, :k]
    lrd_q = 1 / (np.maximum(kd[nq], np.take_along_axis(dq, nq, 1)).mean(1) + 1e-10)
    exp = lrd[nq].mean(1) / lrd_q
    for i in range(len(x)):
        assert got[i] == pytest.approx(exp[i], rel=1e-6)
    assert np.mean([got[i] for i in range(10)]) > 1.5


def test_isolation_forest_properties(points):
    x, df = points
    f = IsolationForest(n_trees=20, max_samples=64, seed=1).fit(df.where(F.col("id") >= 10), "id", "vec")
    s = {r.id: r.y_score for r in f.score(df, "vec").collect()}
    assert all(0 < v <= 1 for v in s.values())
    assert np.mean([s[i] for i in range(10)]) > np.mean([s[i] for i in range(10, 300)])
    g = IsolationForest(n_trees=20, max_samples=64, seed=1).fit(df.where(F.col("id") >= 10).repartition(5),
                                                                "id", "vec")
    assert g.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        f.nodes.sort_values(["tree", "node"]).reset_index(drop=True))


def test_pca_variance_matches_numpy(points):
    x, df = points
    got = [r.explained_variance_ratio for r in E.pca_variance(df, "vec").orderBy("component").collect()]
    xc = x.astype(np.float64) - x.mean(0)
    sv = np.linalg.svd(xc, compute_uv=False) ** 2
    assert got == pytest.approx(list(sv / sv.sum())[:len(got)], rel=1e-6)


def test_embed_requests_mean_of_distinct_lines(spark):
    req = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "a"]), (2, [])], "pos long, lines array<string>")
    vecs = {"a": [1.0, 0.0], "b": [0.0, 2.0]}

    def line_vectors(lines):
        table = spark.createDataFrame([(k, v) for k, v in vecs.items()], "line string, vec array<float>")
        return lines.join(table, "line")
    got = {r.pos: list(r.embedding) for r in E.embed_requests(req, line_vectors, 2).collect()}
    assert got == {0: [0.5, 1.0], 1: [1.0, 0.0], 2: [0.0, 0.0]}


def test_dedup_reeval_parses_the_pages_once(spark, monkeypatch):
    """Both models read rows that are kept, not the pages again."""
    from reqscope.plans import queries_models as Q

    class Seen(Exception):
        pass

    def seen(frame, keys, *rest):
        for df in (frame, keys):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "html" not in plan and "regexp" not in plan
        raise Seen

    monkeypatch.setattr(Q.ML, "holdout_predictions", lambda frame, *a, **k: frame)
    monkeypatch.setattr(Q.ML, "dedup_reevaluate", seen)
    with pytest.raises(Seen):
        Q.q_dedup_reeval(spark, "/root/testdata/sf0.001")

"""Passes of the linear models hold a bounded part of a batch, however long its rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from reqscope.operators import optim as O

ROWS, EACH, D = 2000, 2000, 5000


@pytest.fixture(scope="module")
def batch():
    rng = np.random.default_rng(41)
    idx = np.sort(rng.integers(0, D, (ROWS, EACH)).astype(np.int32), 1)
    at = pa.array(np.arange(0, ROWS * EACH + 1, EACH, dtype=np.int32))
    cols = [pa.array(rng.integers(0, 2, ROWS)), pa.ListArray.from_arrays(at, pa.array(idx.ravel())), pa.ListArray.from_arrays(at, pa.array(rng.random(ROWS * EACH)))]
    return pa.RecordBatch.from_arrays(cols, ["y", "idx", "val"])


@pytest.mark.parametrize("one_pass", [O._svc_pass, O._logistic_pass])
@pytest.mark.parametrize("want", ["gradient", "product"])
def test_a_pass_over_long_rows_holds_a_part_of_the_batch(batch, one_pass, want, monkeypatch):
    rng = np.random.default_rng(42)
    theta, v = rng.normal(size=D + 1) / 100, rng.normal(size=D + 1)
    run = lambda: next(iter(one_pass(theta, D, want, v)(iter([batch])))).to_pylist()[0]
    tracemalloc.start()
    got = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 4 * O.VALUES + (1 << 22)
    monkeypatch.setattr(O, "VALUES", ROWS * EACH)
    whole = run()
    assert got["loss"] == pytest.approx(whole["loss"], rel=1e-12)
    assert np.frombuffer(got["grad"]) == pytest.approx(np.frombuffer(whole["grad"]), rel=1e-9, abs=1e-9)


def test_parts_keep_every_row_in_order(batch, monkeypatch):
    monkeypatch.setattr(O, "VALUES", 3 * EACH + 1)
    parts = list(O._parts(iter([batch.slice(5, 20), batch.slice(0, 0), batch.slice(90, 1)])))
    assert [p.num_rows for p in parts] == [3] * 6 + [2, 1]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch.slice(5, 20), batch.slice(90, 1)]))

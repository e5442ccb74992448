"""The columns of all rows are built without a second array of their size."""

import tracemalloc

import numpy as np

from tavola.llm import nbsvm


def test_columns_take_little_more_memory_than_they_fill():
    rng = np.random.default_rng(2)
    rows, each = 4_000, 600
    cols = np.sort(rng.integers(0, nbsvm.DIM, (rows, each)), axis=1)
    at = np.arange(rows + 1) * each
    highs = np.stack([np.bincount(c >> 16, minlength=nbsvm.HIGHS) for c in cols]).ravel()
    low = nbsvm._binary((cols.ravel() & 0xFFFF).astype("<u2"), at)
    high = nbsvm._binary(highs.astype("<i4"), np.arange(rows + 1) * nbsvm.HIGHS)
    tracemalloc.start()
    flat, width = nbsvm._columns(low, high)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (flat == cols.ravel()).all() and (width == each).all()
    assert peak < 1.8 * flat.nbytes  # 16-bit input, the result and a few rows more
    assert [len(a) for a in nbsvm._columns(low.slice(0, 0), high.slice(0, 0))] == [0, 0]

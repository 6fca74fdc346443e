"""A task of nearest neighbours compares its tile in stretches."""

import tracemalloc

import numpy as np

from threadloom.operators import nearest


def test_a_tile_is_compared_in_stretches():
    """Memory of a block goes by the stretch and not by the tile; the rows are those of brute force."""
    draw = np.random.default_rng(8)
    index = draw.normal(size=(60_000, 4)).astype(np.float32).astype(np.float64)
    index[40_000:40_300] = index[7]
    queries = np.concatenate([index[7:8], draw.normal(size=(127, 4))])
    tracemalloc.start()
    row, position, distance = nearest.closest(queries, index, np.arange(len(index)), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    exact = ((queries[:, None, :] - index[None, :, :]) ** 2).sum(axis=2)
    expected = np.array([np.lexsort((np.arange(len(index)), d))[:3] for d in exact])
    assert row.tolist() == np.repeat(np.arange(128), 3).tolist() and position.tolist() == expected.ravel().tolist()

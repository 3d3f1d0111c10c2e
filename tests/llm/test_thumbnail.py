"""Thumbnail hashes."""

import numpy as np

from oppflow.llm import media


def plain(dc):
    h, w = dc.shape
    cut = lambda n, k: slice(k * n // 8, max((k + 1) * n // 8, k * n // 8 + 1))
    areas = np.array([[dc[cut(h, i), cut(w, j)].mean() for j in range(8)] for i in range(8)])
    return np.packbits(areas > areas.mean()).tobytes().hex()


def test_every_block_counts_in_the_thumbnail_hash():
    dc = np.zeros((40, 40), np.int64)
    other = dc.copy()
    other[1:5, 1:5] = 100  # beside the corner of the first area
    assert media.thumbnail_hash(dc) == "0" * 16 and media.thumbnail_hash(other) == "8" + "0" * 15
    rng = np.random.default_rng(1)
    for shape in ((1, 2), (3, 9), (8, 8), (13, 50), (127, 126)):
        dc = rng.integers(-1000, 1000, shape)
        assert media.thumbnail_hash(dc) == plain(dc), shape
    assert media.thumbnail_hash(np.full((13, 11), 7)) == "0" * 16

"""Bit-sliced comparison: exact within the radius, and blocks beyond it are left early."""

from __future__ import annotations

import numpy as np
import pytest

from trialscope.llm import simhash


@pytest.mark.parametrize("n,radius,skip", [(1, 4, 0), (64, 4, 0), (130, 4, 0xFFF), (200, 0, 0), (333, 9, 1 << 63), (70, 20, 0)])
def test_within_is_exact(n, radius, skip):
    r = np.random.default_rng(n)
    values = r.integers(0, 1 << 64, n, dtype=np.uint64) & ~np.uint64(skip)
    near = values[:max(1, n // 3)] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 63, (max(1, n // 3), 5)).astype(np.uint64), axis=1) & ~np.uint64(skip)
    queries = np.concatenate((near, values[:5]))
    got = simhash.within(queries, simhash.planes(values), n, radius, skip)
    want = np.array([[bin(int(q ^ v)).count("1") <= radius for v in values] for q in queries])
    assert (got == want).all()


def test_own_lane_is_left_out():
    values = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = simhash.within(values, simhash.planes(values), 100, 4, own=np.arange(100))
    want = simhash.within(values, simhash.planes(values), 100, 4) & ~np.eye(100, dtype=bool)
    assert (got == want).all()


def test_blocks_beyond_the_radius_are_abandoned(monkeypatch):
    r = np.random.default_rng(1)
    values = r.integers(0, 1 << 64, 6400, dtype=np.uint64)
    read, real = [], simhash.unfinished

    def noted(beyond):
        read.append((len(beyond), len(real(beyond))))
        return real(beyond)
    monkeypatch.setattr(simhash, "unfinished", noted)
    hit = simhash.within(values[:64], simhash.planes(values), 6400, 4, own=np.arange(64))
    assert not hit.any() and read[0][0] == 6400
    assert read[-1][1] == 0 and sum(left for _, left in read) < 0.2 * 12 * 6400  # 12 more rounds over all blocks without it

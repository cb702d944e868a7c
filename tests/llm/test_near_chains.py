"""Pigeonring chains of 128-bit fingerprints: what is sure and what share of the rest meets."""

import math

import numpy as np

from memlattice.llm import near_copies


def test_every_ring_finds_all_pairs_within_the_sure_bits():
    draw = np.random.default_rng(1)
    width, orders = near_copies.rings(10)
    differ = np.zeros((3000, near_copies.BITS), dtype=bool)
    for row in differ:
        if draw.random() < 0.5:  # spread over the segments of the first ring
            row[orders[0][near_copies.WIDTH * draw.choice(near_copies.SEGMENTS, 10, replace=False)]] = True
        else:
            row[draw.choice(near_copies.BITS, 10, replace=False)] = True
    for ring in orders:
        met = np.zeros(len(differ), dtype=bool)
        for turn in near_copies.turns(ring):
            chain = differ[:, turn]
            sums = chain.reshape(len(chain), near_copies.SEGMENTS, -1).sum(axis=2).cumsum(axis=1)
            within = np.all(sums <= [k * near_copies.MOST // near_copies.SEGMENTS for k in range(1, near_copies.SEGMENTS + 1)], axis=1)
            halves = np.ascontiguousarray(np.packbits(chain, axis=1)).view(np.int64)
            assert (near_copies._within(halves[:, 0].copy(), halves[:, 1].copy()) == within).all()
            met |= within & np.any([~chain[:, part].any(axis=1) for part in near_copies.parts(width)], axis=0)
        assert met.all()


def test_most_similar_fingerprints_meet_where_keys_are_long(spark):
    draw = np.random.default_rng(4)
    bits = draw.random((800, near_copies.BITS)) < 0.5
    other = bits ^ (draw.random(bits.shape) < math.acos(1.6 / 1.8) / math.pi)  # as often as at a similarity of 0.8
    words = np.packbits(np.concatenate([bits, other]), axis=1).view(np.int64)
    frame = spark.createDataFrame([(k, *map(int, row)) for k, row in enumerate(words)], "node long, lo long, hi long")
    roots = {r.node: r.root for r in near_copies.candidates(frame, 10**7).collect()}
    met = sum(roots.get(k) == k and roots.get(k + 800) == k for k in range(800))
    assert met > 0.94 * 800 and all(roots[k] % 800 == k % 800 for k in roots)
    assert abs(met / 800 - near_copies.expected_recall(0.8, 10**7)) < 0.03

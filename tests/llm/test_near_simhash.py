"""The near-dedup stage's SimHash and its multi-index, against their definitions."""

import numpy as np

from lamina.llm import near_copies as nc


def test_fingerprint_is_the_majority_of_each_bit():
    for n in (1, 2, 3, 4, 10, 2500):
        own = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64))
        x = (own[:, None] ^ nc._SALT) * nc._MIX
        x ^= x >> np.uint64(32)
        x *= nc._MORE
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.view(np.uint8), axis=1)
        assert nc.fingerprint(own) == np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(own)).tobytes()


def test_pairs_at_the_limit_agree_in_a_segment():
    rng, places, met = np.random.default_rng(1), nc.segments(200_000), 0
    for _ in range(300):
        own = rng.integers(0, 1 << 63, 200, np.uint64)  # 160 shared of 200
        a, b = (np.unpackbits(np.frombuffer(nc.fingerprint(np.sort(x)), np.uint8)) for x in (own[:180], np.concatenate((own[:160], own[180:200]))))
        met += bool((a[places] == b[places]).all(axis=1).any()) and int((a != b).sum()) < nc.FAR
    assert met >= 299

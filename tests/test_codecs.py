"""Round trips of every code over sizes, magnitudes, and known and unknown sums."""

import numpy as np
import pytest

from quern.functions import codecs


@pytest.mark.parametrize("name", sorted(codecs.CODECS))
@pytest.mark.parametrize("known", [True, False])
def test_round_trip(name, known):
    r = np.random.default_rng(12345)
    codec = codecs.CODECS[name]
    for n in (0, 1, 3, 7, 8, 16, 127, 128, 255, 256, 700):
        for magnitude in (0, 1, 2, 3, 5, 8, 11, 16, 20, 24, 27):
            v = r.integers(0, (1 << magnitude) + 1, n)
            if magnitude == 11:
                v[r.random(n) < 0.95] = 0  # mostly zeros, some large
            total = int(v.sum()) if known else None
            assert codec.decode(codec.encode(v, total), n, total).tolist() == v.tolist(), (n, magnitude)


@pytest.mark.parametrize("name", ["vbyte", "maskedvbyte", "streamvbyte", "varintgb", "u32", "varintg8iu", "gamma", "delta", "interpolative", "qmx"])
def test_large_values(name):
    v = np.array([0, 2**32 - 1, 127, 128, 2**14, 2**21, 2**28, 255, 256, 65535, 65536, 2**24], np.int64)
    codec = codecs.CODECS[name]
    assert codec.decode(codec.encode(v, None), len(v), None).tolist() == v.tolist()


def test_monotone():
    r = np.random.default_rng(42)
    for n, u in ((1, 1), (1, 2), (1, 100_000), (42, 100_000), (500, 500), (1000, 1100), (3000, 9000), (2000, 2000 * 1024)):
        v = np.sort(r.choice(u, n, replace=False))
        for name in codecs.MONOTONE:
            c = codecs.MONOTONE[name]
            assert c.decode(c.encode(v, u), n, u).tolist() == v.tolist(), (name, n, u)
        w = np.sort(r.integers(0, u, n))
        assert codecs.elias_fano_decode(codecs.elias_fano_encode(w, u), n, u).tolist() == w.tolist()


def test_sizes():
    v = np.array([1, 130, 20_000, 3_000_000, 2**28])
    assert len(codecs.vbyte_encode(v)) == 1 + 2 + 3 + 4 + 5
    assert len(codecs.stream_encode(v)) == len(codecs.group_encode(v)) == 2 + 1 + 1 + 2 + 3 + 4
    assert len(codecs.u32_encode(v)) == 20
    assert codecs.mixed_encode(v[:4])[1:] == min((codecs.CODECS[c].encode(v[:4]) for c in codecs.MIXED), key=len)
    assert sum(map(codecs.gamma_bits, (0, 1, 2, 6))) == 1 + 3 + 3 + 5

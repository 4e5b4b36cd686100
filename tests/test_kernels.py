import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bioquery.operators import kernels as k


def adversarial():
    r = np.random.default_rng(42)
    for n in (0, 1, 2, 7, 8, 100, 313, 625, 2501):
        yield from (np.zeros(n, int), np.ones(n, int), np.full(n, 32767), np.full(n, -32768), np.where(np.arange(n) % 2, 32767, -32768), np.arange(n) - n // 2, r.integers(-5000, 5000, n), r.normal(0, 300, n).astype(int))
    spike = np.zeros(500, int)
    spike[250] = 30000
    yield spike


@pytest.mark.parametrize("x", adversarial(), ids=lambda x: f"{len(x)}")
def test_round_trips(x):
    x = x.astype(np.int64)
    assert (k.bias_restore(k.bias_cancel(x)) == x).all()
    assert (k.unzigzag(k.zigzag(x)) == x).all()
    assert (k.golomb_decode(k.golomb_encode(x)) == x).all()
    assert (k.bit_unpack(k.bit_pack(x)) == x).all()
    assert (k.unlift(*k.lift(x)) == x).all()
    assert (k.decode_window(k.encode_window(x)) == x).all()
    _, recon = k.bounded_dpcm(x, 3)
    assert not len(x) or np.abs(recon - x).max() <= 3
    for c in ([], [1 << 27], [240_000_000, -110_000_000]):
        assert (k.lpc_synthesis(k.lpc_residual(x, c), c) == x).all()
    if len(x) < 700:
        assert (k.rls_residual(k.rls_residual(x), restore=True) == x).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-32768, 32767), min_size=32, max_size=512))
def test_window_codec(x):
    x = np.array(x)
    assert (k.decode_window(k.encode_window(x)) == x).all()


def test_coding_saves_on_a_smooth_signal():
    t = np.arange(2500)
    x = (4000 * np.sin(t / 12) + 500 * np.sin(t / 3)).astype(np.int64)
    assert sum(len(d) + 4 * len(c) for c, d in k.encode_window(x)) < 0.6 * 2 * len(x)
    assert np.abs(k.lpc_residual(x, k.lpc_adaptive(x))[16:]).mean() < 0.1 * np.abs(x).mean()


def test_rans():
    s = np.random.default_rng(1).geometric(0.4, 3000).clip(1, 12) - 1
    data, freq = k.rans_encode(s)
    assert (k.rans_decode(data, freq, len(s)) == s).all()
    p = np.bincount(s) / len(s)
    assert len(data) * 8 < 1.05 * len(s) * -(p * np.log2(p)).sum() + 64


def test_scales():
    x = np.random.default_rng(2).normal(size=500).astype(np.float32)
    for bits in (8, 16):
        scale, mant = k.bfp_quantize(x, bits)
        assert np.abs(mant).max() == (1 << (bits - 1)) - 1
        assert np.abs(k.bfp_dequantize(scale, mant) - x).max() <= scale * 0.5001
    assert k.q31(np.zeros((2, 5))) is None
    assert np.abs(k.q31([[1, -4], [2, 3]])).max() == int(0.72 * 2147483647)


def test_zero_phase_and_resample():
    t = np.arange(5000) / 250
    fast, drift = np.sin(2 * np.pi * 10 * t), 50 + 3 * t
    y = k.zero_phase(fast + drift)
    assert np.abs(y - fast)[500:-500].max() < 0.1
    assert (k.zero_phase(np.arange(9)) == np.arange(9)).all()
    half = k.resample(fast, 1, 2)
    assert len(half) == 2500
    assert np.abs(half - fast[::2])[50:-50].max() < 0.01
    odd = k.resample(fast, 257, 500)
    assert len(odd) == -(-5000 * 257 // 500)


def test_change_points():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 10, 2000), r.normal(0, 300, 2000), r.normal(0, 300, 1000)])
    at = np.flatnonzero(k.change_points(x))
    assert any(2000 <= i < 2100 for i in at)
    assert not any(600 <= i < 2000 for i in at)


def test_biquad_saturates():
    assert (k.biquad_q30([1 << 30] * 3, (1 << 33, 0, 0), (0, 0)) == (1 << 31) - 1).all()

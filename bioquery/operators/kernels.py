"""Sequential kernels on one channel window, in numpy; ``per_group`` runs them on groups of a DataFrame.

A group is one window or channel, whose state is its own, so groups run in
parallel and a lost one is computed again alone.
"""

import math
import operator

import numpy as np
from pyspark.sql import DataFrame

#: Prediction orders of the fixed schedule, from the approximation band on: fixed values.
FIXED_ORDERS = (3, 3, 6, 8)
LPC_SHIFT = 27


def per_group(df: DataFrame, kernel, keys=("ch", "win"), value="x", order="t", out="y long") -> DataFrame:
    """Rows (keys, order, value, out): kernel maps the ordered values of a group to as many results."""
    name = out.split()[0]
    keys = list(keys)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in [*keys, order, value]) + f", {out}"

    def run(pdf):
        pdf = pdf.sort_values(order)
        pdf[name] = kernel(pdf[value].to_numpy())
        return pdf[[*keys, order, value, name]]

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


def bias_cancel(x, width=32):
    total = np.concatenate([[0], np.cumsum(x)])
    at = np.arange(len(x))
    return x - (total[at] - total[np.maximum(at - width, 0)]) // width


def bias_restore(y, width=32):
    out, total = np.empty(len(y), dtype=np.int64), 0
    for i, v in enumerate(y.tolist()):
        out[i] = v + total // width
        total += int(out[i]) - (int(out[i - width]) if i >= width else 0)
    return out


def autocorrelation(x, order):
    x = np.asarray(x, dtype=np.float64)
    return [float(np.sum(x[: len(x) - k] * x[k:])) / max(1, len(x)) for k in range(order + 1)]


def levinson(r, order):
    """(coefficients by order, error by order) of the Durbin recursion."""
    a, errors, all_a = [], [r[0]], [[]]
    e = r[0]
    for k in range(1, order + 1):
        if e <= 0:
            break
        reflection = (r[k] - sum(c * r[k - 1 - j] for j, c in enumerate(a))) / e
        a = [c - reflection * d for c, d in zip(a, reversed(a), strict=True)] + [reflection]
        e *= 1 - reflection * reflection
        errors.append(e)
        all_a.append(a)
    return all_a, errors


def lpc_fixed(x, order):
    """Fixed-point coefficients from the first half of the window, 256 samples at most."""
    n = max(1, min(256, len(x) // 2))
    found, _ = levinson(autocorrelation(x[:n], order), order)
    a = found[-1]
    return [round(c * (1 << LPC_SHIFT)) for c in a]


def lpc_adaptive(x, most=16):
    """Coefficients of the order that costs least: bits of the residual and 32 bits a coefficient."""
    n = len(x)
    found, errors = levinson(autocorrelation(x, min(most, max(0, n - 1))), min(most, max(0, n - 1)))
    cost = [0.72 * n * math.log(max(e, 1e-12)) + 32 * math.log(2) * k for k, e in enumerate(errors)]
    return [round(c * (1 << LPC_SHIFT)) for c in found[int(np.argmin(cost))]]


def lpc_residual(x, coefficients):
    k = len(coefficients)
    samples = np.asarray(x, dtype=np.int64)
    if len(samples) and int(np.abs(samples).max()) * (sum(abs(int(c)) for c in coefficients) + 1) < 1 << 62:
        total = np.zeros(len(samples), dtype=np.int64)
        for j, c in enumerate(coefficients):
            total[j + 1 :] += int(c) * samples[: len(samples) - j - 1]
        return samples - np.where(np.arange(len(samples)) < k, 0, total >> LPC_SHIFT)
    x = [int(v) for v in x]  # sums that don't fit 64 bits
    return np.array([v if i < k else v - (sum(c * x[i - 1 - j] for j, c in enumerate(coefficients)) >> LPC_SHIFT) for i, v in enumerate(x)], dtype=np.int64)


def lpc_synthesis(residual, coefficients):
    out, k = [], len(coefficients)
    for i, v in enumerate(residual.tolist()):
        out.append(v if i < k else v + (sum(c * out[i - 1 - j] for j, c in enumerate(coefficients)) >> LPC_SHIFT))
    return np.array(out, dtype=np.int64)


def zigzag(x):
    x = np.asarray(x, dtype=np.int64)
    return np.where(x >= 0, 2 * x, -2 * x - 1)


def unzigzag(z):
    z = np.asarray(z, dtype=np.int64)
    return np.where(z & 1, -(z >> 1) - 1, z >> 1)


def rice_parameter(z):
    some = z[z != 0]
    mean, k = float(some.mean()) if len(some) else 0.0, 0
    while mean >= 2 and k < 31:
        mean, k = mean / 2, k + 1
    return k


def golomb_encode(x):
    """Parameter byte, count as two bytes, then unary quotients (ones ended by a zero) with k low bits each."""
    z = zigzag(x)
    if len(z) > 65535:
        raise ValueError("a window has 65535 samples at most")
    k = rice_parameter(z)
    q = z >> k
    size = q + 1 + k
    ends = np.cumsum(size)
    bits = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    stop = ends - k - 1
    bits[stop] = 0
    for b in range(k):
        bits[stop + 1 + b] = z >> (k - 1 - b) & 1
    return bytes([k]) + len(z).to_bytes(2, "little") + np.packbits(bits).tobytes()


def golomb_decode(data):
    k, n = data[0], int.from_bytes(data[1:3], "little")
    bits = np.unpackbits(np.frombuffer(data[3:], dtype=np.uint8)).tolist()
    out, at = [], 0
    for _ in range(n):
        q = 0
        while bits[at]:
            q, at = q + 1, at + 1
        at += 1
        low = 0
        for _ in range(k):
            low, at = low << 1 | bits[at], at + 1
        out.append(q << k | low)
    return unzigzag(np.array(out, dtype=np.int64))


def bit_pack(x):
    """Width byte, count as four bytes, then zigzag codes of the smallest width."""
    z = zigzag(x)
    width = int(z.max()).bit_length() if len(z) else 0
    bits = (z[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)
    return bytes([width]) + len(z).to_bytes(4, "little") + np.packbits(bits).tobytes()


def bit_unpack(data):
    width, n = data[0], int.from_bytes(data[1:5], "little")
    bits = np.unpackbits(np.frombuffer(data[5:], dtype=np.uint8))[: width * n].reshape(n, width).astype(np.int64)
    return unzigzag(bits @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64)) if width else np.zeros(n, dtype=np.int64))


def rans_encode(symbols, total_bits=12):
    """(bytes, frequencies) by range asymmetric numeral systems with a 32-bit state and byte output."""
    symbols = np.asarray(symbols)
    count = np.bincount(symbols)
    scale = 1 << total_bits
    freq = np.maximum((count * scale) // max(1, len(symbols)), (count > 0).astype(int))
    freq[int(freq.argmax())] += scale - int(freq.sum())
    start = np.concatenate([[0], np.cumsum(freq)])
    state, out = 1 << 23, bytearray()
    for s in reversed(symbols.tolist()):
        f = int(freq[s])
        while state >= f << (31 - total_bits):
            out.append(state & 255)
            state >>= 8
        state = (state // f << total_bits) + state % f + int(start[s])
    return state.to_bytes(4, "little") + bytes(reversed(out)), freq


def rans_decode(data, freq, n, total_bits=12):
    start = np.concatenate([[0], np.cumsum(freq)])
    state, at, out = int.from_bytes(data[:4], "little"), 4, []
    for _ in range(n):
        slot = state & (1 << total_bits) - 1
        s = int(np.searchsorted(start, slot, side="right")) - 1
        out.append(s)
        state = int(freq[s]) * (state >> total_bits) + slot - int(start[s])
        while state < 1 << 23 and at < len(data):
            state, at = state << 8 | data[at], at + 1
    return np.array(out, dtype=np.int64)


def bounded_dpcm(x, delta):
    """(indices, reconstruction): prediction from the reconstruction, so no error exceeds delta."""
    step, last = 2 * delta + 1, 0
    indices, recon = [], []
    for v in np.asarray(x).tolist():
        e = v - last
        q = (abs(e) + delta) // step * (1 if e >= 0 else -1)
        last += q * step
        indices.append(q)
        recon.append(last)
    return np.array(indices, dtype=np.int64), np.array(recon, dtype=np.int64)


def rls_residual(x, order=8, forget=0.999, reset=16384, restore=False, before=()):
    """Residual of a recursive least-squares predictor with rounded predictions; restore undoes it.

    x starts at a reset; before has the samples ahead of it, the last of which count.
    """
    x = np.asarray(x).tolist()
    n, out = len(x), []
    last = np.zeros(n + order)  # samples from the last to the first, those to predict from as a slice
    ahead = list(before)[-order:] if order else []
    last[n : n + len(ahead)] = ahead[::-1]
    g, move, square = np.empty(order), np.empty(order), np.empty((order, order))
    for i, v in enumerate(x):
        if i % reset == 0:
            w, p = np.zeros(order), np.eye(order) * 1e-2
        past = last[n - i : n - i + order]
        guess = math.floor(sum(map(operator.mul, w.tolist(), past.tolist())) + 0.5)
        true = v + guess if restore else v
        out.append(true if restore else v - guess)
        np.matmul(p, past, out=g)
        np.divide(g, forget + float(past @ g), out=g)
        np.multiply(g, true - float(w @ past), out=move)
        np.add(w, move, out=w)
        np.multiply(g[:, None], past @ p, out=square)
        np.subtract(p, square, out=p)
        np.divide(p, forget, out=p)
        np.add(p, p.T, out=square)
        np.divide(square, 2, out=p)
        last[n - i - 1] = true
    return np.array(out, dtype=np.int64)


def rls_by_blocks(df: DataFrame, order=8, reset=16384, keys=("ch",)) -> DataFrame:
    """Rows (keys, t, y) of the residual, a block between resets to a task with the samples before it; t counts from 0 without gaps.

    Only the samples go over a reset, so blocks give what the whole channel gives.
    """
    from bioquery.operators import signal

    keys, kinds = list(keys), dict(df.dtypes)

    def run(pdf):
        pdf = pdf.sort_values("t")
        own = pdf["__own"].to_numpy()
        rows = pdf.loc[own, [*keys, "t"]]
        rows["y"] = rls_residual(pdf["x"].to_numpy()[own], order=order, reset=reset, before=pdf["x"].to_numpy()[~own])
        return rows

    near = signal.blocked(df.select(*keys, "t", "x"), before=order, size=reset)
    return near.groupBy(*keys, "__block").applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", t long, y long")


def change_points(x, fast=0.05, slow=0.002, ratio=4.0, dwell=256, warm=512):
    """1 where short-term energy leaves the long-term one by a factor, at least dwell samples apart."""
    out = np.zeros(len(x), dtype=np.int64)
    short = long_ = None
    last = -dwell
    for i, v in enumerate(np.abs(np.asarray(x, dtype=float)).tolist()):
        short = v if short is None else short + fast * (v - short)
        long_ = v if long_ is None else long_ + slow * (v - long_)
        if i >= warm and i - last >= dwell and (short > ratio * long_ or short * ratio < long_):
            out[i], last, long_ = 1, i, short
    return out


def bfp_quantize(x, bits=16):
    """(scale, mantissas) of float32 values: the largest magnitude takes the largest mantissa; ties away from zero."""
    x = np.asarray(x, dtype=np.float32)
    top = np.float32((1 << (bits - 1)) - 1)
    peak = np.abs(x).max() if len(x) else np.float32(0)
    if peak == 0:
        return np.float32(0), np.zeros(len(x), dtype=np.int64)
    scale = np.float32(peak / top)
    y = x / scale
    return scale, np.clip(np.sign(y) * np.floor(np.abs(y) + np.float32(0.5)), -top, top).astype(np.int64)


def bfp_dequantize(scale, mantissas):
    return np.asarray(mantissas, dtype=np.float32) * np.float32(scale)


def q31(channels, gain=0.72):
    """One scale for all channels, so that the peak is gain of full range; truncated; None for a flat recording."""
    x = np.asarray(channels, dtype=np.float64)
    peak = np.abs(x).max() if x.size else 0.0
    return None if peak == 0 else np.trunc(x / peak * gain * 2147483647).astype(np.int64)


def biquad_q30(x, b, a):
    """Second-order section in direct form I with 30 fractional bits, saturating to 32 bits."""
    x1 = x2 = y1 = y2 = 0
    out = []
    for v in np.asarray(x).tolist():
        y = (b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2) >> 30
        y = max(-(1 << 31), min((1 << 31) - 1, y))
        x1, x2, y1, y2 = v, x1, y, y1
        out.append(y)
    return np.array(out, dtype=np.int64)


def high_pass(rate, cutoff=0.5):
    """Numerator and denominator of a second-order Butterworth high-pass by the bilinear transform."""
    k = math.tan(math.pi * cutoff / rate)
    n = 1 / (1 + math.sqrt(2) * k + k * k)
    return (n, -2 * n, n), (1.0, 2 * (k * k - 1) * n, (1 - math.sqrt(2) * k + k * k) * n)


def filter_once(x, b, a, state=(0.0, 0.0)):
    z1, z2 = state
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        out[i] = y
    return out


def zero_phase(x, rate=250.0, cutoff=0.5, pad=9):
    """Forward and backward high-pass over an odd extension of 9 samples; short signals pass unchanged."""
    x = np.asarray(x, dtype=float)
    if len(x) <= pad:
        return x.copy()
    b, a = high_pass(rate, cutoff)
    z2 = b[2] - a[2] * sum(b) / sum(a)
    z1 = b[1] - a[1] * sum(b) / sum(a) + z2
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        y = filter_once(y, b, a, (z1 * y[0], z2 * y[0]))[::-1]
    return y[pad:-pad]


def resample(x, up, down, half=10, beta=5.0):
    """Rational resampling by a windowed sinc; by the spectrum where the reduced factors exceed 256."""
    x = np.asarray(x, dtype=float)
    g = math.gcd(up, down)
    up, down = up // g, down // g
    n = -(-len(x) * up // down)
    if up == down:
        return x.copy()
    if max(up, down) > 256:
        spectrum = np.fft.rfft(x)
        size = n // 2 + 1
        spectrum = np.pad(spectrum, (0, max(0, size - len(spectrum))))[:size]
        return np.fft.irfft(spectrum, n) * n / len(x)
    most = max(up, down)
    taps = half * most
    h = np.sinc(np.arange(-taps, taps + 1) / most) * np.kaiser(2 * taps + 1, beta)
    h *= up / h.sum()
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.convolve(wide, h)[taps : taps + len(wide)][::down][:n]


def lift(x):
    """(approximation, detail) of one level of the integer 5/3 transform."""
    x = np.asarray(x, dtype=np.int64)
    if len(x) < 2:
        return x.copy(), x[:0].copy()
    a, d = x[::2].copy(), x[1::2].copy()
    right = np.append(a[1:], a[-1])[: len(d)]
    d -= np.where(np.arange(len(d)) + 1 < len(a), (a[: len(d)] + right) >> 1, a[: len(d)])
    return a + _update(len(a), d), d


def _update(n, d):
    i = np.arange(n)
    left, here = d[np.clip(i - 1, 0, len(d) - 1)], d[np.clip(i, 0, len(d) - 1)]
    return np.where(i == 0, (here + 1) >> 1, np.where(i < len(d), (left + here + 2) >> 2, (left + 1) >> 1))


def unlift(a, d):
    if not len(d):
        return np.asarray(a).copy()
    even = a - _update(len(a), d)
    right = np.append(even[1:], even[-1])[: len(d)]
    odd = d + np.where(np.arange(len(d)) + 1 < len(even), (even[: len(d)] + right) >> 1, even[: len(d)])
    out = np.empty(len(a) + len(d), dtype=np.int64)
    out[::2], out[1::2] = even, odd
    return out


def depth(n):
    """Levels of the transform: 3, fewer for short windows."""
    return next((level for level in (3, 2, 1) if n >= 4 << level), 0)


def encode_window(x, predict=True):
    """The stage chain on a window: lifting, prediction, bias, Rice codes; a list of (coefficients, bytes) by band."""
    bands, a = [], np.asarray(x, dtype=np.int64)
    for _ in range(depth(len(a))):
        a, d = lift(a)
        bands.append(d)
    out = []
    for band in [a, *reversed(bands)]:
        c = lpc_adaptive(band) if predict and len(band) else []
        out.append((c, golomb_encode(bias_cancel(lpc_residual(band, c)))))
    return out


def decode_window(parts):
    bands = [lpc_synthesis(bias_restore(golomb_decode(data)), c) for c, data in parts]
    x = bands[0]
    for d in bands[1:]:
        x = unlift(x, d)
    return x

"""Filters, envelopes, spectra and autoregressive models of one series."""

from __future__ import annotations

import numpy as np


def next_power_of_two(n: int) -> int:
    return 1 if n <= 1 else 1 << (n - 1).bit_length()


def envelope(x: np.ndarray) -> np.ndarray:
    """Modulus of the analytic signal, computed on the next power of two and cut back."""
    n = next_power_of_two(len(x))
    f = np.fft.fft(x, n)
    weight = np.zeros(n)
    weight[0] = 1
    if n > 1:
        weight[n // 2] = 1
        weight[1 : n // 2] = 2
    return np.abs(np.fft.ifft(f * weight))[: len(x)]


def fir_taps(sfreq: float, low: float | None = None, high: float | None = None, taps: int = 101) -> np.ndarray:
    """A symmetric windowed-sinc filter: pass between low and high (None: open)."""
    if taps % 2 == 0:
        raise ValueError("taps must be odd")
    t = np.arange(taps) - taps // 2

    def lowpass(f: float) -> np.ndarray:
        h = np.sinc(2 * f / sfreq * t) * np.hamming(taps)
        return h / h.sum()

    h = np.zeros(taps)
    h[taps // 2] = 1.0
    h = lowpass(high) if high is not None else h
    if low is not None:
        h = h - (np.convolve(h, lowpass(low), "same") if high is not None else lowpass(low))
    return h


def notch_taps(sfreq: float, freq: float, width: float = 1.0) -> np.ndarray:
    """A symmetric filter that stops a band of this width around a frequency, long enough for its edges to be as steep as it is narrow."""
    taps = 2 * int(np.ceil(3.3 * sfreq / width)) + 1
    h = -fir_taps(sfreq, max(freq - width, width / 8), min(freq + width, sfreq / 2 * 0.999), taps)
    h[taps // 2] += 1
    return h


def convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The whole overlaps of x and the taps; of long ones by their spectra, in pieces of a few times the taps."""
    n = len(x) - len(taps) + 1
    if len(taps) < 64:
        return np.convolve(x, taps, "valid")
    size = next_power_of_two(8 * len(taps))
    f, step, out = np.fft.rfft(taps, size), size - len(taps) + 1, np.zeros(n)
    for i in range(0, n, step):
        piece = np.fft.irfft(np.fft.rfft(x[i : i + size], size) * f, size)[len(taps) - 1 :]
        out[i : i + step] = piece[: min(step, n - i)]
    return out


def fir_filter(x: np.ndarray, sfreq: float, low: float | None = None, high: float | None = None, taps: int = 101) -> np.ndarray:
    """Zero-phase filtering, the ends continued by their point reflections."""
    h = fir_taps(sfreq, low, high, taps)
    pad = min(len(x) - 1, taps // 2)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    return np.convolve(wide, h, "same")[pad : pad + len(x)]


def notch(x: np.ndarray, sfreq: float, freq: float, width: float = 1.0) -> np.ndarray:
    """Removes a narrow band in the frequency domain."""
    f = np.fft.rfft(x)
    at = np.fft.rfftfreq(len(x), 1 / sfreq)
    f[np.abs(at - freq) <= width / 2] = 0
    return np.fft.irfft(f, len(x))


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """n samples of the same span, by its spectrum."""
    f = np.fft.rfft(x)
    m = n // 2 + 1
    g = np.zeros(m, dtype=complex)
    k = min(len(f), m)
    g[:k] = f[:k]
    return np.fft.irfft(g, n) * (n / len(x))


def power_spectrum(v: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(v)) ** 2


def periodogram(x: np.ndarray, block: int, step: int | None = None, taper: np.ndarray | None = None) -> np.ndarray:
    """Averaged spectrum of tapered blocks, scaled so its mean over all frequencies is the variance of white noise."""
    step = block // 2 if step is None else step
    w = np.hamming(block) if taper is None else taper
    starts = range(0, len(x) - block + 1, step)
    if not len(starts):
        raise ValueError("the series is shorter than a block")
    return np.mean([np.abs(np.fft.fft(w * x[s : s + block])) ** 2 for s in starts], axis=0) / np.sum(w * w)


def yule_walker(psd: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """(coefficients a with x[t] = sum a[i] x[t-1-i] + e, variance of e) from a full power spectrum."""
    r = np.fft.ifft(psd).real[: order + 1]
    if order == 0:
        return np.zeros(0), float(r[0])
    lhs = r[np.abs(np.arange(order)[:, None] - np.arange(order)[None, :])]
    a = np.linalg.solve(lhs, r[1:])
    return a, float(r[0] - a @ r[1:])


def ar_spectrum(a: np.ndarray, variance: float, n: int) -> np.ndarray:
    f = np.fft.fft(np.concatenate([[1.0], -a]), n)
    return variance / np.abs(f) ** 2


def whiten(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Innovations of an autoregressive series; the first samples lack a past and take zeros for it."""
    return np.convolve(x, np.concatenate([[1.0], -a]))[: len(x)]


def ar_to_parcor(a: np.ndarray) -> np.ndarray:
    """Reflection coefficients, by Levinson's recursion downwards."""
    a, out = np.array(a, dtype=float), np.zeros(len(a))
    for m in range(len(a) - 1, -1, -1):
        k = out[m] = a[m]
        if m:
            if abs(k) >= 1:
                raise ValueError("the model is not stable")
            a = (a[:m] + k * a[:m][::-1]) / (1 - k * k)
    return out


def parcor_to_ar(p: np.ndarray) -> np.ndarray:
    a = np.zeros(0)
    for k in p:
        a = np.append(a - k * a[::-1], k)
    return a

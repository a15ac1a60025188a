"""Numpy kernels on one short array; Spark hands them frames or segments, never whole libraries."""

from __future__ import annotations

import numpy as np


def hann(n: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(signal: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """Frames x bins: centred frames, reflected edges, windowed."""
    padded = np.pad(np.asarray(signal, np.float64), n_fft // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    return np.fft.rfft(frames * hann(n_fft), axis=1)


def istft(spectrum: np.ndarray, n_fft: int, hop: int, length: int) -> np.ndarray:
    """The signal back: frames overlapped and added, divided by the sum of squared windows."""
    window = hann(n_fft)
    frames = np.fft.irfft(spectrum, n_fft, axis=1) * window
    total = n_fft + hop * (len(frames) - 1)
    out, norm = np.zeros(total), np.zeros(total)
    for k, frame in enumerate(frames):
        out[k * hop : k * hop + n_fft] += frame
        norm[k * hop : k * hop + n_fft] += window**2
    out = np.where(norm > 1e-8, out / np.maximum(norm, 1e-8), out)
    return out[n_fft // 2 : n_fft // 2 + length]


def pitch(frame: np.ndarray, rate: float, low: float = 80.0, high: float = 1000.0, limit: float = 0.15) -> float | None:
    """The frame's pitch in Hz by cumulative mean normalised differences, or none below the limit."""
    x = np.asarray(frame, np.float64)
    longest = min(len(x) // 2, int(rate / low))
    if longest < 3:
        return None
    size = len(x) - longest
    diff = np.array([np.sum((x[:size] - x[k : k + size]) ** 2) for k in range(longest + 1)])
    mean = np.cumsum(diff[1:]) / np.arange(1, longest + 1)
    norm = np.concatenate(([1.0], diff[1:] / np.maximum(mean, 1e-12)))
    for k in range(max(2, int(rate / high)), longest):
        if norm[k] < limit and norm[k] <= norm[k + 1]:
            a, b, c = norm[k - 1], norm[k], norm[k + 1]
            bend = a - 2 * b + c
            return rate / (k + (0.5 * (a - c) / bend if bend else 0.0))
    return None


def spectral_peaks(frame: np.ndarray, count: int = 3, apart: int = 2) -> list[tuple[int, float]]:
    """The largest (bin, power) of a windowed frame, more than ``apart`` bins from each other."""
    power = np.abs(np.fft.rfft(np.asarray(frame, np.float64) * hann(len(frame)))) ** 2
    found: list[tuple[int, float]] = []
    for k in np.argsort(-power, kind="stable"):
        if all(abs(k - b) > apart for b, _ in found):
            found.append((int(k), float(power[k])))
            if len(found) == count:
                break
    return found


def quantise(x: np.ndarray) -> np.ndarray:
    """Samples as 16-bit integers: clamped, halves away from zero."""
    y = np.clip(np.asarray(x, np.float64), -1, 1) * 32767
    return (np.sign(y) * np.floor(np.abs(y) + 0.5)).astype(np.int16)


def resample(x: np.ndarray, rate: float, to: float = 44100.0) -> np.ndarray:
    """Another rate by zero-filled or cut spectra; the length is floor(n * to / rate)."""
    n = int(len(x) * to // rate)
    if not n:
        return np.zeros(0)
    spectrum = np.fft.rfft(x)
    size = n // 2 + 1
    out = np.zeros(size, complex)
    m = min(size, len(spectrum))
    out[:m] = spectrum[:m]
    return np.fft.irfft(out, n) * (n / len(x))


def limit(x: np.ndarray, state: float, rate: float, ceiling: float = 0.89, release_s: float = 0.08) -> tuple[np.ndarray, float]:
    """Samples held under the ceiling by a gain that drops at once and comes back slowly; the gain goes on to the next block."""
    step, out = 1 - np.exp(-1 / (release_s * rate)), np.zeros(len(x))
    for k, v in enumerate(np.nan_to_num(np.asarray(x, np.float64), nan=0.0, posinf=0.0, neginf=0.0)):
        wanted = min(1.0, ceiling / max(abs(v), 1e-9))
        state = wanted if wanted < state else state + (wanted - state) * step
        out[k] = v * state
    return out, state

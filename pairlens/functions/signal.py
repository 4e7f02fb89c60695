"""Filters over sample arrays, in numpy: a polyphase resampler and a band-pass
of second-order sections at zero phase."""

from __future__ import annotations

from functools import cache
from math import gcd, pi, tan

import numpy as np

#: Samples that a section filters at once, and outputs that a resampler gathers at once.
BLOCK, GATHER = 256, 1 << 16


@cache
def lowpass(up: int, down: int, zeros: int = 10, beta: float = 5.0) -> np.ndarray:
    """A windowed sinc for a change of rate by up / down: it cuts at the lower of
    both Nyquist frequencies, has ``zeros`` crossings a side and a Kaiser window,
    and a gain of ``up`` at 0."""
    widest = max(up, down)
    k = np.arange(-zeros * widest, zeros * widest + 1)
    h = np.sinc(k / widest) * np.kaiser(len(k), beta)
    return h * (up / h.sum())


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """``x`` at another rate: ceil(n * to / rate) samples, silence beyond the ends.

    Output n lies at n * down of the inputs put ``up`` apart.  Its phase says
    which taps meet inputs, so only those are multiplied."""
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    if up == down or not len(x):
        return np.asarray(x, float)
    h = lowpass(up, down)
    half = len(h) // 2
    width = -(-len(h) // up)
    phases = np.zeros((up, width))
    for p in range(up):
        own = h[p::up][::-1]
        phases[p, width - len(own) :] = own
    n = -(-len(x) * up // down)
    at = np.arange(n) * down + half
    padded = np.concatenate([np.zeros(width), x, np.zeros(width + half // up + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(n)
    for i in range(0, n, GATHER):
        a = at[i : i + GATHER]
        out[i : i + GATHER] = np.einsum("ij,ij->i", windows[a // up + 1], phases[a % up])
    return out


@cache
def bandpass(order: int, low: float, high: float, rate: float) -> tuple[tuple[float, float, float], ...]:
    """Second-order sections (gain, a1, a2) of a maximally flat band-pass; each
    has its zeros at 0 and at half the rate: gain * (1 - z^-2) / (1 + a1 z^-1 + a2 z^-2)."""
    w1, w2 = (2 * rate * tan(pi * f / rate) for f in (low, high))
    width, centre = w2 - w1, (w1 * w2) ** 0.5
    out = []
    for k in range(order):
        p = np.exp(1j * pi * (2 * k + order + 1) / (2 * order)) * width / 2
        root = np.sqrt(p * p - centre * centre)
        out += [p + root, p - root]
    poles = [(2 * rate + s) / (2 * rate - s) for s in out]
    pairs = sorted((p for p in poles if p.imag > 0), key=abs)
    z = np.exp(2j * np.arctan(centre / (2 * rate)))
    gain = [abs((1 - 2 * p.real / z + abs(p) ** 2 / z**2) / (1 - 1 / z**2)) for p in pairs]
    return tuple((float(g), float(-2 * p.real), float(abs(p) ** 2)) for g, p in zip(gain, pairs, strict=True))


@cache
def _block_matrices(gain: float, a1: float, a2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A section over ``BLOCK`` samples as matrices: outputs by inputs and by the
    state before, the state after by inputs and by the state before."""
    def run(x, s):
        y = np.empty(BLOCK)
        for k, v in enumerate(x):
            y[k] = gain * v + s[0]
            s = (s[1] - a1 * y[k], -gain * v - a2 * y[k])
        return y, s

    one = np.zeros(BLOCK)
    one[0] = 1
    impulse = run(one, (0.0, 0.0))[0]
    by_input = np.zeros((BLOCK, BLOCK))
    for k in range(BLOCK):
        by_input[k:, k] = impulse[: BLOCK - k]
    states = [run(np.zeros(BLOCK), s) for s in ((1.0, 0.0), (0.0, 1.0))]
    ends = np.array([run(np.eye(BLOCK)[k], (0.0, 0.0))[1] for k in range(BLOCK)]).T
    return by_input, np.array([y for y, _ in states]).T, ends, np.array([s for _, s in states]).T


def _section(x: np.ndarray, gain: float, a1: float, a2: float) -> np.ndarray:
    """A section that has met ``x[0]`` forever before."""
    by_input, by_state, end_input, end_state = _block_matrices(gain, a1, a2)
    n = len(x)
    blocks = np.concatenate([x, np.zeros(-n % BLOCK)]).reshape(-1, BLOCK)
    steps = blocks @ end_input.T
    # Of a constant, this section's output is 0: the zeros at 0 take it out.
    state, states = np.array([-gain * x[0], -gain * x[0]]), np.empty((len(blocks), 2))
    for k in range(len(blocks)):
        states[k] = state
        state = end_state @ state + steps[k]
    return (blocks @ by_input.T + states @ by_state.T).ravel()[:n]


def filter_both_ways(x: np.ndarray, sections, pad: int | None = None) -> np.ndarray:
    """``x`` through the sections forwards and then backwards, so that nothing is
    delayed.  The ends are continued by ``pad`` samples turned about them."""
    x = np.asarray(x, float)
    pad = 3 * (2 * len(sections) + 1) if pad is None else pad
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for s in sections:
            y = _section(y, *s)
        y = y[::-1]
    return y[pad : len(y) - pad]

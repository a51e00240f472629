"""Treatments that carry state from block to block: how a signal is cut into blocks changes nothing.

Each has push(block) -> samples that are ready, and flush() -> those that were
still held back when the input ended.
"""

from __future__ import annotations

import math

import numpy as np

from tempograph.functions import kernels

NOTHING = np.zeros(0)


def coefficient(ms: float, rate: float) -> float:
    """Share of a one-pole follower's state that is left after one of `rate` steps a second."""
    return math.exp(-1.0 / max(1e-6, ms * 0.001 * rate))


class Section:
    """A second-order section (b, a), transposed form, a run of SPAN samples at a time.

    The response of a run to its input and to the state before it are two
    matrices, so only one step a run goes from state to state.
    """

    SPAN = 64

    def __init__(self, b, a):
        b, a = (np.asarray(v, float) / a[0] for v in (b, a))
        self.b, self.a, self.state = b, a, np.zeros(2)
        # columns: unit impulses at each place, then the two unit states
        x = np.hstack([np.eye(self.SPAN), np.zeros((self.SPAN, 2))])
        z1, z2 = np.zeros(self.SPAN + 2), np.zeros(self.SPAN + 2)
        z1[self.SPAN], z2[self.SPAN + 1] = 1.0, 1.0
        out = np.empty_like(x)
        for i, v in enumerate(x):
            out[i] = y = b[0] * v + z1
            z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        self.whole, self.free = out[:, : self.SPAN], out[:, self.SPAN :]
        ends = np.stack([z1, z2])
        self.driven, self.carried = ends[:, : self.SPAN], ends[:, self.SPAN :]

    def push(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        runs = len(x) // self.SPAN
        parts = x[: runs * self.SPAN].reshape(runs, self.SPAN)
        ends, before = parts @ self.driven.T, np.empty((runs, 2))
        (p, q), (r, s) = self.carried.tolist()
        z1, z2 = self.state.tolist()
        for i, (e1, e2) in enumerate(ends.tolist()):
            before[i] = z1, z2
            z1, z2 = p * z1 + q * z2 + e1, r * z1 + s * z2 + e2
        out = np.empty(len(x))
        out[: runs * self.SPAN] = (parts @ self.whole.T + before @ self.free.T).ravel()
        (b0, b1, b2), (_, a1, a2) = self.b.tolist(), self.a.tolist()
        for i in range(runs * self.SPAN, len(x)):
            v = float(x[i])
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            out[i] = y
        self.state = np.array([z1, z2])
        return out

    def flush(self) -> np.ndarray:
        return NOTHING


class Chain:
    """Treatments one after the other."""

    def __init__(self, *parts):
        self.parts = parts

    def push(self, x: np.ndarray) -> np.ndarray:
        for part in self.parts:
            x = part.push(x)
        return x

    def flush(self) -> np.ndarray:
        out = NOTHING
        for part in self.parts:
            out = np.concatenate([part.push(out), part.flush()])
        return out


class Delay:
    """The signal and, `time` samples later, `mix` of what came out then."""

    def __init__(self, time: int, mix: float):
        self.mix, self.line = mix, np.zeros(time)

    def push(self, x: np.ndarray) -> np.ndarray:
        out, at = np.empty(len(x)), 0
        while at < len(x):
            n = min(len(self.line), len(x) - at)
            out[at : at + n] = x[at : at + n] + self.mix * self.line[:n]
            self.line = np.concatenate([self.line[n:], out[at : at + n]])
            at += n
        return out

    def flush(self) -> np.ndarray:
        return NOTHING


class _Controlled:
    """A gain that is worked out once for `decimate` samples, counted from the first one on, and held."""

    look = 0

    def __init__(self, decimate: int = 16):
        self.decimate, self.held = decimate, NOTHING

    def push(self, x: np.ndarray) -> np.ndarray:
        self.held = np.concatenate([self.held, np.asarray(x, float)])
        return self._ready(max(0, len(self.held) - self.look) // self.decimate * self.decimate, self.held[self.look :])

    def flush(self) -> np.ndarray:
        return self._ready(len(self.held), np.append(self.held[self.look :], np.zeros(self.look)))

    def _ready(self, n: int, ahead: np.ndarray) -> np.ndarray:
        if not n:
            return NOTHING
        x, self.held = self.held[:n], self.held[n:]
        control = np.maximum.reduceat(np.maximum(np.abs(x), np.abs(ahead[:n])), np.arange(0, n, self.decimate))
        return self._applied(x, np.repeat(self.gains(control), self.decimate)[:n])

    def _applied(self, x: np.ndarray, gain: np.ndarray) -> np.ndarray:
        return x * gain

    def _follow(self, control: np.ndarray) -> np.ndarray:
        """One-pole envelope with its own coefficients for rise and fall."""
        state, rise, fall, out = self.envelope, self.attack, self.release, []
        for v in control.tolist():
            k = rise if v > state else fall
            state = k * state + (1 - k) * v
            out.append(state)
        self.envelope = state
        return np.array(out)


class Compressor(_Controlled):
    """Feed-forward compressor with a soft knee; attack and release are a follower's coefficients."""

    def __init__(self, threshold: float = -18.0, ratio: float = 3.0, knee: float = 6.0, attack: float = 0.0, release: float = 0.0, makeup_db: float = 0.0, decimate: int = 16):
        super().__init__(decimate)
        self.threshold, self.slope, self.knee, self.attack, self.release = threshold, 1 - 1 / max(1.0, ratio), knee, attack, release
        self.makeup, self.envelope = 10 ** (makeup_db / 20), 0.0

    def gains(self, control: np.ndarray) -> np.ndarray:
        over = 20 * np.log10(np.maximum(self._follow(control), 1e-9)) - self.threshold
        bent = np.clip(over + self.knee / 2, 0.0, self.knee)
        less = np.where(over >= self.knee / 2, over, bent * bent / (2 * self.knee) if self.knee > 0 else 0.0) * self.slope
        return 10 ** (-less / 20) * self.makeup


class Limiter(_Controlled):
    """Gain that falls at once and rises by a follower, so that no sample, nor the one `look` ahead of it, is over the ceiling."""

    def __init__(self, ceiling: float, release: float, look: int = 220, decimate: int = 16):
        super().__init__(decimate)
        self.ceiling, self.release, self.look, self.gain = ceiling, release, look, 1.0

    def gains(self, control: np.ndarray) -> np.ndarray:
        state, k, out = self.gain, self.release, []
        for t in np.minimum(1.0, self.ceiling / np.maximum(control, 1e-9)).tolist():
            state = t if t < state else k * state + (1 - k) * t
            out.append(state)
        self.gain = state
        return np.array(out)

    def _applied(self, x: np.ndarray, gain: np.ndarray) -> np.ndarray:
        return np.clip(x * gain, -self.ceiling, self.ceiling)


class Ducker(_Controlled):
    """Gain down to `depth` as the trigger's envelope nears its own slowly falling maximum; the signal is its own trigger."""

    def __init__(self, depth: float = 0.7, attack: float = 0.0, release: float = 0.0, decay: float = 0.999, decimate: int = 16):
        super().__init__(decimate)
        self.depth, self.attack, self.release, self.decay = depth, attack, release, decay
        self.envelope, self.top = 0.0, 1e-6

    def gains(self, control: np.ndarray) -> np.ndarray:
        out = []
        for v in self._follow(control).tolist():
            self.top = max(self.top * self.decay, v, 1e-6)
            out.append(1 - (1 - self.depth) * min(max(v / self.top, 0.0), 1.0))
        return np.array(out)


class Loudness:
    """Integrated loudness of channels pushed block by block: weighting, 400 ms blocks a quarter apart, two gates."""

    def __init__(self, sr: int, channels: int = 1, win: int | None = None):
        self.chains = [Chain(*(Section(b, a) for b, a in kernels.k_weight(sr))) for _ in range(channels)]
        self.win = win or round(0.4 * sr)
        self.hop = max(1, self.win // 4)
        self.held, self.means = NOTHING, []

    def push(self, *channels: np.ndarray) -> None:
        square = sum(chain.push(x) ** 2 for chain, x in zip(self.chains, channels))
        self.held = np.concatenate([self.held, square])
        n = 0 if len(self.held) < self.win else 1 + (len(self.held) - self.win) // self.hop
        if n:
            total = np.append(0.0, np.cumsum(self.held))
            first = np.arange(n) * self.hop
            self.means.append((total[first + self.win] - total[first]) / self.win)
            self.held = self.held[n * self.hop :]

    def value(self) -> float:
        """-infinity where no block passes the first gate; the first gate's mean where none passes the second."""
        level = lambda v: -0.691 + 10 * np.log10(np.maximum(v, 1e-20))
        z = np.concatenate([NOTHING, *self.means])
        z = z[level(z) > -70]
        if not len(z):
            return -math.inf
        gated = z[level(z) > level(z.mean()) - 10]
        return float(level((gated if len(gated) else z).mean()))


class Resampler:
    """Windowed-sinc resampling by a reduced ratio: one short filter for each phase, and the samples it still needs."""

    def __init__(self, sr_in: int, sr_out: int, taps: int = 32):
        g = math.gcd(sr_in, sr_out)
        self.up, self.down, self.taps = sr_out // g, sr_in // g, taps
        cut = min(1.0, self.up / self.down)
        # output i lies at input i * down / up; phase p of `up` has this fraction behind the sample before it
        offset = np.arange(self.up)[:, None] / self.up - np.arange(-taps + 1, taps + 1)
        window = np.where(np.abs(offset) < taps, 0.5 + 0.5 * np.cos(np.pi * offset / taps), 0.0)
        self.weights = cut * np.sinc(cut * offset) * window
        self.held, self.done, self.seen = np.zeros(taps - 1), 0, 0

    def push(self, x: np.ndarray) -> np.ndarray:
        self.seen += len(x)
        return self._made(np.asarray(x, float), max(self.done, ((self.seen - self.taps) * self.up) // self.down))

    def flush(self) -> np.ndarray:
        return self._made(np.zeros(self.taps), -(-self.seen * self.up // self.down))

    def _made(self, x: np.ndarray, until: int) -> np.ndarray:
        first = self.done * self.down // self.up  # held[taps - 1] is the input sample `first`
        self.held = np.concatenate([self.held, x])
        out = []
        for lo in range(self.done, until, 1 << 14):
            i = np.arange(lo, min(lo + (1 << 14), until))
            at, phase = i * self.down // self.up - first, i * self.down % self.up
            view = np.lib.stride_tricks.sliding_window_view(self.held, 2 * self.taps)
            out.append(np.einsum("ij,ij->i", view[at], self.weights[phase]))
        if until > self.done:
            self.done = until
            self.held = self.held[self.done * self.down // self.up - first :]
        return np.concatenate([NOTHING, *out])


class TruePeak:
    """Highest absolute value between the samples of blocks, by oversampling."""

    def __init__(self, oversample: int = 4):
        self.resampler, self.top = Resampler(1, oversample), 0.0

    def push(self, x: np.ndarray) -> None:
        for lo in range(0, len(x), 1 << 16):
            y = self.resampler.push(x[lo : lo + (1 << 16)])
            self.top = max(self.top, float(np.abs(y).max(initial=0.0)))

    def value_db(self) -> float:
        return 20 * math.log10(max(self.top, float(np.abs(self.resampler.flush()).max(initial=0.0))) + 1e-12)

"""NumPy kernels for what expressions cannot say: transforms, filters with state, stretching.

They work on float arrays of one track (or one block and the state carried to
it) and are called from grouped-map and stateful operators.
"""

from __future__ import annotations

import math

import numpy as np

#: Half-open ranges of FFT bins of which the loudest is looked for.
BANDS = [(1, 10), (10, 20), (20, 40), (40, 80), (80, 160), (160, 320), (320, 512)]


def frames(x: np.ndarray, win: int, hop: int, count: int) -> np.ndarray:
    """`count` windows of x, hop apart, as rows of a view."""
    if count <= 0:
        return np.zeros((0, win))
    step = x.strides[0]
    return np.lib.stride_tricks.as_strided(x, (count, win), (hop * step, step), writeable=False)


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n) / (n - 1))


class LevelFrames:
    """Loudest bin of each frame of a signal pushed block by block, and the mean and deviation of all levels.

    (len - win) // hop frames count, one less than there are, so the last one
    waits until another follows.
    """

    def __init__(self, win: int = 1024, hop: int = 512):
        self.win, self.hop, self.held, self.waiting = win, hop, np.zeros(0), None
        self.count, self.total, self.square, self.bins, self.tops = 0, 0.0, 0.0, [], []

    def push(self, x: np.ndarray) -> None:
        self.held = np.concatenate([self.held, x])
        n = 0 if len(self.held) < self.win else 1 + (len(self.held) - self.win) // self.hop
        for lo in range(0, n, 2048):
            part = frames(self.held[lo * self.hop :], self.win, self.hop, min(2048, n - lo))
            level = 20 * np.log10(np.abs(np.fft.rfft(part * hann(self.win), axis=1)) + 1e-9)
            level = level if self.waiting is None else np.vstack([self.waiting, level])
            self.waiting, level = level[-1:], level[:-1]
            self.count, self.total, self.square = self.count + level.size, self.total + level.sum(), self.square + (level * level).sum()
            low, high = BANDS[0][0], BANDS[-1][1]
            best = level[:, low:high].argmax(1) + low
            self.bins.append(best)
            self.tops.append(level[np.arange(len(level)), best])
        self.held = self.held[n * self.hop :]

    def peaks(self, sigmas: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
        """(frame, bin) of the loudest bin of each frame, lowest of equals, where it is above mean + sigmas deviations.

        Fewer than four frames give none.
        """
        bins, tops = (np.concatenate([np.zeros(0), *v]) for v in (self.bins, self.tops))
        if len(bins) < 4:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        mean = self.total / self.count
        loud = tops > mean + sigmas * math.sqrt(max(0.0, self.square / self.count - mean * mean))
        return np.flatnonzero(loud), bins[loud].astype(np.int64)


def spectral_peaks(x: np.ndarray, win: int = 1024, hop: int = 512, sigmas: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    found = LevelFrames(win, hop)
    found.push(x)
    return found.peaks(sigmas)


#: Peaks that an anchor is paired with, and how far from it they may be in frames and bins.
FAN_OUT, REACH = 3, 63


def loud(owner: np.ndarray, level: np.ndarray, rows: int, sigmas: float = 0.8) -> np.ndarray:
    """Which values are above the mean and `sigmas` population deviations of their owner's; levels are whole numbers."""
    n, total, square = (np.bincount(owner, w, rows) for w in (None, level, level.astype(float) * level))
    with np.errstate(invalid="ignore", divide="ignore"):
        floor = total / n + sigmas * np.sqrt(np.maximum(square * n - total * total, 0.0)) / n
    return level > floor[owner]


def landmark_pairs(owner: np.ndarray, t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash << 32 | t) of the pairs of peaks in order of owner and t, sorted and distinct for each owner.

    A peak is paired with the first FAN_OUT later ones of its owner within
    REACH frames and bins; one pass looks at all peaks k places ahead.
    """
    taken, owners, pairs = np.zeros(len(t), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, REACH + 1):
        dt, df = t[k:] - t[:-k], f[k:] - f[:-k]
        near = (owner[k:] == owner[:-k]) & (dt <= REACH)
        if not near.any():
            break
        at = np.flatnonzero(near & (np.abs(df) <= REACH) & (taken[:-k] < FAN_OUT))
        taken[at] += 1
        owners.append(owner[at])
        pairs.append(((f[at] & 0x1FF) << 16 | ((df[at] + 63) & 0x7F) << 8 | (dt[at] & 0x3F)) << 32 | t[at])
    owners, pairs = np.concatenate(owners), np.concatenate(pairs)
    order = np.lexsort((pairs, owners))
    owners, pairs = owners[order], pairs[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (pairs[1:] != pairs[:-1])
    return owners[new], pairs[new]


#: Places of common hashes that are looked at in one go.
PLACES = 1 << 21


def _prominence(anchor: np.ndarray, lo: np.ndarray, count: np.ndarray, places: np.ndarray, anchors: int) -> float:
    """Score of rows (anchor, lo, count), in order of anchor, whose places in the other print are places[lo : lo + count]."""
    low = int(places.min()) - int(anchor[-1]) - 1
    span = int(places.max()) - int(anchor[0]) + 2 - low
    single, beside, gap = (np.zeros(span, np.int64) for _ in range(3))
    total, at = np.cumsum(count), 0
    while at < len(anchor):
        # whole anchors, at least one
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + PLACES, "right"))
        end = int(np.searchsorted(anchor, anchor[max(end - 1, at)], "right")) if end < len(anchor) else end
        n = count[at:end]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo[at:end], n)
        offset = places[place] - np.repeat(anchor[at:end], n) - low
        # an anchor's offsets, each once, lie together in order
        key = np.unique(np.repeat(anchor[at:end] - anchor[at], n) * span + offset)
        offset, step = key % span, np.diff(key)
        single += np.bincount(offset, minlength=span)
        beside += np.bincount(offset[:-1][step == 1], minlength=span)
        gap += np.bincount(offset[:-1][step == 2], minlength=span)
        at = end
    occur = np.flatnonzero(single)
    # anchors with offset o - 1, o or o + 1, each counted once
    merged = single[occur - 1] + single[occur] + single[occur + 1] - beside[occur - 1] - beside[occur] - gap[occur - 1]
    best = int(merged.max())
    rest = (int(merged.sum()) - best) / (len(merged) - 1) if len(merged) > 1 else 0.0
    return max(0.0, min(1.0, (best - rest) / anchors))


def offset_scores(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> tuple[float, float]:
    """Scores of print A in B and of B in A; prints are sorted distinct hash << 32 | time.

    Both are 0 if on both sides fewer than `least` of the anchors have a
    common hash. Memory follows the prints and PLACES, not the product of
    their places.
    """
    if not len(a) or not len(b):
        return 0.0, 0.0
    (ha, ta), (hb, tb) = ((x >> 32, x & 0xFFFFFFFF) for x in (a, b))
    sides = []
    for h, t, other, places in ((ha, ta, hb, tb), (hb, tb, ha, ta)):
        lo = np.searchsorted(other, h, "left")
        count = np.searchsorted(other, h, "right") - lo
        common = np.flatnonzero(count)
        common = common[np.argsort(t[common], kind="stable")]
        sides.append((t[common], lo[common], count[common], places, len(np.unique(t))))
    if not len(sides[0][0]) or all(len(np.unique(s[0])) < least * s[4] for s in sides):
        return 0.0, 0.0
    return _prominence(*sides[0]), _prominence(*sides[1])


def stretched_sequence(seq: np.ndarray, factor: float) -> np.ndarray:
    """A sequence of frames (n, width) of `factor` times the length by linear interpolation, frames scaled to length 1."""
    at = np.linspace(0.0, len(seq) - 1.0, max(1, round(len(seq) * factor)))
    low = np.floor(at).astype(int)
    part = (at - low)[:, None]
    out = seq[low] * (1 - part) + seq[np.minimum(low + 1, len(seq) - 1)] * part
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


def sequence_distances(stack: np.ndarray, span: float, seq: np.ndarray, seq_span: float, least_frames: int = 8) -> np.ndarray:
    """Distance of each sequence of a stack (count, n, width) to one sequence (m, width): 0 alike, 1 unrelated.

    `span` is the beats that a frame covers; where the two differ by more than
    0.5 % `seq` is stretched to the stack's. The shorter side slides over the
    longer, frames are turned through all rotations, and the best mean dot
    product counts. Fewer than least_frames frames on a side give 1.
    """
    count, n, width = stack.shape
    if min(n, len(seq)) < least_frames:
        return np.ones(count)
    if span > 0 and seq_span > 0 and abs(span / seq_span - 1) > 0.005:
        seq = stretched_sequence(seq, seq_span / span)
        if len(seq) < least_frames:
            return np.ones(count)
    short, best = min(n, len(seq)), np.zeros(count)
    for turn in range(width):
        turned = np.roll(seq, turn, axis=1)
        if n <= len(seq):
            places = np.lib.stride_tricks.sliding_window_view(turned, n, axis=0)
            dots = np.tensordot(places, stack, axes=((2, 1), (1, 2)))
            best = np.maximum(best, dots.max(0))
        else:
            places = np.lib.stride_tricks.sliding_window_view(stack, len(seq), axis=1)
            best = np.maximum(best, np.tensordot(places, turned, axes=((3, 2), (0, 1))).max(1))
    return np.clip(1 - best / short, 0.0, 1.0)


def onset_envelope(x: np.ndarray, win: int = 1024, hop: int = 512) -> np.ndarray:
    n = (len(x) - win) // hop
    if n <= 2:
        return np.zeros(1)
    mag = np.log1p(8 * np.abs(np.fft.rfft(frames(x, win, hop, n) * hann(win), axis=1)))
    rise = np.maximum(np.diff(mag, axis=0), 0).sum(1)
    rise = rise - rise.mean()
    return rise / rise.std() if rise.std() > 0 else rise


class ChromaSum:
    """Power of the twelve pitch classes between 55 and 2200 Hz of a signal pushed block by block."""

    def __init__(self, sr: float, win: int = 8192, hop: int = 4096):
        self.win, self.hop, self.held, self.waiting, self.power, self.n = win, hop, np.zeros(0), None, np.zeros(win // 2 + 1), 0
        freq = np.fft.rfftfreq(win, 1 / sr)
        self.inside = (freq > 55) & (freq < 2200)
        self.pc = np.round(12 * np.log2(freq[self.inside] / 440) + 69).astype(int) % 12

    def push(self, x: np.ndarray) -> None:
        self.held = np.concatenate([self.held, x])
        n = 0 if len(self.held) < self.win else 1 + (len(self.held) - self.win) // self.hop
        for i in range(n):
            # the last frame counts only if it is the only one
            if self.waiting is not None:
                self.power += self.waiting
                self.n += 1
            self.waiting = np.abs(np.fft.rfft(self.held[i * self.hop : i * self.hop + self.win] * hann(self.win))) ** 2
        self.held = self.held[n * self.hop :]

    def value(self) -> np.ndarray:
        """Shares of the pitch classes, summing to 1 (0 for silence)."""
        power = self.power
        if not self.n:
            padded = np.pad(self.held, (0, max(0, self.win - len(self.held))))[: self.win]
            power = self.waiting if self.waiting is not None else np.abs(np.fft.rfft(padded * hann(self.win))) ** 2
        out = np.bincount(self.pc, power[self.inside], 12)
        return out / out.sum() if out.sum() > 0 else out


def chroma(x: np.ndarray, sr: float, win: int = 8192, hop: int = 4096) -> np.ndarray:
    found = ChromaSum(sr, win, hop)
    found.push(x)
    return found.value()


def biquad(kind: str, sr: float, freq: float, q: float = 0.7071, gain_db: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of the usual second-order sections, a[0] = 1; freq is kept within 10 Hz and 0.49 sr."""
    w = 2 * math.pi * min(max(freq, 10.0), 0.49 * sr) / sr
    cos, alpha, amp = math.cos(w), math.sin(w) / (2 * q), 10 ** (gain_db / 40)
    root = 2 * math.sqrt(amp) * alpha
    shelf = lambda s: ([amp * (amp + 1 - s * (amp - 1) * cos + root), s * 2 * amp * (amp - 1 - s * (amp + 1) * cos), amp * (amp + 1 - s * (amp - 1) * cos - root)],
                       [amp + 1 + s * (amp - 1) * cos + root, -s * 2 * (amp - 1 + s * (amp + 1) * cos), amp + 1 + s * (amp - 1) * cos - root])
    plain = [1 + alpha, -2 * cos, 1 - alpha]
    sections = {
        "lowpass": ([(1 - cos) / 2, 1 - cos, (1 - cos) / 2], plain),
        "highpass": ([(1 + cos) / 2, -(1 + cos), (1 + cos) / 2], plain),
        "bandpass": ([alpha, 0.0, -alpha], plain),
        "notch": ([1.0, -2 * cos, 1.0], plain),
        "peak": ([1 + alpha * amp, -2 * cos, 1 - alpha * amp], [1 + alpha / amp, -2 * cos, 1 - alpha / amp]),
        "lowshelf": shelf(1),
        "highshelf": shelf(-1),
    }
    b, a = map(np.array, sections[kind])
    return b / a[0], a / a[0]


def k_weight(sr: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two sections of loudness weighting at a sample rate (a shelf and a high-pass of the loudness standard)."""
    def section(f, q, db, high):
        k = math.tan(math.pi * f / sr)
        if high:
            a = np.array([1 + k / q + k * k, 2 * (k * k - 1), 1 - k / q + k * k])
            return np.array([1.0, -2.0, 1.0]), a / a[0]
        vh = 10 ** (db / 20)
        vb = vh**0.4996667741545416
        a = np.array([1 + k / q + k * k, 2 * (k * k - 1), 1 - k / q + k * k])
        return np.array([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k]) / a[0], a / a[0]

    # fixed values of the loudness standard
    return [section(1681.974450955533, 0.7071752369554196, 3.999843853973347, False), section(38.13547087602444, 0.5003270373238773, 0.0, True)]


def resample(x: np.ndarray, sr_in: int, sr_out: int, taps: int = 32) -> np.ndarray:
    """Windowed-sinc resampling of a whole signal by a reduced ratio."""
    from tempograph.functions.stateful import Resampler

    if sr_in == sr_out or not len(x):
        return x
    made = Resampler(sr_in, sr_out, taps)
    return np.concatenate([made.push(x), made.flush()])


def time_stretch(x: np.ndarray, rate: float, frame: int = 2048, search: int = 384) -> np.ndarray:
    """Waveform-similarity overlap-add: rate above 1 is shorter. Pieces are moved by up to `search` to fit the tail before."""
    if len(x) < 2 * frame or abs(rate - 1) < 1e-9:
        return x.copy()
    hop, window = frame // 2, hann(frame)
    count = int(len(x) / rate) // hop
    padded = np.pad(x, (search, frame + search + hop))
    out, norm = np.zeros((count + 2) * hop), np.zeros((count + 2) * hop)
    expected = None
    for i in range(count):
        head = int(i * hop * rate) + search
        if head + frame + search > len(padded):
            break
        if expected is None:
            start = head
        else:
            zone = padded[head - search : head + search + hop]
            start = head - search + int(np.argmax(np.correlate(zone, expected, "valid")))
        out[i * hop : i * hop + frame] += padded[start : start + frame] * window
        norm[i * hop : i * hop + frame] += window
        expected = padded[start + hop : start + 2 * hop]
    n = int(round(len(x) / rate))
    out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-6)
    return np.pad(out, (0, max(0, n - len(out))))[:n]


def pitch_shift(x: np.ndarray, semitones: float) -> np.ndarray:
    """Shifted in pitch, of the same length."""
    factor = 2 ** (semitones / 12)
    longer = time_stretch(x, 1 / factor)
    at = np.arange(len(x)) * factor
    return np.interp(at, np.arange(len(longer)), longer, right=0.0) if len(longer) else longer


def hpss(x: np.ndarray, win: int = 2048, hop: int = 512, width: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Harmonic and percussive parts by soft masks from medians over time and over frequency."""
    if len(x) < win:
        x = np.pad(x, (0, win - len(x)))
    n, w = 1 + (len(x) - win) // hop, hann(win)
    spec = np.fft.rfft(frames(x, win, hop, n) * w, axis=1)
    mag = np.abs(spec)
    half = width // 2
    medians = []
    for axis in (0, 1):
        padded = np.pad(mag, [(half, half) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        medians.append(np.median(np.lib.stride_tricks.sliding_window_view(padded, width, axis), axis=-1) ** 2)
    total = medians[0] + medians[1] + 1e-12
    parts = []
    for m in medians:
        back = np.fft.irfft(spec * (m / total), win, axis=1) * w
        out, norm = np.zeros(len(x)), np.zeros(len(x))
        for i in range(n):
            out[i * hop : i * hop + win] += back[i]
            norm[i * hop : i * hop + win] += w * w
        parts.append(np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-6))
    return parts[0], parts[1]

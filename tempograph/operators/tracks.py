"""Whole-track analysis and treatment: one group is one track's blocks (track, block_no, sr, x array<float>)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tempograph.functions import kernels, stateful


def joined(blocks: pd.DataFrame) -> tuple[np.ndarray, int]:
    """Samples of a track in order of its blocks, and its rate."""
    ordered = blocks.sort_values("block_no")
    parts = [np.asarray(x, float) for x in ordered["x"]]
    return (np.concatenate(parts) if parts else np.zeros(0)), int(ordered["sr"].iloc[0])


def per_track(blocks: DataFrame, schema: str, compute: Callable[[np.ndarray, int], list[tuple]], status: bool = True) -> DataFrame:
    """Rows (track, *schema) of compute(samples, sr); a failing track becomes a row with `error`, and others go on."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, pdf):
        error = None
        try:
            rows = compute(*joined(pdf))
        except Exception as e:  # noqa: BLE001  any track may be broken in any way
            rows, error = [(None,) * len(names)], f"{type(e).__name__}: {e}"
        out = pd.DataFrame(rows, columns=names).astype(object)
        out.insert(0, "track", key[0])
        if status:
            out["error"] = error
        return out

    return blocks.groupBy("track").applyInPandas(run, f"track string, {schema}" + (", error string" if status else ""))


def per_block(blocks: DataFrame, schema: str, start: Callable[[int], object]) -> DataFrame:
    """Rows (track, *schema, error) of a measurement that walks through each track's blocks in order.

    start(sr) gives an object with push(samples) and end(), the rows. A task
    holds one block, whatever the length of a track. A failing track becomes a
    row with `error`, and others go on.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, meter, error = None, None, None

        def finished() -> pd.DataFrame:
            rows, wrong = [], error
            if wrong is None:
                try:
                    rows = meter.end()
                except Exception as e:  # noqa: BLE001  any track may be broken in any way
                    wrong = f"{type(e).__name__}: {e}"
            if wrong is not None:
                rows = [(None,) * len(names)]
            out = pd.DataFrame(rows, columns=names).astype(object)
            out.insert(0, "track", track)
            out["error"] = wrong
            return out

        for pdf in batches:
            for name, sr, x in zip(pdf["track"], pdf["sr"], pdf["x"]):
                if name != track:
                    if track is not None:
                        yield finished()
                    track, meter, error = name, None, None
                if error is None:
                    try:
                        meter = start(int(sr)) if meter is None else meter
                        meter.push(np.asarray(x, float))
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
        if track is not None:
            yield finished()

    ordered = blocks.select("track", "block_no", "sr", "x").repartition(n, "track").sortWithinPartitions("track", "block_no")
    return ordered.mapInPandas(run, f"track string, {schema}, error string")


class _Peaks:
    """Spectral peaks at 11025 Hz; the level that they must pass is known at the end."""

    def __init__(self, sr: int, target: int = 11025):
        self.resampler = stateful.Resampler(sr, target) if sr != target else None
        self.frames = kernels.LevelFrames()

    def push(self, x: np.ndarray) -> None:
        self.frames.push(self.resampler.push(x) if self.resampler else x)

    def end(self) -> list[tuple]:
        if self.resampler:
            self.frames.push(self.resampler.flush())
        return list(zip(*(a.tolist() for a in self.frames.peaks())))


def peaks(blocks: DataFrame) -> DataFrame:
    """(track, frame, bin, error) of spectral peaks of the signal at 11025 Hz."""
    return per_block(blocks, "frame long, bin long", _Peaks)


class _Analysis:
    def __init__(self, sr: int):
        self.sr, self.n, self.square = sr, 0, 0.0
        self.peak, self.tone = stateful.TruePeak(), kernels.ChromaSum(sr)

    def push(self, x: np.ndarray) -> None:
        self.n, self.square = self.n + len(x), self.square + float((x * x).sum())
        self.peak.push(x)
        self.tone.push(x)

    def end(self) -> list[tuple]:
        rms = float(20 * np.log10(np.sqrt(self.square / max(1, self.n)) + 1e-12))
        return [(self.n / self.sr, rms, self.peak.value_db(), int(self.tone.value().argmax()))]


def analysis(blocks: DataFrame) -> DataFrame:
    """Duration, level, true peak and the strongest pitch class of each track."""
    return per_block(blocks, "duration double, rms_db double, true_peak_db double, pitch_class int", _Analysis)


class _Loudness:
    def __init__(self, sr: int, win: int | None = None):
        self.meter = stateful.Loudness(sr, win=win)

    def push(self, x: np.ndarray) -> None:
        self.meter.push(x)

    def end(self) -> list[tuple]:
        return [(self.meter.value(),)]


def loudness(blocks: DataFrame, win: int | None = None) -> DataFrame:
    """Integrated loudness of each track: weighting, blocks of 400 ms (or `win` samples), two gates; -infinity where nothing passes."""
    return per_block(blocks, "lufs double", lambda sr: _Loudness(sr, win))


class _TruePeak:
    def __init__(self, _: int):
        self.meter = stateful.TruePeak()

    def push(self, x: np.ndarray) -> None:
        self.meter.push(x)

    def end(self) -> list[tuple]:
        return [(self.meter.value_db(),)]


def true_peak(blocks: DataFrame) -> DataFrame:
    """Level of the highest value between each track's samples."""
    return per_block(blocks, "true_peak_db double", _TruePeak)


def treated(blocks: DataFrame, treat: Callable[[np.ndarray, int], np.ndarray], block_frames: int = 1 << 18) -> DataFrame:
    """The blocks of each track after a treatment of its whole signal: (track, block_no, sr, x, error)."""

    def compute(x, sr):
        y = treat(x, sr)
        return [(i, sr, y[k : k + block_frames].tolist()) for i, k in enumerate(range(0, max(1, len(y)), block_frames))]

    return per_track(blocks, "block_no long, sr int, x array<double>", compute)


def stretched(blocks: DataFrame, rate: float, frame: int = 2048, search: int = 384) -> DataFrame:
    return treated(blocks, lambda x, sr: kernels.time_stretch(x, rate, frame, search))


def shifted(blocks: DataFrame, semitones: float) -> DataFrame:
    return treated(blocks, lambda x, sr: kernels.pitch_shift(x, semitones))

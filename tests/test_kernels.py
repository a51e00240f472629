"""Kernels, track operators and the audio source, on generated tones."""

import io
import math
import wave

import numpy as np
import pytest

from tempograph.functions import kernels, stateful
from tempograph.operators import tracks
from tempograph.sources import audio


def tone(freq, seconds, sr=8000, amp=0.4):
    return amp * np.sin(2 * math.pi * freq * np.arange(int(seconds * sr)) / sr)


def cut(treat, x, size):
    return np.concatenate([*(treat.push(x[k : k + size]) for k in range(0, len(x), size)), treat.flush()])


def plain_section(b, a, x):
    z1 = z2 = 0.0
    out = []
    for v in x:
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        out.append(y)
    return np.array(out)


def test_cutting_into_blocks_changes_nothing():
    x = np.random.default_rng(1).normal(size=5000)
    for kind in ("lowpass", "highpass", "bandpass", "notch", "peak", "lowshelf", "highshelf"):
        b, a = kernels.biquad(kind, 8000, 900, gain_db=4)
        assert all(np.allclose(cut(stateful.Section(b, a), x, size), plain_section(b, a, x), atol=1e-9) for size in (5000, 997, 3))
    made = [
        lambda: stateful.Limiter(0.5, 0.9, look=37, decimate=16), lambda: stateful.Compressor(attack=0.4, release=0.9), lambda: stateful.Ducker(0.5, 0.3, 0.9),
        lambda: stateful.Delay(300, 0.4), lambda: stateful.Resampler(3, 2), lambda: stateful.Resampler(80, 147),
        lambda: stateful.Chain(stateful.Section(*kernels.biquad("highpass", 8000, 50)), stateful.Compressor(), stateful.Limiter(0.8, 0.9, look=20)),
    ]
    for start in made:
        whole = cut(start(), x, len(x))
        assert all(np.allclose(cut(start(), x, size), whole, atol=1e-9) for size in (1, 13, 256, 997))
        assert len(whole) in (5000, -(-5000 * 2 // 3), -(-5000 * 147 // 80))


def test_limiter_holds_its_ceiling_and_looks_ahead():
    x = tone(100, 1, amp=0.2)
    x[4000] = 3.0
    y = cut(stateful.Limiter(0.5, stateful.coefficient(50, 8000), look=40, decimate=1), x, 700)
    assert len(y) == len(x) and np.abs(y).max() <= 0.5 and np.allclose(y[:3900], x[:3900])
    assert abs(y[3960] / x[3960]) < 0.2 and abs(y[7900] / x[7900]) > 0.9


def test_resampling_keeps_a_tone():
    x = tone(440, 1, 44100)
    y = kernels.resample(x, 44100, 11025)
    want = tone(440, 1, 11025)
    assert len(y) == 11025 and np.abs(y[100:-100] - want[100:-100]).max() < 5e-3


def test_filters_pass_and_stop():
    low, high = tone(100, 1), tone(3000, 1)
    b, a = kernels.biquad("lowpass", 8000, 600)
    level = lambda x: np.sqrt((stateful.Section(b, a).push(x)[2000:] ** 2).mean())
    assert level(low) > 0.27 and level(high) < 0.02


def test_stretch_and_pitch():
    x = tone(440, 4)
    for rate in (0.85, 1.15):
        assert abs(len(kernels.time_stretch(x, rate)) - len(x) / rate) / len(x) < 0.02
    assert len(kernels.time_stretch(x, 1.0)) == len(x)
    y = kernels.pitch_shift(x, 12)
    peak = np.abs(np.fft.rfft(y[4000:20000] * kernels.hann(16000))).argmax() * 8000 / 16000
    assert len(y) == len(x) and abs(1200 * math.log2(peak / 880)) < 15


def test_true_peak_exceeds_the_samples():
    x = np.sin(2 * math.pi * np.arange(4000) / 4 + math.pi / 4)
    levels = []
    for size in (4000, 333):
        peak = stateful.TruePeak()
        for k in range(0, len(x), size):
            peak.push(x[k : k + size])
        levels.append(peak.value_db())
    assert np.abs(x).max() < 0.72 and abs(levels[0]) < 0.2 and abs(levels[0] - levels[1]) < 1e-9
    long = stateful.TruePeak()
    long.push(np.sin(np.arange(3_000_000)))
    assert abs(long.value_db()) < 0.5  # the ends ring a little


def test_hpss_splits_a_tone_and_a_click():
    x = tone(500, 1)
    x[4000] += 5
    harmonic, percussive = kernels.hpss(x)
    assert np.abs(percussive).argmax() in range(3990, 4011) and np.abs(harmonic[6000:7000]).max() > 0.3


def test_peaks_follow_the_code_that_drops_a_frame():
    x = np.concatenate([np.random.default_rng(2).normal(0, 1e-4, 4096), tone(1000, 1, 11025)])
    frame, bin_ = kernels.spectral_peaks(x)
    assert frame.max() == (len(x) - 1024) // 512 - 1 and set(bin_[frame >= 8]) <= {92, 93, 94}
    assert len(kernels.spectral_peaks(x[:3000])[0]) == 0


@pytest.fixture
def folder(tmp_path):
    sounds = {"a b.wav": tone(220, 1), "quiet.wav": tone(220, 1) * 0, "short.wav": tone(220, 0.05)}
    for name, x in sounds.items():
        (tmp_path / name).write_bytes(audio.encode(np.stack([x, x], 1), 8000))
    (tmp_path / "broken.wav").write_bytes(b"RIFFxxxx")
    (tmp_path / "empty.WAV").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no sound")
    return tmp_path


def test_scan_headers_and_blocks(spark, folder):
    name = lambda p: p.rsplit("/", 1)[-1].replace("%20", " ")
    heads = {name(r.track): r for r in audio.headers(spark, str(folder)).collect()}
    assert heads["a b.wav"].frames == 8000 and heads["a b.wav"].seconds == 1.0 and heads["broken.wav"].error is not None and len(heads) == 4
    rows = audio.blocks(spark, str(folder), block_frames=3000).collect()
    mine = sorted((r for r in rows if name(r.track) == "a b.wav"), key=lambda r: r.block_no)
    assert [r.start for r in mine] == [0, 3000, 6000] and np.allclose(np.concatenate([r.l for r in mine]), tone(220, 1), atol=1e-4)
    assert sorted(name(r.track) for r in rows if r.error) == ["broken.wav"]
    assert sum(len(r.l) for r in audio.blocks(spark, str(folder), max_seconds=0.5).collect() if r.l) == 4000 + 4000 + 400


def test_track_operators_do_not_depend_on_block_size(spark, folder):
    out = []
    for size in (1 << 18, 777):
        mono = audio.mono(audio.blocks(spark, str(folder), block_frames=size))
        loud = {r.track.rsplit("/", 1)[-1]: r.lufs for r in tracks.loudness(mono).collect()}
        seen = {r.track.rsplit("/", 1)[-1]: r for r in tracks.analysis(mono).collect()}
        out.append((loud, {k: (r.duration, round(r.true_peak_db, 6), r.pitch_class) for k, r in seen.items()}))
    assert out[0][0].keys() == out[1][0].keys()
    assert all(a == b or abs(a - b) < 1e-6 for a, b in zip(*(sorted(o[0].values()) for o in out))) and out[0][1] == out[1][1]
    assert out[0][0]["quiet.wav"] == float("-inf") == out[0][0]["short.wav"]


def test_resampled_blocks_and_windows(spark, folder):
    whole = audio.blocks(spark, str(folder), target_sr=4000).where("error is null").collect()
    cut_ = audio.blocks(spark, str(folder), block_frames=700, target_sr=4000).where("error is null").collect()
    by = lambda rows: {t: np.concatenate([r.l for r in sorted((r for r in rows if r.track == t), key=lambda r: r.block_no)]) for t in {r.track for r in rows}}
    a, b = by(whole), by(cut_)
    assert a.keys() == b.keys() and len(a) == 3 and all(np.allclose(a[t], b[t], atol=1e-6) for t in a) and sorted(map(len, a.values())) == [200, 4000, 4000]
    found = audio.windows(audio.headers(spark, str(folder)), max_seconds=0.4, count=4)
    rows = sorted((r.start, r.frames) for r in found.where("track like '%quiet%'").collect())
    assert rows == [(600, 800), (2600, 800), (4600, 800), (6600, 800)] and found.where("track like '%short%'").count() == 1
    assert sum(len(r.l) for r in audio.read(found).collect()) == 2 * 3200 + 400


def test_peaks_are_found_at_one_rate(spark, folder):
    rows = tracks.peaks(audio.mono(audio.blocks(spark, str(folder), block_frames=900))).where("error is null").collect()
    bins = {r.bin for r in rows if "quiet" not in r.track}
    assert bins and bins <= {19, 20, 21}


def test_a_failing_track_is_a_row(spark, folder):
    def treat(x, sr):
        if not x.any():
            raise ValueError("silence")
        return x * 0.5

    rows = tracks.treated(audio.mono(audio.blocks(spark, str(folder))), treat).collect()
    assert {r.track.rsplit("/", 1)[-1]: r.error for r in rows} == {"a b.wav": None, "quiet.wav": "ValueError: silence", "short.wav": None}


def test_written_files_are_metered_and_read_back(spark, folder, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    done = audio.write(audio.blocks(spark, str(folder)), str(out), 3).collect()
    assert {r.frames for r in done} == {8000, 400} and max(r.peak for r in done) == pytest.approx(0.4, abs=1e-3)
    with wave.open(io.BytesIO((out / "quiet.wav").read_bytes())) as w:
        assert w.getsampwidth() == 3 and w.getnframes() == 8000


def test_inputs_are_distinct_in_order(spark):
    listing = spark.createDataFrame([(0, 0, "/m/a.wav", "dir"), (0, 1, "/m/a.txt", "dir"), (1, 0, "/m/odd.bin", "file"), (3, 0, "/m/a.wav", "glob")], "ord int, sub int, path string, kind string")
    lines = ["# note", "", '"/m/b.wav"', "  c.flac ", "/m/odd.bin"]
    playlists = spark.createDataFrame([(2, i, "/p", x) for i, x in enumerate(lines)], "ord int, sub int, folder string, line string")
    found = audio.collect_inputs(spark, listing, playlists).orderBy("ord", "sub").collect()
    assert [r.path for r in found] == ["/m/a.wav", "/m/odd.bin", "/m/b.wav", "/p/c.flac"]


def test_inputs_are_listed(spark, folder):
    (folder / "list.txt").write_text('# c\n"quiet.wav"\nmissing.wav\n\n')
    found = audio.inputs(spark, str(folder / "list.txt"), str(folder), str(folder / "s*.wav"), str(folder / "note.txt")[:-8] + "broken.wav", str(folder / "none*"))
    rows = [(r.path.rsplit("/", 1)[-1], r.error) for r in found.orderBy("ord", "sub").collect()]
    assert rows == [("quiet.wav", None), ("missing.wav", "no such file"), ("a b.wav", None), ("broken.wav", None), ("empty.WAV", None), ("short.wav", None), ("none*", "no such file")]


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"0{i}:00 t{i}") for i in (2, 0, 1)], "pos int, line string").repartition(3)
    audio.write_tracklist(lines, "pos", "line", f"{tmp_path}/list")
    assert [r.value for r in spark.read.text(f"{tmp_path}/list").collect()] == ["00:00 t0", "01:00 t1", "02:00 t2"]
    audio.write_report(lines, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 3

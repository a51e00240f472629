"""Column expressions: levels, curves, keys, text and time. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PITCH_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
#: Other spellings of notes.
SPELLINGS = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#", "Cb": "B", "Fb": "E", "E#": "F", "B#": "C"}
#: Keys whose notes are written with flats.
FLAT_KEYS = [1, 3, 5, 8, 10]
#: Short names of scales.
SHORT_SCALES = {"": "minor", "maj": "major", "min": "minor", "m": "minor"}
#: Scales that a key may name.
SCALE_NAMES = ["major", "minor", "natural minor", "harmonic minor", "melodic minor", "dorian", "phrygian", "lydian", "mixolydian", "aeolian", "pentatonic", "minor pentatonic"]


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once; a plain column expression inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def gain_to_db(gain: Column) -> Column:
    return 20 * F.log10(F.greatest(gain, F.lit(1e-12)))


def soft_clip(x: Column, drive: float = 1.0) -> Column:
    return F.tanh(x * drive) / math.tanh(drive)


def tape_saturate(x: Column, drive: float = 1.4, asym: float = 0.06) -> Column:
    return F.tanh(drive * (x + asym * x * x)) / math.tanh(drive)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def quantise(x: Column, bits: int = 12) -> Column:
    """Nearest of 2**(bits-1) levels, halves to even."""
    levels = 2.0 ** (bits - 1)
    return F.rint(x * levels) / levels


def hold(rows: Column, every: int) -> Column:
    """An array in which each run of `every` values has the first of them."""
    return F.transform(rows, lambda x, i: F.get(rows, (F.floor(i / every) * every).cast("int")))


def equal_power(i: Column, n: int, fade_in: bool = True) -> Column:
    """Quarter-wave curve over 0..n-1; 1 throughout when n is at most 1."""
    if n <= 1:
        return F.lit(1.0)
    angle = F.lit(math.pi / 2) * i / (n - 1)
    return F.sin(angle) if fade_in else F.cos(angle)


def raised_cosine(i: Column, n: int, fade_in: bool = True) -> Column:
    if n <= 1:
        return F.lit(1.0)
    curve = F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(math.pi) * i / (n - 1))
    return curve if fade_in else 1 - curve


def compressor_gain_db(level: Column, threshold: float = -18.0, ratio: float = 3.0, knee: float = 6.0) -> Column:
    """Static curve: none below the knee, quadratic in it, linear above."""
    slope, over = 1 / ratio - 1, level - threshold
    inside = slope * F.pow(over + knee / 2, F.lit(2.0)) / (2 * knee)
    return F.when(2 * over < -knee, 0.0).when(2 * F.abs(over) <= knee, inside).otherwise(slope * over)


def perc_envelope(i: Column, sr: float, attack: float = 0.002, decay: float = 0.4, curve: float = 3.5) -> Column:
    t = i / sr
    return F.least(F.lit(1.0), t / attack) * F.exp(-curve * t / decay)


def midi_to_hz(midi: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (midi - 69) / 12)


def midi_to_name(midi: Column) -> Column:
    names = F.array(*map(F.lit, PITCH_NAMES))
    return F.concat(F.element_at(names, F.pmod(midi, F.lit(12)).cast("int") + 1), (F.floor(midi / 12) - 1).cast("string"))


def pitch_class(note: Column) -> Column:
    """0..11 of a note name with sharps or flats, null if there is no such note."""
    named = {n.upper(): i for i, n in enumerate(PITCH_NAMES)} | {n.upper(): PITCH_NAMES.index(s) for n, s in SPELLINGS.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), F.upper(F.trim(note)))


def parse_key(text: Column) -> Column:
    """struct(pc, mode) of text such as 'A Minor', 'Bb-dorian' or 'F# harmonic minor'.

    Without text A minor; an unknown note is A; without a scale minor; an
    unknown scale is minor if it says `min`, else major.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "-", " "), r"\s+", " "))
    note, scale = F.split_part(plain, F.lit(" "), F.lit(1)), F.lower(F.trim(F.regexp_replace(plain, r"^\S*", "")))
    scale = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SHORT_SCALES.items() for x in pair]), scale), scale)
    mode = F.when(scale.isin(*SCALE_NAMES), scale).when(scale.contains("min"), "minor").otherwise("major")
    return F.struct(F.coalesce(pitch_class(note), F.lit(9)).alias("pc"), mode.alias("mode"))


def note_name(pc: Column, key: Column) -> Column:
    """A pitch class as written in a key: with flats in flat keys, else with sharps."""
    flats = {PITCH_NAMES.index(s): n for n, s in SPELLINGS.items() if n[1:] == "b" and s.endswith("#")}
    low = F.pmod(pc, F.lit(12)).cast("int")
    flat = F.try_element_at(F.create_map(*[F.lit(x) for pair in flats.items() for x in pair]), low)
    sharp = F.element_at(F.array(*map(F.lit, PITCH_NAMES)), low + 1)
    return F.when(F.pmod(key, F.lit(12)).isin(*FLAT_KEYS), F.coalesce(flat, sharp)).otherwise(sharp)


def quantise_to_scale(midi: Column, tones: Column) -> Column:
    """The nearest note whose pitch class is in `tones`, the lower of two equally near; itself if there is none within six."""
    near = F.filter(F.sequence(F.lit(-6), F.lit(6)), lambda d: F.array_contains(tones, F.pmod(midi + d, F.lit(12))))
    best = F.array_min(F.transform(near, lambda d: F.struct(F.abs(d).alias("far"), d.alias("d"))))
    return midi + F.coalesce(best.d, F.lit(0))


def circle(a: Column, b: Column) -> Column:
    """Semitones between pitch classes the shorter way round."""
    return F.least(F.pmod(a - b, F.lit(12)), F.pmod(b - a, F.lit(12)))


def _folded(pc: Column, minor: Column) -> Column:
    return F.pmod(pc + F.when(minor, 3).otherwise(0), F.lit(12))


def key_distance(pc_a: Column, minor_a: Column, pc_b: Column, minor_b: Column) -> Column:
    """Distance of relative majors; another mode costs 0.75 unless the keys are relatives."""
    d = circle(_folded(pc_a, minor_a), _folded(pc_b, minor_b)).cast("double")
    return d + F.when((minor_a != minor_b) & (d > 0), 0.75).otherwise(0.0)


def semitones_to_key(pc_a: Column, minor_a: Column, pc_b: Column, minor_b: Column, most: int = 4) -> Column:
    """Signed shift in -5..6 between relative majors, 0 if it is beyond `most`."""
    up = F.pmod(_folded(pc_b, minor_b) - _folded(pc_a, minor_a), F.lit(12))
    shift = F.when(up > 6, up - 12).otherwise(up)
    return F.when(F.abs(shift) > most, 0).otherwise(shift)


def step_time(step: Column, bpm: Column, swing: float, sr: float) -> Column:
    """Samples of a sixteenth-grid step; odd steps come later by `swing` of a step."""
    step_s = 60.0 / bpm / 4
    odd = F.pmod(F.floor(step), F.lit(2)) == 1
    return (step * step_s + F.when(odd, swing * step_s).otherwise(0.0)) * sr


def slug(text: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(body, F.lit("")), F.lit("track"))


def fmt_time(seconds: Column, force_hours: Column | bool = False) -> Column:
    """H:MM:SS from an hour on or when forced, else MM:SS; halves of a second to even, never below 0."""
    s = F.greatest(F.rint(seconds), F.lit(0.0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    forced = F.lit(force_hours) if isinstance(force_hours, bool) else force_hours
    return F.when((h > 0) | forced, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def human_size(size: Column) -> Column:
    units, out = ["B", "KB", "MB", "GB"], None
    for k, unit in enumerate(units):
        text = F.format_string("%.1f %s", size / 1024.0**k, F.lit(unit))
        out = F.when(size < 1024.0 ** (k + 1), text) if out is None else out.when(size < 1024.0 ** (k + 1), text)
    return out.otherwise(F.format_string("%.1f %s", size / 1024.0**4, F.lit("TB")))


def coerce(text: Column) -> Column:
    """struct(kind, value): bool, int, float or string, as an override's text is read."""
    low = F.lower(F.trim(text))
    kind = F.when(low.isin("true", "false"), "bool").when(text.try_cast("bigint").isNotNull(), "int").when(text.try_cast("double").isNotNull(), "float").otherwise("string")
    return F.struct(kind.alias("kind"), F.when(kind == "bool", low).otherwise(text).alias("value"))


def is_out_of_memory(message: Column) -> Column:
    # fixed values: what servers say
    return F.lower(message).rlike("out of memory|cuda oom|outofmemory|allocate|cublas_status_alloc_failed")


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit("." + suffix.lstrip(".")))


def iso_time(ts: Column) -> Column:
    """ISO form of a time, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def day_stamp(ts: Column) -> Column:
    """The form of a time that names files."""
    return F.date_format(ts, "yyyyMMdd-HHmmss")

"""Sequencing: targets, order, timelines, titles, chapters and event grids."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions.scalar import bound, clip, fmt_time, key_distance, step_time
from tempograph.operators.catalogue import melody_pool
from tempograph.operators.ordered import numbered

#: Suffixes of repeated titles.
NUMERALS = ["II", "III", "IV", "V", "VI", "VII", "VIII"]


#: Key (pc, minor) of a group without tracks that have one.
DEFAULT_KEY = (9, True)


def target_tempo(tracks: DataFrame, group: str, bpm: str, low: float = 55.0, high: float = 110.0, default: float = 80.0, wanted: Column | None = None) -> DataFrame:
    """The wanted tempo, else the median of those that are not zero, else the default, kept within bounds."""
    middle = F.percentile(F.when(F.col(bpm) != 0, F.col(bpm)), F.lit(0.5))
    chosen = F.coalesce(middle, F.lit(default)) if wanted is None else F.coalesce(F.nullif(F.first(wanted), F.lit(0.0)), middle, F.lit(default))
    return tracks.groupBy(group).agg(F.round(clip(chosen, low, high), 2).alias("bpm"))


def target(groups: DataFrame, tracks: DataFrame, group: str, bpm: str) -> DataFrame:
    """(group, bpm, pc, minor) of groups (group, want_bpm, want_pc, want_minor): what is wanted, else what the tracks suggest.

    A wanted tempo is kept within bounds too. Without a wanted key the medoid
    counts, without any key DEFAULT_KEY.
    """
    middle = tracks.groupBy(group).agg(F.percentile(F.when(F.col(bpm) != 0, F.col(bpm)), F.lit(0.5)).alias("__middle"))
    keys = medoid_key(tracks.where("pc is not null"), group).select(group, F.col("pc").alias("__pc"), F.col("minor").alias("__minor"))
    joined = groups.join(middle, group, "left").join(keys, group, "left")
    tempo = F.coalesce(F.nullif("want_bpm", F.lit(0.0)), "__middle", F.lit(80.0))
    key = lambda wanted, own, default: F.when(F.col("want_pc").isNotNull(), F.col(wanted)).otherwise(F.coalesce(own, F.lit(default)))
    return joined.select(group, F.round(clip(tempo, 55.0, 110.0), 2).alias("bpm"), key("want_pc", "__pc", DEFAULT_KEY[0]).alias("pc"), key("want_minor", "__minor", DEFAULT_KEY[1]).alias("minor"))


def medoid_key(tracks: DataFrame, group: str) -> DataFrame:
    """The key (pc, minor) with the least total distance to all tracks of the group, the first by `pos` of equals.

    Tracks are counted by key first, so at most 24 keys meet 24.
    """
    keys = tracks.groupBy(group, "pc", "minor").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    other = keys.select(group, F.col("pc").alias("pc2"), F.col("minor").alias("minor2"), F.col("n").alias("n2"))
    total = keys.join(other, group).groupBy(group, "pc", "minor", "first").agg(F.sum(key_distance(F.col("pc"), F.col("minor"), F.col("pc2"), F.col("minor2")) * F.col("n2")).alias("total"))
    best = total.groupBy(group).agg(F.min(F.struct("total", "first", "pc", "minor")).alias("b"))
    return best.select(group, F.col("b.pc").alias("pc"), F.col("b.minor").alias("minor"), F.col("b.total").alias("total"))


def ordered_tracks(tracks: DataFrame, group: str, mode: str = "harmonic", seed: int = 0) -> DataFrame:
    """(group, place, id) of tracks (group, pos, id, bpm, pc, minor) in a mode.

    `asis` keeps pos; `shuffle` orders by a digest of seed and id; `harmonic`
    starts with the slowest track and goes on to the nearest by (key distance,
    tempo difference), the first by pos of equals. A set list is walked by one
    task; it must be one that a listener could hear.
    """
    if mode == "asis":
        return tracks.select(group, (F.row_number().over(W.partitionBy(group).orderBy("pos")) - 1).alias("place"), "id")
    if mode == "shuffle":
        digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string")))
        return tracks.select(group, (F.row_number().over(W.partitionBy(group).orderBy(digest, "pos")) - 1).alias("place"), "id")
    if mode != "harmonic":
        raise ValueError(f"no such order: {mode}")
    kinds = {c: tracks.schema[c].dataType.simpleString() for c in (group, "id")}

    def walk(key, pdf):
        rows = pdf.sort_values("pos")
        order = greedy_order(list(zip(rows["id"], rows["bpm"], rows["pc"], rows["minor"])), key_gap)
        return type(pdf)({group: [key[0]] * len(order), "place": range(len(order)), "id": order})

    return tracks.select(group, "pos", "id", "bpm", "pc", "minor").groupBy(group).applyInPandas(walk, f"{group} {kinds[group]}, place int, id {kinds['id']}")


def greedy_order(tracks: list[tuple], distance) -> list:
    """Ids of (id, bpm, pc, minor): from the slowest on always the nearest by (distance, tempo difference), the first of equals.

    A driver loop: each step depends on the one before, and a set list is
    short; the caller bounds its length.
    """
    left = list(tracks)
    out = [min(left, key=lambda t: t[1])] if left else []
    left = [t for t in left if not out or t is not out[0]]
    while left:
        last = out[-1]
        best = min(left, key=lambda t: (distance(last, t), abs(last[1] - t[1])))
        left = [t for t in left if t is not best]
        out.append(best)
    return [t[0] for t in out]


def key_gap(a: tuple, b: tuple) -> float:
    """The distance of `key_distance` for two tracks (id, bpm, pc, minor)."""
    x, y = ((t[2] + (3 if t[3] else 0)) % 12 for t in (a, b))
    d = min((x - y) % 12, (y - x) % 12)
    return d + (0.75 if a[3] != b[3] and d else 0.0)


def mix_timeline(tracks: DataFrame, group: str, length: str, crossfade: int, least: int) -> DataFrame:
    """Start of each track when neighbours overlap by the crossfade, or by the shorter of the two if that is less.

    Tracks shorter than `least` are left out; `pos` gives the order.
    """
    w = W.partitionBy(group).orderBy("pos")
    kept = tracks.where(F.col(length) >= least)
    overlap = F.least(F.lit(crossfade), F.lag(length).over(w), F.col(length))
    laid = kept.withColumn("overlap", F.coalesce(F.when(F.lag(length).over(w).isNotNull(), overlap), F.lit(0)))
    return laid.withColumn("start", F.sum(F.col(length) - F.col("overlap")).over(w) - (F.col(length) - F.col("overlap")) - F.col("overlap"))


class Reel:
    """What has been written of a programme and the tail that the next track is blended with, in frames."""

    def __init__(self, crossfade: int, held: int):
        self.crossfade, self.held, self.written, self.tail, self.empty = crossfade, held, 0, 0, True

    def add(self, frames: int) -> tuple[int, int]:
        """(start, overlap) of a track: its start is what was written before the blend."""
        overlap = 0 if self.empty else min(self.crossfade, self.tail, frames)
        self.written += 0 if self.empty else self.tail - overlap
        start, body = self.written, frames - overlap
        kept = min(body, self.held)
        self.written, self.tail, self.empty = self.written + overlap + body - kept, kept, False
        return start, overlap


def programme(tracks: DataFrame, group: str, begin: Callable, goal: int = 0) -> DataFrame:
    """(group, segment, pos, turn, start, frames, overlap) of tracks laid one after the other, over and over until a goal.

    `tracks` has group, pos and what begin looks at: begin(key, rows) gives a
    Reel and a function (row, turn, index) -> frames of a track in a turn, or
    None to pass over it. A programme ends when it has `goal` frames (0: after
    each track's turn), when as many tracks in a row as there are were passed
    over, or after 200 turns. One task lays one programme.
    """
    names = [c for c in tracks.columns if c != group]
    kind = tracks.schema[group].dataType.simpleString()

    def lay(key, pdf):
        rows = list(pdf.sort_values("pos")[names].itertuples(index=False, name="Track"))
        reel, place = begin(key[0], rows)
        out, index, passed = [], 0, 0
        while passed < len(rows) and index <= 200 * len(rows):
            row, turn = rows[index % len(rows)], index // len(rows)
            if turn and not goal:
                break
            frames = place(row, turn, index)
            index, passed = index + 1, passed + 1
            if frames is None:
                continue
            passed = 0
            start, overlap = reel.add(frames)
            out.append((key[0], len(out), row.pos, turn, start, frames, overlap))
            if goal and reel.written + reel.tail >= goal:
                break
        return type(pdf)(out, columns=[group, "segment", "pos", "turn", "start", "frames", "overlap"])

    return tracks.groupBy(group).applyInPandas(lay, f"{group} {kind}, segment int, pos long, turn int, start long, frames long, overlap long")


def mix_programme(tracks: DataFrame, group: str, crossfade: int, fade: int, least: int, goal: int = 0) -> DataFrame:
    """Tracks (group, pos, len) back to back, as `programme`: the longer of crossfade and final fade is held back as the tail.

    Tracks shorter than `least` are passed over.
    """
    return programme(tracks, group, lambda *_: (Reel(crossfade, max(crossfade, fade)), lambda row, *_: None if row.len < least else int(row.len)), goal)


def draw(*parts) -> float:
    """A number in [0, 1) that depends on its arguments alone; SQL can work it out too."""
    return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:4], 16) / 65536


def drawn(*parts: Column) -> Column:
    """`draw` of columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *(p.cast("string") for p in parts))), 1, 4), 16, 10).cast("int") / 65536


def fitted_rate(ratio: float, max_percent: float) -> float:
    """`tempo_fit` of a ratio of tempos."""
    rate = next((r for r in (ratio, ratio * 2, ratio / 2) if r and abs(r - 1) * 100 <= max_percent), 1.0)
    return 1.0 if abs(rate - 1) < 0.002 else rate


def song_programme(tracks: DataFrame, group: str, sr: int, bpm: float, bars: int, goal: int = 0, max_stretch: float = 18.0) -> DataFrame:
    """Tracks (group, pos, seconds, bpm, downbeat) as one song at a tempo, as `programme`.

    The crossfade shrinks to what the group's shortest track allows. A track
    is played at its fitted rate, in later turns at a tempo up to 1 % off for
    each turn up to the third, and cut to whole bars from its downbeat on; it
    needs a second more than the crossfade before and twice the crossfade
    after that.
    """
    bar = 60.0 / bpm * 4
    shortest = tracks.groupBy(group).agg(F.min("seconds").alias("shortest"))
    wanted = crossfade_bars(F.col("shortest"), F.lit(bar), bars, max_stretch)
    sized = tracks.join(shortest, group).withColumn("cf", F.greatest(F.lit(int(0.5 * sr)), F.floor(wanted * bar * sr).cast("int"))).drop("shortest")

    def begin(key, rows):
        cf = int(rows[0].cf)

        def place(row, turn, index):
            drift = 1.0 + (draw(key, index) - 0.5) * 0.02 * min(turn, 3)
            frames = int(row.seconds / fitted_rate(bpm * drift / row.bpm if row.bpm else 0.0, max_stretch) * sr)
            head = int(max(0.0, row.downbeat) * sr)
            body = frames - (head if head < frames else 0)
            whole = int(body / (bar * sr))
            snapped = round(whole * bar * sr) if whole >= 1 else body
            return None if frames < cf + sr or snapped < 2 * cf else int(snapped)

        return Reel(cf, cf), place

    return programme(sized, group, begin, goal)


def crossfade_bars(shortest: Column, bar: Column, wanted: int, max_stretch: float = 18.0) -> Column:
    """Bars of crossfade that the shortest track allows, at least one."""
    usable = shortest * (1 - max_stretch / 100) - 2 * bar
    most = F.greatest(F.lit(1), F.floor(usable / (2 * bar)).cast("int"))
    return F.when(usable > 0, F.least(F.lit(wanted), most)).when(shortest > 0, F.least(F.lit(wanted), F.lit(1))).otherwise(wanted)


def snap_to_bars(length: Column, bar: Column, downbeat: Column) -> Column:
    """struct(start, stop) of the whole bars from the downbeat on; everything where there is not one bar."""
    bars = F.floor((length - downbeat) / bar)
    return F.when(bars >= 1, F.struct(downbeat.cast("double").alias("start"), (downbeat + bars * bar).cast("double").alias("stop"))).otherwise(F.struct(downbeat.cast("double").alias("start"), length.cast("double").alias("stop")))


def clean_title(stem: Column) -> Column:
    """A file's stem as a title: leading digits and signs go, dashes and underlines are spaces."""
    text = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(stem, r"^[0-9_\- ]+", ""), r"[-_]", " ")))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("Untitled"))


def repeated_titles(tracks: DataFrame, title: str, order: list[str], bucket: Column | None = None) -> DataFrame:
    """Adds `shown`: the nth track of a title gets (II) to (VIII), then (n).

    `bucket`, which must not fall as the order rises, spreads a title that
    very many tracks have over several tasks.
    """
    numbered_ = numbered(tracks, title, order, F.lit(0) if bucket is None else bucket)
    n = F.col("n") + 1
    suffix = F.when(n <= len(NUMERALS) + 1, F.get(F.array(*map(F.lit, NUMERALS)), (n - 2).cast("int"))).otherwise(n.cast("string"))
    return numbered_.withColumn("shown", F.when(n == 1, F.col(title)).otherwise(F.concat(F.col(title), F.lit(" ("), suffix, F.lit(")")))).select(*tracks.columns, "shown")


def chapter_lines(chapters: DataFrame, start: Column, total: Column, title: str) -> DataFrame:
    """Adds `line`: time and title, with hours where the whole lasts one."""
    return chapters.withColumn("line", F.concat(fmt_time(start, total >= 3600), F.lit(" "), F.col(title)))


def tempo_fit(source: Column, target: Column, max_percent: float = 18.0) -> Column:
    """Rate to play at: the first of r, 2r, r/2 within max_percent of 1, else 1; a change under 0.2 % is none."""
    r = F.try_divide(target, source)
    fits = [F.when(F.abs(x - 1) * 100 <= max_percent, x) for x in (r, r * 2, r / 2)]
    rate = F.coalesce(*fits, F.lit(1.0))
    return F.when(F.abs(rate - 1) < 0.002, 1.0).otherwise(rate)


#: Sections of an arrangement: kind, bars, drums, lead, intensity, cutoff, chord shift.
OPEN = 16000.0
INTRO = ("intro", 4, False, False, 0.55, 2600.0, 0)
OUTRO = ("outro", 4, True, False, 0.6, 3200.0, 0)
SHORT_ARC = [("verse", 8, True, False, 0.85, OPEN, 0), ("main", 8, True, True, 1.0, OPEN, 0), ("break", 4, False, True, 0.6, 5200.0, 0), ("main", 8, True, True, 1.0, OPEN, 1)]
LONG_ARC = [
    ("verse", 8, True, False, 0.85, OPEN, 0), ("main", 8, True, True, 1.0, OPEN, 0), ("lift", 8, True, True, 1.05, OPEN, 1), ("break", 4, False, True, 0.6, 5200.0, 0),
    ("main", 8, True, True, 0.95, OPEN, 2), ("rest", 8, True, False, 0.8, OPEN, 3),
]
#: Bars from which on the long arc is used, and the cutoffs of later turns.
LONG_FROM = 60
CUTOFFS = [4200.0, 6500.0, 16000.0]
SECTION = ["kind", "bars", "drums", "lead", "intensity", "cutoff", "chord_shift"]


def bars_of(minutes: Column, bpm: Column, beats: int = 4) -> Column:
    """Bars that a piece of so many minutes has, at least eight."""
    return F.greatest(F.lit(8), F.rint(minutes * 60.0 / (60.0 / bpm * beats)).cast("int"))


def _section(values: tuple) -> Column:
    return F.struct(*(F.lit(v).alias(n) for n, v in zip(SECTION, values)))


def section_plan(tracks: DataFrame, key: str, bars: str) -> DataFrame:
    """(key, section, kind, start, length, drums, lead, intensity, cutoff, chord_shift): intro, the arc over and over, outro.

    Sections are generated up to what the target needs and cut to what is
    left; all is arithmetic on positions, so nothing is ordered or gathered.
    From the second turn of the arc on chords shift on, and a digest of key
    and section decides about cutoff, drums and lead.
    """
    names = [key, "section", "start", "length", *(n for n in SECTION if n != "bars")]
    intro, outro = INTRO[1], OUTRO[1]
    total, plans = F.col(bars), []
    for arc, fits in ((SHORT_ARC, total < LONG_FROM), (LONG_ARC, total >= LONG_FROM)):
        cycle, offsets = sum(a[1] for a in arc), [sum(a[1] for a in arc[:i]) for i in range(len(arc))]
        body = F.greatest(total - intro - outro, F.lit(0))
        dim = F.array(*(F.struct(_section(a).alias("s"), F.lit(o).alias("at")) for a, o in zip(arc, offsets)))
        turns = F.ceil(body / cycle).cast("int")
        each = tracks.where(fits).select(key, body.alias("body"), F.explode(F.when(turns > 0, F.sequence(F.lit(0), turns - 1)).otherwise(F.array().cast("array<int>"))).alias("turn")).select("*", F.posexplode(dim).alias("i", "p"))
        at = F.col("turn") * cycle + F.col("p.at")
        middle = each.where(at < F.col("body")).select(key, (F.col("turn") * len(arc) + F.col("i") + 1).alias("section"), (at + intro).cast("int").alias("start"), F.least(F.col("p.s.bars"), F.greatest(F.lit(4), F.col("body") - at)).cast("int").alias("length"), "turn", "p.s")
        later = lambda tag, share: (F.col("turn") > 0) & (drawn(F.col(key), F.col("section"), F.lit(tag)) < share)
        choice = F.get(F.array(*map(F.lit, CUTOFFS)), F.floor(drawn(F.col(key), F.col("section"), F.lit("which")) * len(CUTOFFS)).cast("int"))
        plans.append(middle.select(
            key, "section", "start", "length", F.col("s.kind").alias("kind"), (F.col("s.drums") & ~later("drums", 0.15)).alias("drums"), (F.col("s.lead") != later("lead", 0.3)).alias("lead"), F.col("s.intensity").alias("intensity"),
            F.when(later("cutoff", 0.22), choice).otherwise(F.col("s.cutoff")).alias("cutoff"), F.pmod(F.col("s.chord_shift") + F.col("turn"), F.lit(4)).alias("chord_shift"),
        ))
    middle = plans[0].unionByName(plans[1])
    first = tracks.select(key, F.lit(0).alias("section"), F.lit(0).alias("start"), F.lit(intro).alias("length"), _section(INTRO).alias("s")).select(key, "section", "start", "length", "s.*").select(*names)
    ends = middle.groupBy(key).agg(F.max(F.struct("section", (F.col("start") + F.col("length")).alias("end"))).alias("e"))
    last = tracks.join(ends, key, "left").select(key, (F.coalesce("e.section", F.lit(0)) + 1).alias("section"), F.coalesce("e.end", F.lit(intro)).alias("start"), F.greatest(F.lit(outro), total - F.coalesce("e.end", F.lit(intro))).cast("int").alias("length"), _section(OUTRO).alias("s"))
    return first.unionByName(middle.select(*names)).unionByName(last.select(key, "section", "start", "length", "s.*").select(*names))


#: When the chord instrument plays under a drum pattern: step, steps held, velocity.
COMPS = {
    "boom_bap": [(0, 7, 0.85), (6, 4, 0.55), (10, 6, 0.7)],
    "lazy": [(0, 8, 0.8), (8, 8, 0.65)],
    "halftime": [(0, 12, 0.8), (12, 4, 0.5)],
    "swing": [(0, 5, 0.8), (4, 3, 0.5), (7, 4, 0.65), (12, 4, 0.6)],
    "shuffle": [(0, 6, 0.85), (6, 3, 0.5), (10, 5, 0.7)],
    "brushed": [(0, 8, 0.75), (8, 8, 0.6)],
    "tabla": [(0, 8, 0.7), (8, 8, 0.6)],
    "none": [(0, 16, 0.7)],
}
PLAYED = ["step", "hold", "velocity"]
FILLS = ["snare", "tom", "rim"]


def bars_with_chords(sections: DataFrame, key: str) -> DataFrame:
    """One row for each bar of sections (key, section, start, length, chords, chord_shift, …), with its chord.

    `chords` is an array of struct(notes, bass); bar b of a section has chord
    (b + chord_shift) mod their number.
    """
    each = sections.withColumn("bar", F.explode(F.sequence(F.lit(0), F.col("length") - 1)))
    return each.withColumn("chord", F.get("chords", F.pmod(F.col("bar") + F.col("chord_shift"), F.size("chords")).cast("int")))


def _events(bars: DataFrame, key: str, stem: str, events: Column) -> DataFrame:
    """Rows of an array of struct(step, kind, midi, hold, velocity, pan) that each bar has."""
    return bars.select(key, "section", "bar", F.lit(stem).alias("stem"), F.explode(events).alias("e")).select(key, "section", "bar", "stem", "e.*")


def _event(step, kind, midi, hold, velocity, pan) -> Column:
    values = (step, kind, midi, hold, velocity, pan)
    types = ("double", "string", "int", "int", "double", "double")
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast(t).alias(n) for n, v, t in zip(("step", "kind", "midi", "hold", "velocity", "pan"), values, types)))


def expand_notes(bars: DataFrame, key: str) -> DataFrame:
    """(key, section, bar, stem, step, kind, midi, hold, velocity, pan) of chords, bass and pad of each bar.

    `bars` comes from bars_with_chords and has pattern and intensity. Chords
    are strummed by 0.08 of a step and spread from left to right. What is left
    to chance in a performance is a digest of key, section, bar and a tag.
    """
    u = lambda *tags: drawn(F.col(key), F.col("section"), F.col("bar"), *(t if isinstance(t, Column) else F.lit(t) for t in tags))
    hit = lambda h: F.struct(*(F.lit(v).alias(n) for n, v in zip(PLAYED, h)))
    comps = F.create_map(*[x for k, hits in COMPS.items() for x in (F.lit(k), F.array(*map(hit, hits)))])
    comp = F.coalesce(F.try_element_at(comps, F.col("pattern")), F.element_at(comps, F.lit("lazy")))
    comp = F.when((u("comp") < 0.3) & (F.size(comp) > 1), F.slice(comp, F.lit(1), F.size(comp) - 1)).otherwise(comp)
    notes, loud = F.col("chord.notes"), F.col("intensity")
    pan = lambda j: -0.55 + 1.10 * (j / F.greatest(F.lit(1), F.size(notes) - 1))
    strum = lambda c: F.transform(notes, lambda m, j: _event(c.step + j * 0.08, "note", m, c.hold, c.velocity * loud * (0.85 + 0.15 * u("touch", c.step, j)), pan(j)))
    chords = _events(bars, key, "chords", F.flatten(F.transform(comp, strum)))
    root = F.col("chord.bass")
    low = lambda step, hold, velocity, midi: _event(float(step), "note", midi, hold, velocity * loud, 0.0)
    more = F.when(u("bass") < 0.45, F.array(low(8, 5, 0.75, root))).when(u("bass") < 0.75, F.array(low(8, 3, 0.7, root + 7), low(12, 3, 0.6, root))).otherwise(F.array(low(10, 5, 0.7, F.when(u("fifth") < 0.5, root).otherwise(root + 7))))
    bass = _events(bars, key, "bass", F.concat(F.array(low(0, 6, 1.0, root)), more))
    pad = _events(bars, key, "pad", F.transform(F.slice(notes, 1, 4), lambda m, j: _event(0.0, "note", m - 12, 16, 0.5 * loud, -0.7 + 1.4 * (j % 2))))
    return chords.unionByName(bass).unionByName(pad)


def expand_drums(bars: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """(key, section, bar, stem, step, kind, midi, hold, velocity, pan) of the drums of each bar, and of fills.

    `patterns` (pattern, piece, grid of 16 velocities) is broadcast. One hit in
    sixteen is left out, one hat in twenty is open; at the end of every eighth
    bar of the piece three hits may fill in.
    """
    u = lambda *tags: drawn(F.col(key), F.col("section"), F.col("bar"), *(t if isinstance(t, Column) else F.lit(t) for t in tags))
    loud, piece = F.col("intensity"), F.col("piece")
    on = bars.where("drums")
    hits = on.join(F.broadcast(patterns), "pattern").select(key, "section", "bar", "piece", "intensity", F.posexplode("grid").alias("at", "v")).where("v > 0")
    hits = hits.where(u("drop", piece, F.col("at")) >= 0.06)
    kind = F.when((piece == "hat") & (u("open", F.col("at")) < 0.05), "hat_open").otherwise(piece)
    pan = F.when(piece.isin("kick", "snare"), 0.0).when(piece == "hat", -0.30).otherwise(0.34)
    event = _event(F.col("at"), kind, 0, 1, F.col("v") * loud * (0.88 + 0.24 * u("touch", piece, F.col("at"))), pan)
    played = hits.select(key, "section", "bar", F.lit("drums").alias("stem"), event.alias("e")).select(key, "section", "bar", "stem", "e.*")
    last = (F.pmod(F.col("start") + F.col("bar") + 1, F.lit(8)) == 0) & (u("fill") < 0.6)
    which = lambda k: F.get(F.array(*map(F.lit, FILLS)), F.floor(u("which", k) * len(FILLS)).cast("int"))
    fill = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: _event(13.0 + k, which(k), 0, 1, 0.5 + 0.18 * k, -0.3 + 0.3 * k))
    return played.unionByName(_events(on.where(last), key, "drums", fill))


def expand_lead(bars: DataFrame, key: str, motif: list[tuple[int, int, int]], tones: str, register: int = 74, density: float = 0.55) -> DataFrame:
    """(key, section, bar, stem, step, kind, midi, hold, velocity, pan) of a melody over each bar's chord.

    `motif` is (step, steps held, move); moves count notes of the chord from
    the one nearest to the register. Every second bar the motif may be moved,
    turned over or thinned; a note off the beat may lean on a scale tone
    within two semitones. `tones` are the scale's pitch classes.
    """
    u = lambda *tags: drawn(F.col(key), F.col("section"), F.col("bar"), *(t if isinstance(t, Column) else F.lit(t) for t in tags))
    pool = melody_pool(F.col("chord.notes"), F.col(tones), register - 7, register + 14)
    on = bars.where("lead").withColumn("pool", pool).where("size(pool.strong) > 0")
    even = F.col("bar") - F.pmod(F.col("bar"), F.lit(2))
    turn = F.floor(drawn(F.col(key), F.col("section"), even, F.lit("turn")) * 6)
    moves = [m for _, _, m in motif]
    steps = F.array(*(F.struct(F.lit(s).alias("step"), F.lit(d).alias("hold"), F.lit(m).alias("move"), F.lit(-m).alias("turned"), F.lit(b).alias("back")) for (s, d, m), b in zip(motif, moves[::-1])))
    move = lambda x: F.when(turn == 2, x.move + 1).when(turn == 3, x.turned).when(turn == 4, x.back).otherwise(x.move)
    used = F.when(turn == 5, F.filter(steps, lambda x, i: i % 2 == 0)).otherwise(steps)
    nearest = lambda notes, to: F.array_min(F.transform(notes, lambda m, i: F.struct(F.abs(m - to).alias("far"), i.alias("i"), m.alias("m"))))
    strong, weak = F.col("pool.strong"), F.col("pool.weak")
    anchor = nearest(strong, F.lit(register)).i
    note = lambda x: F.get(strong, F.greatest(F.lit(0), F.least(F.size(strong) - 1, anchor + move(x))))
    leant = lambda x: bound(nearest(weak, note(x)), lambda w: F.when((x.step % 4 != 0) & (u("lean", x.step) < 0.35) & (w.far <= 2), w.m).otherwise(note(x)))
    share = F.lit(density) * F.when(F.pmod(F.col("bar"), F.lit(4)) == 3, 0.6).otherwise(1.0)
    kept = F.filter(used, lambda x: u("rest", x.step) <= share)
    return _events(on, key, "lead", F.transform(kept, lambda x: _event(x.step, "note", leant(x), x.hold, (0.62 + 0.3 * u("touch", x.step)) * F.col("intensity"), 0.12)))


def expand_events(tracks: DataFrame, patterns: DataFrame, bars: int, swing: float, sr: float, drop_percent: int, key: str) -> DataFrame:
    """One row for each hit of a track's pattern in each bar, with its place in samples.

    `patterns` (pattern, piece, grid of 16 velocities) is broadcast. A hit is
    left out when a digest of (key, bar, piece, step) falls in drop_percent,
    so the choice depends on nothing but the row.
    """
    grid = tracks.join(F.broadcast(patterns), "pattern").withColumn("bar", F.explode(F.sequence(F.lit(0), F.lit(bars - 1))))
    hits = grid.select(key, "bpm", "pattern", "piece", "bar", F.posexplode("grid").alias("step", "velocity")).where("velocity > 0")
    digest = F.conv(F.substring(F.md5(F.concat_ws("/", F.col(key).cast("string"), F.col("bar").cast("string"), "piece", F.col("step").cast("string"))), 1, 4), 16, 10).cast("int")
    kept = hits.where(F.pmod(digest, F.lit(100)) >= drop_percent)
    return kept.withColumn("sample", step_time((F.col("bar") * 16 + F.col("step")).cast("double"), F.col("bpm"), swing, sr))

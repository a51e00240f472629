"""Configuration, catalogue, harmony, graph and rule operators over nested data."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.functions.scalar import bound, note_name

#: Scales in semitones above the root.
SCALES = {
    "major": [0, 2, 4, 5, 7, 9, 11],
    "minor": [0, 2, 3, 5, 7, 8, 10],
    "natural minor": [0, 2, 3, 5, 7, 8, 10],
    "harmonic minor": [0, 2, 3, 5, 7, 8, 11],
    "melodic minor": [0, 2, 3, 5, 7, 9, 11],
    "dorian": [0, 2, 3, 5, 7, 9, 10],
    "phrygian": [0, 1, 3, 5, 7, 8, 10],
    "lydian": [0, 2, 4, 6, 7, 9, 11],
    "mixolydian": [0, 2, 4, 5, 7, 9, 10],
    "aeolian": [0, 2, 3, 5, 7, 8, 10],
    "pentatonic": [0, 2, 4, 7, 9],
    "minor pentatonic": [0, 3, 5, 7, 10],
}

#: Chord qualities as semitones above the root.
CHORDS = {
    "maj": [0, 4, 7],
    "min": [0, 3, 7],
    "dim": [0, 3, 6],
    "aug": [0, 4, 8],
    "sus2": [0, 2, 7],
    "sus4": [0, 5, 7],
    "maj6": [0, 4, 7, 9],
    "min6": [0, 3, 7, 9],
    "maj7": [0, 4, 7, 11],
    "min7": [0, 3, 7, 10],
    "dom7": [0, 4, 7, 10],
    "m7b5": [0, 3, 6, 10],
    "dim7": [0, 3, 6, 9],
    "minmaj7": [0, 3, 7, 11],
    "maj9": [0, 4, 7, 11, 14],
    "min9": [0, 3, 7, 10, 14],
    "dom9": [0, 4, 7, 10, 14],
    "add9": [0, 4, 7, 14],
    "madd9": [0, 3, 7, 14],
    "maj69": [0, 4, 7, 9, 14],
    "min11": [0, 3, 7, 10, 14, 17],
    "maj7s11": [0, 4, 7, 11, 18],
    "dom13": [0, 4, 7, 10, 14, 21],
    "min7add11": [0, 3, 7, 10, 17],
}


def ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def scale_tones(root: Column, scale: Column) -> Column:
    """Pitch classes of a named scale on a root, null for an unknown name."""
    named = F.create_map(*[x for k, v in SCALES.items() for x in (F.lit(k), ints(v))])
    return F.transform(F.try_element_at(named, scale), lambda s: F.pmod(root + s, F.lit(12)))


def chords_in_scale(roots: DataFrame, root: str, tones: str) -> DataFrame:
    """Chord qualities all of whose notes are in `tones` when built on the root."""
    dim = F.array(*(F.struct(F.lit(k).alias("quality"), ints(v).alias("steps")) for k, v in CHORDS.items()))
    each = roots.select("*", F.explode(dim).alias("c"))
    return each.where(F.forall("c.steps", lambda s: F.array_contains(F.col(tones), F.pmod(F.col(root) + s, F.lit(12))))).select("*", F.col("c.quality").alias("quality"), F.col("c.steps").alias("steps")).drop("c")


#: Semitones of third and fifth above the root, and the triad that they make.
TRIADS = {(4, 7): "maj", (3, 7): "min", (3, 6): "dim", (4, 8): "aug"}
#: Richer chords that a triad may be coloured with, and its plain seventh.
COLOURS = {
    "maj": (["maj7", "maj9", "maj69", "add9", "maj6"], "maj7"),
    "min": (["min7", "min9", "min11", "madd9", "min6"], "min7"),
    "dom": (["dom7", "dom9", "dom13"], "dom7"),
    "dim": (["m7b5", "dim7"], "m7b5"),
}
SHORT = {"maj": "", "min": "m", "min7": "m7", "dom7": "7", "min9": "m9", "dom9": "9", "madd9": "m(add9)", "maj6": "6", "min6": "m6", "maj69": "6/9", "min11": "m11", "dom13": "13",
         "minmaj7": "mMaj7", "maj7s11": "maj7#11", "min7add11": "m7add11"}


def voice(notes: Column, low: int = 52, high: int = 76, spread: bool = True) -> Column:
    """Notes folded into [low, high] by octaves, sorted and distinct.

    Below 64 the upper of two a semitone apart is left out. Of four or more
    that stay the lowest goes down an octave.
    """
    folded = F.transform(notes, lambda n: F.when(n < low, n + F.ceil((low - n) / 12) * 12).when(n > high, n - F.ceil((n - high) / 12) * 12).otherwise(n).cast("int"))
    start = F.array().cast("array<int>")
    clash = lambda kept, n: (F.size(kept) > 0) & (n - F.try_element_at(kept, F.lit(-1)) == 1) & (n < 64)
    clean = F.aggregate(F.array_sort(F.array_distinct(folded)), start, lambda kept, n: F.when(clash(kept, n), kept).otherwise(F.concat(kept, F.array(n))))
    if not spread:
        return clean
    return bound(clean, lambda c: F.when(F.size(c) >= 4, F.array_sort(F.transform(c, lambda n, i: F.when(i == 0, n - 12).otherwise(n)))).otherwise(c))


def degree(steps: Column, number: Column) -> Column:
    """Semitones above the root of a scale's degree, counted from 0, octaves on for degrees beyond the scale."""
    n = F.size(steps)
    return F.get(steps, F.pmod(number, n).cast("int")) + 12 * F.floor(number / n).cast("int")


def triad(steps: Column, number: Column) -> Column:
    """Quality of the chord of stacked thirds on a degree of a scale (of seven or other many tones)."""
    root, third, fifth = (degree(steps, number + k) for k in (0, 2, 4))
    t, f = third - root, fifth - root
    out = F.when(t == 5, "sus4").when(t == 2, "sus2").when(t >= 4, "maj").otherwise("min")
    for (a, b), name in TRIADS.items():
        out = F.when((t == a) & (f == b), name).otherwise(out)
    return out


def colours(quality: Column, root: Column, tones: Column) -> Column:
    """Array of chords that may colour a triad on a root without leaving the scale, its plain seventh last; the seventh if none fits."""
    dim = F.create_map(*[F.lit(k) if i == 0 else F.array(*(F.struct(F.lit(q).alias("q"), ints(CHORDS[q]).alias("steps")) for q in [*many, plain])) for k, (many, plain) in COLOURS.items() for i in (0, 1)])
    seventh = F.create_map(*[F.lit(x) for k, (_, plain) in COLOURS.items() for x in (k, plain)])
    every = F.try_element_at(dim, quality)
    fitting = F.transform(F.filter(every, lambda c: F.forall(c.steps, lambda s: F.array_contains(tones, F.pmod(root + s, F.lit(12))))), lambda c: c.q)
    # the first colour of major and minor chords may be the seventh itself
    names = F.array_distinct(fitting)
    return F.when(every.isNull(), F.array(quality)).when(F.size(names) > 0, names).otherwise(F.array(F.try_element_at(seventh, quality)))


def chord_label(root: Column, key: Column, quality: Column) -> Column:
    """A chord as written in a key, such as `Bbm7`."""
    short = F.try_element_at(F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair]), quality)
    return F.concat(note_name(root, key), F.coalesce(short, quality))


def melody_pool(notes: Column, tones: Column, low: int = 64, high: int = 86) -> Column:
    """struct(strong, weak): notes of a register that a chord has, and those that only the scale has."""
    register = F.sequence(F.lit(low), F.lit(high))
    chord = F.transform(notes, lambda n: F.pmod(n, F.lit(12)))
    own = lambda m: F.array_contains(chord, F.pmod(m, F.lit(12)))
    return F.struct(F.filter(register, own).alias("strong"), F.filter(register, lambda m: ~own(m) & F.array_contains(tones, F.pmod(m, F.lit(12)))).alias("weak"))


def resolve(specific: Column, *fallbacks: Column) -> Column:
    """The first value that is set, from the most specific layer on."""
    return F.coalesce(specific, *fallbacks)


def pick(values: Column, draw: Column) -> Column:
    """The entry of a list that a draw in [0, 1) falls on."""
    return F.get(values, F.floor(draw * F.size(values)).cast("int"))


def tempo_in(low: Column, high: Column, draw: Column, shift: Column, least: int = 40, most: int = 180) -> Column:
    """A whole tempo of a range by a draw in [0, 1), moved by a mood and kept within bounds."""
    drawn = low + F.floor(draw * (high - low + 1)).cast("int") + F.coalesce(shift, F.lit(0))
    return F.greatest(F.lit(least), F.least(F.lit(most), drawn))


def filter_or_all(values: Column, keep) -> Column:
    """The values that pass, or all of them if none does."""
    kept = F.filter(values, keep)
    return F.when(F.size(kept) > 0, kept).otherwise(values)


def fits(need: Column, memory: Column, offload: float = 2.5) -> Column:
    return (need <= 0) | (memory + offload >= need)


def catalogue(models: DataFrame, licence: str, need: str, memory: Column, commercial_only: bool) -> DataFrame:
    """Rows with `fits`; for commercial use those whose licence is yes or conditional."""
    out = models.where(F.col(licence).isin("yes", "conditional")) if commercial_only else models
    return out.withColumn("fits", fits(F.col(need), memory))


GRAPH = "map<string,struct<class_type:string,_meta:struct<title:string>,inputs:map<string,variant>>>"

#: The input that holds the prompt, by class, and the names to try for other classes.
TEXT_FIELDS = {
    "CLIPTextEncode": "text",
    "CLIPTextEncodeSDXL": "text_g",
    "CLIPTextEncodeSDXLRefiner": "text",
    "TextEncodeAceStepAudio": "tags",
    "T5TextEncode": "text",
}
TEXT_FALLBACKS = ["text", "tags", "prompt", "string", "text_g"]
#: What kinds of results are called, and the suffixes of their files.
OUTPUT_KEYS = {"audio": ["audio"], "image": ["images"], "video": ["gifs", "videos", "images"], "": ["audio", "images", "gifs", "videos"]}
OUTPUT_SUFFIXES = {"audio": [".wav", ".flac", ".mp3", ".ogg", ".m4a", ".aac", ".aif", ".aiff"], "video": [".mp4", ".webm", ".gif", ".mkv"]}


def graph(text: Column) -> Column:
    """Array of struct(node, class_type, title, inputs) of a JSON map node -> {class_type, _meta, inputs}, by node.

    Values of inputs are JSON. A whole graph is one value, so what is done to
    it stays in its row. Text that is no such map is a graph without nodes.
    """
    entries = F.map_entries(F.from_json(text, GRAPH))
    values = lambda m: F.transform_values(F.coalesce(m, F.create_map().cast("map<string,variant>")), lambda _, v: F.to_json(v))
    plain = lambda e: F.struct(e.key.alias("node"), e.value.class_type.alias("class_type"), F.coalesce(e.value["_meta"].title, F.lit("")).alias("title"), values(e.value.inputs).alias("inputs"))
    none = F.array().cast("array<struct<node:string,class_type:string,title:string,inputs:map<string,string>>>")
    return F.array_sort(F.coalesce(F.transform(entries, plain), none), by_number)


def quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def by_number(a: Column, b: Column) -> Column:
    """Order of nodes: numbers by value, then other names; equals by name."""
    number = lambda n: F.coalesce(n.node.try_cast("bigint"), F.lit(1 << 30))
    return F.when(number(a) < number(b), -1).when(number(a) > number(b), 1).when(a.node < b.node, -1).when(a.node > b.node, 1).otherwise(0)


def link(value: Column) -> Column:
    """The node that an input is wired to; null for a literal. A link is a list, of node and slot."""
    return F.when(value.startswith("["), F.coalesce(F.get(F.from_json(value, "array<string>"), F.lit(0)), F.lit("")))


def rank(node: Column, selector: Column) -> Column:
    """How a selector means a node: 1 by id, 2 by title, 3 by class (case does not count in these two), null not at all."""
    low = F.lower(selector)
    return F.when(node.node == selector, 1).when(F.lower(node.title) == low, 2).when(F.lower(node.class_type) == low, 3)


def selected(nodes: Column, selector: Column) -> Column:
    """Ids of the nodes that a selector means: by id, else by title, else by class."""
    best = F.array_min(F.transform(nodes, lambda n: rank(n, selector)))
    return bound(best, lambda b: F.transform(F.filter(nodes, lambda n: rank(n, selector) == b), lambda n: n.node))


def set_input(nodes: Column, ids: Column, field: Column, value: Column, create: bool = False) -> Column:
    """Nodes with a field of some of them set. Links stay; a field that is not there is only made where `create` says so."""

    def one(n):
        old = F.try_element_at(n.inputs, field)
        free = (F.lit(create) | F.map_contains_key(n.inputs, field)) & (old.isNull() | link(old).isNull())
        rest = F.map_filter(n.inputs, lambda k, _: k != field)
        return F.when(F.array_contains(ids, n.node) & free, F.struct(n.node.alias("node"), n.class_type.alias("class_type"), n.title.alias("title"), F.map_concat(rest, F.create_map(field, value)).alias("inputs"))).otherwise(n)

    return F.transform(nodes, one)


def set_where(nodes: Column, field: Column, value: Column, classes: list[str] | None = None) -> Column:
    """Nodes with a field set wherever it is there and no link, in nodes of some classes or in all."""
    ids = F.transform(F.filter(nodes, lambda n: n.class_type.isin(*classes) if classes else F.lit(True)), lambda n: n.node)
    return set_input(nodes, ids, field, value)


def refusals(nodes: Column, ids: Column, field: Column) -> Column:
    """Why a required input cannot be set: no such node, a node without the field, or a link; empty if it can."""
    chosen = F.filter(nodes, lambda n: F.array_contains(ids, n.node))
    lacking = F.filter(chosen, lambda n: ~F.map_contains_key(n.inputs, field))
    linked = F.filter(chosen, lambda n: F.map_contains_key(n.inputs, field) & link(F.try_element_at(n.inputs, field)).isNotNull())
    name = lambda what: lambda n: F.concat(n.node, F.lit(what))
    return F.when(F.size(chosen) == 0, F.array(F.lit("no such node"))).otherwise(F.concat(F.transform(lacking, name(": no such input")), F.transform(linked, name(": connected"))))


def text_field(node: Column) -> Column:
    """The input that carries a node's prompt: by class if it is there as a literal, else the first usual name that is a text; null if none."""
    has = lambda f: F.map_contains_key(node.inputs, f) & link(F.try_element_at(node.inputs, f)).isNull()
    by_class = F.try_element_at(F.create_map(*[F.lit(x) for pair in TEXT_FIELDS.items() for x in pair]), node.class_type)
    known = F.when(by_class.isNotNull() & has(F.coalesce(by_class, F.lit(""))), by_class)
    return F.coalesce(known, *(F.when(F.try_element_at(node.inputs, F.lit(f)).startswith('"'), F.lit(f)) for f in TEXT_FALLBACKS))


def set_text(nodes: Column, selector: Column, value: Column) -> Column:
    """Nodes with the prompt of those that a selector means set, each in its own text field."""

    def one(ids):
        def of(n):
            field = text_field(n)
            rest = F.map_filter(n.inputs, lambda k, _: k != field)
            new = F.struct(n.node.alias("node"), n.class_type.alias("class_type"), n.title.alias("title"), F.map_concat(rest, F.create_map(field, value)).alias("inputs"))
            return F.when(F.array_contains(ids, n.node) & field.isNotNull(), new).otherwise(n)

        return F.transform(nodes, of)

    return bound(selected(nodes, selector), one)


def dangling(nodes: Column) -> Column:
    """Array of struct(node, field, src): links to nodes that the graph does not have."""
    ids = F.transform(nodes, lambda n: n.node)
    each = lambda n: F.transform(F.map_entries(n.inputs), lambda e: F.struct(n.node.alias("node"), e.key.alias("field"), link(e.value).alias("src")))
    return F.filter(F.flatten(F.transform(nodes, each)), lambda x: x.src.isNotNull() & ~F.array_contains(ids, x.src))


def graph_json(nodes: Column) -> Column:
    """The graph as JSON again, inputs by name."""
    entries = lambda m: F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(quoted(e.key), F.lit(":"), e.value))
    meta = lambda n: F.when(n.title != "", F.concat(F.lit('"_meta":{"title":'), quoted(n.title), F.lit("},"))).otherwise("")
    one = lambda n: F.concat(quoted(n.node), F.lit(':{"class_type":'), quoted(F.coalesce(n.class_type, F.lit(""))), F.lit(","), meta(n), F.lit('"inputs":{'), F.array_join(entries(n.inputs), ","), F.lit("}}"))
    return F.concat(F.lit("{"), F.array_join(F.transform(nodes, one), ","), F.lit("}"))


def outputs(text: Column, want: str = "") -> Column:
    """File names of a JSON map node -> {kind: [{filename}]}: those of a kind, and of its suffixes if any has one."""
    keys = OUTPUT_KEYS.get(want, OUTPUT_KEYS[""])
    found = F.from_json(text, "map<string,map<string,array<struct<filename:string>>>>")
    per_node = F.transform(F.array_sort(F.map_keys(found)), lambda k: F.flatten(F.transform(F.array(*map(F.lit, keys)), lambda f: F.coalesce(F.try_element_at(F.try_element_at(found, k), f), F.array()))))
    names = F.filter(F.transform(F.flatten(per_node), lambda x: x.filename), lambda x: x.isNotNull() & (x != ""))
    suffixes = OUTPUT_SUFFIXES.get(want)
    if not suffixes:
        return names
    ends = lambda x: F.lower(F.regexp_extract(x, r"(\.[^./]*)$", 1)).isin(*suffixes)
    return filter_or_all(names, ends)


def readiness(lufs: Column, true_peak: Column, chapters: Column, first_line: Column, blocked: Column, provenance: Column | None = None) -> Column:
    """struct(problems, notes).

    Problems: loudness off by over 1.5 from -14, peak over -0.9, few chapters
    or a first one not at 0, provenance, duplicates. No track list (`chapters`
    is null) is a note.
    """
    few = chapters < 3
    late = ~first_line.startswith("00:00") & ~first_line.startswith("0:00")
    found = [F.when(F.abs(lufs + 14) > 1.5, "loudness"), F.when(true_peak > -1 + 0.1, "true peak"), F.when(few, "chapters").when(late, "first chapter")]
    found += [] if provenance is None else [provenance]
    return F.struct(F.array_compact(F.array(*found, F.when(blocked, "duplicate"))).alias("problems"), F.array_compact(F.array(F.when(chapters.isNull(), "no tracklist"))).alias("notes"))


def provenance(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """files (path, folder, parent) with engine, source and problem, by the manifest of the folder, else of its parent.

    `manifests` has folder, engine, tracks (how many), reference, ref_mode. A
    manifest without tracks gives way to the parent's, if there is one.
    """
    own, up = (manifests.select(F.col("folder").alias(f"{k}_folder"), *(F.col(c).alias(f"{k}_{c}") for c in ("engine", "tracks", "reference", "ref_mode"))) for k in ("own", "up"))
    joined = files.join(own, F.col("folder") == F.col("own_folder"), "left").join(up, F.col("parent") == F.col("up_folder"), "left")
    use_up = (F.coalesce("own_tracks", F.lit(0)) == 0) & F.col("up_folder").isNotNull()
    chosen = lambda c: F.when(use_up, F.col(f"up_{c}")).otherwise(F.col(f"own_{c}"))
    engine = F.coalesce(chosen("engine"), F.lit("unknown"))
    cover = (engine == "ace-step") & chosen("reference").isNotNull() & (F.coalesce(chosen("ref_mode"), F.lit("style")) == "cover")
    source = F.when(engine == "builtin", "built-in").when(engine == "lofify", "own recordings").when(cover, "cover").when((engine == "ace-step") & chosen("reference").isNotNull(), "style reference").when(engine == "ace-step", "model").otherwise("unknown")
    problem = F.when(engine == "lofify", "only reprocessed").when(cover, "cover")
    return joined.select(*files.columns, engine.alias("engine"), source.alias("source"), problem.alias("problem"))


def file_key(path: Column, modified: Column, size: Column) -> Column:
    """Under which a file's results are remembered: a change of time or size makes it another file."""
    return F.concat_ws("|", path, modified.cast("string"), size.cast("string"))


def analysed(files: DataFrame, cache: DataFrame, compute, least_seconds: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) of files (path, modified, size).

    `cache` has key and duration; compute(files) gives key, duration and error
    for those that are not in it. Results are (path, key, duration, hit);
    rejects (path, reason): unreadable, or shorter than least_seconds.
    """
    keyed = files.withColumn("key", file_key(F.col("path"), F.col("modified"), F.col("size")))
    hits = keyed.join(cache, "key").select("path", "key", "duration", F.lit(True).alias("hit"))
    fresh = keyed.join(cache.select("key"), "key", "left_anti")
    done = fresh.join(compute(fresh), "key")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("duration", F.lit(0.0)) < least_seconds, F.format_string("only %.1f s of audio", F.coalesce("duration", F.lit(0.0))))
    judged = done.select("path", "key", "duration", reason.alias("reason"))
    return hits.unionByName(judged.where("reason is null").select("path", "key", "duration", F.lit(False).alias("hit"))), judged.where("reason is not null").select("path", "reason")


def memo(items: DataFrame, cache: DataFrame, key: str, compute, columns: list[str]) -> DataFrame:
    """Cached results of items, and computed ones for those that the cache lacks: (key, columns, hit)."""
    hits = items.select(key).join(cache, key).select(key, *columns, F.lit(True).alias("hit"))
    fresh = compute(items.join(cache.select(key), key, "left_anti")).select(key, *columns, F.lit(False).alias("hit"))
    return hits.unionByName(fresh)


def note_key(dur: Column, velocity: Column) -> tuple[Column, Column]:
    """Buckets under which a rendered note is remembered: 0.05 of duration, 0.125 of velocity from 0.125 to 1."""
    return F.rint(dur / 0.05).cast("int"), F.greatest(F.lit(1), F.least(F.lit(8), F.rint(velocity / 0.125).cast("int")))


def fifo(requests: DataFrame, group: str, order: list[str], key: str, limit: int = 4096) -> DataFrame:
    """(group, place, key, hit) of a group's requests in order: whether a memory of `limit` keys had the key.

    What is not there is rendered and remembered; then the key that came first
    goes. A hit changes nothing. A task holds one memory, whatever the number
    of requests of a group.
    """
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = requests.select(group, key, *order).repartition(n, group).sortWithinPartitions(group, *order)
    kinds = [f"{c} {requests.schema[c].dataType.simpleString()}" for c in (group, key)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, memory, place = None, None, 0
        for batch in batches:
            hits, places = [], []
            for g, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if memory is None or g != last:
                    last, memory, place = g, {}, 0
                hits.append(k in memory)
                if k not in memory:
                    if len(memory) >= limit:
                        del memory[next(iter(memory))]
                    memory[k] = None
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), batch.column(1), pa.array(hits, pa.bool_())], names=[group, "place", key, "hit"])

    return ordered.mapInArrow(run, f"{kinds[0]}, place long, {kinds[1]}, hit boolean")

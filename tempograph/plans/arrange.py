"""Sequencing, configuration, catalogue and graph queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions import scalar
from tempograph.operators import catalogue as cat
from tempograph.operators import timeline as tl
from tempograph.session import table

#: Grids of 16 velocities, of our own.
GRIDS = [
    ("small", "kick", [1.0, 0, 0, 0, 0.6, 0, 0, 0, 1.0, 0, 0.4, 0, 0, 0, 0.5, 0]),
    ("small", "hat", [0.5, 0, 0.3, 0, 0.5, 0, 0.3, 0, 0.5, 0, 0.3, 0, 0.5, 0, 0.3, 0.2]),
    ("red", "snare", [0, 0, 0, 0, 0.9, 0, 0, 0, 0, 0, 0, 0, 0.9, 0, 0, 0.3]),
    ("blue", "rim", [0, 0, 0.4, 0, 0, 0, 0, 0.4, 0, 0, 0, 0, 0.4, 0, 0, 0]),
]


KEY_TEXTS = ["", "A Minor", "Bb dorian", "C", "E# Major", "b# min", "F# harmonic minor", "Cb-Lydian", "H Major", "G# weird", "d minorish", " eb   melodic  minor ", "G m", "A maj", "x"]
#: A motif of our own: step, steps held, move.
MOTIF = [(0, 2, 0), (3, 3, 1), (6, 2, 2), (9, 4, -1), (13, 3, 1)]


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as set lists: a turn is a track, its characters the length."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("len"), "role")


def _set_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as its set list, tempo and key derived from their numbers; those of some have no key."""
    key = F.when(F.pmod("c_custkey", F.lit(9)) > 0, F.pmod("c_custkey", F.lit(12))).cast("int")
    return table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("pos"), F.pmod(F.abs("c_acctbal"), F.lit(120.0)).alias("bpm"), key.alias("pc"), (F.pmod(F.col("c_custkey") * 7, F.lit(5)) < 2).alias("minor"))


def medoid_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _set_list(spark, sf_dir).withColumn("pc", F.pmod("pos", F.lit(12)).cast("int"))
    return tl.target_tempo(c, "c_nationkey", "bpm").join(tl.medoid_key(c, "c_nationkey"), "c_nationkey").select("c_nationkey", "bpm", "pc", "minor", F.round("total", 4).alias("total"))


def target_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target of each nation's set list: every third nation wants a tempo, every fourth a key; nations of region 0 have no list."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("c_nationkey"))
    wants = n.select("c_nationkey", F.when(F.col("c_nationkey") % 3 == 0, F.col("c_nationkey") * 9.0).alias("want_bpm"), F.when(F.col("c_nationkey") % 4 == 0, F.pmod("c_nationkey", F.lit(12))).cast("int").alias("want_pc"), F.when(F.col("c_nationkey") % 4 == 0, F.col("c_nationkey") % 8 == 0).alias("want_minor"))
    tracks = _set_list(spark, sf_dir).join(n.where("n_regionkey > 0"), "c_nationkey").drop("n_regionkey")
    return tl.target(wants, tracks, "c_nationkey", "bpm")


def greedy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as tracks, tempo and key derived from their numbers."""
    n = F.col("n_nationkey")
    tracks = table(spark, sf_dir, "nation").select(F.lit(0).alias("g"), n.alias("pos"), n.alias("id"), (60.0 + n * 37 % 50).alias("bpm"), (n * 5 % 12).alias("pc"), (n % 3 == 0).alias("minor"))
    return tl.ordered_tracks(tracks, "g").select(F.col("place").alias("pos"), F.col("id").alias("n_nationkey"))


def track_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as they are and shuffled by a seed."""
    tracks = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("pos"), F.col("s_suppkey").alias("id"))
    modes = [tl.ordered_tracks(tracks, "s_nationkey", mode, 7).withColumn("mode", F.lit(mode)) for mode in ("asis", "shuffle")]
    return modes[0].unionByName(modes[1])


def mix_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.mix_timeline(_tracks(spark, sf_dir), "conv_id", "len", 40, 60).select("conv_id", "pos", "len", "overlap", "start")


def mix_programme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations over and over until 3000 characters, 50 of which are held back for the final fade."""
    return tl.mix_programme(_tracks(spark, sf_dir).select("conv_id", "pos", "len"), "conv_id", 40, 50, 60, 3000)


def song_programme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as songs of 85 beats a minute: a turn has a second for two characters."""
    tracks = _tracks(spark, sf_dir).select("conv_id", "pos", (F.col("len") / 2).alias("seconds"), (60.0 + F.col("pos") * 7 % 50).alias("bpm"), (F.col("pos") % 4 / 4).alias("downbeat"))
    return tl.song_programme(tracks, "conv_id", 10, 85.0, 4, 4000)


def bar_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bar = F.lit(240.0) / (60 + F.pmod("conv_id", F.lit(50)))
    snapped = tl.snap_to_bars(F.col("len") / 10, bar, F.pmod("pos", F.lit(4)) / 4)
    return _tracks(spark, sf_dir).select("conv_id", "pos", F.round(snapped.start, 4).alias("start"), F.round(snapped.stop, 4).alias("stop"), tl.crossfade_bars(F.col("len") / 10, bar, 4).alias("bars"))


def title_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", tl.clean_title(F.concat(F.lit("07_"), F.regexp_replace("p_name", " ", "-"))).alias("title"))
    return tl.repeated_titles(parts, "title", ["p_partkey"], F.floor(F.col("p_partkey") / 4096)).select("p_partkey", "shown")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = tl.mix_timeline(_tracks(spark, sf_dir), "conv_id", "len", 40, 60)
    total = F.max(F.col("start") + F.col("len")).over(W.partitionBy("conv_id"))
    return tl.chapter_lines(laid.withColumn("total", total), F.col("start") / 2, F.col("total") / 2, "role").select("conv_id", "pos", "line")


def event_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = spark.createDataFrame([(a, b, [float(x) for x in c]) for a, b, c in GRIDS], "pattern string, piece string, grid array<double>")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("pattern"), (F.col("p_size") + 60).alias("bpm"))
    found = tl.expand_events(parts, grids, 4, 0.16, 100.0, 6, "p_partkey")
    return found.select("p_partkey", "piece", "bar", "step", "velocity", F.round("sample", 4).alias("sample"))


def section_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pieces whose price gives the minutes."""
    minutes, bpm = F.col("o_totalprice") / 100000, 60.0 + F.pmod("o_orderkey", F.lit(30))
    return tl.section_plan(table(spark, sf_dir, "orders").select("o_orderkey", tl.bars_of(minutes, bpm).alias("bars")), "o_orderkey", "bars")


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of suppliers' pieces; their chords stand on four degrees above a note of their own."""
    n = F.col("s_suppkey")
    pieces = table(spark, sf_dir, "supplier").select("s_suppkey", (8 + F.pmod(n, F.lit(60))).cast("int").alias("bars"))
    chord = lambda k: F.struct(cat.voice(F.transform(cat.ints([0, 3, 7, 10]), lambda s: 57 + F.pmod(n + k, F.lit(12)).cast("int") + s)).alias("notes"), (33 + F.pmod(n + k, F.lit(12))).cast("int").alias("bass"))
    pattern = F.get(F.array(*map(F.lit, [*tl.COMPS, "other"])), F.pmod(n, F.lit(len(tl.COMPS) + 1)).cast("int"))
    sections = tl.section_plan(pieces, "s_suppkey", "bars").withColumns({"chords": F.array(*map(chord, (0, 5, 7, 3))), "pattern": pattern})
    return tl.bars_with_chords(sections, "s_suppkey")


def note_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.expand_notes(_bars(spark, sf_dir), "s_suppkey").withColumns({c: F.round(c, 6) for c in ("step", "velocity", "pan")})


def drum_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(tl.COMPS)
    rows = [(names[i % len(names)], piece, [float(x) for x in grid]) for i, (_, piece, grid) in enumerate(GRIDS * 4)]
    grids = spark.createDataFrame(sorted({(a, b, tuple(g)) for a, b, g in rows}), "pattern string, piece string, grid array<double>")
    return tl.expand_drums(_bars(spark, sf_dir), grids, "s_suppkey").withColumns({c: F.round(c, 6) for c in ("velocity", "pan")})


def lead_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A melody in the scale of each supplier's first chord."""
    tones = cat.scale_tones(F.pmod(F.col("s_suppkey") + 9, F.lit(12)), F.lit("minor"))
    return tl.expand_lead(_bars(spark, sf_dir).withColumn("tones", tones), "s_suppkey", MOTIF, "tones").withColumns({c: F.round(c, 6) for c in ("velocity", "pan")})


def tempo_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = tl.tempo_fit(F.pmod("o_totalprice", F.lit(100.0)) + 40, F.lit(85.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(rate, 6).alias("rate"))


def key_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.pmod("s_suppkey", F.lit(12)).alias("a"), (F.pmod("s_suppkey", F.lit(2)) == 0).alias("ma"), F.pmod("s_nationkey", F.lit(12)).alias("b"), (F.pmod("s_nationkey", F.lit(3)) == 0).alias("mb"))
    args = F.col("a"), F.col("ma"), F.col("b"), F.col("mb")
    return s.select("s_suppkey", scalar.key_distance(*args).alias("distance"), scalar.semitones_to_key(*args).cast("long").alias("shift"), scalar.midi_to_name(F.col("a") + 60).alias("note"), F.round(scalar.midi_to_hz(F.col("a") + 60), 4).alias("hz"))


def harmony_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation's root and scale: the chords that fit, and how they are voiced."""
    scale = F.get(F.array(*map(F.lit, cat.SCALES)), F.pmod("n_nationkey", F.lit(len(cat.SCALES))))
    roots = table(spark, sf_dir, "nation").select("n_nationkey", F.pmod(F.col("n_nationkey") * 5, F.lit(12)).alias("root"), scale.alias("scale"))
    fit = cat.chords_in_scale(roots.withColumn("tones", cat.scale_tones(F.col("root"), F.col("scale"))), "root", "tones")
    voiced = cat.voice(F.transform("steps", lambda s: F.col("root") + 48 + s))
    return fit.select("n_nationkey", "scale", "quality", F.array_join(voiced.cast("array<string>"), ",").alias("notes"))


def chord_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation's key the chord on each degree: triad, the colours that stay in the scale, its name, and the notes to play over it."""
    n = F.col("n_nationkey")
    names = [k for k, v in cat.SCALES.items() if len(v) == 7]
    scale = F.get(F.array(*map(F.lit, names)), F.pmod(n, F.lit(len(names))))
    steps = F.element_at(F.create_map(*[x for k in names for x in (F.lit(k), cat.ints(cat.SCALES[k]))]), F.col("scale"))
    keys = table(spark, sf_dir, "nation").select("n_nationkey", F.pmod(n * 5, F.lit(12)).cast("int").alias("key"), scale.alias("scale"))
    each = keys.withColumns({"steps": steps, "tones": cat.scale_tones(F.col("key"), F.col("scale")), "degree": F.explode(F.sequence(F.lit(0), F.lit(8)))})
    each = each.withColumns({"root": F.col("key") + cat.degree(F.col("steps"), F.col("degree")), "triad": cat.triad(F.col("steps"), F.col("degree"))})
    pool = cat.melody_pool(F.transform(cat.ints(cat.CHORDS["min7"]), lambda s: F.col("root") + s), F.col("tones"))
    text = lambda xs: F.array_join(xs.cast("array<string>"), ",")
    return each.select(
        "n_nationkey", "scale", "degree", "triad", text(cat.colours(F.col("triad"), F.col("root"), F.col("tones"))).alias("colours"), cat.chord_label(F.col("root"), F.col("key"), F.col("triad")).alias("label"),
        text(pool.strong).alias("strong"), text(pool.weak).alias("weak"), scalar.quantise_to_scale(F.col("root") + 61, F.col("tones")).alias("near"),
    )


def key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of keys as people write them, read."""
    text = F.get(F.array(*map(F.lit, KEY_TEXTS)), F.pmod("p_partkey", F.lit(len(KEY_TEXTS))).cast("int"))
    key = scalar.parse_key(text)
    return table(spark, sf_dir, "part").select("p_partkey", key.pc.alias("pc"), key.mode.alias("mode"))


def config_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's setting, else its nation's, else its region's; a list gives one of its entries; a mood moves the tempo and chooses among keys."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    keys = F.array(*(F.concat(F.lit(x), F.lit(" Minor" if i % 3 == 0 else " Major")) for i, x in enumerate("CDEFG")))
    joined = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    u = lambda tag: tl.drawn(F.col("c_custkey"), F.lit(tag))
    low = cat.resolve(F.when(F.col("c_acctbal") > 5000, F.lit(90)), F.when(F.col("n_nationkey") % 2 == 0, F.lit(40) + F.col("n_nationkey") * 6), F.lit(60) + F.col("r_regionkey")).cast("int")
    mode = F.get(F.array(F.lit("Minor"), F.lit("Major"), F.lit("Dorian")), F.pmod("c_custkey", F.lit(3)).cast("int"))
    shift = F.when(mode == "Minor", -6).when(mode == "Major", 8)
    swing = cat.resolve(F.when(F.col("c_acctbal") > 5000, F.array(F.lit(0.1), F.lit(0.2))), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit(0.16))), F.array(F.lit(0.12), F.lit(0.14), F.lit(0.18)))
    pool = cat.filter_or_all(keys, lambda k: k.endswith(mode))
    built_in, remote = (cat.tempo_in(low, low + 16, u("bpm"), shift, 40, most) for most in (180, 200))
    return joined.select("c_custkey", built_in.alias("bpm"), remote.alias("remote_bpm"), cat.pick(swing, u("swing")).alias("swing"), cat.pick(pool, u("key")).alias("key"))


def catalogue_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, ("yes", "no", "conditional", "check"))), F.pmod("p_partkey", F.lit(4)).cast("int")).alias("licence"), (F.col("p_size") - 5).alias("need"))
    return cat.catalogue(parts, "licence", "need", F.lit(12.0), True)


def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, nodes): a graph around each event's props."""
    head = '{"1":{"class_type":"Loader","inputs":{"name":"m"}},"2":{"class_type":"Sampler","_meta":{"title":"Main"},"inputs":{"model":["1",0],"seed":'
    graph = F.concat(F.lit(head), F.get_json_object("props", "$.k"), F.lit('}},"3":{"class_type":"Save","inputs":{"images":["2",0],"seed":["9",1]}},"10":{"class_type":"CLIPTextEncode","_meta":{"title":"POSITIVE"},"inputs":{"text":"old","clip":["1",1]}}}'))
    return table(spark, sf_dir, "events").select("event_id", cat.graph(graph).alias("nodes"))


def graph_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampler's seed is set by its title, links and other nodes stay; all in each graph's row."""
    nodes = F.col("nodes")
    ids = F.flatten(F.array(cat.selected(nodes, F.lit("main")), cat.selected(nodes, F.lit("3"))))
    done = _graphs(spark, sf_dir).withColumn("new", cat.set_input(nodes, ids, F.lit("seed"), F.lit("7"))).withColumn("lost", cat.dangling(F.col("new")))
    inputs = F.flatten(F.transform("new", lambda n: F.transform(F.map_entries(n.inputs), lambda e: F.struct(n.node.alias("node"), e.key.alias("field"), e.value.alias("value")))))
    each = done.select("event_id", "lost", "nodes", F.explode(inputs).alias("i"))
    old = F.get(F.filter("nodes", lambda n: n.node == F.col("i.node")), F.lit(0)).inputs
    return each.select("event_id", "i.node", "i.field", "i.value", (F.try_element_at(old, F.col("i.field")) != F.col("i.value")).alias("patched"), F.exists("lost", lambda x: (x.node == F.col("i.node")) & (x.field == F.col("i.field"))).alias("dangling"))


def graph_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, seeds wherever they are, and a new field; the graph as JSON again, and why some settings are refused."""
    graphs = _graphs(spark, sf_dir).withColumn("nodes", cat.set_text(F.col("nodes"), F.lit("positive"), cat.quoted(F.concat(F.lit('say "'), F.col("event_id").cast("string"), F.lit('"')))))
    graphs = graphs.withColumn("nodes", cat.set_where(F.col("nodes"), F.lit("seed"), F.lit("11")))
    graphs = graphs.withColumn("nodes", cat.set_input(F.col("nodes"), F.array(F.lit("1")), F.lit("strength"), F.lit("0.5"), create=True))
    refused = lambda selector, field: F.array_join(cat.refusals(F.col("nodes"), cat.selected(F.col("nodes"), F.lit(selector)), F.lit(field)), ";")
    return graphs.select("event_id", cat.graph_json(F.col("nodes")).alias("graph"), refused("none", "x").alias("no_node"), refused("loader", "x").alias("no_input"), refused("3", "seed").alias("connected"))


def graph_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files among the results of a run, by kind."""
    k = F.get_json_object("props", "$.k")
    run = F.concat(F.lit('{"4":{"images":[{"filename":"a'), k, F.lit('.png"},{"filename":""}]},"3":{"audio":[{"filename":"b'), k, F.lit('.wav"}],"gifs":[{"filename":"c.WEBM"}]}}'))
    names = lambda want: F.array_join(cat.outputs(run, want), ",")
    return table(spark, sf_dir, "events").select("event_id", names("").alias("every"), names("audio").alias("audio"), names("image").alias("image"), names("video").alias("video"))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey, "left")
    chapters = F.when(F.pmod("o_orderkey", F.lit(7)) > 0, F.pmod("o_orderkey", F.lit(6)))
    source = F.when(F.pmod("o_orderkey", F.lit(11)) == 0, "cover")
    found = cat.readiness(-F.pmod("o_totalprice", F.lit(30.0)), -F.pmod("o_orderkey", F.lit(5)) / 2, chapters, scalar.fmt_time(F.pmod("o_custkey", F.lit(2)).cast("double")), F.coalesce(F.col("c_acctbal") < 0, F.lit(False)), source)
    return joined.select("o_orderkey", F.array_join(found.problems, ",").alias("problems"), F.array_join(found.notes, ",").alias("notes"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files in folders; some folders have manifests."""
    n = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(n.alias("path"), F.pmod(n, F.lit(40)).alias("folder"), (F.pmod(n, F.lit(8)) + 100).alias("parent"))
    engine = F.get(F.array(*map(F.lit, ("builtin", "lofify", "ace-step", "other"))), F.pmod(F.col("id"), F.lit(4)).cast("int"))
    manifests = spark.range(108).where("id % 3 <> 1").select(F.col("id").alias("folder"), engine.alias("engine"), F.pmod("id", F.lit(2)).alias("tracks"), F.when(F.col("id") % 5 < 3, "r").alias("reference"), F.when(F.col("id") % 10 < 4, "cover").alias("ref_mode"))
    return cat.provenance(files, manifests).select("path", "engine", "source", F.coalesce("problem", F.lit("")).alias("problem"))


def memo_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lengths; labelled documents are in the cache, whose value is 0 minus the id."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    cache = labels.select("doc_id", (-F.col("doc_id")).alias("size")).distinct()
    return cat.memo(docs, cache, "doc_id", lambda d: d.select("doc_id", F.length("text").cast("long").alias("size")), ["size"])


def file_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files that were analysed before, some of which have changed since, are too short or cannot be read."""
    n = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("/m/"), n.cast("string")).alias("path"), F.pmod(n, F.lit(5)).alias("modified"), F.col("p_size").cast("long").alias("size"), n)
    cache = files.where(n % 3 == 0).select(cat.file_key(F.col("path"), F.when(n % 2 == 0, F.col("modified")).otherwise(9), F.col("size")).alias("key"), F.lit(-1.0).alias("duration"))
    compute = lambda d: d.select("key", (F.col("size") / 10).alias("duration"), F.when(n % 7 == 0, "broken").alias("error"))
    results, rejects = cat.analysed(files, cache, compute)
    return results.select("path", "duration", "hit", F.lit("").alias("reason")).unionByName(rejects.select("path", F.lit(0.0).alias("duration"), F.lit(False).alias("hit"), "reason"))


def note_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a bucketed note is asked for and how often it would be rendered, by instrument."""
    dur, vel = cat.note_key(F.col("l_quantity") / 7, F.col("l_discount") * 10)
    asked = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("instrument"), F.pmod("l_partkey", F.lit(49)).alias("midi"), dur.alias("d"), vel.alias("v")).agg(F.count("*").alias("n"))
    total = asked.groupBy("instrument").agg(F.sum("n").alias("asked"), F.count("*").alias("rendered"))
    return total.select("instrument", "asked", "rendered", F.round(1 - F.col("rendered") / F.col("asked"), 3).alias("hit_rate"))


def note_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as requests for five notes to a memory of three."""
    asked = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.pmod(F.floor(F.col("value")), F.lit(5)).alias("note"))
    return cat.fifo(asked, "user_id", ["ts", "event_id"], "note", 3)


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", scalar.iso_time(ts).alias("iso"), scalar.day_stamp(ts).alias("stamp"), F.year(ts).alias("year"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", scalar.slug(F.concat("p_brand", F.lit(" / "), "p_name")).alias("slug"), scalar.fmt_time(F.col("p_retailprice") * 4).alias("time"), scalar.human_size(F.col("p_retailprice") * F.col("p_partkey") * 100).alias("size"), scalar.coerce(F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(F.col("p_type"))).kind.alias("kind"))


_KD = "CASE WHEN (CAST({ma} AS BOOLEAN) <> CAST({mb} AS BOOLEAN)) AND d > 0 THEN d + 0.75 ELSE d END"
_FOLD = "(({a} + CASE WHEN {m} THEN 3 ELSE 0 END) % 12)"
_TRACKS = "(SELECT conv_id, turn AS pos, length(coalesce(text, ''))::BIGINT AS len, role FROM conversations)"
_MIX = f"""k AS (SELECT *, lag(len) OVER w AS before FROM {_TRACKS} WHERE len >= 60 WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
o AS (SELECT *, CASE WHEN before IS NULL THEN 0 ELSE least(40, before, len) END AS overlap FROM k),
l AS (SELECT *, CAST(sum(len - overlap) OVER (PARTITION BY conv_id ORDER BY pos) - len AS BIGINT) AS start FROM o)"""
_TIME = "CASE WHEN s >= 3600 OR {force} THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END"
_GRIDS = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in GRIDS)
_SCALES = ", ".join(f"({i}, '{k}', {v})" for i, (k, v) in enumerate(cat.SCALES.items()))
_CHORDS = ", ".join(f"('{k}', {v})" for k, v in cat.CHORDS.items())

_U = "(('0x' || substr(md5(concat_ws('/', {})), 1, 4))::INT / 65536.0::DOUBLE)"


def _u(*parts: str) -> str:
    """`drawn` in SQL."""
    return _U.format(", ".join(parts))


_ARCS = ", ".join(
    f"({long}, {i}, '{kind}', {n}, {sum(x[1] for x in arc[:i])}, {str(drums).lower()}, {str(lead).lower()}, {loud}, {cutoff}, {shift}, {sum(x[1] for x in arc)}, {len(arc)})"
    for long, arc in (("false", tl.SHORT_ARC), ("true", tl.LONG_ARC)) for i, (kind, n, drums, lead, loud, cutoff, shift) in enumerate(arc)
)
#: Sections of the pieces t(key, bars).
_SECTIONS = f"""a AS (SELECT * FROM (VALUES {_ARCS}) v(arc, i, kind, n, off, drums, lead, loud, cutoff, shift, cyc, cnt)),
m AS (SELECT key, bars, loop, loop * cnt + i + 1 AS section, loop * cyc + off + 4 AS start, least(n, greatest(4, bars - 8 - loop * cyc - off)) AS length, kind, drums, lead, loud, cutoff, shift
      FROM (SELECT key, bars, a.*, unnest(range(CAST(ceil(greatest(bars - 8, 0) / cyc::DOUBLE) AS BIGINT))) AS loop FROM t JOIN a ON a.arc = (bars >= 60)) WHERE loop * cyc + off < bars - 8),
e AS (SELECT key, max(section) AS section, max(start + length) AS stop FROM m GROUP BY 1),
sec AS (SELECT key, 0 AS section, 'intro' AS kind, 0 AS start, 4 AS length, false AS drums, false AS lead, 0.55::DOUBLE AS intensity, 2600::DOUBLE AS cutoff, 0 AS chord_shift FROM t
  UNION ALL SELECT key, section::INT, kind, start::INT, length::INT, drums AND NOT (loop > 0 AND {_u("key", "section", "'drums'")} < 0.15), lead <> (loop > 0 AND {_u("key", "section", "'lead'")} < 0.3), loud::DOUBLE,
    CASE WHEN loop > 0 AND {_u("key", "section", "'cutoff'")} < 0.22 THEN ([4200.0, 6500.0, 16000.0])[floor({_u("key", "section", "'which'")} * 3)::INT + 1] ELSE cutoff END::DOUBLE, ((shift + loop) % 4)::INT FROM m
  UNION ALL SELECT key, (coalesce(section, 0) + 1)::INT, 'outro', coalesce(stop, 4)::INT, greatest(4, bars - coalesce(stop, 4))::INT, true, false, 0.6, 3200, 0 FROM t LEFT JOIN e USING (key))"""
_VOICE = """list_sort(list_distinct(list_transform({notes}, lambda x: CASE WHEN x < 52 THEN x + 12 WHEN x > 76 THEN x - 12 ELSE x END)))"""
_CLEAN = """list_reduce(list_transform({notes}, lambda x: [x]), lambda k, n: CASE WHEN n[1] - k[len(k)] = 1 AND n[1] < 64 THEN k ELSE list_concat(k, n) END)"""
_SPREAD = """CASE WHEN len({notes}) >= 4 THEN list_sort(list_concat([{notes}[1] - 12], {notes}[2:])) ELSE {notes} END"""
_PATTERNS = [*tl.COMPS, "other"]
#: Bars of suppliers' pieces with their chord.
_BARS = f"""t AS (SELECT s_suppkey AS key, 8 + s_suppkey % 60 AS bars FROM supplier), {_SECTIONS},
b0 AS (SELECT *, unnest(range(length)) AS bar FROM sec),
b1 AS (SELECT *, ({_PATTERNS})[key % {len(_PATTERNS)} + 1] AS pattern, (key + ([0, 5, 7, 3])[(bar + chord_shift) % 4 + 1]) % 12 AS pc FROM b0),
b2 AS (SELECT *, {_VOICE.format(notes="[57 + pc, 60 + pc, 64 + pc, 67 + pc]")} AS voiced FROM b1),
b3 AS (SELECT *, {_CLEAN.format(notes="voiced")} AS clean FROM b2),
b AS (SELECT key, section, start, bar, drums, lead, intensity, pattern, (33 + pc)::INT AS bass, {_SPREAD.format(notes="clean")} AS notes FROM b3)"""
_COMPS = ", ".join(f"('{k}', [{', '.join(f'{{step: {a}, hold: {b}, velocity: {c}::DOUBLE}}' for a, b, c in hits)}])" for k, hits in tl.COMPS.items())
_DRUMS = sorted({([*tl.COMPS][i % len(tl.COMPS)], piece, tuple(grid)) for i, (_, piece, grid) in enumerate(GRIDS * 4)})


def _tag(name: str, *more: str) -> str:
    return _u("key", "section", "bar", f"'{name}'", *more)


SQL = {
    "medoid_target": f"""WITH c AS (SELECT c_nationkey, c_custkey AS pos, abs(c_acctbal) % 120.0 AS bpm, c_custkey % 12 AS pc, (c_custkey * 7) % 5 < 2 AS minor FROM customer),
t AS (SELECT c_nationkey, round(greatest(least(coalesce(median(bpm) FILTER (bpm <> 0), 80.0), 110.0), 55.0), 2) AS bpm FROM c GROUP BY 1),
d AS (SELECT a.c_nationkey, a.pos, a.pc, a.minor, sum({_KD.format(ma='a.minor', mb='b.minor')}) AS total
      FROM c a JOIN c b USING (c_nationkey), LATERAL (SELECT least((x - y + 12) % 12, (y - x + 12) % 12) AS d FROM (SELECT {_FOLD.format(a='a.pc', m='a.minor')} AS x, {_FOLD.format(a='b.pc', m='b.minor')} AS y)) GROUP BY ALL)
SELECT c_nationkey, bpm, pc::INT AS pc, minor, round(total, 4)::DOUBLE AS total FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY total, pos) AS rn FROM d) JOIN t USING (c_nationkey) WHERE rn = 1""",
    "greedy_order": """WITH RECURSIVE t AS (SELECT n_nationkey AS id, 60.0 + n_nationkey * 37 % 50 AS bpm, n_nationkey * 5 % 12 AS pc, n_nationkey % 3 = 0 AS minor FROM nation),
w AS (SELECT 0 AS pos, id, [id] AS seen FROM (SELECT id FROM t ORDER BY bpm, id LIMIT 1)
      UNION ALL
      SELECT pos + 1, best, list_append(seen, best) FROM (SELECT w.pos, w.seen, (SELECT n.id FROM t n, t l, LATERAL (SELECT least((x - y + 12) % 12, (y - x + 12) % 12) AS d FROM (SELECT (l.pc + CASE WHEN l.minor THEN 3 ELSE 0 END) % 12 AS x, (n.pc + CASE WHEN n.minor THEN 3 ELSE 0 END) % 12 AS y)) g
        WHERE l.id = w.id AND NOT list_contains(w.seen, n.id) ORDER BY CASE WHEN l.minor <> n.minor AND d > 0 THEN d + 0.75 ELSE d END, abs(l.bpm - n.bpm), n.id LIMIT 1) AS best FROM w) WHERE best IS NOT NULL)
SELECT pos, id AS n_nationkey FROM w""",
    "target_select": f"""WITH c AS (SELECT c_nationkey, c_custkey AS pos, abs(c_acctbal) % 120.0 AS bpm, CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 12 END AS pc, (c_custkey * 7) % 5 < 2 AS minor FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey > 0),
t AS (SELECT c_nationkey, median(bpm) FILTER (bpm <> 0) AS middle FROM c GROUP BY 1),
d AS (SELECT a.c_nationkey, a.pos, a.pc, a.minor, sum({_KD.format(ma='a.minor', mb='b.minor')}) AS total
      FROM c a JOIN c b USING (c_nationkey), LATERAL (SELECT least((x - y + 12) % 12, (y - x + 12) % 12) AS d FROM (SELECT {_FOLD.format(a='a.pc', m='a.minor')} AS x, {_FOLD.format(a='b.pc', m='b.minor')} AS y)) WHERE a.pc IS NOT NULL AND b.pc IS NOT NULL GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY total, pos) AS rn FROM d) WHERE rn = 1)
SELECT n_nationkey AS c_nationkey, round(greatest(least(coalesce(nullif(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 9.0::DOUBLE END, 0), middle, 80.0), 110.0), 55.0), 2) AS bpm,
CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey % 12 ELSE coalesce(pc, 9) END::INT AS pc, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey % 8 = 0 ELSE coalesce(minor, true) END AS minor
FROM nation LEFT JOIN t ON t.c_nationkey = n_nationkey LEFT JOIN k ON k.c_nationkey = n_nationkey""",
    "track_order": """SELECT s_nationkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS place, s_suppkey AS id, 'asis' AS mode FROM supplier
UNION ALL SELECT s_nationkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('7/' || s_suppkey), s_suppkey) - 1)::INT, s_suppkey, 'shuffle' FROM supplier""",
    "mix_timeline": f"WITH {_MIX} SELECT conv_id, pos, len, overlap, start FROM l",
    "mix_programme": f"""WITH RECURSIVE t AS (SELECT conv_id, list({{pos: pos, len: len}} ORDER BY pos) AS rows FROM {_TRACKS} GROUP BY 1),
m AS (SELECT conv_id, rows, 0::BIGINT AS idx, 0 AS passed, 0::BIGINT AS written, 0::BIGINT AS tail, 0 AS seg, false AS done, NULL::BIGINT AS pos, NULL::BIGINT AS turn, NULL::BIGINT AS start, NULL::BIGINT AS frames, NULL::BIGINT AS overlap FROM t
      UNION ALL
      SELECT conv_id, rows, idx + 1, CASE WHEN ok THEN 0 ELSE passed + 1 END, CASE WHEN ok THEN st + f - kept ELSE written END, CASE WHEN ok THEN kept ELSE tail END, seg + ok::INT,
             CASE WHEN ok THEN st + f >= 3000 ELSE passed + 1 >= len(rows) END OR idx + 1 > 200 * len(rows), CASE WHEN ok THEN p END, turn, st, f, ov
      FROM (SELECT *, least(f - ov, 50) AS kept FROM (SELECT *, written + CASE WHEN seg = 0 THEN 0 ELSE tail - ov END AS st FROM (SELECT *, CASE WHEN seg = 0 THEN 0 ELSE least(40, tail, f) END AS ov
        FROM (SELECT conv_id, rows, idx, passed, written, tail, seg, rows[idx % len(rows) + 1].pos AS p, rows[idx % len(rows) + 1].len AS f, rows[idx % len(rows) + 1].len >= 60 AS ok, idx // len(rows) AS turn FROM m WHERE NOT done)))))
SELECT conv_id, seg - 1 AS segment, pos, turn::INT AS turn, start, frames, overlap FROM m WHERE pos IS NOT NULL""",
    "song_programme": f"""WITH RECURSIVE t AS (SELECT conv_id, list({{pos: pos, seconds: len / 2.0::DOUBLE, bpm: 60.0::DOUBLE + pos * 7 % 50, down: pos % 4 / 4.0::DOUBLE}} ORDER BY pos) AS rows, min(len / 2.0::DOUBLE) AS s FROM {_TRACKS} GROUP BY 1),
g AS (SELECT conv_id, rows, greatest(5, floor(CASE WHEN s * (1 - 18.0 / 100) - 2 * bar > 0 THEN least(4, greatest(1, floor((s * (1 - 18.0 / 100) - 2 * bar) / (2 * bar)))) WHEN s > 0 THEN 1 ELSE 4 END * bar * 10))::BIGINT AS cf, bar FROM t CROSS JOIN (SELECT 60.0::DOUBLE / 85 * 4 AS bar)),
m AS (SELECT conv_id, rows, cf, bar, 0::BIGINT AS idx, 0 AS passed, 0::BIGINT AS written, 0::BIGINT AS tail, 0 AS seg, false AS done, NULL::BIGINT AS pos, NULL::BIGINT AS turn, NULL::BIGINT AS start, NULL::BIGINT AS frames, NULL::BIGINT AS overlap FROM g
      UNION ALL
      SELECT conv_id, rows, cf, bar, idx + 1, CASE WHEN ok THEN 0 ELSE passed + 1 END, CASE WHEN ok THEN st + f - kept ELSE written END, CASE WHEN ok THEN kept ELSE tail END, seg + ok::INT,
             CASE WHEN ok THEN st + f >= 4000 ELSE passed + 1 >= len(rows) END OR idx + 1 > 200 * len(rows), CASE WHEN ok THEN r.pos END, turn, st, f, ov
      FROM (SELECT *, least(f - ov, cf) AS kept FROM (SELECT *, written + CASE WHEN seg = 0 THEN 0 ELSE tail - ov END AS st FROM (SELECT *, CASE WHEN seg = 0 THEN 0 ELSE least(cf, tail, f) END AS ov FROM (SELECT *, raw >= cf + 10 AND f >= 2 * cf AS ok
        FROM (SELECT *, CASE WHEN floor(body / (bar * 10)) >= 1 THEN round_even(floor(body / (bar * 10)) * bar * 10, 0)::BIGINT ELSE body END AS f FROM (SELECT *, raw - CASE WHEN floor(r.down * 10) < raw THEN floor(r.down * 10)::BIGINT ELSE 0 END AS body
        FROM (SELECT *, floor(r.seconds / CASE WHEN abs(fit - 1) < 0.002 THEN 1.0 ELSE fit END * 10)::BIGINT AS raw FROM (SELECT *, CASE WHEN abs(ratio - 1) * 100 <= 18 THEN ratio WHEN abs(ratio * 2 - 1) * 100 <= 18 THEN ratio * 2 WHEN abs(ratio / 2 - 1) * 100 <= 18 THEN ratio / 2 ELSE 1 END AS fit
        FROM (SELECT *, 85.0::DOUBLE * (1.0::DOUBLE + ({_u("conv_id", "idx")} - 0.5) * 0.02::DOUBLE * least(turn, 3)) / r.bpm AS ratio
        FROM (SELECT conv_id, rows, cf, bar, idx, passed, written, tail, seg, rows[idx % len(rows) + 1] AS r, idx // len(rows) AS turn FROM m WHERE NOT done)))))))))))
SELECT conv_id, seg - 1 AS segment, pos, turn::INT AS turn, start, frames, overlap FROM m WHERE pos IS NOT NULL""",
    "bar_snap": f"""WITH t AS (SELECT conv_id, pos, len / 10.0 AS l, 240.0 / (60 + conv_id % 50) AS bar, pos % 4 / 4.0 AS down FROM {_TRACKS})
SELECT conv_id, pos, round(down, 4)::DOUBLE AS start, round(CASE WHEN floor((l - down) / bar) >= 1 THEN down + floor((l - down) / bar) * bar ELSE l END, 4)::DOUBLE AS stop,
CASE WHEN l * 0.82 - 2 * bar > 0 THEN least(4, greatest(1, floor((l * 0.82 - 2 * bar) / (2 * bar))::INT)) WHEN l > 0 THEN 1 ELSE 4 END AS bars FROM t""",
    "title_repeat": """WITH t AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY p_partkey) AS n FROM t)
SELECT p_partkey, CASE WHEN n = 1 THEN title WHEN n <= 8 THEN title || ' (' || (['II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII'])[n - 1] || ')' ELSE title || ' (' || n || ')' END AS shown FROM n""",
    "chapters": f"""WITH {_MIX}, e AS (SELECT *, max(start + len) OVER (PARTITION BY conv_id) AS total, greatest(round_even(start / 2.0, 0), 0)::BIGINT AS s FROM l)
SELECT conv_id, pos, {_TIME.format(force='total / 2.0 >= 3600')} || ' ' || role AS line FROM e""",
    "event_expand": f"""WITH g AS (SELECT pattern, piece, unnest(range(16)) AS step, unnest(grid) AS velocity FROM (VALUES {_GRIDS}) v(pattern, piece, grid)),
h AS (SELECT p_partkey, p_size + 60 AS bpm, piece, bar, step, velocity FROM part JOIN g ON g.pattern = string_split(p_name, ' ')[1] CROSS JOIN (SELECT unnest(range(4)) AS bar) WHERE velocity > 0)
SELECT p_partkey, piece, bar::INT AS bar, step::INT AS step, velocity::DOUBLE AS velocity, round(((bar * 16 + step) * (60.0 / bpm / 4) + CASE WHEN (bar * 16 + step) % 2 = 1 THEN 0.16 * (60.0 / bpm / 4) ELSE 0 END) * 100, 4) AS sample
FROM h WHERE ('0x' || substr(md5(concat_ws('/', p_partkey, bar, piece, step)), 1, 4))::INT % 100 >= 6""",
    "section_plan": f"""WITH t AS (SELECT o_orderkey AS key, greatest(8, round_even(o_totalprice / 100000 * 60.0 / (60.0::DOUBLE / (60.0 + o_orderkey % 30) * 4), 0)::INT) AS bars FROM orders), {_SECTIONS}
SELECT key AS o_orderkey, section, kind, start, length, drums, lead, intensity, cutoff, chord_shift FROM sec""",
    "note_expand": f"""WITH {_BARS}, c AS (SELECT * FROM (VALUES {_COMPS}) v(pattern, hits)),
p AS (SELECT b.*, CASE WHEN {_tag("comp")} < 0.3 AND len(h) > 1 THEN h[:len(h) - 1] ELSE h END AS comp FROM (SELECT b.*, coalesce(c.hits, (SELECT hits FROM c WHERE pattern = 'lazy')) AS h FROM b LEFT JOIN c USING (pattern)) b),
s AS (SELECT *, unnest(comp) AS x FROM p), n AS (SELECT *, unnest(notes) AS midi, unnest(range(len(notes))) AS j FROM s),
w AS (SELECT *, {_tag("bass")} AS r, {_tag("fifth")} AS q FROM b),
l AS (SELECT key, section, bar, unnest(list_concat([{{step: 0, hold: 6, v: 1.0::DOUBLE, midi: bass}}], CASE WHEN r < 0.45 THEN [{{step: 8, hold: 5, v: 0.75::DOUBLE, midi: bass}}]
        WHEN r < 0.75 THEN [{{step: 8, hold: 3, v: 0.7::DOUBLE, midi: bass + 7}}, {{step: 12, hold: 3, v: 0.6::DOUBLE, midi: bass}}] ELSE [{{step: 10, hold: 5, v: 0.7::DOUBLE, midi: CASE WHEN q < 0.5 THEN bass ELSE bass + 7 END}}] END)) AS e, intensity FROM w),
d AS (SELECT *, unnest(notes[:4]) AS midi, unnest(range(least(len(notes), 4))) AS j FROM b)
SELECT key AS s_suppkey, section, bar::INT AS bar, 'chords' AS stem, round(x.step + j * 0.08::DOUBLE, 6) AS step, 'note' AS kind, midi::INT AS midi, x.hold::INT AS hold, round(x.velocity * intensity * (0.85 + 0.15 * {_tag("touch", "x.step", "j")}), 6) AS velocity,
       round(-0.55 + 1.10 * (j / greatest(1, len(notes) - 1)::DOUBLE), 6) AS pan FROM n
UNION ALL SELECT key, section, bar::INT, 'bass', e.step::DOUBLE, 'note', e.midi::INT, e.hold::INT, round(e.v * intensity, 6), 0.0 FROM l
UNION ALL SELECT key, section, bar::INT, 'pad', 0.0, 'note', (midi - 12)::INT, 16, round(0.5 * intensity, 6), round(-0.7 + 1.4 * (j % 2), 6) FROM d""",
    "drum_expand": f"""WITH {_BARS}, g AS (SELECT pattern, piece, unnest(range(16)) AS place, unnest(grid)::DOUBLE AS v FROM (VALUES {", ".join(f"('{a}', '{p_}', {list(g_)})" for a, p_, g_ in _DRUMS)}) w(pattern, piece, grid)),
h AS (SELECT b.*, piece, place, v FROM b JOIN g USING (pattern) WHERE drums AND v > 0 AND {_tag("drop", "piece", "place")} >= 0.06),
f AS (SELECT *, unnest(range(3)) AS k FROM b WHERE drums AND (start + bar + 1) % 8 = 0 AND {_tag("fill")} < 0.6)
SELECT key AS s_suppkey, section, bar::INT AS bar, 'drums' AS stem, place::DOUBLE AS step, CASE WHEN piece = 'hat' AND {_tag("open", "place")} < 0.05 THEN 'hat_open' ELSE piece END AS kind, 0 AS midi, 1 AS hold,
       round(v * intensity * (0.88 + 0.24 * {_tag("touch", "piece", "place")}), 6) AS velocity, CASE WHEN piece IN ('kick', 'snare') THEN 0.0 WHEN piece = 'hat' THEN -0.3 ELSE 0.34 END::DOUBLE AS pan FROM h
UNION ALL SELECT key, section, bar::INT, 'drums', 13.0 + k, (['snare', 'tom', 'rim'])[floor({_tag("which", "k")} * 3)::INT + 1], 0, 1, round(0.5 + 0.18 * k, 6), round(-0.3 + 0.3 * k, 6) FROM f""",
    "tempo_fit": """WITH r AS (SELECT o_orderkey, 85.0 / (o_totalprice % 100.0 + 40) AS r FROM orders),
f AS (SELECT o_orderkey, CASE WHEN abs(r - 1) * 100 <= 18 THEN r WHEN abs(r * 2 - 1) * 100 <= 18 THEN r * 2 WHEN abs(r / 2 - 1) * 100 <= 18 THEN r / 2 ELSE 1 END AS f FROM r)
SELECT o_orderkey, round(CASE WHEN abs(f - 1) < 0.002 THEN 1.0 ELSE f END, 6)::DOUBLE AS rate FROM f""",
    "key_math": f"""WITH s AS (SELECT s_suppkey, s_suppkey % 12 AS a, s_suppkey % 2 = 0 AS ma, s_nationkey % 12 AS b, s_nationkey % 3 = 0 AS mb FROM supplier),
f AS (SELECT *, {_FOLD.format(a='a', m='ma')} AS x, {_FOLD.format(a='b', m='mb')} AS y FROM s),
g AS (SELECT *, least((x - y + 12) % 12, (y - x + 12) % 12)::DOUBLE AS d, CASE WHEN (y - x + 12) % 12 > 6 THEN (y - x + 12) % 12 - 12 ELSE (y - x + 12) % 12 END AS sh FROM f)
SELECT s_suppkey, {_KD.format(ma='ma', mb='mb')} AS distance, CASE WHEN abs(sh) > 4 THEN 0 ELSE sh END::BIGINT AS shift, (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[a + 1] || '4' AS note, round(440 * pow(2, (a + 60 - 69) / 12.0), 4) AS hz FROM g""",
    "harmony_filter": f"""WITH s AS (SELECT * FROM (VALUES {_SCALES}) v(i, scale, steps)), c AS (SELECT * FROM (VALUES {_CHORDS}) v(quality, steps)),
r AS (SELECT n_nationkey, n_nationkey * 5 % 12 AS root, scale, list_transform(steps, lambda x: (n_nationkey * 5 + x) % 12) AS tones FROM nation JOIN s ON i = n_nationkey % {len(cat.SCALES)}),
f AS (SELECT n_nationkey, scale, quality, root, c.steps FROM r CROSS JOIN c WHERE len(list_filter(c.steps, lambda x: NOT list_contains(tones, (root + x) % 12))) = 0),
v AS (SELECT *, {_VOICE.format(notes="list_transform(steps, lambda x: root + 48 + x)")} AS voiced FROM f), o AS (SELECT *, {_CLEAN.format(notes="voiced")} AS notes FROM v)
SELECT n_nationkey, scale, quality, array_to_string({_SPREAD.format(notes="notes")}, ',') AS notes FROM o""",
    "chord_colour": f"""WITH s AS (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in cat.SCALES.items() if len(v) == 7)}) v(scale, steps)),
k AS (SELECT n_nationkey, n_nationkey * 5 % 12 AS key, scale, steps, list_transform(steps, lambda x: (n_nationkey * 5 + x) % 12) AS tones, unnest(range(9)) AS degree FROM nation JOIN s ON s.i = n_nationkey % {sum(len(v) == 7 for v in cat.SCALES.values())}),
d AS (SELECT *, list_transform([0, 2, 4], lambda j: steps[(degree + j) % 7 + 1] + 12 * ((degree + j) // 7)) AS tri FROM k),
t AS (SELECT *, key + tri[1] AS root, CASE (tri[2] - tri[1]) * 100 + tri[3] - tri[1] WHEN 407 THEN 'maj' WHEN 307 THEN 'min' WHEN 306 THEN 'dim' WHEN 408 THEN 'aug'
        ELSE CASE WHEN tri[2] - tri[1] = 5 THEN 'sus4' WHEN tri[2] - tri[1] = 2 THEN 'sus2' WHEN tri[2] - tri[1] >= 4 THEN 'maj' ELSE 'min' END END AS triad FROM d),
q AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {i}, '{q_}', {cat.CHORDS[q_]}, '{plain}')" for k, (many, plain) in cat.COLOURS.items() for i, q_ in enumerate(dict.fromkeys([*many, plain])))}) v(triad, o, name, steps, plain)),
f AS (SELECT n_nationkey, degree, string_agg(name, ',' ORDER BY o) AS names FROM t JOIN q USING (triad) WHERE len(list_filter(q.steps, lambda x: NOT list_contains(tones, (root + x) % 12))) = 0 GROUP BY ALL)
SELECT t.n_nationkey, scale, t.degree::INT AS degree, triad, coalesce(names, (SELECT any_value(plain) FROM q WHERE q.triad = t.triad), triad) AS colours,
       CASE WHEN key IN (1, 3, 5, 8, 10) THEN (['C', 'Db', 'D', 'Eb', 'E', 'F', 'Gb', 'G', 'Ab', 'A', 'Bb', 'B'])[root % 12 + 1] ELSE (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[root % 12 + 1] END || CASE triad WHEN 'maj' THEN '' WHEN 'min' THEN 'm' ELSE triad END AS label,
       array_to_string(list_filter(range(64, 87), lambda m: (m - root + 120) % 12 IN (0, 3, 7, 10)), ',') AS strong, array_to_string(list_filter(range(64, 87), lambda m: (m - root + 120) % 12 NOT IN (0, 3, 7, 10) AND list_contains(tones, m % 12)), ',') AS weak,
       (root + 61 + list_sort(list_transform(list_filter(range(-6, 7), lambda x: list_contains(tones, (root + 61 + x) % 12)), lambda x: {{far: abs(x), d: x}}))[1].d)::INT AS near FROM t LEFT JOIN f USING (n_nationkey, degree)""",
    "key_names": f"""SELECT p_partkey, pc, mode FROM part JOIN (VALUES (0, 9, 'minor'), (1, 9, 'minor'), (2, 10, 'dorian'), (3, 0, 'minor'), (4, 5, 'major'), (5, 0, 'minor'), (6, 6, 'harmonic minor'), (7, 11, 'lydian'), (8, 9, 'major'), (9, 8, 'major'),
(10, 2, 'minor'), (11, 3, 'melodic minor'), (12, 7, 'minor'), (13, 9, 'major'), (14, 9, 'minor')) v(i, pc, mode) ON i = p_partkey % {len(KEY_TEXTS)}""",
    "config_resolve": f"""WITH k AS (SELECT ['C Minor', 'D Major', 'E Major', 'F Minor', 'G Major'] AS keys),
j AS (SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN 90 END, CASE WHEN n_nationkey % 2 = 0 THEN 40 + n_nationkey * 6 END, 60 + r_regionkey) AS low, (['Minor', 'Major', 'Dorian'])[c_custkey % 3 + 1] AS mode, ([-6, 8, 0])[c_custkey % 3 + 1] AS shift,
        coalesce(CASE WHEN c_acctbal > 5000 THEN [0.1, 0.2] END, CASE WHEN n_nationkey % 2 = 0 THEN [0.16] END, [0.12, 0.14, 0.18])::DOUBLE[] AS swings FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT *, low + floor({_u("c_custkey", "'bpm'")} * 17)::INT + shift AS b, CASE WHEN len(list_filter(keys, lambda x: ends_with(x, mode))) > 0 THEN list_filter(keys, lambda x: ends_with(x, mode)) ELSE keys END AS pool FROM j CROSS JOIN k)
SELECT c_custkey, greatest(40, least(180, b))::INT AS bpm, greatest(40, least(200, b))::INT AS remote_bpm, swings[floor({_u("c_custkey", "'swing'")} * len(swings))::INT + 1] AS swing, pool[floor({_u("c_custkey", "'key'")} * len(pool))::INT + 1] AS key FROM p""",
    "catalogue_fit": "SELECT * FROM (SELECT p_partkey, (['yes', 'no', 'conditional', 'check'])[p_partkey % 4 + 1] AS licence, p_size - 5 AS need, p_size - 5 <= 0 OR 12 + 2.5 >= p_size - 5 AS fits FROM part) WHERE licence IN ('yes', 'conditional')",
    "graph_patch": """SELECT event_id, node, field, CASE WHEN v.value = '7' THEN '7' ELSE v.value END AS value, v.value = '7' AND json_extract_string(props, '$.k') <> '7' AS patched, dangling FROM events,
LATERAL (VALUES ('1', 'name', '"m"', false), ('2', 'model', '["1",0]', false), ('2', 'seed', '7', false), ('3', 'images', '["2",0]', false), ('3', 'seed', '["9",1]', true), ('10', 'text', '"old"', false), ('10', 'clip', '["1",1]', false)) v(node, field, value, dangling)""",
    "graph_rewrite": r"""SELECT event_id, '{"1":{"class_type":"Loader","inputs":{"name":"m","strength":0.5}},"2":{"class_type":"Sampler","_meta":{"title":"Main"},"inputs":{"model":["1",0],"seed":11}},"3":{"class_type":"Save","inputs":{"images":["2",0],"seed":["9",1]}},"10":{"class_type":"CLIPTextEncode","_meta":{"title":"POSITIVE"},"inputs":{"clip":["1",1],"text":"say \"' || event_id || '\""}}}' AS graph,
'no such node' AS no_node, '1: no such input' AS no_input, '3: connected' AS connected FROM events""",
    "graph_outputs": """SELECT event_id, 'b' || k || '.wav,c.WEBM,a' || k || '.png' AS every, 'b' || k || '.wav' AS audio, 'a' || k || '.png' AS image, 'c.WEBM' AS video FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""",
    "readiness": """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN abs(-(o_totalprice % 30.0) + 14) > 1.5 THEN 'loudness' END, CASE WHEN -(o_orderkey % 5) / 2.0 > -0.9 THEN 'true peak' END,
CASE WHEN c < 3 THEN 'chapters' WHEN o_custkey % 2 <> 0 THEN 'first chapter' END, CASE WHEN o_orderkey % 11 = 0 THEN 'cover' END, CASE WHEN coalesce(c_acctbal < 0, false) THEN 'duplicate' END], lambda x: x IS NOT NULL), ',') AS problems, CASE WHEN c IS NULL THEN 'no tracklist' ELSE '' END AS notes
FROM (SELECT *, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 6 END AS c FROM orders) LEFT JOIN customer ON o_custkey = c_custkey""",
    "provenance": """WITH m AS (SELECT id AS folder, (['builtin', 'lofify', 'ace-step', 'other'])[id % 4 + 1] AS engine, id % 2 AS tracks, CASE WHEN id % 5 < 3 THEN 'r' END AS ref, CASE WHEN id % 10 < 4 THEN 'cover' ELSE 'style' END AS mode FROM range(108) r(id) WHERE id % 3 <> 1),
f AS (SELECT p_partkey AS path, o.folder AS o, u.folder AS u, coalesce(o.tracks, 0) = 0 AND u.folder IS NOT NULL AS up, o.engine AS oe, u.engine AS ue, o.ref AS orf, u.ref AS urf, o.mode AS om, u.mode AS um
      FROM part LEFT JOIN m o ON o.folder = p_partkey % 40 LEFT JOIN m u ON u.folder = p_partkey % 8 + 100),
c AS (SELECT path, coalesce(CASE WHEN up THEN ue ELSE oe END, 'unknown') AS engine, CASE WHEN up THEN urf ELSE orf END AS ref, CASE WHEN up THEN um ELSE om END AS mode FROM f)
SELECT path, engine, CASE WHEN engine = 'builtin' THEN 'built-in' WHEN engine = 'lofify' THEN 'own recordings' WHEN engine = 'ace-step' AND ref IS NOT NULL THEN CASE mode WHEN 'cover' THEN 'cover' ELSE 'style reference' END WHEN engine = 'ace-step' THEN 'model' ELSE 'unknown' END AS source,
CASE WHEN engine = 'lofify' THEN 'only reprocessed' WHEN engine = 'ace-step' AND ref IS NOT NULL AND mode = 'cover' THEN 'cover' ELSE '' END AS problem FROM c""",
    "memo_incremental": "SELECT doc_id, coalesce(-l.id, length(text))::BIGINT AS size, l.id IS NOT NULL AS hit FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS id FROM labels) l ON doc_id = l.id",
    "file_memo": """SELECT '/m/' || p_partkey AS path, CASE WHEN hit THEN -1.0 WHEN reason <> '' THEN 0.0 ELSE p_size / 10.0 END::DOUBLE AS duration, hit, reason FROM (SELECT *, p_partkey % 6 = 0 AS hit,
CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'broken' WHEN p_size < 20 THEN printf('only %.1f s of audio', p_size / 10.0) ELSE '' END AS reason FROM part)""",
    "note_cache": """WITH k AS (SELECT l_returnflag AS instrument, l_partkey % 49 AS midi, round_even(l_quantity / 7 / 0.05, 0)::INT AS d, greatest(1, least(8, round_even(l_discount * 10 / 0.125, 0)::INT)) AS v FROM lineitem)
SELECT instrument, count(*) AS asked, count(DISTINCT (midi, d, v)) AS rendered, round(1 - count(DISTINCT (midi, d, v)) / count(*), 3) AS hit_rate FROM k GROUP BY 1""",
    "note_fifo": """WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, floor(value)::BIGINT % 5 AS note FROM events),
f AS (SELECT user_id, n, note, false AS hit, [note] AS memory FROM s WHERE n = 0
      UNION ALL SELECT f.user_id, s.n, s.note, list_contains(memory, s.note), CASE WHEN list_contains(memory, s.note) THEN memory WHEN len(memory) < 3 THEN list_append(memory, s.note) ELSE list_append(memory[2:], s.note) END FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
SELECT user_id, n AS place, note, hit FROM f""",
    "date_functions": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, year(ts)::INT AS year FROM events",
    "text_functions": f"""WITH p AS (SELECT *, round_even(p_retailprice * 4, 0)::BIGINT AS s, p_retailprice * p_partkey * 100 AS z FROM part)
SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, {_TIME.format(force='false')} AS time,
CASE WHEN z < 1024 THEN printf('%.1f B', z) WHEN z < 1048576 THEN printf('%.1f KB', z / 1024) WHEN z < 1073741824 THEN printf('%.1f MB', z / 1048576) ELSE printf('%.1f GB', z / 1073741824) END AS size,
CASE WHEN p_size > 25 THEN 'int' ELSE 'string' END AS kind FROM p""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "lead_expand"]}

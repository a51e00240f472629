"""Edge cases and metamorphic properties of the operators."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tempograph.functions import kernels, landmarks, scalar
from tempograph.operators import catalogue, fingerprint, ordered, signal, timeline


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert v(scalar.fmt_time(F.lit(3599.5))) == "1:00:00" and v(scalar.fmt_time(F.lit(-3.0))) == "00:00" and v(scalar.fmt_time(F.lit(59.0), True)) == "0:00:59"
    assert v(scalar.slug(F.lit(" Déjà vu! "))) == "d-j-vu" and v(scalar.slug(F.lit("!!!"))) == "track"
    assert v(scalar.parse_key(F.lit(" f#  Major "))) == (6, "major") and v(scalar.parse_key(F.lit(None).cast("string"))) == (9, "minor") and v(scalar.parse_key(F.lit("Bb"))) == (10, "minor")
    assert v(scalar.quantise(F.lit(0.3125), 4)) == 0.25 and v(scalar.quantise(F.lit(0.1875), 4)) == 0.25
    assert v(scalar.human_size(F.lit(1536.0))) == "1.5 KB" and v(scalar.with_suffix(F.lit("a/b.c.mp3"), "wav")) == "a/b.c.wav"
    assert v(scalar.coerce(F.lit("3"))).kind == "int" and v(scalar.coerce(F.lit("True"))).value == "true" and v(scalar.coerce(F.lit("x"))).kind == "string"
    assert v(scalar.is_out_of_memory(F.lit("CUDA OOM at"))) and not v(scalar.is_out_of_memory(F.lit("timeout")))
    key = lambda a, ma, b, mb: v(scalar.key_distance(F.lit(a), F.lit(ma), F.lit(b), F.lit(mb)))
    assert key(9, True, 0, False) == 0 and key(0, False, 1, True) == 4.75 and key(0, False, 11, False) == 1


def test_numbering_does_not_depend_on_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(50), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, ts int, id int")
    one, many = (sorted(ordered.numbered(df, "k", ["ts", "id"], b).select("k", "id", "n").collect()) for b in (F.lit(0), F.floor(F.col("ts") / 7)))
    assert one == many and {r.n for r in one if r.k == 0} == set(range(sum(r[0] == 0 for r in rows)))


def test_frames_are_complete(spark):
    df = spark.createDataFrame([(1, n, float(n)) for n in range(11)] + [(2, 0, 0.0)], "k int, n long, x double")
    found = ordered.framed(df, "k", 4, 3).groupBy("k", "frame").agg(F.min("n").alias("lo"), F.count("*").alias("c")).orderBy("frame").collect()
    assert [(r.k, r.frame, r.lo, r.c) for r in found] == [(1, 0, 0, 4), (1, 1, 3, 4), (1, 2, 6, 4)]
    assert ordered.framed(df, "k", 4, 3, drop_last=True).select("frame").distinct().count() == 2


def test_silence_and_gates(spark):
    quiet = [(1, n, 0.0) for n in range(40)]
    df = spark.createDataFrame(quiet + [(2, n, 0.5 if 8 <= n < 16 else 0.0) for n in range(40)] + [(3, 0, 0.0)], "k int, n long, x double")
    trim = {r.k: (r.start, r.stop) for r in signal.silence_trim(df, "k", 4, 2, -50.0).collect()}
    assert trim == {1: (0, 0), 2: (6, 18), 3: (0, 1)}
    loud = {r.k: r.loudness for r in signal.gated_mean(df, "k", 8).collect()}
    assert loud[1] == -math.inf and -9.2 < loud[2] < -9.1 and 3 not in loud


def test_fingerprint_of_edges(spark):
    peaks = lambda ps: F.lit([{"t": t, "f": f} for t, f in ps]) if ps else F.array().cast("array<struct<t:int,f:int>>")
    schema = "id int, peaks array<struct<t:int,f:int>>"
    rows = [(1, []), (2, [(5, 3)]), (3, [(0, 10), (1, 200), (2, 73), (64, 10), (66, 12)]), (4, [(i, 100) for i in range(30)])]
    df = spark.createDataFrame(rows, schema)
    full = {r.id: r.fp for r in df.select("id", fingerprint.fingerprint(F.col("peaks")).alias("fp")).collect()}
    assert full[1] == [] and full[2] == []
    assert {(p.h, p.t) for p in full[3]} == {(10 << 16 | 126 << 8 | 2, 0), (73 << 16 | 0 << 8 | 62, 2), (10 << 16 | 65 << 8 | 2, 64), (73 << 16 | 2 << 8 | 0, 2)} - {(73 << 16 | 2 << 8 | 0, 2)}
    capped = df.where("id = 4").select(fingerprint.fingerprint(F.col("peaks"), 7).alias("fp")).first().fp
    assert {p.t for p in capped} == {0, 1, 2} and len(capped) == 9
    assert peaks([]) is not None


def test_prints_of_arrays_and_of_expressions_are_equal(spark):
    rng = random.Random(11)
    rows = [(i, [rng.randrange(512) for _ in range(n)], [rng.randrange(1, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 70, 300, 40])] + [(9, [5] * 30, [3] * 30), (10, None, None)]
    df = spark.createDataFrame(rows, "id long, f array<int>, mag array<int>").repartition(2)
    frames = df.select("id", F.transform(F.arrays_zip("f", "mag"), lambda z, i: F.struct(i.alias("t"), z.f.alias("f"), z.mag.cast("double").alias("mag"))).alias("frames"))
    want = frames.where("frames is not null").select("id", fingerprint.fingerprint(fingerprint.loud_frames(F.col("frames"))).alias("fp"))
    got = {r.id: r.fp for r in fingerprint.prints(df).collect()}
    assert got.pop(10) == [] and got == {r.id: r.fp for r in want.collect()}


def plain_score(a, b):
    """Prominence of the best offset of a's anchors in b, by its definition; prints are sets of (h, t)."""
    met = {}
    for h, t in a:
        for g, u in b:
            if g == h:
                met.setdefault(u - t, set()).add(t)
    if not met:
        return 0.0
    merged = [len(met[o] | met.get(o - 1, set()) | met.get(o + 1, set())) for o in met]
    best = max(merged)
    rest = (sum(merged) - best) / (len(merged) - 1) if len(merged) > 1 else 0.0
    return min(1.0, max(0.0, (best - rest) / len({t for _, t in a})))


def test_scores_equal_brute_force(monkeypatch):
    rng = random.Random(9)
    pack = lambda p: np.array(sorted(h << 32 | t for h, t in p), np.int64)
    for places in (1 << 21, 5):
        monkeypatch.setattr(kernels, "PLACES", places)
        for _ in range(60):
            a, b = ({(rng.randrange(6), rng.randrange(20)) for _ in range(rng.randrange(1, 30))} for _ in range(2))
            got = kernels.offset_scores(pack(a), pack(b))
            assert np.allclose(got, (plain_score(a, b), plain_score(b, a)))
    assert kernels.offset_scores(pack([]), pack([(1, 2)])) == (0.0, 0.0)


def test_same_fingerprint_scores_one_and_candidates_miss_nothing(spark):
    rng = random.Random(3)
    prints = []
    for i in range(12):
        base = [(rng.randrange(60), t) for t in range(40)]
        prints += [(i, h, t) for h, t in base]
        if i % 3 == 0:
            prints += [(100 + i, h, t + 9) for h, t in base[: rng.randrange(10, 40)]]
    df = fingerprint.gathered(spark.createDataFrame(sorted(set(prints)), "id int, h int, t int"))
    every = df.select(F.col("id").alias("a")).crossJoin(df.select(F.col("id").alias("b"))).where("a < b")
    scores = fingerprint.similarity(df, every).where("similarity >= 0.35")
    found = fingerprint.near_duplicates(df, 0.35)
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, found.collect())) and found.count() >= 2
    self_pairs = fingerprint.align(df, df.select(F.col("id").alias("a"), F.col("id").alias("b")))
    assert self_pairs.where("score > 0.6").count() == self_pairs.count() == df.count()


def test_meetings_are_not_shuffled_and_blocks_lose_nothing(spark, monkeypatch):
    """Blocks and pieces of few entries give what all pairs do, and no plan joins prints by hash."""
    monkeypatch.setattr(fingerprint, "BLOCK", 150)
    monkeypatch.setattr(fingerprint, "PIECE", 70)
    monkeypatch.setattr(landmarks, "MEETINGS", 40)
    monkeypatch.setattr(landmarks, "ENTRIES", 50)
    monkeypatch.setattr(landmarks, "MATCHES", 60)
    rng = random.Random(8)
    prints = [(i, rng.choice([1, 2, rng.randrange(1 << 25)]), t) for i in range(40) for t in range(rng.choice([1, 2, 5, 30]))]
    prints += [(100 + i, h, t + 7) for i, h, t in prints if rng.random() < 0.8] + [(300, 5, 1 << 21), (301, 5, 3)]
    df = fingerprint.gathered(spark.createDataFrame(sorted(set(prints)), "id int, h int, t int"))
    every = df.select(F.col("id").alias("a")).crossJoin(df.select(F.col("id").alias("b"))).where("a < b")
    want = sorted(map(tuple, fingerprint.similarity(df, every).where("similarity >= 0.35").collect()))
    found = fingerprint.near_duplicates(df, 0.35)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 40
    sides = fingerprint.near_duplicates(df, 0.35, F.col("id") < 100)
    assert sorted(map(tuple, sides.collect())) == [x for x in want if (x[0] < 100) != (x[1] < 100)]
    assert "Join" not in found._jdf.queryExecution().toString()


def test_queries_in_blocks_meet_every_sequence(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.random(40 + 8 * (i % 3)).tolist(), 0.5) for i in range(25)]
    df = spark.createDataFrame(rows, "id long, seq array<double>, span double")
    whole = sorted(map(tuple, fingerprint.sequence_distances(df.where("id < 15"), df, 4).collect()))
    monkeypatch.setattr(fingerprint, "QUERY_VALUES", 200)
    monkeypatch.setattr(fingerprint, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, fingerprint.sequence_distances(df.where("id < 15"), df, 4).collect())) == whole and len(whole) == 15 * 24
    assert "Exchange" not in fingerprint.sequence_distances(df.where("id < 15"), df, 4)._jdf.queryExecution().toString()


def test_sequences_turned_stretched_and_cut_are_near(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(np.abs(np.cumsum(rng.normal(size=(40, 12)), axis=0)) + 0.1)
    rows = [(1, base, 0.5), (2, np.roll(base, 5, axis=1), 0.5), (3, kernels.stretched_sequence(base, 1.25), 0.4), (4, base[10:30], 0.5), (5, unit(np.abs(rng.normal(size=(40, 12)))), 0.5), (6, base[:7], 0.5)]
    df = spark.createDataFrame([(i, x.ravel().tolist(), s) for i, x, s in rows] + [(7, None, None)], "id long, seq array<double>, span double")
    found = {r.id: r.distance for r in fingerprint.sequence_distances(df.where("id = 1"), df).collect()}
    assert found[2] < 1e-3 and found[3] < 0.05 and found[4] < 1e-3 and found[5] > 0.1 and found[6] == found[7] == 1.0 and 1 not in found


def test_ledger_rules_in_order(spark):
    entries = spark.createDataFrame([(1, "s", True), (2, "s", False), (3, "t", False), (4, "u", False), (5, "v", False), (6, "w", True)], "id long, sha string, is_new boolean")
    own = [(h * 7 % 90, h) for h in range(40)]
    prints = [(1, own), (2, own), (3, own[:35] + [(500 + i, 40 + i) for i in range(5)]), (4, [(900 + i, i) for i in range(9)]), (5, [(700 + i, i) for i in range(9)]), (6, [])]
    fps = spark.createDataFrame([(i, [{"h": h, "t": t} for h, t in p]) for i, p in prints], "id long, fp array<struct<h:int,t:int>>")
    flat = lambda v: [float(x) for x in v] * 10
    features = spark.createDataFrame([(1, flat([1, 0, 0]), 1.0), (3, flat([1, 0, 0]), 1.0), (4, flat([0, 1, 0]), 1.0), (5, flat([0.6, 0.6, 0.52]), 1.0)], "id long, seq array<double>, span double")
    found = {(r.id, r.entry): (r.kind, r.place) for r in fingerprint.ledger_probe(entries, fps, features, width=3).collect()}
    assert found == {(1, 2): (fingerprint.IDENTICAL, 1), (1, 3): (fingerprint.NEAR, 3), (1, 4): (fingerprint.ADVISORY, 2)}
    assert fingerprint.ledger_probe(entries, fps).count() == 2


def test_timeline_operators(spark):
    df = spark.createDataFrame([(1, 0, 100), (1, 1, 30), (1, 2, 5), (1, 3, 80)], "g int, pos int, len int")
    laid = timeline.mix_timeline(df, "g", "len", 40, 10).orderBy("pos").collect()
    assert [(r.pos, r.overlap, r.start) for r in laid] == [(0, 0, 0), (1, 30, 70), (3, 30, 70)]
    assert timeline.greedy_order([], timeline.key_gap) == []
    titles = spark.createDataFrame([(i, "T") for i in range(10)], "i int, title string")
    shown = [r.shown for r in timeline.repeated_titles(titles, "title", ["i"]).orderBy("i").collect()]
    assert shown[0] == "T" and shown[1] == "T (II)" and shown[7] == "T (VIII)" and shown[8] == "T (9)"
    assert value(spark, timeline.clean_title(F.lit("03 - some_song"))) == "Some Song" and value(spark, timeline.clean_title(F.lit("007"))) == "Untitled"
    plan = timeline.section_plan(spark.createDataFrame([(1, 8), (2, 30), (3, 200)], "id int, bars int"), "id", "bars")
    rows = sorted((r.id, r.section, r.kind, r.start, r.length) for r in plan.collect())
    assert rows[:2] == [(1, 0, "intro", 0, 4), (1, 1, "outro", 4, 4)] and [r[2] for r in rows if r[0] == 2] == ["intro", "verse", "main", "break", "main", "outro"]
    for i, bars in ((1, 8), (2, 30), (3, 200)):
        mine = [r for r in rows if r[0] == i]
        assert all(a[3] + a[4] == b[3] for a, b in zip(mine, mine[1:])) and mine[-1][3] + mine[-1][4] >= bars


def test_programmes(spark):
    one = spark.createDataFrame([(1, 0, 100), (1, 1, 30), (1, 2, 5), (1, 3, 80), (2, 0, 3)], "g int, pos long, len long")
    once = sorted(tuple(r) for r in timeline.mix_programme(one, "g", 40, 10, 10).collect())
    assert once == [(1, 0, 0, 0, 0, 100, 0), (1, 1, 1, 0, 70, 30, 30), (1, 2, 3, 0, 100, 80, 0)]
    laid = [r for r in timeline.mix_programme(one, "g", 40, 10, 10, 500).orderBy("segment").collect()]
    assert {r.g for r in laid} == {1} and max(r.turn for r in laid) > 0 and laid[-1].start + laid[-1].frames >= 500
    song = spark.createDataFrame([(1, 0, 60.0, 80.0, 0.0), (1, 1, 2.0, 80.0, 0.0)], "g int, pos long, seconds double, bpm double, downbeat double")
    found = timeline.song_programme(song, "g", 10, 80.0, 4, 3000).collect()
    assert {r.pos for r in found} == {0} and len({r.frames for r in found}) >= 1 and max(r.start + r.frames for r in found) >= 3000


def test_lead_stays_in_the_scale(spark):
    """Every melody note is of the chord or the scale, in the register, and depends on nothing but its bar."""
    bars = spark.createDataFrame([(1, 0, b, True, 1.0, [60, 64, 67], 40, [0, 2, 4, 5, 7, 9, 11]) for b in range(64)], "k int, section int, bar int, lead boolean, intensity double, notes array<int>, bass int, tones array<int>")
    bars = bars.withColumn("chord", F.struct("notes", "bass"))
    motif = [(0, 2, 0), (3, 3, 1), (7, 2, 9), (9, 4, -9)]
    found = timeline.expand_lead(bars, "k", motif, "tones").collect()
    assert found and all(r.midi % 12 in (0, 2, 4, 5, 7, 9, 11) and 67 <= r.midi <= 88 for r in found)
    assert all(r.midi % 12 in (0, 4, 7) for r in found if r.step % 4 == 0) and {r.step for r in found} == {0.0, 3.0, 7.0, 9.0}
    again = timeline.expand_lead(bars.repartition(3).where("bar % 2 = 1"), "k", motif, "tones").collect()
    assert sorted(map(tuple, again)) == sorted(tuple(r) for r in found if r.bar % 2 == 1)


def test_catalogue_operators(spark):
    v = lambda c: value(spark, c)
    assert v(catalogue.voice(F.lit([40, 41, 64, 90]))) == [52, 64, 66] and v(catalogue.voice(F.lit([64, 65]))) == [64, 65]
    assert v(catalogue.voice(F.lit([60, 64, 67, 71]))) == [48, 64, 67, 71] and v(catalogue.voice(F.lit([60, 64, 67, 71]), spread=False)) == [60, 64, 67, 71]
    assert v(catalogue.filter_or_all(F.lit([1, 3]), lambda x: x > 5)) == [1, 3]
    assert v(catalogue.pick(F.lit(["a", "b"]), F.lit(0.99))) == "b" and v(catalogue.tempo_in(F.lit(170), F.lit(190), F.lit(0.9), F.lit(5))) == 180
    ready = v(catalogue.readiness(F.lit(-14.0), F.lit(-2.0), F.lit(3), F.lit("0:00 a"), F.lit(False)))
    assert (ready.problems, ready.notes) == ([], [])


def test_graphs(spark):
    texts = ['{"a":{"class_type":"K","_meta":{"title":"b"},"inputs":{"s":1,"t":["zz",0],"text":"x"}},"b":{"class_type":"b","inputs":{}}}', None, "{}", "[1]", '{"10":{"class_type":"X"},"9":{"class_type":"X"}}']
    g = spark.createDataFrame(list(enumerate(texts)), "g int, j string").select("g", catalogue.graph(F.col("j")).alias("n"))
    n = F.col("n")
    at = lambda c: {r.g: r.v for r in g.select("g", c.alias("v")).collect()}
    assert at(F.transform(n, lambda x: x.node)) == {0: ["a", "b"], 1: [], 2: [], 3: [], 4: ["9", "10"]}
    assert at(catalogue.selected(n, F.lit("b")))[0] == ["b"] and at(catalogue.selected(n, F.lit("k")))[0] == ["a"] and at(catalogue.selected(n, F.lit("x")))[4] == ["9", "10"]
    done = at(catalogue.set_input(n, F.array(F.lit("a"), F.lit("b")), F.lit("t"), F.lit("9")))[0]
    assert done[0].inputs["t"] == '["zz",0]' and done[1].inputs == {}
    assert at(catalogue.set_input(n, F.array(F.lit("b")), F.lit("t"), F.lit("9"), create=True))[0][1].inputs == {"t": "9"}
    assert at(catalogue.set_where(n, F.lit("s"), F.lit("2"), ["K"]))[0][0].inputs["s"] == "2" and at(catalogue.set_where(n, F.lit("s"), F.lit("2"), ["Z"]))[0][0].inputs["s"] == "1"
    assert at(catalogue.set_text(n, F.lit("b"), F.lit('"y"')))[0][0].inputs["text"] == '"x"' and at(catalogue.set_text(n, F.lit("a"), F.lit('"y"')))[0][0].inputs["text"] == '"y"'
    assert [(r.node, r.src) for r in at(catalogue.dangling(n))[0]] == [("a", "zz")]
    assert at(catalogue.graph_json(n))[0] == '{"a":{"class_type":"K","_meta":{"title":"b"},"inputs":{"s":1,"t":["zz",0],"text":"x"}},"b":{"class_type":"b","inputs":{}}}' and at(catalogue.graph_json(n))[1] == "{}"


def test_provenance_and_memo(spark):
    files = spark.createDataFrame([(1, "a", "top"), (2, "b", "top"), (3, "c", "none")], "path long, folder string, parent string")
    manifests = spark.createDataFrame([("a", "builtin", 2, None, None), ("b", "lofify", 0, None, None), ("top", "ace-step", 1, "r", "cover")], "folder string, engine string, tracks int, reference string, ref_mode string")
    found = {r.path: (r.engine, r.source, r.problem) for r in catalogue.provenance(files, manifests).collect()}
    assert found == {1: ("builtin", "built-in", None), 2: ("ace-step", "cover", "cover"), 3: ("unknown", "unknown", None)}
    asked = spark.createDataFrame([(1, i, k) for i, k in enumerate([1, 2, 1, 3, 1, 4, 1])], "g int, o int, k int").repartition(3)
    assert [r.hit for r in catalogue.fifo(asked, "g", ["o"], "k", 2).orderBy("place").collect()] == [False, False, True, False, False, False, True]


def test_long_series_are_cut_into_chunks(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=300)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(z)] + [(2, 0, 1.0)], "k int, frame long, z double")
    want = np.correlate(z, z, "full")[299:] / (z * z).sum()
    for chunk in (1024, 37):
        got = {r.lag: r.ac for r in signal.autocorrelation(df, "k", (1, 60), chunk).where("k = 1").collect()}
        assert np.allclose([got[i] for i in range(1, 61)], want[1:61])
        medians = signal.moving_median(df.withColumnRenamed("frame", "n"), "k", "z", 8, chunk).where("k = 1").orderBy("n").collect()
        padded = np.pad(z, 8, mode="edge")
        assert np.allclose([r.median for r in medians], np.median(np.lib.stride_tricks.sliding_window_view(padded, 17), axis=1))
    assert signal.autocorrelation(df.where("k = 2"), "k", (1, 60)).count() == 0

"""Signal queries: a user's event values in time order stand in for samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.functions import kernels, scalar, stateful
from tempograph.operators import ordered, signal, tracks
from tempograph.session import table

#: Key profiles of the tonal hierarchy, and band centres in Hz.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
BANDS = [1000.0 * 1.5**i for i in range(14)]
#: A one-pole and a low-pass second-order section.
POLE = 1 / 3
B, A = (0.2, 0.4, 0.2), (-0.6, 0.3)
#: The rate that tracks claim to have.
RATE = 48000
_SIGNAL = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, (value - 50) / 50 AS x FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, n, x): values of a user's events, centred, in order of time."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", ((F.col("value") - 50) / 50).alias("x"))
    return ordered.numbered(events, "user_id", ["ts", "event_id"], F.to_date("ts")).select("user_id", "n", "x")


def hop_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = ordered.frame_sums(samples(spark, sf_dir), "user_id", 8, 2, drop_last=True)
    return frames.select("user_id", "frame", F.round(F.col("total") / F.col("count"), 6).alias("mean"), F.round("top", 6).alias("top"))


def silence_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.silence_trim(samples(spark, sf_dir), "user_id", 4, 2, -1.0)


def gated_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal.gated_mean(samples(spark, sf_dir), "user_id", 8, absolute=-4.0, relative=2.0)
    return found.select("user_id", "blocks", F.round("loudness", 4).alias("loudness"))


def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal.meter(samples(spark, sf_dir), "user_id")
    return found.select("user_id", "frames", F.round("peak", 6).alias("peak"), F.round("sum_sq", 4).alias("sum_sq"), F.round("rms_db", 4).alias("rms_db"))


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of each event type in every hour: (event_type, frame, e)."""
    events = table(spark, sf_dir, "events").select("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h"), (F.col("value") / 100).alias("v"))
    energy = events.groupBy("event_type", "h").agg(F.sum(F.col("v") * F.col("v")).alias("e"))
    span = events.groupBy("event_type").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    grid = span.select("event_type", "lo", F.explode(F.sequence("lo", "hi")).alias("h"))
    return grid.join(energy, ["event_type", "h"], "left").select("event_type", (F.col("h") - F.col("lo")).alias("frame"), F.coalesce("e", F.lit(0.0)).alias("e"))


def onset_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.onset_strength(_hourly(spark, sf_dir), "event_type").select("event_type", "frame", F.round("z", 4).alias("z"))


def autocorr_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    ac = signal.autocorrelation(signal.onset_strength(_hourly(spark, sf_dir), "event_type"), "event_type", (1, 120))
    return signal.tempo(ac, "event_type", 0.05, 40, 400).select("event_type", "lag", "bpm", F.round("score", 4).alias("score"))


def beat_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal.beat_phase(signal.onset_strength(_hourly(spark, sf_dir), "event_type"), "event_type", 24.5)
    return found.select("event_type", "phase", F.round("total", 4).alias("total"))


def profile_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.pmod(F.hour("ts"), F.lit(12)).cast("int").alias("pc"), "value")
    weight = events.groupBy("user_id", "pc").agg(F.sum("value").alias("w"))
    every = events.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pc"))
    chroma = every.join(weight, ["user_id", "pc"], "left").fillna(0.0, ["w"])
    return signal.profile_match(chroma, "user_id", [("Major", MAJOR), ("Minor", MINOR)])


def band_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    found = signal.band_profile(items, "l_returnflag", "l_extendedprice", F.col("l_quantity"), BANDS)
    return found.select("l_returnflag", "band", F.round("db", 4).alias("db"))


def hpss_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.moving_median(samples(spark, sf_dir), "user_id", "x").select("user_id", "n", F.round("median", 6).alias("median"))


def fade_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's signal cut into chunks of 16, faded at both ends and laid 12 apart."""
    i = F.pmod("n", F.lit(16))
    gain = F.when(i < 4, scalar.raised_cosine(i, 4)).when(i >= 12, scalar.equal_power(i - 12, 4, fade_in=False)).otherwise(1.0)
    chunks = ordered.chunked(samples(spark, sf_dir).select("user_id", "n", (F.col("x") * gain).alias("v")), "user_id", 16)
    laid = chunks.select("user_id", (F.col("chunk") * 12).alias("start"), F.transform("rows", lambda r: r.v).alias("values"))
    return signal.overlap_add(laid, "user_id", "start", "values").select("user_id", "n", F.round("x", 6).alias("x"))


def bit_crush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by their discount, quantised to 4 bits: how many share a level and what they sum to."""
    q = scalar.quantise(F.col("l_discount") * 3 - 0.1, 4)
    return table(spark, sf_dir, "lineitem").groupBy(F.round(q, 6).alias("level")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def saturate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = samples(spark, sf_dir)
    y = x.select("user_id", scalar.tape_saturate(F.col("x")).alias("t"), scalar.soft_clip(F.col("x"), 2.0).alias("s"), scalar.compressor_gain_db(scalar.gain_to_db(F.abs("x"))).alias("g"))
    return y.groupBy("user_id").agg(F.round(F.avg("t"), 6).alias("tape"), F.round(F.avg("s"), 6).alias("soft"), F.round(F.min("g"), 4).alias("most_reduction"))


def tone_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as tracks: the profile of their orders' prices moved towards that of the first four nations."""
    o, c = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    prices = o.join(c, o.o_custkey == c.c_custkey).select("c_nationkey", "o_totalprice")
    profile = signal.band_profile(prices, "c_nationkey", "o_totalprice", F.lit(1.0), BANDS).withColumn("pos", F.col("c_nationkey"))
    return signal.tone_delta(profile, "c_nationkey", "pos").select("c_nationkey", "band", F.round("delta", 4).alias("delta"))


def biquad_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample after a one-pole filter and after a second-order section."""
    x = samples(spark, sf_dir)
    pole = ordered.streamed(x, "user_id", lambda: stateful.Section((POLE, 0.0, 0.0), (1.0, POLE - 1, 0.0)), "pole")
    y = ordered.streamed(x, "user_id", lambda: stateful.Section(B, (1.0, *A)), "y")
    return pole.join(y, ["user_id", "n"]).select("user_id", "n", F.round("pole", 6).alias("pole"), F.round("y", 6).alias("y"))


def limiter_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample under a limiter that looks three samples ahead."""
    found = ordered.streamed(samples(spark, sf_dir), "user_id", lambda: stateful.Limiter(0.9, 0.8, look=3, decimate=2))
    return found.select("user_id", "n", F.round("y", 6).alias("y"))


def compress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample after a compressor whose envelope is held over four samples."""
    start = lambda: stateful.Compressor(threshold=-18.0, ratio=3.0, knee=6.0, attack=0.5, release=0.9, decimate=4)
    return ordered.streamed(samples(spark, sf_dir), "user_id", start).select("user_id", "n", F.round("y", 6).alias("y"))


def duck_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample ducked by its own signal."""
    start = lambda: stateful.Ducker(depth=0.5, attack=0.5, release=0.9, decimate=4)
    return ordered.streamed(samples(spark, sf_dir), "user_id", start).select("user_id", "n", F.round("y", 6).alias("y"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' signals as the blocks of tracks."""
    cut = ordered.chunked(samples(spark, sf_dir), "user_id", 50)
    return cut.select(F.col("user_id").cast("string").alias("track"), F.col("chunk").alias("block_no"), F.lit(RATE).alias("sr"), F.transform("rows", lambda r: r.x).alias("x"))


def track_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.loudness(_blocks(spark, sf_dir), 8).select("track", F.round("lufs", 4).alias("lufs"), F.coalesce("error", F.lit("")).alias("error"))


def true_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.true_peak(_blocks(spark, sf_dir)).select("track", F.round("true_peak_db", 4).alias("true_peak_db"), "error")


def wsola(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks played a tenth faster at the same pitch."""
    return tracks.stretched(_blocks(spark, sf_dir), 1.1, 16, 4)


class _Refusing:
    """A measurement that some tracks break: those whose first sample is below 0."""

    def __init__(self, _: int):
        self.n, self.first = 0, None

    def push(self, x) -> None:
        self.first = x[0] if self.first is None else self.first
        if self.first < 0:
            raise ValueError("starts below zero")
        self.n += len(x)

    def end(self) -> list[tuple]:
        return [(self.n,)]


def track_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures become rows, and the other tracks go on."""
    found = tracks.per_block(_blocks(spark, sf_dir), "frames long", _Refusing)
    return found.select("track", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("error", F.lit("")).alias("error"))


_FRAMES = f"""SELECT user_id, frame, n, x FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS len FROM {_SIGNAL} s) s,
  LATERAL (SELECT unnest(range(CAST(greatest(ceil((n - {{win}} + 1) / {{hop}}.0), 0) AS BIGINT), CAST(least(n // {{hop}}, (len - {{win}}) // {{hop}} - {{less}}) AS BIGINT) + 1)) AS frame)"""
_HOURLY = """h AS (SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT // 3600 AS h, value / 100 AS v FROM events),
e AS (SELECT event_type, h, sum(v * v) AS e FROM h GROUP BY ALL),
f AS (SELECT g.event_type, g.h - g.lo AS frame, coalesce(e.e, 0.0) AS e
      FROM (SELECT event_type, lo, unnest(range(lo, hi + 1)) AS h FROM (SELECT event_type, min(h) AS lo, max(h) AS hi FROM h GROUP BY 1)) g LEFT JOIN e USING (event_type, h)),
r AS (SELECT * FROM (SELECT event_type, frame, greatest(ln(1 + 8 * e) - lag(ln(1 + 8 * e)) OVER (PARTITION BY event_type ORDER BY frame), 0.0) AS rise,
             row_number() OVER (PARTITION BY event_type ORDER BY frame) AS k FROM f) WHERE k > 1),
o AS (SELECT event_type, frame, (rise - avg(rise) OVER w) / nullif(stddev_pop(rise) OVER w, 0) AS z FROM r WINDOW w AS (PARTITION BY event_type))"""
_FOLLOW = f"""s AS ({_SIGNAL[1:-1]}),
c AS (SELECT user_id, n // 4 AS i, max(abs(x)) AS v FROM s GROUP BY ALL),
f AS (SELECT user_id, i, CASE WHEN v > 0 THEN 0.5 * v ELSE 0.1 * v END AS e, greatest(CASE WHEN v > 0 THEN 0.5 * v ELSE 0.1 * v END, 1e-6) AS top FROM c WHERE i = 0
      UNION ALL SELECT user_id, i, e, greatest(top * 0.999, e, 1e-6) FROM (SELECT f.user_id, f.i + 1 AS i, CASE WHEN v > e THEN 0.5 * e + 0.5 * v ELSE 0.9 * e + (1 - 0.9) * v END AS e, top FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1))"""
_P12 = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(MAJOR, MINOR)))

SQL = {
    "hop_frames": f"SELECT user_id, frame, round(avg(x), 6) AS mean, round(max(x), 6) AS top FROM ({_FRAMES.format(win=8, hop=2, less=1)}) GROUP BY user_id, frame",
    "silence_trim": f"""WITH f AS (SELECT user_id, n // 4 AS frame, count(*) AS c, avg(x * x) AS ms FROM {_SIGNAL} GROUP BY ALL),
g AS (SELECT user_id, sum(c)::BIGINT AS len, min(CASE WHEN c = 4 AND 10 * log10(ms + 1e-12) > -1 THEN frame END) AS lo, max(CASE WHEN c = 4 AND 10 * log10(ms + 1e-12) > -1 THEN frame END) AS hi FROM f GROUP BY 1)
SELECT user_id, len, CASE WHEN len < 4 OR lo IS NULL THEN 0 ELSE greatest(lo * 4 - 2, 0) END AS start, CASE WHEN len < 4 THEN len WHEN lo IS NULL THEN 0 ELSE least((hi + 1) * 4 + 2, len) END AS stop FROM g""",
    "gated_mean": f"""WITH b AS (SELECT user_id, frame, avg(x * x) AS z FROM ({_FRAMES.format(win=8, hop=2, less=0)}) GROUP BY ALL),
l AS (SELECT *, -0.691 + 10 * log10(greatest(z, 1e-20)) AS l FROM b), m AS (SELECT user_id, avg(z) FILTER (l > -4) AS m FROM l GROUP BY 1),
g AS (SELECT user_id, m, count(*) AS blocks, avg(z) FILTER (l > -4 AND l > -0.691 + 10 * log10(greatest(m, 1e-20)) - 2) AS g FROM l JOIN m USING (user_id) GROUP BY ALL)
SELECT user_id, blocks, CASE WHEN coalesce(g, m) IS NULL THEN -CAST('inf' AS DOUBLE) ELSE round(-0.691 + 10 * log10(greatest(coalesce(g, m), 1e-20)), 4) END AS loudness FROM g""",
    "meter": f"SELECT user_id, count(*) AS frames, round(max(abs(x)), 6) AS peak, round(sum(x * x), 4) AS sum_sq, round(20 * log10(sqrt(sum(x * x) / count(*)) + 1e-12), 4) AS rms_db FROM {_SIGNAL} GROUP BY 1",
    "onset_z": f"WITH {_HOURLY} SELECT event_type, frame, round(z, 4) AS z FROM o",
    "autocorr_tempo": f"""WITH {_HOURLY}, p AS (SELECT event_type, sum(z * z) AS p FROM o GROUP BY 1), k AS (SELECT unnest(range(1, 121)) AS lag),
ac AS (SELECT a.event_type, lag, sum(a.z * b.z) / any_value(p) AS ac FROM o a CROSS JOIN k JOIN o b ON a.event_type = b.event_type AND b.frame = a.frame + lag JOIN p ON p.event_type = a.event_type GROUP BY 1, 2),
c AS (SELECT a.event_type, a.lag AS base, avg(b.ac / m) AS m FROM ac a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m) JOIN ac b ON a.event_type = b.event_type AND b.lag = a.lag * m GROUP BY 1, 2),
s AS (SELECT event_type, base, 60.0 / (base * 0.05) AS bpm, round(m * exp(-0.5 * pow(log2(60.0 / (base * 0.05) / 85.0) / 0.75, 2)), 9) AS score FROM c WHERE 60.0 / (base * 0.05) BETWEEN 40 AND 400),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, base DESC) AS rn FROM s) WHERE rn = 1),
v AS (SELECT event_type, place, bpm * g AS bpm FROM b CROSS JOIN (VALUES (1, 0.5::DOUBLE), (2, 2 / 3.0::DOUBLE), (3, 0.75::DOUBLE), (4, 1.5::DOUBLE), (5, 2.0::DOUBLE), (6, 3.0::DOUBLE)) w(place, g) WHERE bpm * g BETWEEN 40 AND 400),
u AS (SELECT event_type, 0 AS place, base, bpm, score FROM b UNION ALL
      SELECT v.event_type, place, base, bpm, round(m * exp(-0.5 * pow(log2(bpm / 85.0) / 0.75, 2)), 9) FROM v JOIN c ON c.event_type = v.event_type AND c.base = round_even(60.0 / bpm / 0.05, 0))
SELECT event_type, base::INT AS lag, round(bpm, 2) AS bpm, round(greatest(least(score, 1), 0), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, place) AS rn FROM u) WHERE rn = 1""",
    "beat_phase": f"""WITH {_HOURLY}, n AS (SELECT event_type, max(frame) + 1 AS len FROM o GROUP BY 1),
g AS (SELECT event_type, len, phase, unnest(range(0, CAST(floor(len / 24.5) AS BIGINT) + 1)) AS i FROM n CROSS JOIN (SELECT unnest(range(64)) AS phase)),
t AS (SELECT g.event_type, phase, round(sum(z), 9) AS total FROM g JOIN o ON o.event_type = g.event_type AND o.frame = CAST(floor(phase * (24.5 / 64) + i * 24.5) AS BIGINT) GROUP BY ALL)
SELECT event_type, phase, round(total, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY total DESC, phase) AS rn FROM t) WHERE rn = 1""",
    "profile_corr": f"""WITH w AS (SELECT user_id, (hour(ts) % 12) AS pc, sum(value) AS w FROM events GROUP BY ALL),
c AS (SELECT u.user_id, pc.pc, coalesce(w.w, 0) AS w FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(12)) AS pc) pc LEFT JOIN w ON w.user_id = u.user_id AND w.pc = pc.pc),
p AS (SELECT * FROM (VALUES {_P12}) v(i, major, minor)), roots AS (SELECT unnest(range(12)) AS root),
f AS (SELECT user_id, root, mode, round(corr(w, CASE mode WHEN 'Major' THEN major ELSE minor END), 9) AS r, 2 * root + CASE mode WHEN 'Major' THEN 0 ELSE 1 END AS pos
      FROM c CROSS JOIN roots CROSS JOIN (SELECT unnest(['Major', 'Minor']) AS mode) JOIN p ON p.i = ((pc - root) % 12 + 12) % 12 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, pos) AS rn FROM f)
SELECT a.user_id, a.root::INT AS root, a.mode, round(a.r, 4) AS r, round(a.r - greatest(b.r, 0), 3) AS confidence FROM k a JOIN k b ON a.user_id = b.user_id AND a.rn = 1 AND b.rn = 2""",
    "band_profile": f"""WITH d AS (SELECT i AS band, c / 1.26 AS low, c * 1.26 AS high FROM (VALUES {", ".join(f"({i}, {c!r})" for i, c in enumerate(BANDS))}) v(i, c)),
p AS (SELECT l_returnflag, band, sum(l_quantity) AS p FROM lineitem JOIN d ON l_extendedprice >= low AND l_extendedprice < high GROUP BY ALL)
SELECT k.l_returnflag, d.band, coalesce(round(10 * log10(p + 1e-20), 4), -200.0) AS db FROM (SELECT DISTINCT l_returnflag FROM lineitem) k CROSS JOIN d LEFT JOIN p ON p.l_returnflag = k.l_returnflag AND p.band = d.band""",
    "hpss_median": f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS len FROM {_SIGNAL} t), o AS (SELECT unnest(range(-8, 9)) AS d)
SELECT a.user_id, a.n, round(median(b.x), 6) AS median FROM s a CROSS JOIN o JOIN s b ON b.user_id = a.user_id AND b.n = least(greatest(a.n + d, 0), a.len - 1) GROUP BY 1, 2""",
    "fade_mix": f"""SELECT user_id, n // 16 * 12 + n % 16 AS n, round(sum(x * CASE WHEN n % 16 < 4 THEN 0.5 - 0.5 * cos(pi() * (n % 16) / 3) WHEN n % 16 >= 12 THEN cos(pi() / 2 * (n % 16 - 12) / 3) ELSE 1 END), 6) AS x
FROM {_SIGNAL} GROUP BY user_id, n // 16 * 12 + n % 16""",
    "bit_crush": "SELECT round(round_even((l_discount * 3 - 0.1) * 8, 0) / 8, 6) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1",
    "saturate_levels": f"""SELECT user_id, round(avg(tanh(1.4 * (x + 0.06 * x * x)) / {math.tanh(1.4)!r}), 6) AS tape, round(avg(tanh(2 * x) / {math.tanh(2.0)!r}), 6) AS soft,
round(min(CASE WHEN 2 * o < -6 THEN 0 WHEN 2 * abs(o) <= 6 THEN (1 / 3.0 - 1) * pow(o + 3, 2) / 12 ELSE (1 / 3.0 - 1) * o END), 4) AS most_reduction
FROM (SELECT *, 20 * log10(greatest(abs(x), 1e-12)) + 18 AS o FROM {_SIGNAL}) GROUP BY 1""",
    "tone_delta": f"""WITH d AS (SELECT i AS band, c / 1.26 AS low, c * 1.26 AS high FROM (VALUES {", ".join(f"({i}, {c!r})" for i, c in enumerate(BANDS))}) v(i, c)),
q AS (SELECT c_nationkey, o_totalprice AS x FROM orders JOIN customer ON o_custkey = c_custkey), k AS (SELECT DISTINCT c_nationkey FROM q),
p AS (SELECT c_nationkey, band, count(*) AS p FROM q JOIN d ON x >= low AND x < high GROUP BY ALL),
b AS (SELECT k.c_nationkey, d.band, coalesce(10 * log10(p + 1e-20), -200.0) AS db FROM k CROSS JOIN d LEFT JOIN p ON p.c_nationkey = k.c_nationkey AND p.band = d.band),
t AS (SELECT band, avg(db) AS target FROM b WHERE c_nationkey IN (SELECT c_nationkey FROM k ORDER BY 1 LIMIT 4) GROUP BY 1),
m AS (SELECT c_nationkey, band, greatest(least((target - db) * 0.7, 6), -6) AS d FROM b JOIN t USING (band))
SELECT c_nationkey, band, round(d - avg(d) OVER (PARTITION BY c_nationkey), 4) AS delta FROM m""",
    "biquad_fold": f"""WITH RECURSIVE s AS ({_SIGNAL[1:-1]}),
f AS (SELECT user_id, 0::BIGINT AS n, {POLE} * x AS p, {B[0]} * x AS y, {B[1]} * x - ({A[0]}) * ({B[0]} * x) AS z1, {B[2]} * x - ({A[1]}) * ({B[0]} * x) AS z2 FROM s WHERE n = 0
      UNION ALL
      SELECT f.user_id, f.n + 1, {1 - POLE} * p + {POLE} * x, {B[0]} * x + z1, {B[1]} * x - ({A[0]}) * ({B[0]} * x + z1) + z2, {B[2]} * x - ({A[1]}) * ({B[0]} * x + z1) FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
SELECT user_id, n, round(p, 6) AS pole, round(y, 6) AS y FROM f""",
    "limiter_fold": f"""WITH RECURSIVE s AS (SELECT user_id, n, x, greatest(abs(x), coalesce(abs(lead(x, 3) OVER (PARTITION BY user_id ORDER BY n)), 0)) AS k FROM {_SIGNAL}),
c AS (SELECT user_id, n // 2 AS i, least(1.0, 0.9 / greatest(max(k), 1e-9)) AS t FROM s GROUP BY ALL),
f AS (SELECT user_id, i, CAST(CASE WHEN t < 1 THEN t ELSE 1 * 0.8 + t * 0.2 END AS DOUBLE) AS g FROM c WHERE i = 0
      UNION ALL SELECT f.user_id, f.i + 1, CASE WHEN t < g THEN t ELSE g * 0.8 + t * 0.2 END FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1)
SELECT s.user_id, n, round(greatest(least(x * g, 0.9), -0.9), 6) AS y FROM s JOIN f ON f.user_id = s.user_id AND i = n // 2""",
    "compress_fold": f"""WITH RECURSIVE {_FOLLOW}
SELECT s.user_id, n, round(x * pow(10, -(CASE WHEN o >= 3 THEN o * (1 - 1 / 3.0) WHEN o > -3 THEN (1 - 1 / 3.0) * pow(o + 3, 2) / 12 ELSE 0 END) / 20), 6) AS y
FROM (SELECT *, 20 * log10(greatest(e, 1e-9)) + 18 AS o FROM f) f JOIN s ON f.user_id = s.user_id AND i = n // 4""",
    "duck_fold": f"""WITH RECURSIVE {_FOLLOW}
SELECT s.user_id, n, round(x * (1 - 0.5 * greatest(least(e / top, 1), 0)), 6) AS y FROM f JOIN s ON f.user_id = s.user_id AND i = n // 4""",
}
(_B1, _A1), (_B2, _A2) = ((tuple(map(float, b)), tuple(map(float, a))) for b, a in kernels.k_weight(RATE))
SQL |= {
    "track_loudness": f"""WITH RECURSIVE s AS ({_SIGNAL[1:-1]}),
f AS (SELECT user_id, n, u, {_B1[1]} * x - ({_A1[1]}) * u + p2 AS p1, {_B1[2]} * x - ({_A1[2]}) * u AS p2, {_B2[0]} * u + q1 AS y, {_B2[1]} * u - ({_A2[1]}) * ({_B2[0]} * u + q1) + q2 AS q1, {_B2[2]} * u - ({_A2[2]}) * ({_B2[0]} * u + q1) AS q2
        FROM (SELECT user_id, n, x, {_B1[0]} * x AS u, 0::DOUBLE AS p2, 0::DOUBLE AS q1, 0::DOUBLE AS q2 FROM s WHERE n = 0)
      UNION ALL
      SELECT user_id, n, u, {_B1[1]} * x - ({_A1[1]}) * u + p2, {_B1[2]} * x - ({_A1[2]}) * u, {_B2[0]} * u + q1, {_B2[1]} * u - ({_A2[1]}) * ({_B2[0]} * u + q1) + q2, {_B2[2]} * u - ({_A2[2]}) * ({_B2[0]} * u + q1)
        FROM (SELECT s.user_id, s.n, s.x, {_B1[0]} * s.x + p1 AS u, p2, q1, q2 FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)),
t AS (SELECT user_id, n, y, count(*) OVER (PARTITION BY user_id) AS len FROM f),
b AS (SELECT user_id, frame, avg(y * y) AS z FROM (SELECT user_id, y, unnest(range(CAST(greatest(ceil((n - 7) / 2.0), 0) AS BIGINT), CAST(least(n // 2, (len - 8) // 2) AS BIGINT) + 1)) AS frame FROM t WHERE len >= 8) GROUP BY ALL),
l AS (SELECT *, -0.691 + 10 * log10(greatest(z, 1e-20)) AS l FROM b), m AS (SELECT user_id, avg(z) FILTER (l > -70) AS m FROM l GROUP BY 1),
g AS (SELECT user_id, m, avg(z) FILTER (l > -70 AND l > -0.691 + 10 * log10(greatest(m, 1e-20)) - 10) AS g FROM l JOIN m USING (user_id) GROUP BY ALL)
SELECT u.user_id::VARCHAR AS track, CASE WHEN coalesce(g, m) IS NULL THEN -CAST('inf' AS DOUBLE) ELSE round(-0.691 + 10 * log10(greatest(coalesce(g, m), 1e-20)), 4) END AS lufs, '' AS error
FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN g USING (user_id)""",
    "track_status": f"""SELECT user_id::VARCHAR AS track, CASE WHEN arg_min(x, n) >= 0 THEN count(*) ELSE 0 END AS frames, CASE WHEN arg_min(x, n) < 0 THEN 'ValueError: starts below zero' ELSE '' END AS error FROM {_SIGNAL} GROUP BY user_id""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "true_peak", "wsola"]}

"""Framed analytics over numbered signals (key, n, x)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.operators.ordered import chunked, frame_sums


def meter(signal: DataFrame, key: str) -> DataFrame:
    """Peak, mean square and RMS in dB of each key, in one partial aggregation."""
    square = F.sum(F.col("x") * F.col("x"))
    return signal.groupBy(key).agg(
        F.count("*").alias("frames"), F.max(F.abs("x")).alias("peak"), square.alias("sum_sq"), (20 * F.log10(F.sqrt(square / F.count("*")) + 1e-12)).alias("rms_db")
    )


def silence_trim(signal: DataFrame, key: str, win: int, pad: int, threshold_db: float) -> DataFrame:
    """First and last sample kept: from the first loud frame less pad to the end of the last one and pad.

    Frames do not overlap; a frame is loud above threshold_db. No loud frame
    keeps nothing (start = stop = 0); less than one frame keeps everything.
    """
    frames = signal.groupBy(key, F.floor(F.col("n") / win).alias("frame")).agg(F.count("*").alias("c"), F.avg(F.col("x") * F.col("x")).alias("ms"))
    loud = (F.col("c") == win) & (10 * F.log10(F.col("ms") + 1e-12) > threshold_db)
    ends = frames.groupBy(key).agg(F.sum("c").alias("len"), F.min(F.when(loud, F.col("frame"))).alias("lo"), F.max(F.when(loud, F.col("frame"))).alias("hi"))
    start = F.when(F.col("len") < win, 0).when(F.col("lo").isNull(), 0).otherwise(F.greatest(F.col("lo") * win - pad, F.lit(0)))
    stop = F.when(F.col("len") < win, F.col("len")).when(F.col("lo").isNull(), 0).otherwise(F.least((F.col("hi") + 1) * win + pad, F.col("len")))
    return ends.select(key, "len", start.alias("start"), stop.alias("stop"))


def gated_mean(signal: DataFrame, key: str, win: int, absolute: float = -70.0, relative: float = 10.0) -> DataFrame:
    """Loudness gated twice: blocks above `absolute`, then those above the mean of these less `relative`.

    Blocks overlap by three quarters. Nothing above the gate gives -infinity;
    nothing above the relative gate falls back to the first gate.
    """
    blocks = frame_sums(signal, key, win, max(1, win // 4)).select(key, "frame", (F.col("square") / F.col("count")).alias("z"))
    loud = lambda z: -0.691 + 10 * F.log10(F.greatest(z, F.lit(1e-20)))
    blocks = blocks.withColumn("l", loud(F.col("z")))
    first = blocks.groupBy(key).agg(F.avg(F.when(F.col("l") > absolute, F.col("z"))).alias("m"))
    both = blocks.join(first, key)
    second = both.groupBy(key, "m").agg(F.count("*").alias("blocks"), F.avg(F.when((F.col("l") > absolute) & (F.col("l") > loud(F.col("m")) - relative), F.col("z"))).alias("g"))
    mean = F.coalesce("g", "m")
    return second.select(key, "blocks", F.when(mean.isNull(), F.lit(-math.inf)).otherwise(loud(mean)).alias("loudness"))


def onset_strength(frames: DataFrame, key: str) -> DataFrame:
    """From frame energies (key, frame, e): rise of log energy, less its mean, over its population deviation."""
    change = F.log1p(8 * F.col("e")) - F.lag(F.log1p(8 * F.col("e"))).over(W.partitionBy(key).orderBy("frame"))
    rises = frames.withColumn("rise", change).where("rise is not null").withColumn("rise", F.greatest("rise", F.lit(0.0)))
    stats = rises.groupBy(key).agg(F.avg("rise").alias("mu"), F.stddev_pop("rise").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("rise") - F.col("mu")) / F.col("sd")).otherwise(F.col("rise") - F.col("mu"))
    return rises.join(stats, key).select(key, "frame", z.alias("z"))


def autocorrelation(series: DataFrame, key: str, lags: tuple[int, int], chunk: int = 1024) -> DataFrame:
    """ac(lag) / ac(0) of a series (key, frame, z) without gaps, for lags up to its length.

    Chunks of the series with the frames behind them are one row each; their
    lag products are summed, so no series is in one task and none is joined
    with itself.
    """
    numbered = series.select(key, F.col("frame").alias("n"), "z")
    parts = chunked(numbered, key, chunk, after=lags[1])
    own = F.filter("rows", lambda r: F.floor(r.n / chunk) == F.col("chunk"))
    parts = parts.select(key, F.transform(own, lambda r: r.z).alias("a"), F.transform("rows", lambda r: r.z).alias("b"))
    # a chunk without frames of its own has no products
    parts = parts.where("size(a) > 0")
    product = lambda lag: F.aggregate(F.zip_with("a", F.slice("b", lag + 1, F.size("a")), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    sums = parts.select(key, F.size("a").alias("c"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(lags[1])), product)).alias("lag", "s"))
    total = sums.groupBy(key, "lag").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    power = total.where("lag = 0 and s > 0").select(key, F.col("s").alias("p"))
    return total.where(F.col("lag").between(*lags) & (F.col("lag") < F.col("c"))).join(power, key).select(key, "lag", (F.col("s") / F.col("p")).alias("ac"))


#: Metrical relatives that a tempo is mistaken for.
RELATIVES = [1 / 2, 2 / 3, 3 / 4, 3 / 2, 2.0, 3.0]


def tempo(ac: DataFrame, key: str, frame_s: float, low: float, high: float, prior: float = 85.0, octaves: float = 0.75) -> DataFrame:
    """(key, lag, bpm, score): the best period and its metrical relatives tested again.

    A period's score is the mean over k = 1..4 of ac(k*lag)/k under a
    log-normal prior; the longer lag wins ties. A relative of the best tempo
    takes its place if its score is higher. `score` within 0 and 1 is the
    confidence. A key without a candidate gets 80 and 0.
    """
    scored = ac.select(key, F.col("lag").alias("base"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).withColumn("lag", F.col("base") * F.col("k")).join(ac, [key, "lag"])
    comb = scored.groupBy(key, "base").agg(F.avg(F.col("ac") / F.col("k")).alias("m"))
    weight = lambda bpm: F.exp(-0.5 * F.pow(F.log2(bpm / prior) / octaves, F.lit(2.0)))
    own = 60.0 / (F.col("base") * frame_s)
    first = comb.where((own >= low) & (own <= high)).groupBy(key).agg(F.max(F.struct(F.round(F.col("m") * weight(own), 9).alias("score"), F.col("base").alias("lag"))).alias("b"))
    first = first.select(key, "b.score", "b.lag", (60.0 / (F.col("b.lag") * frame_s)).alias("bpm"))
    others = first.select(key, F.posexplode(F.array(*(F.col("bpm") * m for m in RELATIVES))).alias("place", "bpm")).where((F.col("bpm") >= low) & (F.col("bpm") <= high))
    others = others.withColumn("base", F.rint(60.0 / F.col("bpm") / frame_s).cast("int")).join(comb, [key, "base"])
    others = others.select(key, F.round(F.col("m") * weight(F.col("bpm")), 9).alias("score"), F.col("base").alias("lag"), "bpm", (-F.col("place") - 1).alias("order"))
    every = first.withColumn("order", F.lit(0)).unionByName(others)
    best = every.groupBy(key).agg(F.max(F.struct("score", "order", "lag", "bpm")).alias("b"))
    keys = ac.select(key).distinct().join(best, key, "left")
    return keys.select(key, F.col("b.lag").alias("lag"), F.round(F.coalesce("b.bpm", F.lit(80.0)), 2).alias("bpm"), F.coalesce(F.greatest(F.least("b.score", F.lit(1.0)), F.lit(0.0)), F.lit(0.0)).alias("score"))


def beat_phase(series: DataFrame, key: str, bar: float, phases: int = 64) -> DataFrame:
    """Phase of a bar of `bar` frames at which the summed strength is highest; the earliest wins ties."""
    spans = series.groupBy(key).agg((F.max("frame") + 1).alias("len"))
    grid = spans.select(key, "len", F.explode(F.sequence(F.lit(0), F.lit(phases - 1))).alias("phase"))
    start = F.col("phase") * (bar / phases)
    hits = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.col("len") / bar).cast("int")))).withColumn("frame", F.floor(start + F.col("i") * bar)).where("frame < len")
    total = hits.join(series, [key, "frame"]).groupBy(key, "phase").agg(F.round(F.sum("z"), 9).alias("total"))
    return total.groupBy(key).agg(F.max(F.struct("total", (-F.col("phase")).alias("p"))).alias("best")).select(key, (-F.col("best.p")).alias("phase"), F.col("best.total").alias("total"))


def profile_match(chroma: DataFrame, key: str, profiles: list[tuple[str, list[float]]]) -> DataFrame:
    """Key of the profile that correlates best with twelve weights (key, pc, w); the first of equals.

    Each named profile is turned through twelve roots; the order of candidates
    is root by root. Confidence is the lead over the next candidate, at least
    over 0.
    """
    rows = [(2 * root + j, root, mode, pc, float(values[(pc - root) % 12])) for root in range(12) for j, (mode, values) in enumerate(profiles) for pc in range(12)]
    dim = chroma.sparkSession.createDataFrame(rows, "pos int, root int, mode string, pc int, p double")
    fit = chroma.join(F.broadcast(dim), "pc").groupBy(key, "pos", "root", "mode").agg(F.round(F.corr("w", "p"), 9).alias("r"))
    ranked = fit.where("r is not null").withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("r"), "pos")))
    top = ranked.groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.struct("root", "mode", "r"))).alias("b"), F.max(F.when(F.col("rank") == 2, F.col("r"))).alias("next"))
    return top.select(key, F.col("b.root").alias("root"), F.col("b.mode").alias("mode"), F.round(F.col("b.r"), 4).alias("r"), F.round(F.col("b.r") - F.greatest(F.coalesce("next", F.lit(0.0)), F.lit(0.0)), 3).alias("confidence"))


def band_profile(values: DataFrame, key: str, value: str, power: Column, centres: list[float], ratio: float = 1.26) -> DataFrame:
    """dB of the power in the bands [c/ratio, c*ratio); an empty band is -200. The band dimension is broadcast."""
    dim = values.sparkSession.createDataFrame([(i, c / ratio, c * ratio) for i, c in enumerate(centres)], "band int, low double, high double")
    inside = values.join(F.broadcast(dim), (F.col(value) >= F.col("low")) & (F.col(value) < F.col("high"))).groupBy(key, "band").agg(F.sum(power).alias("p"))
    every = values.select(key).distinct().crossJoin(F.broadcast(dim.select("band")))
    return every.join(inside, [key, "band"], "left").select(key, "band", F.when(F.col("p").isNull(), -200.0).otherwise(10 * F.log10(F.col("p") + 1e-20)).alias("db"))


def tone_delta(profiles: DataFrame, key: str, order: str, strength: float = 0.7, most: float = 6.0, first: int = 4) -> DataFrame:
    """(key, band, delta): dB by which each key's bands are moved towards the mean profile of the first few keys.

    The difference is scaled, kept within +-most, and its mean over the bands
    taken away, so that balance changes and level does not. `profiles` has
    key, band, db and `order`, by which the first keys are chosen.
    """
    chosen = profiles.select(key, order).distinct().orderBy(order, key).limit(first).select(key)
    target = profiles.join(F.broadcast(chosen), key, "left_semi").groupBy("band").agg(F.avg("db").alias("target"))
    moved = profiles.join(F.broadcast(target), "band").withColumn("d", F.greatest(F.least((F.col("target") - F.col("db")) * strength, F.lit(most)), F.lit(-most)))
    level = moved.groupBy(key).agg(F.avg("d").alias("mean"))
    return moved.join(level, key).select(key, "band", (F.col("d") - F.col("mean")).alias("delta"))


def moving_median(signal: DataFrame, key: str, value: str, half: int = 8, chunk: int = 1024) -> DataFrame:
    """(key, n, value, median): median over 2*half+1 rows around each, edges repeating the outermost value.

    Worked out in chunks with `half` rows of their neighbours.
    """
    parts = chunked(signal.select(key, "n", F.col(value).alias("v")), key, chunk, before=half, after=half)

    def around(rows):
        at = lambda i: F.get(rows, F.greatest(F.least(i, F.size(rows) - 1), F.lit(0))).v
        median = lambda i: F.get(F.array_sort(F.transform(F.sequence(i - half, i + half), at)), F.lit(half))
        whole = F.transform(rows, lambda r, i: F.struct(r.n.alias("n"), r.v.alias("v"), F.when(F.floor(r.n / chunk) == F.col("chunk"), median(i)).alias("m"), (F.floor(r.n / chunk) == F.col("chunk")).alias("own")))
        return F.filter(whole, lambda r: r.own)

    return parts.select(key, F.explode(around(F.col("rows"))).alias("r")).select(key, "r.n", F.col("r.v").alias(value), F.col("r.m").alias("median"))


def overlap_add(chunks: DataFrame, key: str, start: str, values: str) -> DataFrame:
    """Sum of arrays laid from `start` on: (key, n, x)."""
    return chunks.select(key, start, F.posexplode(values).alias("i", "v")).groupBy(key, (F.col(start) + F.col("i")).alias("n")).agg(F.sum("v").alias("x"))

"""PCM files as tables: a WAV data source that reads blocks or headers only, and a sink that meters what it writes."""

from __future__ import annotations

import io
import os
import re
import uuid
import wave
from urllib.parse import quote

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempograph.functions.stateful import Resampler

#: Suffixes of sound files that a folder is searched for.
SUFFIXES = (".wav", ".flac", ".mp3", ".ogg", ".m4a", ".aac", ".aif", ".aiff")
BLOCKS = T.StructType([T.StructField(n, t) for n, t in (("track", T.StringType()), ("block_no", T.LongType()), ("start", T.LongType()), ("sr", T.IntegerType()), ("l", T.ArrayType(T.FloatType())), ("r", T.ArrayType(T.FloatType())), ("error", T.StringType()))])
HEADERS = "track string, sr int, channels int, frames long, seconds double, error string"


def decode(raw: bytes, widths: int, channels: int) -> np.ndarray:
    """Frames by two channels in -1..1 of little-endian PCM; one channel is doubled, more than two are cut."""
    if widths == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    elif widths == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    else:
        x = np.frombuffer(raw, f"<i{widths}") / float(1 << (8 * widths - 1))
    x = x[: len(x) // channels * channels].reshape(-1, channels)
    return np.repeat(x, 2, axis=1) if channels == 1 else x[:, :2]


def encode(x: np.ndarray, sr: int, widths: int = 2) -> bytes:
    """A WAV file of frames by two channels, clipped to -1..1."""
    level = float(1 << (8 * widths - 1))
    ints = np.clip(np.rint(np.clip(x, -1, 1) * level), -level, level - 1).astype(np.int64)
    raw = ints.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :widths].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(widths)
        w.setframerate(sr)
        w.writeframes(raw)
    return out.getvalue()


def _files(spark: SparkSession, path: str) -> DataFrame:
    # no column of the content, so no file is read here
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(path).select(F.col("path").alias("track"))


def _open(track: str):
    """A file of any store that Arrow knows, for reading from any place in it."""
    if track.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/+", "/", track))
    system, path = fs.FileSystem.from_uri(quote(track, safe=":/@%"))
    return system.open_input_file(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Rate, channels and length of each file from its first bytes; a broken file is a row with `error`.

    Spark does not hand out files of no bytes.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for track in pdf["track"]:
                try:
                    with _open(track) as f, wave.open(f) as w:
                        rows.append((track, w.getframerate(), w.getnchannels(), w.getnframes(), w.getnframes() / w.getframerate(), None))
                except (wave.Error, EOFError, ZeroDivisionError, OSError) as e:
                    rows.append((track, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield type(pdf)(rows, columns=["track", "sr", "channels", "frames", "seconds", "error"]).astype(object)

    return _files(spark, path).mapInPandas(run, HEADERS)


def windows(heads: DataFrame, max_seconds: float = 900.0, count: int = 4) -> DataFrame:
    """(track, sr, window, start, frames): the whole of a file of up to max_seconds, else `count` windows spread over it.

    Together the windows last max_seconds; each lies in the middle of its part
    of the file.
    """
    width = max_seconds / count
    place = lambda k: F.greatest(F.least(F.col("seconds") * (k + 0.5) / count - width / 2, F.col("seconds") - width), F.lit(0.0))
    parts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.struct(k.alias("window"), F.floor(place(k) * F.col("sr")).alias("start"), F.floor(width * F.col("sr")).alias("frames")))
    whole = F.array(F.struct(F.lit(0).alias("window"), F.lit(0).cast("long").alias("start"), F.col("frames").alias("frames")))
    return heads.where("error is null").select("track", "sr", F.explode(F.when(F.col("seconds") <= max_seconds, whole).otherwise(parts)).alias("w")).select("track", "sr", "w.*")


def _rows(track: str, x: np.ndarray, start: int, block: int, sr: int) -> tuple:
    part = x.astype(np.float32)
    return track, block, start, sr, part[:, 0].tolist(), part[:, 1].tolist(), None


def read(ranges: DataFrame, block_frames: int = 1 << 18) -> DataFrame:
    """Blocks of ranges (track, start, frames) of files, each read by a task of its own: only those bytes are fetched."""
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("frames") - 1) / block_frames), F.lit(0)))
    each = ranges.where("frames > 0").select("track", "start", "frames", F.explode(cut).alias("block"))
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for pdf in batches:
            for track, start, frames, block in pdf.itertuples(index=False):
                try:
                    with _open(track) as f, wave.open(f) as w:
                        at = start + block * block_frames
                        w.setpos(at)
                        x = decode(w.readframes(min(block_frames, frames - block * block_frames)), w.getsampwidth(), w.getnchannels())
                        row = _rows(track, x, at, block, w.getframerate())
                except (wave.Error, EOFError, ValueError, OSError) as e:
                    row = (track, None, None, None, None, None, f"{type(e).__name__}: {e}")
                yield type(pdf)([row], columns=BLOCKS.names).astype(object)

    return each.repartition(n, "track", "start", "block").mapInPandas(run, BLOCKS)


def blocks(spark: SparkSession, path: str, block_frames: int = 1 << 18, max_seconds: float | None = None, target_sr: int | None = None) -> DataFrame:
    """Blocks of every file, numbered by block_no from the start, with both channels.

    max_seconds limits what is read of a file. target_sr resamples: one task
    then walks through a file block by block and carries what the filter needs
    over their edges. A broken file is one row with `error`.
    """
    heads = headers(spark, path)
    most = F.col("frames") if max_seconds is None else F.least("frames", F.floor(F.col("sr") * max_seconds))
    broken = heads.where("error is not null").select("track", *(F.lit(None).cast(BLOCKS[c].dataType).alias(c) for c in ("block_no", "start", "sr", "l", "r")), "error")
    ranges = heads.where("error is null").select("track", "sr", F.lit(0).cast("long").alias("start"), most.alias("frames"))
    if not target_sr:
        return read(ranges, block_frames).unionByName(broken)

    def run(batches):
        for pdf in batches:
            for track, sr, _, frames in pdf.itertuples(index=False):
                made, done, block = [Resampler(int(sr), target_sr) for _ in (0, 1)], 0, 0
                try:
                    with _open(track) as f, wave.open(f) as w:
                        for at in range(0, int(frames) + 1, block_frames):
                            x = decode(w.readframes(min(block_frames, int(frames) - at)), w.getsampwidth(), w.getnchannels())
                            parts = [m.push(x[:, c]) if int(sr) != target_sr else x[:, c] for c, m in enumerate(made)]
                            if at + block_frames > frames and int(sr) != target_sr:
                                parts = [np.concatenate([p, m.flush()]) for p, m in zip(parts, made)]
                            if len(parts[0]):
                                yield type(pdf)([_rows(track, np.stack(parts, 1), done, block, target_sr)], columns=BLOCKS.names).astype(object)
                                done, block = done + len(parts[0]), block + 1
                except (wave.Error, EOFError, ValueError, OSError) as e:
                    yield type(pdf)([(track, None, None, None, None, None, f"{type(e).__name__}: {e}")], columns=BLOCKS.names).astype(object)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "track").mapInPandas(run, BLOCKS).unionByName(broken)


def mono(table: DataFrame) -> DataFrame:
    """(track, block_no, sr, x) with x the mean of both channels."""
    return table.where("error is null").select("track", "block_no", "sr", F.zip_with("l", "r", lambda a, b: (a + b) / 2).alias("x"))


def write(table: DataFrame, folder: str, widths: int = 2) -> DataFrame:
    """Writes one file for each track and gives (track, file, frames, peak, sum_sq).

    `folder` must be one that all executors share. A file appears under its
    name only when it is whole, so a task that is done again does no harm.
    """

    def run(key, pdf):
        ordered = pdf.sort_values("block_no")
        x = np.stack([np.concatenate([np.asarray(b, float) for b in ordered[c]]) for c in ("l", "r")], 1)
        x = np.clip(x, -1, 1)
        name = os.path.splitext(os.path.basename(key[0]))[0] + ".wav"
        part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        with open(part, "wb") as f:
            f.write(encode(x, int(ordered["sr"].iloc[0]), widths))
        os.replace(part, os.path.join(folder, name))
        return type(pdf)([(key[0], name, len(x), float(np.abs(x).max()) if len(x) else 0.0, float((x * x).sum()))], columns=["track", "file", "frames", "peak", "sum_sq"])

    return table.where("error is null").groupBy("track").applyInPandas(run, "track string, file string, frames long, peak double, sum_sq double")


def collect_inputs(spark: SparkSession, listing: DataFrame, playlists: DataFrame) -> DataFrame:
    """(ord, path) of inputs, each path at its first place.

    `listing` has ord, sub, path and kind (dir, file or glob): entries of
    folders and globs count by suffix, named files always. `playlists` has
    ord, sub, folder and line: quotes and blanks around a line go, blank lines
    and comments are skipped, and paths are relative to the playlist's folder.
    """
    low = F.lower("path")
    known = F.lit(False)
    for suffix in SUFFIXES:
        known = known | low.endswith(suffix)
    listed = listing.where((F.col("kind") == "file") | known).select("ord", "sub", "path")
    line = F.trim(F.regexp_replace(F.trim("line"), '^"+|"+$', ""))
    named = playlists.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    named = named.select("ord", "sub", F.when(F.col("line").startswith("/"), F.col("line")).otherwise(F.concat("folder", F.lit("/"), "line")).alias("path"))
    first = listed.unionByName(named).groupBy("path").agg(F.min(F.struct("ord", "sub")).alias("o"))
    return first.select(F.col("o.ord").alias("ord"), F.col("o.sub").alias("sub"), "path")


def inputs(spark: SparkSession, *paths: str) -> DataFrame:
    """(ord, sub, path, error): what folders, playlists (.txt), files and patterns name, each path at its first place.

    A folder gives its sound files in order of name; a playlist the lines that
    are no comment; a file itself, whatever its suffix; anything else is a
    pattern. What is not there is a row with `error`. Names are listed on the
    driver, as Spark does; no file but a playlist is read.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    listing, lost = [], []
    playlists: DataFrame | None = None
    for i, path in enumerate(paths):
        target = jvm.org.apache.hadoop.fs.Path(path)
        store = target.getFileSystem(conf)
        if not store.exists(target):
            found = [s.getPath().toUri().getPath() for s in store.globStatus(target) or () if s.isFile()]
            listing += [(i, k, p, "glob") for k, p in enumerate(sorted(found))]
            lost += [(i, 0, path, "no such file")] if not found else []
        elif store.getFileStatus(target).isDirectory():
            found = sorted(s.getPath().toUri().getPath() for s in store.listStatus(target) if s.isFile())
            listing += [(i, k, p, "dir") for k, p in enumerate(found)]
        elif path.lower().endswith(".txt"):
            lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias("sub", "line"))
            lines = lines.select(F.lit(i).alias("ord"), "sub", F.lit(os.path.dirname(os.path.abspath(path))).alias("folder"), "line")
            playlists = lines if playlists is None else playlists.unionByName(lines)
        else:
            listing.append((i, 0, target.toUri().getPath(), "file"))
    if playlists is None:
        playlists = spark.createDataFrame([], "ord int, sub int, folder string, line string")
    named = collect_inputs(spark, spark.createDataFrame(listing, "ord int, sub int, path string, kind string"), playlists)
    # only names from a playlist may be missing
    there = {}
    for r in playlists.select("ord").distinct().collect() if lost or playlists.columns else ():
        for row in named.where(F.col("ord") == r.ord).collect():
            target = jvm.org.apache.hadoop.fs.Path(row.path)
            there[row.path] = target.getFileSystem(conf).exists(target)
    gone = [p for p, ok in there.items() if not ok]
    error = F.when(F.col("path").isin(gone), "no such file") if gone else F.lit(None).cast("string")
    return named.withColumn("error", error).unionByName(spark.createDataFrame(lost, "ord int, sub int, path string, error string"))


def write_tracklist(chapters: DataFrame, order: str, line: str, folder: str) -> None:
    """One text file of the lines in order. A track list is short: one task writes it."""
    chapters.select(order, line).coalesce(1).sortWithinPartitions(order).select(F.col(line).alias("value")).write.mode("overwrite").text(folder)


def write_report(report: DataFrame, folder: str) -> None:
    """A report as JSON lines; Spark's commit makes all of it appear or none."""
    report.write.mode("overwrite").json(folder)

"""Main text of HTML pages: page structure, and suffix arrays of each host's pages for what its pages repeat."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm import store
from tempograph.llm.fmindex import suffix_array
from tempograph.llm.words import GRAM, mix, runs, split_words

#: Words of a substring that counts as repeated.
REPEAT = 8
#: Pages of one host, and bytes of their HTML, that share a suffix array; larger hosts have several.
SHARD_PAGES, SHARD_BYTES = 250, 16 << 20
#: Outside a marked main part a block goes if so large a part of its words is covered by what another page repeats.
COVERED = 0.5
#: Inside one it takes a run that so large a share of the host's distinct texts has, and at least so many of them,
SHARE, LEAST_PAGES = 0.3, 5
#: covering so large a part of the block, while so large a part of the main text is left.
COVERED_MAIN, LEFT_MAIN = 0.9, 0.2

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*+>|<[a-zA-Z/!?][^<>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements of HTML and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg object annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form button select dialog menu head datalist audio video canvas map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_TEXT, OPEN, MAIN = 0, 1, 2
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments disqus respond replies related "
    "recommended share sharing social widget widgets pagination pager skip hidden".split()
)
#: Words at the end of a name that say where or how a part is laid out; what stands before them names it.
LAYOUT = frozenset(
    "area articles bar block bottom box button buttons container content form icons inner item items left link links list main outer panel posts right row section stories "
    "thread top wrap wrapper".split()
)
REMARKS = frozenset("comment comments disqus respond replies".split())
#: Elements whose name may say that they are no part of an article.
NAMED = frozenset("div section ul ol dl table figure details span header center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article-body articlebody article-content post-content post-body entry-content story-body main-content content article post story".split())


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}


def _names(at: dict[str, str]) -> set[str]:
    return set(re.split(r"\s+", html.unescape(f"{at.get('class', '')} {at.get('id', '')}").lower().strip()))


def _part(name: str) -> str:
    """What a class or id names: its last word, those of layout and numbers aside. `share-price` names a price."""
    words = [w for w in re.split(r"[-_]+|(?<=[a-z])(?=\d)", name) if w and not w.isdigit()]
    while len(words) > 1 and words[-1] in LAYOUT:
        words.pop()
    return words[-1] if words else ""


def _dropped(tag: str, at: dict[str, str]) -> str:
    """Why an element is no part of an article; empty if it may be."""
    if tag in DROPPED:
        return tag
    if not at or tag in ("html", "body", "main"):
        return ""
    if "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower():
        return "hidden"
    if at.get("role", "").lower() in ROLES:
        return "role"
    if not at.get("class") and not at.get("id"):
        return ""
    names = _names(at)
    parts = set(map(_part, names))
    if parts & REMARKS and (tag in NAMED or tag in ("article", "li")):
        return "comments"
    if tag not in NAMED or names & CONTENT:
        return ""
    # a class that hides an element on some screens only does not hide it
    if parts & (PARTS - {"hidden"}) or ("hidden" in names and not any(":" in n for n in names)):
        return "part"
    if "header" in parts and not {p for n in names for p in re.split(r"[-_]+", n)} & {"article", "entry", "post", "content", "story"}:
        return "part"
    return ""


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of the page's text blocks in order; kind is DROPPED_TEXT, OPEN or MAIN.

    Main are all articles, unless a main element holds more text than twice
    theirs; else the main element, else all elements named like content.
    Without any of these no block is main. A page that ends within a tag loses
    that tag; unclosed elements end with their parent.
    """
    found: list[tuple[str, tuple[int, ...] | None]] = []
    stack: list[tuple[str, str, int]] = []  # tag, why dropped, container or -1
    kinds: list[int] = []  # of containers: 0 article, 1 main, 2 named
    buffer: list[str] = []
    waste: list[str] = []
    dropped, heading, header = 0, 0, 0

    def flush():
        if not buffer and not waste:
            return
        for parts, inside in ((buffer, tuple(c for _, _, c in stack if c >= 0)), (waste, None)):
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    found.append((text, inside))

    def pop():
        nonlocal dropped, header, heading
        tag, why, _ = stack.pop()
        dropped -= bool(why)
        header -= tag == "header"
        heading -= tag in HEADINGS

    def say(text: str):
        # of a page's header nothing is kept, of an article's header its headings are
        lost = dropped or (header and not (heading and any(c >= 0 for _, _, c in stack)))
        (waste if lost else buffer).append(html.unescape(text) if "&" in text else text)

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        tag, rest = m["name"].lower(), m["rest"]
        if m["end"]:
            if tag == "br":
                say(" ")
            if tag in BLOCK:
                flush()
            if any(t == tag for t, _, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW and not rest.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
        while tag in BLOCK and stack and stack[-1][0] == "p":
            pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            pop()
        attributes = _attributes(rest) if rest.strip(" /") else {}
        why = _dropped(tag, attributes)
        if tag in ("article", "main") and not why and dropped and all(w in ("", "part") for _, w, _ in stack):
            while dropped:  # an unclosed advert or notice ends where the article begins
                pop()
        container = -1
        if not why and not dropped:
            if tag == "article" or attributes.get("itemprop", "").lower() == "articlebody":
                container = 0
            elif tag == "main" or attributes.get("role", "").lower() == "main":
                container = 1
            elif attributes and _names(attributes) & CONTENT:
                container = 2
            if container >= 0:
                kinds.append(container)
                container = len(kinds) - 1
        stack.append((tag, why, container))
        dropped += bool(why)
        header += tag == "header"
        heading += tag in HEADINGS
    flush()
    total = [0] * len(kinds)
    sizes = [0, 0, 0]
    for text, inside in found:
        for c in inside or ():
            total[c] += len(text)
        for k in {kinds[c] for c in inside or ()}:
            sizes[k] += len(text)
    kind = 1 if sizes[1] > 2 * sizes[0] else next((k for k in range(3) if sizes[k]), None)
    main = {c for c in range(len(kinds)) if kinds[c] == kind}
    return [(text, DROPPED_TEXT if inside is None else MAIN if main.intersection(inside) else OPEN) for text, inside in found]


def host(url):
    """Host of a url column, lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _streams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows and the index of each row's first word."""
    parts, first, n = [np.zeros(0, np.uint64)], [], 0
    for words in split_words(texts):
        parts.append(words.hashes())
        first.append(words.first[:-1] + n)
        n += len(words)
    return np.concatenate(parts), np.append(np.concatenate(first) if first else np.zeros(0, np.int64), n).astype(np.int64)


def _equal_windows(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all windows of REPEAT words of some rows, equal ones side by side; their rows; and where each group starts.

    The rows are concatenated with separators into one suffix array; suffixes
    that share REPEAT words stand together in it.
    """
    sizes = np.diff(first)
    names, symbol = np.unique(hashes, return_inverse=True)
    at = runs(first[:-1] + np.arange(len(sizes)), sizes)
    symbols = np.zeros(len(hashes) + len(sizes), np.int64)
    symbols[at] = symbol + 1
    row = np.repeat(np.arange(len(sizes)), sizes + 1)
    order = suffix_array(symbols, REPEAT)
    padded = np.concatenate([symbols, np.zeros(REPEAT, np.int64)])
    full = np.ones(len(order), bool)
    same = np.ones(len(order), bool)
    for j in range(REPEAT):
        here = padded[order + j]
        full &= here > 0
        same[1:] &= here[1:] == here[:-1]
    # separators do not equal each other; windows with one are left out
    order, same = order[full], same[full]
    same[:1] = False
    rows = row[order]
    return order - rows, rows, np.flatnonzero(~same)


def repeated_windows(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of REPEAT words of some rows: a place of each, and the first and last row that has it."""
    place, rows, group = _equal_windows(hashes, first)
    if not len(place):
        return (np.zeros(0, np.int64),) * 3
    return place[group], np.minimum.reduceat(rows, group), np.maximum.reduceat(rows, group)


def windows_of_texts(hashes: np.ndarray, first: np.ndarray, least: int, asked=None) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct window of REPEAT words that at least `least` rows have, and how many do.

    `asked`, if given, tells of places whether their windows are to be counted instead.
    """
    place, rows, group = _equal_windows(hashes, first)
    if not len(place):
        return (np.zeros(0, np.int64),) * 2
    size = np.diff(np.append(group, len(place)))
    few = np.flatnonzero(size >= least if asked is None else asked(place[group]))
    at, number = runs(group[few], size[few]), np.repeat(np.arange(len(few)), size[few])
    pairs = np.unique(number * len(first) + rows[at])
    n = np.bincount(pairs // len(first), minlength=len(few))
    enough = n >= (least if asked is None else 0)
    return place[group[few[enough]]], n[enough]


def _covered(starts: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` words lie in a window that starts at one of the places."""
    cover = np.zeros(size + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + REPEAT, -1)
    return np.cumsum(cover[:-1]) > 0


def _outside(pages: DataFrame) -> DataFrame:
    """hosted, key, th, stream (blocks outside each page's main part, one to a line) and whole, whether it has a main part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(page or "") for page in batch.column("html").to_pylist()]
            streams = pa.array(["\n".join(t for t, k in page if k != MAIN) for page in found], pa.string())
            whole = pa.array([any(k == MAIN for _, k in page) for page in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("hosted", "key", "th")), streams, whole], names=["hosted", "key", "th", "stream", "whole"])

    return pages.select("hosted", "key", "th", "html").mapInArrow(run, "hosted long, key long, th long, stream string, whole boolean").where("stream <> ''")


def _windows(host: np.ndarray, hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of the REPEAT words from each place on, and of their host."""
    return mix(GRAM.spans(hashes, place, place + REPEAT) ^ mix(host.view(np.uint64))).view(np.int64)


def _big(pages: DataFrame) -> DataFrame:
    """hosted and shards of the hosts that one suffix array cannot hold."""
    size = F.greatest(F.count("*") / SHARD_PAGES, F.sum(F.coalesce(F.length("html"), F.lit(0))) / SHARD_BYTES)
    return pages.groupBy("hosted").agg(F.ceil(size).alias("shards")).where("shards > 1")


def _dealt(rows: DataFrame, big: DataFrame, *by: str) -> DataFrame:
    """Adds shards and shard. `big` has no hint: Spark broadcasts it only if its size allows."""
    shards = F.coalesce("shards", F.lit(1))
    return rows.join(big, "hosted", "left").withColumns({"shard": F.pmod(F.xxhash64(*by), shards), "shards": shards})


def _in_all_shards(rows: DataFrame, big: DataFrame) -> DataFrame:
    """Adds shard, with a copy of each row in every shard of its host."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shards", F.lit(1)).cast("long") - 1))
    return rows.join(big, "hosted", "left").withColumn("shard", every).drop("shards")


def _by_shard(batches: Iterator[pa.RecordBatch], solve) -> Iterator[pa.RecordBatch]:
    """solve(table, whole) of each (hosted, shard) of sorted batches; one shard is held at a time.

    A shard that is still too large, as where one row is repeated very often,
    is solved in pieces, which are then not `whole`.
    """
    held: list[pa.RecordBatch] = []
    whole = True
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        group, shard = table["hosted"].to_numpy(), table["shard"].to_numpy()
        cuts = np.flatnonzero((group[1:] != group[:-1]) | (shard[1:] != shard[:-1])) + 1
        for lo, hi in zip(np.append(0, cuts), cuts):
            yield solve(table.slice(lo, hi - lo), whole)
            whole = True
        rest = table.slice(cuts[-1] if len(cuts) else 0)
        if len(rest) > 4 * SHARD_PAGES or rest.nbytes > 4 * SHARD_BYTES:
            yield solve(rest, False)
            rest, whole = rest.slice(len(rest)), False
        held = rest.to_batches()
    if held:
        yield solve(pa.Table.from_batches(held), whole)


def _shared(streams: DataFrame, big: DataFrame) -> DataFrame:
    """window: the windows that two pages of a host have outside their main parts.

    A host's streams go to suffix arrays of about SHARD_PAGES pages. What is
    repeated across them is found by merging their distinct windows, each with
    its first and last page, so no task sees a whole large host.
    """
    dealt = _dealt(streams, big, "key", "th").select("hosted", "shards", "shard", "key", "stream")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(part: pa.Table, whole: bool) -> pa.RecordBatch:
            hashes, first = _streams(part["stream"].combine_chunks())
            key = part["key"].to_numpy()
            place, low, high = repeated_windows(hashes, first)
            if whole and part["shards"][0].as_py() == 1:
                place, low, high = (x[key[low] < key[high]] for x in (place, low, high))
            window = _windows(part["hosted"].to_numpy()[:1], hashes, place)
            return pa.RecordBatch.from_arrays([pa.array(window), pa.array(key[low]), pa.array(key[high])], names=["window", "low", "high"])

        return _by_shard(batches, solved)

    n = store.shuffle_partitions(streams.sparkSession)
    ordered = dealt.repartition(n, "hosted", "shard").sortWithinPartitions("hosted", "shard", "key")
    found = ordered.mapInArrow(run, "window long, low long, high long")
    return found.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("window")


def _page_windows(streams: DataFrame) -> DataFrame:
    """hosted, key, th and window of each place of the streams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first = _streams(batch.column("stream"))
            n = np.maximum(np.diff(first) - REPEAT + 1, 0)
            at = runs(first[:-1], n)
            row = np.repeat(np.arange(len(n)), n)
            window = _windows(batch.column("hosted").to_numpy()[row], hashes, at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("hosted", "key", "th")), pa.array(window)], names=["hosted", "key", "th", "window"])

    return streams.select("hosted", "key", "th", "stream").mapInArrow(run, "hosted long, key long, th long, window long")


def _kept(page: str | None) -> tuple[int, list[str]]:
    """Blocks of a page's main part, or of one without any those outside what markup drops; and which of both."""
    found = blocks(page or "")
    kind = MAIN if any(k == MAIN for _, k in found) else OPEN
    return kind, [t for t, k in found if k == kind]


def _main_texts(pages: DataFrame) -> DataFrame:
    """hosted, open (a text without a main part) and text, blocks of one to a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_kept(page) for page in batch.column("html").to_pylist()]
            texts = pa.array(["\n".join(texts) for _, texts in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("hosted"), pa.array([k == OPEN and bool(t) for k, t in found], pa.bool_()), texts], names=["hosted", "open", "text"])

    return pages.select("hosted", "html").mapInArrow(run, "hosted long, open boolean, text string")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves out a text that equals the one before it, also of the batch before."""
    before = None
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("hosted", "digest", "text"))))
        fresh = [r[2] is None or r != b for r, b in zip(rows, [before, *rows])]
        before = rows[-1] if rows else before
        yield batch.filter(pa.array(fresh, pa.bool_()))


COUNTS = "hosted long, window long, n long, slack long, open boolean"


def _counts(pages: DataFrame, big: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Windows that many distinct texts of a suffix array have: n of them; and a row without window for each array, n its distinct texts.

    Equal texts go to one array. An array that holds its whole host names just
    the windows that are common on it; of a larger host's it names those in at
    least half of SHARE of its texts, `slack` being how many texts may have one
    that it does not name. If windows (hosted, window) are asked for, exactly
    those are counted.
    """
    columns = ["hosted", "shards", "shard", "digest", "open", "text", "windows"]
    texts = _dealt(_main_texts(pages).withColumn("digest", F.xxhash64("text")), big, "digest").withColumn("windows", F.lit(None).cast("array<long>")).select(columns)
    if asked is not None:
        lists = _in_all_shards(asked.groupBy("hosted").agg(F.collect_list("window").alias("windows")), big)
        texts = texts.unionByName(lists.select("hosted", "shard", "windows"), allowMissingColumns=True)
    named = asked is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def solved(part: pa.Table, whole: bool) -> pa.RecordBatch:
            hosted = part["hosted"].to_numpy()[:1]
            known["windows"] = wanted = _listed(part, hosted[0], known)
            part = part.filter(pa.compute.is_valid(part["text"]))
            hashes, first = _streams(part["text"].combine_chunks())
            texts = len(part)
            if whole and texts and part["shards"][0].as_py() == 1:
                least, slack = max(LEAST_PAGES, math.ceil(texts * SHARE)), 0
            else:
                # at least 1, and slack is below texts * SHARE, so what no array names is not common
                least = max(math.ceil(texts * SHARE / 2), min(2, math.ceil(texts * SHARE)), 1)
                slack = least - 1
            place, n = windows_of_texts(hashes, first, least, (lambda at: np.isin(_windows(hosted, hashes, at), wanted)) if named else None)
            size = len(place) + 1
            columns = [pa.array(np.repeat(hosted, size)), pa.array([*_windows(hosted, hashes, place).tolist(), None], pa.int64()), pa.array(np.append(n, texts)), pa.array(np.full(size, slack)), pa.array(np.full(size, pa.compute.any(part["open"]).as_py() or False))]
            return pa.RecordBatch.from_arrays(columns, names=["hosted", "window", "n", "slack", "open"])

        return _by_shard(_distinct(batches), solved)

    n = store.shuffle_partitions(pages.sparkSession)
    # lists of windows come first, and of equal texts an open page's
    order = ["hosted", "shard", F.col("windows").isNull(), "digest", F.desc("open")]
    return texts.repartition(n, "hosted", "shard").sortWithinPartitions(*order).mapInArrow(run, COUNTS)


def _listed(part: pa.Table, hosted: int, known: dict) -> np.ndarray:
    """Windows that a shard's rows list; those of the piece before if it began there."""
    if known.get("shard") != (shard := (hosted, part["shard"][0].as_py())):
        known.update(shard=shard, windows=np.zeros(0, np.int64))
    lists = part["windows"].combine_chunks()
    return np.concatenate([known["windows"], lists.flatten().to_numpy()])


def _judged(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hosted, window) that are common on their host, and those for which arrays that do not name them must be asked."""
    totals = counts.where("window is null").groupBy("hosted").agg(F.sum("n").alias("texts"), F.sum("slack").alias("free"))
    sums = counts.where("window is not null").groupBy("hosted", "window").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack"))
    need = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("texts") * SHARE))
    judged = sums.join(totals, "hosted").select("hosted", "window", (F.col("n") >= need).alias("sure"), (F.col("n") + F.col("free") - F.col("slack") >= need).alias("open"))
    return judged.where("sure").select("hosted", "window"), judged.where("open and not sure").select("hosted", "window")


def _common(pages: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hosted, window) of windows that SHARE of the distinct texts of a host have, LEAST_PAGES at least; and hosts with open pages.

    Exact over whole hosts, however their texts are dealt to arrays: a window
    is named by an array if it may be common; where the arrays that do not
    name it could decide, the texts of its host are counted once more.
    """
    counts = store.table(_counts(pages, big), "counts")
    sure, asked = _judged(counts)
    asked = store.table(asked, "asked")
    if not asked.isEmpty():
        again = _counts(pages.join(asked.select("hosted").distinct(), "hosted", "left_semi"), big, asked).withColumn("slack", F.lit(0))
        sure = sure.unionByName(_judged(again)[0])
    common = store.table(sure, "common")
    hosts = store.table(counts.where("window is null and open").select("hosted").distinct(), "open-hosts")
    for gone in (counts, asked):
        store.drop(gone)
    return common, hosts


TEXTS = "page_id long, url string, text string, n_boilerplate long"


def _solved(part: pa.Table, known: dict) -> pa.RecordBatch:
    """Texts of the pages of one shard or piece of one (rows of side 1); rows of side 0 hold what open pages repeat outside, or what is common on the host.

    `known` is what the piece before knew of its last page and its shard; it is brought up to date.
    """
    side = part["side"].to_numpy()
    hosted = part["hosted"].to_numpy()[:1]
    known["windows"] = _listed(part, hosted[0], known)
    found = part.filter(pa.compute.and_(pa.array(side == 0), pa.compute.is_valid(part["hits"]))).select(["key", "th", "hits"])
    hits = known.get("hits", {}) | {(r["key"], r["th"]): np.array(r["hits"]) for r in found.to_pylist()}
    last = (part["key"][-1].as_py(), part["th"][-1].as_py())
    known["hits"] = {k: v for k, v in hits.items() if k == last}
    pages = part.filter(pa.array(side == 1))
    lists, kinds = pages["blocks"].combine_chunks(), pages["kinds"].combine_chunks().flatten().to_numpy()
    flat = lists.flatten()
    bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy())).astype(np.int64)
    # words are of use only where something repeats
    hashes, begins = _streams(flat) if hits or len(known["windows"]) else (np.zeros(0, np.uint64), np.zeros(len(flat) + 1, np.int64))
    first = begins[bounds]
    listed = flat.to_pylist()
    lost = np.zeros(len(flat), bool)
    size = np.diff(begins)
    gone = np.zeros(len(flat), bool)
    if len(known["windows"]):
        at = runs(first[:-1], np.maximum(np.diff(first) - REPEAT + 1, 0))
        sums = np.append(0, np.cumsum(_covered(at[np.isin(_windows(hosted, hashes, at), known["windows"])], len(hashes))))
        gone = (kinds == MAIN) & (size > 0) & (sums[begins[1:]] - sums[begins[:-1]] >= COVERED_MAIN * size)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if a == b:
            continue
        if kinds[a] == MAIN:
            lost[a:b] = gone[a:b] & ((size[a:b] * ~gone[a:b]).sum() >= LEFT_MAIN * size[a:b].sum())
            continue
        found = hits.get((pages["key"][i].as_py(), pages["th"][i].as_py()))
        if found is not None:
            h = hashes[first[i] : first[i + 1]]
            at = np.arange(len(h) - REPEAT + 1)
            at = at[np.isin(_windows(hosted, h, at), found)]
            over = np.append(0, np.cumsum(_covered(at, len(h))))
            where = begins[a : b + 1] - first[i]
            lost[a:b] = over[where[1:]] - over[where[:-1]] >= np.maximum(COVERED * size[a:b], 1)
    texts = ["\n\n".join(t for t, x in zip(listed[a:b], lost[a:b]) if not x) for a, b in zip(bounds, bounds[1:])]
    removed = np.append(0, np.cumsum(size * lost))[bounds]
    columns = [pages["page_id"].combine_chunks(), pages["url"].combine_chunks(), pa.array(texts, pa.string()), pa.array(np.diff(removed))]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_boilerplate"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_boilerplate (words that went because the host repeats them) of every row of pages.

    Markup makes blocks of a page and leaves out scripts, styles, menus and
    the like. Where it marks a main part, only that part's blocks are looked
    at. Suffix arrays of each host's pages then decide about every block that
    is left. On a page without a main part a block goes if at least half of
    its words are covered by substrings of REPEAT or more words that another
    page of the host has. In a main part, where quotations and copies repeat
    too, a block goes only if runs cover 90 % of it that 30 % of the host's
    distinct texts have (and at least LEAST_PAGES); if that would leave less
    than a fifth of the part, it stays whole. White space in a block becomes one
    space; blocks are joined by an empty line. Null and empty pages give an
    empty text. Rows with one page_id count as one page outside main parts,
    null ids likewise; a null url has the empty host. Other columns are
    ignored.
    """
    keyed = pages.select("page_id", "url", "html", F.xxhash64(host(F.col("url"))).alias("hosted"), F.coalesce("page_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("html", "url").alias("th"))
    big = store.table(_big(keyed), "big-hosts")
    common, hosts = _common(keyed, big)
    streams = store.table(_outside(keyed.join(hosts, "hosted", "left_semi")), "streams")
    shared = store.table(_shared(streams, big), "shared")
    hits = store.table(_page_windows(streams.where("not whole")).join(shared, "window").groupBy("hosted", "key", "th").agg(F.collect_set("window").alias("hits")), "hits")
    for gone in (streams, shared, hosts):
        store.drop(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = [], []
            for page in batch.column("html").to_pylist():
                kind, found = _kept(page)
                texts.append(found)
                kinds.append([kind] * len(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int32()))], names=[*keep, "blocks", "kinds"])

    keep = ["page_id", "url", "hosted", "key", "th"]
    parsed = keyed.select(*keep, "html").mapInArrow(run, "page_id long, url string, hosted long, key long, th long, blocks array<string>, kinds array<int>")
    both = _dealt(parsed.withColumn("side", F.lit(1)).unionByName(hits.withColumn("side", F.lit(0)), allowMissingColumns=True), big, "key", "th").drop("shards")
    lists = _in_all_shards(common.groupBy("hosted").agg(F.collect_list("window").alias("windows")), big).withColumn("side", F.lit(0))
    n = store.shuffle_partitions(pages.sparkSession)
    ordered = both.unionByName(lists, allowMissingColumns=True).repartition(n, "hosted", "shard").sortWithinPartitions("hosted", "shard", F.col("windows").isNull(), "key", "th", "side")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        return _by_shard(batches, lambda part, _: _solved(part, known))

    found = ordered.mapInArrow(solve, TEXTS)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_boilerplate")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tempograph.llm import html
from tempograph.llm.html import MAIN, OPEN, blocks, extract, repeated_windows
from tempograph.llm.html import _streams as streams


def main(page):
    return [t for t, k in blocks(page) if k == MAIN]


def kept(page):
    return [t for t, k in blocks(page) if k >= OPEN]


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- ad --><div class="ad">Buy</div><div class='cookie-notice'>ok?</div>
    <article><header><h1>Head &lt;1&gt;</h1><p>by me</p></header><p>One <b>bold</b>\n\t text&nbsp;&#233;&eacute &copy <a href="x>y">l</a><br>two<p>Para
    <script>if (a < b) {}</script>two<ul><li>i1<li>i2</ul><aside>side</aside><form>f<input></form>a < b &am
    <table><tr><td>c1<td>c2</table><!-- <p>no</p> --><pre>x  y</pre></article><section class="comments"><article class="comment"><p>first!</p></article></section>
    <div id="sidebar">s</div><footer>&copy; f</footer></body></html>"""
    assert main(page) == ["Head <1>", "One bold text éé © l two", "Para two", "i1", "i2", "a < b &am", "c1", "c2", "x y"]


def test_broken_and_odd_pages():
    assert blocks("") == [] and kept("just text") == ["just text"]
    assert main("<article><p>a<p>b<a hre") == ["a", "b"]
    assert main("<div class=ad>buy <article><p>x</p></article>") == ["x"]
    assert main("<article><p>a</article></div></b><p>out") == ["a"]
    assert main("<article>short</article><article>the longer one</article>") == ["short", "the longer one"]
    assert main("<main><p>m</p></main><p>o</p>") == ["m"]
    assert main("<main><article>a</article><p>b</p><article>c</article></main>") == ["a", "c"]
    assert main("<main><article>a</article><p>much more text than that of the teaser</p></main>") == ["a", "much more text than that of the teaser"]
    assert main("<div class=content>one</div><div class=content>two</div>") == ["one", "two"]
    assert main("<div class='post-content'>p</div><div class=x>o</div>") == ["p"]
    assert kept("<body><script>never closed <p>x") == [] and kept("<p>a<!-- open <p>b") == ["a"]
    assert kept("<p hidden>a</p><p style='display: none'>b</p><p>c</p>") == ["c"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert kept(deep) == ["x"]
    assert kept("<p>" + "word " * 300_000)[0].count("word") == 300_000


def test_repeated_windows_equal_brute_force():
    rng = random.Random(1)
    for size in (3, 30):
        rows = [[rng.randrange(size) for _ in range(rng.randrange(60))] for _ in range(25)] + [[], [1] * 8, [2] * 40, [2] * 9]
        texts = pa.array([" ".join(map(str, r)) for r in rows])
        hashes, first = streams(texts)
        place, low, high = repeated_windows(hashes, first)
        want = {}
        for i, r in enumerate(rows):
            for s in range(len(r) - html.REPEAT + 1):
                want.setdefault(tuple(r[s : s + html.REPEAT]), []).append(i)
        flat = [x for r in rows for x in r]
        got = {tuple(flat[p : p + html.REPEAT]): (a, b) for p, a, b in zip(place, low, high)}
        assert len(place) == len(want) and got == {w: (min(v), max(v)) for w, v in want.items()}
    assert not len(repeated_windows(np.zeros(0, np.uint64), np.zeros(3, np.int64))[0])


def test_names_say_what_a_part_is_by_their_last_word():
    inside = ["<p class='share-price'>a</p>", "<section class='related-work'>a</section>", "<p class='notice-period'>a</p>", "<div class='comment-free'>a</div>", "<p>a<math></math></p>",
              "<li class='menu'>a</li>", "<div class='hidden md:block'>a</div>"]
    assert [main(f"<article><p>b</p>{x}</article>") for x in inside] == [["b", "a"]] * len(inside)
    assert main("<article>x<math><mi>y</mi><annotation>t</annotation></math></article>") == ["xy"]
    outside = ["<div class='ad'>a</div>", "<div id='ads-top'>a</div>", "<section class='comments-area'>a</section>", "<div class='related-posts'>a</div>", "<div class='share-buttons'>a</div>",
               "<div class='cookie-notice'>a</div>", "<li class='comment'>a</li>", "<div hidden>a</div>", "<div class='hidden'>a</div>", "<ul class='main-menu'><li>a</ul>"]
    assert [main(f"<article><p>b</p>{x}</article>") for x in outside] == [["b"]] * len(outside)


def plain_extract(pages):
    """The rules of `extract` in plain Python; every host is one shard."""
    parsed = {}
    for n, (page_id, url, page) in enumerate(pages):
        found = blocks(page or "")
        whole = any(k == MAIN for _, k in found)
        site = (url or "").split("//")[-1].split("/")[0].split("@")[-1].split(":")[0].lower() if "//" in (url or "") else ""
        parsed[n] = (site, page_id, whole, [t for t, k in found if k == (MAIN if whole else OPEN)], " ".join(t for t, k in found if k != MAIN).split())
    windows = lambda words: [tuple(words[i : i + html.REPEAT]) for i in range(len(words) - html.REPEAT + 1)]
    texts = []
    for site, page_id, whole, kept, outside in parsed.values():
        words = " ".join(kept).split()
        peers = [p for p in parsed.values() if p[0] == site]
        if whole:
            others = {"\n".join(p[3]) for p in peers}
            need = max(html.LEAST_PAGES, math.ceil(len(others) * html.SHARE))
            seen = [set(windows(t.split())) for t in others]
            bad = [sum(w in s for s in seen) >= need for w in windows(words)]
        else:
            bad = [any(w in windows(p[4]) for p in peers if p[1] != page_id) for w in windows(outside)]
            assert len(outside) >= len(words)
            # what open pages leave out by markup is not in these tests
            assert outside == words
        covered = [any(bad[max(0, i - html.REPEAT + 1) : i + 1]) for i in range(len(words))]
        at, lost = 0, []
        for t in kept:
            n = len(t.split())
            share = sum(covered[at : at + n]) / n
            lost.append(share >= (html.COVERED_MAIN if whole else html.COVERED))
            at += n
        if whole and sum(len(t.split()) for t, x in zip(kept, lost) if not x) < html.LEFT_MAIN * len(words):
            lost = [False] * len(kept)
        texts.append("\n\n".join(t for t, x in zip(kept, lost) if not x))
    return texts


def site(rng, n, marked):
    """Pages of one host, and what each should give: own text, quoted passages and copies stay, what the site says on many pages goes."""
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    notice, plea, quote, copy = say(14), say(25), say(30), [say(20), say(30)]
    pages = []
    for i in range(n):
        own = copy if i in (1, 2) else [say(rng.randrange(8, 40)) for _ in range(rng.randrange(2, 6))]
        if i in (3, 4):
            own = [*own, quote]
        body = list(own)
        if rng.random() < 0.8:
            body.insert(rng.randrange(1, len(body) + 1), notice)
        if rng.random() < 0.7:
            body.append(plea)
        inner = "".join(f"<p>{t}</p>" for t in body)
        frame = f"<nav>{say(5)}</nav><div class='ad'>{say(9)}</div>"
        pages.append((i, "http://a.example/x", (frame if marked else "") + (f"<article>{inner}</article>" if marked else f"<div>{inner}</div>"), "\n\n".join(own)))
    return pages


def test_extract_equals_brute_force(spark):
    for seed, marked in ((1, True), (2, False), (3, True)):
        rng = random.Random(seed)
        pages = [p[:3] for p in site(rng, 30, marked)] + [(40 + i, "http://b.example", f"<article><p>{'same words here ' * 9}</p><p>own {i}</p></article>") for i in range(4)]
        pages += [(50, "http://a.example/x", None), (51, None, "<p>alone</p>"), (52, None, "")]
        found = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
        assert found == {p[0]: t for p, t in zip(pages, plain_extract(pages))}


def test_what_a_site_says_on_many_pages_goes_and_the_rest_stays(spark):
    rng = random.Random(7)
    pages = site(rng, 40, True)
    found = {r.page_id: r for r in extract(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(3)).collect()}
    assert {p[0]: p[3] for p in pages if p[0] not in (1, 2)} == {i: r.text for i, r in found.items() if i not in (1, 2)}
    # copies keep all of their own text
    assert all(pages[i][3].split("\n\n")[0] in found[i].text for i in (1, 2))
    assert sum(r.n_boilerplate > 0 for r in found.values()) > 30


def test_shards_and_pieces_do_not_change_open_pages(spark, monkeypatch):
    pages = [p[:3] for p in site(random.Random(5), 40, False)]
    pages += [(None, "http://a.example/x", pages[3][2])] * 30 + [(None, "http://a.example/x", pages[4][2])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    want = sorted((r.page_id or -1, r.text) for r in extract(frame).collect())
    for size in (2, 5):
        monkeypatch.setattr(html, "SHARD_PAGES", size)
        assert sorted((r.page_id or -1, r.text) for r in extract(frame).collect()) == want


def test_windows_of_texts_equal_brute_force():
    rng = random.Random(3)
    rows = [[rng.randrange(2) for _ in range(rng.randrange(60))] for _ in range(25)] + [[], [1] * 8, [2] * 40, [2] * 9]
    hashes, first = streams(pa.array([" ".join(map(str, r)) for r in rows]))
    flat = [x for r in rows for x in r]
    want = Counter(w for r in rows for w in {tuple(r[s : s + html.REPEAT]) for s in range(len(r) - html.REPEAT + 1)})
    for least in (1, 2, 4):
        place, n = html.windows_of_texts(hashes, first, least)
        assert len(place) and {tuple(flat[p : p + html.REPEAT]): k for p, k in zip(place, n)} == {w: k for w, k in want.items() if k >= least}
    place, n = html.windows_of_texts(hashes, first, 99, lambda at: at % 2 == 0)
    assert len(place) and all(p % 2 == 0 and want[tuple(flat[p : p + html.REPEAT])] == k for p, k in zip(place, n))


def test_shards_and_pieces_do_not_change_main_parts(spark, monkeypatch):
    # sentences that just reach the share of the whole host, or just miss it, with copies that must not count twice
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    n = 50
    said = [(say(12), k) for k in (4, 5, 13, 14, 15, 15, 16, 17, 30, 50)]
    bodies = [[say(rng.randrange(30, 60))] for _ in range(n)]
    for t, k in said:
        for i in rng.sample(range(n), k):
            bodies[i].append(t)
    pages = [(i, "http://a.example/x", "<article>" + "".join(f"<p>{t}</p>" for t in b) + "</article>") for i, b in enumerate(bodies)]
    pages += [(100 + i, "http://a.example/x", pages[i % 3][2]) for i in range(40)] + [(200 + i, "http://a.example/y", f"<p>{said[-1][0]}</p><p>{say(9)}</p>") for i in range(4)]
    want = dict(zip((p[0] for p in pages), plain_extract(pages)))
    # 54 texts: 17 pages and more make a sentence common
    assert [sum(t in want[i] for i in range(n)) for t, _ in said] == [4, 5, 13, 14, 15, 15, 16, 0, 0, 0]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    asked = []
    monkeypatch.setattr(html, "_counts", lambda *a, real=html._counts: asked.append(len(a) > 2) or real(*a))
    for size in (2, 7, 1000):
        monkeypatch.setattr(html, "SHARD_PAGES", size)
        assert {r.page_id: r.text for r in extract(frame).collect()} == want
    # some arrays had to be asked again, a host in one array never
    assert any(asked) and not asked[-1]
    # arrays that are solved in pieces
    monkeypatch.setattr(html, "_big", lambda pages: pages.groupBy("hosted").agg(F.lit(2).cast("long").alias("shards")))
    monkeypatch.setattr(html, "SHARD_PAGES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert {r.page_id: r.text for r in extract(frame).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_boilerplate_of_a_host_goes(spark, monkeypatch):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common, own = say(20), [say(30) for _ in range(12)]
    article = say(40)
    pages = [(i, f"https://u@Site.example:80/{i}", f"<div><p>{common}</p><p>{own[i]}</p></div>", "x") for i in range(12)]
    pages += [(20 + i, "http://site.example/a", f"<p>{common}</p><article><p>{article}</p></article>", "x") for i in range(2)]
    pages += [(30, "http://other.example/", f"<p>{common}</p>", "x"), (31, None, None, "x"), (None, "http://other.example", "", "x"), (30, "http://other.example/", f"<p>{common}</p>", "x")]
    for shard in (2000, 2):
        monkeypatch.setattr(html, "SHARD_PAGES", shard)
        frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string").repartition(4)
        found = extract(frame).collect()
        assert len(found) == len(pages) and all(r.n_chars == len(r.text) for r in found)
        text = {r.page_id: r.text for r in found}
        assert {i: text[i] for i in range(12)} == dict(enumerate(own))
        assert text[20] == text[21] == article and text[30] == common and text[31] == text[None] == ""
    assert extract(frame.where("false")).count() == 0


def test_blocks_are_joined_by_an_empty_line(spark):
    rows = [(1, "http://a.example/", "<article><h1>A</h1><p>b  c<p>d</article>")]
    assert extract(spark.createDataFrame(rows, "page_id long, url string, html string")).first().text == "A\n\nb c\n\nd"

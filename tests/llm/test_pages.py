"""URL rules and template removal against plain statements over all pairs, and on awkward pages."""

import re
import time
from collections import defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.llm import html_text, url_filter

SF = "/root/testdata/sf0.01"
URLS = [
    "http://example.org#x://y/en/1z",
    "http://host?u=http://b.org/p",
    "http://a.com?u=http://b.com/de/x",
    "https://www.EXAMPLE.org/en/12",
    "https://example.org/es/",
    "ftp://x.org/",
    "http://x.org",
    "http://x.org?",
    "http://spam-a.net/",
    "http://x.spam-b.net/",
    "http://xspam-b.net/",
    "http://a.net/x.spam-y.z",
    "http://cheap-pills.net/",
    "http://my-cheap-pills.net/",
    "http://mycheap-pills.net/",
    "http://discount-pills.fr/a",
    "http://casino.net/",
    "http://a.net/casino/",
    "http://a.net/casino",
    "http://casinos.net/",
    "http://ad.foo.net/",
    "http://ads1.foo.net/",
    "http://ad",
    "http://ads7/x.y",
    "http://aad.foo.net/",
    "http://ad.com/fr/",
    "http://x.net/wp-login.php",
    "http://x.net/wp-login.php\n",
    "http://x.net/xmlrpc.php?x",
    "http://x.com/de/xmlrpc.php",
    "http://x.com/DE/",
    "http://é.com/de/ü",
    "://",
    "a://b",
    "//x.com/de/",
    "http://ads-1.x.net/p",
    "",
]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        (len(r), r, v) for v,
        r in url_filter.BASE_RULES if (h := r.partition("/")) and (host == h[0] or host.endswith("." + h[0])) and path.startswith("/" + h[2])
    ]
    if fits:
        return host, path, *max(fits)[1:]
    blocked = any(re.search(e, host + path) for _, e, _ in url_filter.PATTERN_RULES)
    return host, path, None, "block" if blocked else "allow"


def test_index_equals_all_rules_on_all_urls(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionByName(
        spark.createDataFrame([(-1 - i, u) for i, u in enumerate([*URLS, None])], "page_id long, url string")
    )
    urls = {r.page_id: r.url for r in table.collect()}
    got = url_filter.judge(table).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(urls[r.page_id]), urls[r.page_id]


def test_url_sql_equals_the_query_on_awkward_urls(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(i, u) for i, u in enumerate([*URLS, None, URLS[0]])])
    want = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.ORACLE}) ORDER BY 1").fetchall()
    got = url_filter.judge(spark.createDataFrame(con.sql("SELECT * FROM pages").fetchall(), "page_id long, url string")).orderBy("page_id").collect()
    assert [tuple(r)[:5] for r in got] == want


def test_url_rules_need_no_python(spark):
    plan = url_filter.judge(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan


class Tree(HTMLParser):
    """A plain tree of well-formed pages: (tag, attributes, children) with texts as children."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack = [["", (), []]]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, tuple(attrs), []]
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        assert self.stack.pop()[0] == tag

    def handle_data(self, data):
        if data.split():
            self.stack[-1][2].append(" ".join(data.split()))


def frozen(node, text=True):
    tag, attrs, children = node
    return (
        tag,
        tuple(v for k, v in attrs if k == "class") if not text else (),
        tuple(c if isinstance(c, str) and text else frozen(c, text) if not isinstance(c, str) else None for c in children)
    )


def sizes(node):
    """(characters, those inside links)"""
    own = [(len(c), 0) if isinstance(c, str) else sizes(c) for c in node[2]]
    n = sum(x[0] for x in own)
    return n, n if node[0] == "a" else sum(x[1] for x in own)


def in_page(node, in_main=False):
    for c in node[2]:
        if not isinstance(c, str):
            yield c, in_main
            yield from in_page(c, in_main or c[0] in ("article", "main"))


def keys(node, in_main):
    """What names a subtree when it is counted; none where it cannot be template."""
    n, linked = sizes(node)
    if not n or node[0] in ("html", "body", "article", "main"):
        return
    prose = node[0] in html_text.PROSE | html_text.INLINE
    if not in_main or (not prose and (node[1] or 2 * linked > n)):
        yield "text", frozen(node)
    if 2 * linked > n and not in_main:
        yield "shape", repr(frozen(node, False))


def plain_extract(pages, least):
    """Hash, count and delete by nested loops: texts of pages of (host, html), and how many blocks recurrence deletes."""
    trees = [(h, Tree(p).stack[0]) for h, p in pages]
    voices = defaultdict(set)
    for h, t in trees:
        for node, in_main in in_page(t):
            for k in keys(node, in_main):
                voices[h, k].add(frozen(t))
    out = []
    for h, t in trees:
        has_main = any(n[0] in ("article", "main") for n, _ in in_page(t))
        texts, recurring = [], 0

        def walk(node, in_main, gone, dropped, h=h, texts=texts, has_main=has_main):
            nonlocal recurring
            for c in node[2]:
                if isinstance(c, str):
                    recurring += gone
                    if not gone and not dropped and (in_main or not has_main):
                        texts.append(c)
                else:
                    cut = any(len(voices[h, k]) >= least for k in keys(c, in_main))
                    marked = c[0] in html_text.DROPPED or any(v in html_text.MARKS for k, v in c[1] if k == "class")
                    walk(c, in_main or c[0] in ("article", "main"), gone or cut, dropped or marked)

        walk(t, False, False, False)
        out.append((" ".join(texts), recurring))
    return out


def made_page(rng, k):
    words = lambda n: " ".join(rng.choice(["sun", "moon", "sea", "hill", "tree", "rain"], n))
    nav = "".join(f'<li><a href="/{i}">{words(1)}</a></li>' for i in range(4))
    notice = "<div class='x1'><div>We use small files here</div><div>Agree</div></div>"
    box = "<div class='x2'><p>Read all about our club</p></div>"
    quote = "<p>To be quoted by very many articles of this host</p>"
    prose = "".join(f"<p>{words(6)} {k}</p>" for _ in range(rng.integers(1, 4)))
    inner = f"{prose}{quote if rng.random() < 0.7 else ''}{box if rng.random() < 0.7 else ''}<p>{words(5)} {k}.</p>"
    main = f"<article><h1>{words(3)}</h1>{inner}</article>" if k % 3 else f"<div><div>{inner}</div></div>"
    return (
        f"<html><body><ul>{nav}</ul>{notice if rng.random() < 0.8 else ''}{main}<div "
        f"class='x3'>{words(2)}</div><footer>{words(2)}</footer></body></html>"
    )


@pytest.mark.parametrize("few", [300_000, 0])
def test_template_removal_equals_plain_counting(spark, monkeypatch, few):
    monkeypatch.setattr(html_text, "MOST_BROADCAST", few)  # 0: joined by shuffle
    rng = np.random.default_rng(7)
    pages = [(f"h{k % 3}.com", made_page(rng, k)) for k in range(60)]
    pages += [pages[0]] * 6 + [("solo.com", pages[3][1])] * 8  # copies of a page are one voice
    table = spark.createDataFrame(
        [(k, f"http://{h}/{k}", p) for k, (h, p) in enumerate(pages)],
        "page_id long, url string, html string"
    ).withColumn("host", F.lit(1))
    got = {r.page_id: r for r in html_text.extract(table).collect()}
    want = plain_extract(pages, html_text.LEAST_PAGES)
    assert [(got[k].text, got[k].n_recurring) for k in range(len(pages))] == want
    assert all(
        "quoted by very many" not in got[k].text or "quoted by" in pages[k][1] for k in got
    ) and any("quoted by very many" in r.text for r in got.values())
    off = {r.page_id: r.text for r in html_text.extract(table, None).collect()}
    assert all("club" not in got[k].text for k in range(60)) and any("club" in off[k] for k in off)  # an unlisted box inside the article
    assert got[66].text == off[66] and got[66].n_recurring == 0


def test_recurrence_decides_on_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    on, off = (html_text.extract(pages, n).agg(F.sum("n_recurring"), F.sum("n_tagged")).first() for n in (html_text.LEAST_PAGES, None))
    assert on[0] > 1000 and on[0] + on[1] == off[1] and off[0] == 0
    assert on[0] > on[1]


def test_deep_long_and_broken_pages(spark):
    deep = "<div>" * 50_000 + "deep text" + "</div>" * 50_000 + "<p>after"
    bold = "<b>" * 50_000 + "<p>x</p>" * 2000
    long = "<article>" + "<p>word word word</p>" * 60_000 + "</article>"
    stray = "</i></span></div>" * 30_000 + "kept <!-- c --> &copy; &#x41;&nbsp;b<script>no</scrip" + "<"
    began = time.time()
    table = spark.createDataFrame(
        list(enumerate([deep, bold, long, stray, "<", "</", "<a", "&", " \n "])),
        "page_id long, html string"
    ).withColumn("url", F.lit("http://d.com/"))
    got = {r.page_id: r.text for r in html_text.extract(table).collect()}
    assert got[0] == "deep text after" and got[1] == " ".join(["x"] * 2000) and got[2] == " ".join(["word word word"] * 60_000)
    assert got[3] == "kept © A b" and [got[k] for k in range(4, 9)] == ["<", "</", "", "&", ""]
    assert time.time() - began < 120


def test_telling_names_inside_an_article(spark):
    inner = (
        "<section id=related-work><h2 id=comments>Related work</h2><p>Prose {0}.</p></section><div class=comments>me too</div><div "
        "class='ad-slot'>Buy {0}</div>"
    )
    pages = [
        (k, f"http://t.com/{k}", f"<article><p>Own {k}</p>{inner.format(k)}</article>") for k in range(6)
    ] + [(9, "http://u.com/", f"<article>{inner.format(9)}</article>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(6)] == [f"Own {k} Related work Prose {k}." for k in range(6)]
    assert got[9] == "Related work Prose 9. Buy 9"  # a name that only contains a telling word must recur


def test_a_teaser_beside_the_text_is_not_the_page(spark):
    pages = [
        (1, "<div><h1>T</h1><p>main text here long</p></div><article class='teaser'><p>Related card</p></article>", "T main text here long Related card"),
        (2, "<article><p>Prose.</p><section class='search'><p>Search engines index pages.</p></section></article>", "Prose. Search engines index pages."),
        (3, "<article><p>Prose.</p><ul class='menu'><li>Soup of the day</li></ul><ul class='menu'><li><a href='/'>Home</a></li></ul></article>", "Prose. Soup of the day"),
        (4, "<div>" * 600 + "<nav>menu</nav><p>text</p>" + "</div>" * 600, "text"),
        (5, "<article><p>The article's own words.</p></article><div><p>Beside</p></div>", "The article's own words."),
        (6, "<div>" * 50_000 + "deep", "deep"),
    ]
    table = spark.createDataFrame([(i, f"http://h{i}.org/", p) for i, p, _ in pages], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(table).collect()} == {i: t for i, _, t in pages}

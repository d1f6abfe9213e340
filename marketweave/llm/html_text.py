"""Main text of web pages by site template removal.

Every element's subtree is hashed: its tag, its text and its children's hashes. Spark counts each hash over the
different pages of its host; a subtree that recurs across many of them is template and is deleted, with all blocks in
it. Lists of links outside the article are also hashed by their shape (tags and class names without the text), as menus
with a page's own links recur by shape only. Recurrence decides first and over the whole page. What it leaves is then
cut by tag, role and class name (menus, forms, reader comments of this page alone), and an article or main element is
the scope of last resort. Inside an article, prose is never template, however many articles quote it: only boxes with a
class, id or role and lists of links are, and class names that merely contain a telling word count if they recur, too.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, sized, small_batches
from .url_filter import host

#: A subtree is template from this many different pages of its host on, whatever the host's size.
LEAST_PAGES = 5
#: Templates, and pages with their deleted ranges, that are broadcast at most, and ranges of all pages together (8 bytes
#: each, so 16 MB); more are joined by shuffle.
MOST_BROADCAST, MOST_RANGES = 300_000, 2_000_000
#: Elements nested deeper are judged like others, but have no hash of their own: that of the one at this depth holds their content.
DEPTH = 512
#: Elements without main text, elements whose content is no markup, and elements that have no end tag.
DROPPED = frozenset(
    "head script style noscript template svg math canvas object iframe form button select textarea input nav footer aside menu dialog".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run on with the text around them; all others begin and end a block.
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike
    strong sub sup time tt u var wbr ruby rt rp""".split()
)
#: Words in class, id or role that mark what is no main text.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent
    notice notices gdpr popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar widget footer masthead
    comment comments reply replies disqus respond share sharing social related recommended newsletter subscribe subscription
    signup login search pagination pager skip complementary contentinfo""".split()
)
#: Of these words, those that in an article may as well name prose: there they tell only where links make up most of an element.
WEAK = frozenset("menu nav navigation search login overlay skip social".split())
#: Elements that hold prose, and of these the headings.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre table thead tbody tr td th figure figcaption dl dt dd address".split())
#: Elements that a new one of these ends, if open, without an end tag.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",)
}
ENDS_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hr main menu nav ol p pre section table ul""".split()
)
SCOPE = frozenset("html body article main section div table td th ul ol dl blockquote nav aside header footer form figure".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^'">])*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: What keeps a block out of the text: nothing, its tag or class, its place outside the article.
KEPT, TAGGED, OUTSIDE = 0, 1, 2


class Element:
    __slots__ = ("digest", "dropped", "first", "frame", "in_main", "linked", "named", "shape", "size", "tag", "weak")

    def __init__(self, tag: str, parent: "Element | None", names: list[tuple[str, str]], first: int, deep: bool = False):
        self.tag, self.named, self.first = tag, bool(names), first
        self.in_main = bool(parent) and (parent.in_main or parent.tag in ("article", "main"))
        whole, named, part = _marks(tag, names)
        above = parent.dropped if parent else False
        self.weak = whole and self.in_main and not {v for k, v in names if k != "id"} & (MARKS - WEAK)
        whole = whole and not self.weak
        self.dropped = above or whole or (part and not self.in_main) or tag in DROPPED or (tag == "header" and not self.in_main)
        looks = " ".join([tag, *sorted(v for k, v in names if k == "class")])
        self.frame = looks if named and self.in_main else ""
        self.digest, self.shape = (parent.digest, parent.shape) if deep else (xxhash.xxh3_64(tag), xxhash.xxh3_64(looks))
        self.size = self.linked = 0


def _names(attributes: str) -> list[tuple[str, str]]:
    """(attribute, name) of each class, role and id."""
    return [(m[1].lower(), v) for m in _ATTRIBUTE.finditer(attributes) for v in (m[2] or m[3] or m[4] or "").lower().split()] if attributes else []


def _marks(tag: str, names: list[tuple[str, str]]) -> tuple[bool, bool, bool]:
    """Whether a class or role is a telling word, whether one has such a word as a part, and whether any name has."""
    if not names or tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return False, False, False
    told = [(k, v in MARKS, any(t in MARKS for t in re.split(r"[^a-z]+", v))) for k, v in names]
    return any(w for k, w, _ in told if k != "id"), any(p for k, _, p in told if k != "id"), any(p for _, _, p in told)


def _signed(digest: "xxhash.xxh3_64") -> int:
    return digest.intdigest() - (1 << 63)


def parse(page: str) -> tuple[list[str], list[int], list[tuple[int, int, int]], int]:
    """The page's blocks (text, if it may be main text), what keeps each out of the text, the hashes of its subtrees with
    the range of blocks that each covers, and the hash of the page as a whole."""
    root = Element("", None, [], 0)
    stack, open_tags = [root], Counter()
    blocks: list[str] = []
    why: list[int] = []
    scoped: list[bool] = []
    subtrees: list[tuple[int, int, int]] = []
    text: list[str] = []
    has_main = False

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            if block:
                e = stack[-1]
                blocks.append("" if e.dropped else block)
                why.append(TAGGED if e.dropped else KEPT)
                scoped.append(e.in_main or e.tag in ("article", "main"))
            text.clear()

    def close() -> None:
        e = stack.pop()
        open_tags[e.tag] -= 1
        above, deep = stack[-1], e.digest is stack[-1].digest
        above.size += e.size
        above.linked += e.size if e.tag == "a" else e.linked
        last = len(blocks)
        if e.weak and 2 * e.linked > e.size:
            for i in range(e.first, last):
                blocks[i], why[i] = "", TAGGED
        if deep:
            return
        own, shape = _signed(e.digest), _signed(e.shape)
        above.digest.update(own.to_bytes(8, "big", signed=True))
        above.shape.update(shape.to_bytes(8, "big", signed=True))
        if last <= e.first or not e.size or e.tag in ("html", "body", "article", "main"):
            return
        links = 2 * e.linked > e.size
        if not e.in_main or (e.tag not in INLINE and e.tag not in PROSE and (e.named or links)):
            subtrees.append((own, e.first, last))
        if links and not e.in_main:
            subtrees.append((shape ^ 1, e.first, last))
        if e.frame:
            subtrees.append((_signed(xxhash.xxh3_64(e.frame)) ^ 2, e.first, last))

    def add(raw: str) -> None:
        if raw:
            piece = html.unescape(raw)
            e = stack[-1]
            words = " ".join(piece.split())
            if words:
                e.digest.update(words.encode("utf-8", "replace") + b"\0")
                e.size += len(words)
            text.append(piece)

    def close_open(tags: tuple[str, ...]) -> None:
        """Closes the innermost open element of these tags, unless a scope lies above it."""
        if not any(open_tags[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in SCOPE and stack[i].tag not in tags:
                return

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if page.startswith("<!--", lt):
            add(page[at:lt])
            close_at = page.find("-->", lt + 4)
            at = end if close_at < 0 else close_at + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            add(page[at:lt])
            close_at = page.find(">", lt)
            at = end if close_at < 0 else close_at + 1
            continue
        m = _TAG.match(page, lt) or _PLAIN_TAG.match(page, lt)
        if not m:
            after = page[lt + 1 : lt + 3]
            if after[:1].isalpha() or (after[:1] == "/" and after[1:].isalpha()):
                add(page[at:lt])  # a tag that the page's end cuts off
                break
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at, tag, attributes = m.end(), m[2].lower(), m[3]
        if tag not in INLINE:
            flush()
        if m[1]:
            if open_tags[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        while len(stack) > i:
                            close()
                        break
                    if (tag in INLINE or tag in ("p", "li")) and stack[i].tag in SCOPE:
                        break
            continue
        if tag == "br":
            text.append(" ")
        if tag in VOID or attributes.endswith("/") and tag in ("path", "circle"):
            continue
        if tag in CLOSES:
            close_open(CLOSES[tag])
        if tag in ENDS_P:
            close_open(("p",))
        pending = any(t and not t.isspace() for t in text)
        stack.append(Element(tag, stack[-1], _names(attributes), len(blocks) + pending, len(stack) > DEPTH))
        open_tags[tag] += 1
        has_main = has_main or (tag in ("article", "main") and not stack[-1].dropped)
        if tag in RAW:
            close_at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if tag == "textarea" or tag == "title":
                add(page[at : close_at.start() if close_at else end])
            at = close_at.start() if close_at else end
    flush()
    while len(stack) > 1:
        close()
    if has_main:
        why = [OUTSIDE if w == KEPT and not s else w for w, s in zip(why, scoped, strict=True)]
    return blocks, why, subtrees, _signed(root.digest)


_PARSED = (
    "page_id long, url string, host string, blocks array<string>, why array<tinyint>, "
    "subtrees array<bigint>, firsts array<int>, lasts array<int>, whole bigint"
)
_OUT = "page_id long, url string, text string, n_chars long, n_deleted long, n_recurring long, n_tagged long, n_outside long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = [pa.list_(k) for k in (pa.string(), pa.int8(), pa.int64(), pa.int32(), pa.int32())]
    kinds = [pa.int64(), pa.string(), pa.string(), *lists, pa.int64()]
    names = [c.split()[0] for c in _PARSED.split(", ")]
    for batch in batches:
        ids, urls, hosts, pages = (c.to_pylist() for c in batch.columns)
        found = [parse(p or "") for p in pages]
        spans = [[[s[k] for s in x[2]] for x in found] for k in range(3)]
        columns = [ids, urls, hosts, [x[0] for x in found], [x[1] for x in found], *spans, [x[3] for x in found]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text and counts of each page from its blocks and the ranges that recurrence deletes."""
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]
    names = [c.split()[0] for c in _OUT.split(", ")]
    for batch in batches:
        ids, urls, *rest = (c.to_pylist() for c in batch.columns)
        texts, counts = [], []
        for blocks, why, gone in zip(*rest, strict=True):
            depth = np.zeros(len(blocks) + 1, dtype=np.int64)
            for g in gone or ():
                depth[g["first"]] += 1
                depth[g["last"]] -= 1
            recurs = np.cumsum(depth[:-1]) > 0
            cause = np.array(why, dtype=np.int8)
            # an article is the page's text only if it holds the larger part of the prose that recurrence leaves
            sizes = np.array([len(b) for b in blocks], dtype=np.int64)
            if sizes[(cause == OUTSIDE) & ~recurs].sum() > sizes[(cause == KEPT) & ~recurs].sum():
                cause[cause == OUTSIDE] = KEPT
            texts.append(" ".join([blocks[i] for i in np.flatnonzero((cause == KEPT) & ~recurs)]))
            counts.append([int(x.sum()) for x in ((cause == KEPT) & recurs, recurs, (cause == TAGGED) & ~recurs, (cause == OUTSIDE) & ~recurs)])
        columns = [ids, urls, texts, [len(t) for t in texts], *([c[k] for c in counts] for k in range(4))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def extract(pages: DataFrame, least_pages: int | None = LEAST_PAGES) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, n_deleted, n_recurring, n_tagged, n_outside.

    n_recurring counts the blocks that recurrence deletes on at least least_pages different pages of the host (None: not
    at all), and n_deleted those of them that would else be text; n_tagged and n_outside count the blocks that recurrence
    leaves and that go by tag, role or class name, or as they stand outside the page's article. Null and empty pages
    have empty text; null urls and urls without :// share the empty host. Repeated rows and pages that are alike count as
    one page, and each gets its own row. A page without article or main element is taken as a whole, less its template, and so is
    one whose articles hold the smaller part of the prose that recurrence leaves (a teaser beside the text).
    Markup may be unclosed or cut off. Other columns are not read; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html")
    parsed = cut(rows.mapInArrow(_parse, _PARSED).withColumn("uid", F.monotonically_increasing_id()), "parsed-pages")
    own = parsed.select("page_id", "url", "blocks", "why", "uid")
    if least_pages is None:
        joined = own.withColumn("gone", F.lit(None).cast("array<struct<first:int,last:int>>"))
        return joined.select("page_id", "url", "blocks", "why", "gone").mapInArrow(_assemble, _OUT)
    each = parsed.select("host", "whole", F.explode(F.array_distinct("subtrees")).alias("subtree"))
    # a page and its copies are one voice
    different = each.groupBy("host", "subtree", "whole").agg(F.count("*").alias("copies"))
    template = different.groupBy("host", "subtree").agg(F.count("*").alias("pages"), F.sum("copies").alias("n")).where(F.col("pages") >= least_pages)
    template = cut(template.select("host", "subtree", "n"), "templates")
    ranges = parsed.select("uid", "host", F.explode(F.arrays_zip("subtrees", "firsts", "lasts")).alias("s"))
    inside = ranges.select("uid", "host", F.col("s.subtrees").alias("subtree"), F.col("s.firsts").alias("first"), F.col("s.lasts").alias("last"))
    few = sized(template, MOST_BROADCAST)
    found = hot_join(inside, template, ["host", "subtree"], "n") if few is template else inside.join(few, ["host", "subtree"])
    gone = cut(found.groupBy("uid").agg(F.collect_set(F.struct("first", "last")).alias("gone")), "deleted")
    n_ranges = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    joined = own.join(sized(gone, MOST_BROADCAST) if n_ranges <= MOST_RANGES else gone, "uid", "left")
    return joined.select("page_id", "url", "blocks", "why", "gone").mapInArrow(_assemble, _OUT)

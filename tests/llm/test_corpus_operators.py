"""Corpus operators against plain statements of what they compute, and on awkward tables."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.llm import bpe, common, exact_dedup, html_text, language_id, mixing, near_dedup, quality_classifier, quality_rules, queries, secret_scan, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(40)) for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, equal ids, ties, clashing column names."""
    long = prose(30_000, 1)
    near = prose(200, 2)
    rows = [
        (1, "Same Text", "en", "a", 9),
        (2, "sAME tEXT", "en", "b", 9),
        (2, "sAME tEXT", "en", "b", 9),
        (3, "ÉTÉ", "fr", "a", 3),
        (4, "été", "fr", "a", 3),
        (5, None, None, None, None),
        (6, "", "en", "a", 0),
        (None, "", None, "b", 0),
        (None, "no id", "de", None, 5),
        (7, " \n\t ", "en", "a", 4),
        (8, long, "en", "a", len(long)),
        (9, long, None, "c", len(long)),
        (10, near, "en", "b", 1),
        (11, near.replace("alpha", "ALPHA", 1) + " tail", "en", "b", 1),
        (12, "x" * 5000, "en", "a", 5000),
        (13, "123 456 !!", "en", "a", 10),
        (14, near.replace(" ", "\n", 3), "en", "a", 1),
        (12, "other text under an equal id", "es", "c", 1),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.select(
        "*",
        *[
            F.lit(7).alias(c) for c in (
                "score",
                "keep_id",
                "block",
                "band",
                "key",
                "size",
                "uid",
                "name",
                "n",
                "taken",
                "kept",
                "held_out",
                "root",
                "target"
            )
        ]
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0), (8, 1, 0), (12, 0, 0)],
        "doc_id long, quality int, toxic int"
    )


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_exact_dedup_matches_grouping_by_text(spark, docs, empty):
    groups = defaultdict(list)
    for i, t in plain(docs):
        groups[lowered(t)].append(i)
    for block in (4, 64, exact_dedup.BLOCK):  # small blocks need many rounds
        got = exact_dedup.duplicates(docs, block).collect()
        assert len(got) == docs.count()
        by_hash = defaultdict(list)
        for r in got:
            by_hash[r.text_sha256].append(r)
        for t, ids in groups.items():
            rows = by_hash[hashlib.sha256(t.encode()).hexdigest()]
            top = max((i for i in ids if i is not None), default=None)
            assert [r.group_size for r in rows] == [len(ids)] * len(ids)
            assert {r.keep_id for r in rows} == {top} and sum(r.kept for r in rows) == 1
            assert next(r.doc_id for r in rows if r.kept) == top
    assert exact_dedup.duplicates(empty).count() == 0
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_names_hot_blocks(spark):
    rows = [(i, "the very same text" if i % 3 == 0 else prose(5, i)) for i in range(2000)]
    got = exact_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    hot = [r for r in got.collect() if r.doc_id % 3 == 0]
    assert {r.keep_id for r in hot} == {1998} and {r.group_size for r in hot} == {667}


def jaccard_classes(rows):
    sets, root = {}, {}
    for k, (_, t) in enumerate(rows):
        w = lowered(t).encode().split()
        sets[k] = (tuple(w), {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
        root[k] = k

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            x, y = sets[a], sets[b]
            if x[0] == y[0] or (x[1] and y[1] and len(x[1] & y[1]) >= 0.8 * len(x[1] | y[1])):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(rows))]


@pytest.mark.parametrize("small", [32, 2])
def test_near_dedup_matches_all_pairs(spark, docs, empty, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)  # 2: larger buckets are compared block by block
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base = prose(120, 9).split()
    rng = np.random.default_rng(3)
    edited = []
    for k in range(24):
        w = list(base)
        for i in rng.integers(0, len(w), rng.integers(1, 9)):
            w[i] = f"edit{k}{i}"
        edited.append((100 + k, " ".join(w)))
    rows = [(k, t) for k, (_, t) in enumerate(plain(docs) + edited)]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = jaccard_classes(rows)
    members = defaultdict(list)
    for (i, _), r in zip(rows, want, strict=True):
        members[r].append(i)
    ids = defaultdict(list)
    for r in got:
        ids[(r.class_id, r.class_size)].append(r.doc_id)
    assert sorted(sorted(v) for v in members.values()) == sorted(sorted(v) for v in ids.values())
    assert sum(r.kept for r in got) == len(members) and all(r.class_id == min(v) for (c, _), v in ids.items() for r in got if r.class_id == c)
    assert near_dedup.classes(empty).count() == 0


def test_near_dedup_handles_awkward_rows(docs):
    got = near_dedup.classes(docs).collect()
    assert len(got) == docs.count()
    blank = [r for r in got if r.doc_id in (5, 6, 7)]
    assert len({r.class_id for r in blank}) == 1
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_weighted_similarity_and_registers():
    x, p, y, q = np.array([1, 2, 3]), np.array([1.0, 2.0, 3.0]), np.array([2, 3, 4]), np.array([4.0, 1.0, 2.0])
    u, v = {1: 1, 2: 2, 3: 3}, {2: 4, 3: 1, 4: 2}
    want = sum(1 / sum(max(u.get(j, 0) / u[i], v.get(j, 0) / v[i]) for j in (1, 2, 3, 4)) for i in (2, 3))
    assert near_dedup.probability_jaccard(x, p, y, q) == pytest.approx(want)
    a = near_dedup.signatures(np.array(x, dtype=np.uint64), np.zeros(3, int), p, 1, 4000)
    b = near_dedup.signatures(np.array(y, dtype=np.uint64), np.zeros(3, int), q, 1, 4000)
    assert (a == b).mean() == pytest.approx(want, abs=0.04)


def base_spans(text):
    word = "|".join(
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")
    ) + "|[aA][pP][iI]_?[kK][eE][yY]"
    found = [
        (m.start(), 0, m.end(), "assign") for m in re.finditer(rf"""(?:{word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6
    ]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_scan_matches_plain_regular_expressions(spark, docs, empty):
    hexa, live = "0123456789abcdef" * 2, "Zk3vQ9xLm2Rt7Yp4Wn8BcD5f"
    texts = [
        "🎉 token = abcdef",
        "token=token:abcdef",
        "PassWord: 'x1y2z3' api-key",
        f"é {hexa} api_key={hexa}",
        "AKIA" + "Z" * 16 + " AKIAZ",
        "secret=short",
        f"key {live} end",
        "passwd:abc,secret = 'qwerty'",
        hexa[:23],
        ""
    ]
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts * 2)] + [(90, None, None, None)]
    rows += [(50 + i, f"copied {'Xy7' * 9} here", "en", f"o{i}") for i in range(4)]
    got = {(r.doc_id): r for r in secret_scan.digests(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for i, t, *_ in rows:
        want, r = base_spans(t or ""), got[i]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[3] == k for x in want) for k in ("assign", "access", "hex")]
    assert got[6].spans == "token:4:28"  # one owner's value is added
    assert got[50].spans == ""  # a value of many owners is not
    assert secret_scan.digests(docs).count() == docs.count() and secret_scan.digests(empty).count() == 0


def test_secret_of_two_owners_stays(spark):
    live, wide = "Zk3vQ9xLm2Rt7Yp4Wn8BcD5f", "Xy7" * 9
    rows = [(i, f"key {live} end", "en", f"s{i}") for i in range(secret_scan.COPIED_OWNERS - 1)]
    rows += [(10 + i, f"key {wide} end", "en", f"s{i}") for i in range(secret_scan.COPIED_OWNERS)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: [(f.kind, f.verdict, f.owners) for f in r.findings] for r in secret_scan.scan(table).collect()}
    assert got == {0: [("token", "shared", 2)], 1: [("token", "shared", 2)], 10: [], 11: [], 12: []}
    assert {r.doc_id: r.spans for r in secret_scan.digests(table).collect()} == {0: "token:4:28", 1: "token:4:28", 10: "", 11: "", 12: ""}


def test_url_filter_rules(spark):
    urls = {
        "https://A.Example.ORG/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/19": ("example.org", "/en/19", "example.org/en/1", "block"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://xcom/de/": ("xcom", "/de/", None, "allow"),
        "http://www.cheap-pills.net/a": ("www.cheap-pills.net", "/a", None, "block"),
        "http://spam-farm.org/a": ("spam-farm.org", "/a", "org/", "allow"),
        "no scheme": ("", "", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(urls)] + [(99, None), (0, "https://A.Example.ORG/es/x?q"), (None, None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("token", F.lit("x"))).collect()
    assert len(got) == len(rows)
    want = list(urls.values())
    for r in got:
        h, p, rule, verdict = want[r.page_id] if r.page_id is not None and r.page_id < 90 else ("", "", None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (h, p, rule, verdict)
        assert r.fitted <= r.fetched
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_filter_index_finds_all_that_the_rules_fit(spark):
    hosts = [
        "ad.x.net",
        "ad3.x.net",
        "ads.x.net",
        "ads1.x.net",
        "ADS22.x.net",
        "adds.x.net",
        "ad-s.x.net",
        "x.ads.net",
        "ad3s.x.net",
        "spam-1.x.net",
        "casino2.x.net"
    ]
    rows = [(i, f"http://{h}/p") for i, h in enumerate(hosts)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    fits = re.compile("|".join(f"(?:{r[1]})" for r in url_filter.PATTERN_RULES))
    assert [got[i] for i in range(len(hosts))] == ["block" if fits.search(f"{h.lower()}/p") else "allow" for h in hosts]
    assert [got[i] for i in range(5)] == ["block"] * 5


def test_url_path_stands_at_the_first_scheme_mark(spark):
    urls = {
        "http://a.com?u=http://b.com/de/x": "",
        "http://a.com#http://b.com/de/x": "",
        "http://a.com/fr/?u=http://b.com/de/x": "/fr/",
        "http://a.com/http://b.com/de/": "/http://b.com/de/",
        "x\ny://h/p\nq?r": "/p\nq",
        "z" * 50_000 + "://h?://i/j": "",
        "z" * 50_000: ""
    }
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].path for i in range(len(urls))] == list(urls.values())
    assert got[0].verdict == got[1].verdict == "allow" and got[0].rule is None


def test_html_extraction(spark):
    nav = "<nav><a href=/a>Home</a></nav>"
    body = "<article><h1>Head &amp; line</h1><p><b>One\n two<br>three<p>Four &lt;five&gt;</article>"
    promo = "<div><div>Buy our great new things now</div></div>"
    pages = [
        (
            i,
            f"http://h.com/{i}",
            f"<html><head><title>T</title><style>p</style></head><body>{nav}{promo}<div><p>Unique text number {i}.</p></div><footer>f</footer></body>"
        ) for i in range(8)
    ]
    pages += [
        (20, "http://h.com/x", f"<body>{nav}<div class='ad'>Buy</div>{body}<div class=comments>me too</div><script>var a='</p>'</script>"),
        (21, None, None),
        (22, "", ""),
        (23, "http://o.com", "<p>cut off &am"),
        (24, "http://o.com", "a < b <i>c</i><form>x</form>"),
        (20, "http://h.com/x", body)
    ]
    got = defaultdict(list)
    for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("blocks", F.lit(1))).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r)
    for i in range(8):
        assert got[i][0].text == f"Unique text number {i}." and got[i][0].n_deleted == 1
    assert [r.text for r in got[20]] == ["Head & line One two three Four <five>"] * 2
    assert [got[k][0].text for k in (21, 22, 23, 24)] == ["", "", "cut off &am", "a < b c"]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mixing(spark, docs, empty):
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == docs.count()
    for r, again in zip(sorted(mixed, key=str), sorted(mixing.mix(docs).collect(), key=str), strict=True):
        assert r == again
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in mixed:
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(s.words for s in r.segments)
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, free, want = {s: i % 3 + 1 for i, s in enumerate(order)}, set(order), {}
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in order if s not in free)
        want = {s: rest * weight[s] / sum(weight[f] for f in free) if s in free else 3 * size[s] for s in order}
        over = {s for s in free if want[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        free -= over
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 0.5
    assert mixing.mix(empty).count() == 0
    assert mixing.mixture(docs).columns == docs.columns


def test_splitting_tree_is_exact(spark):
    table = spark.createDataFrame([("a", 1000), ("b", 37), (None, 0), ("c", 5)], "source string, blocks long")
    rows = {r.source: r.quotas for r in mixing.split(table, 8, 3).collect()}
    assert {k: sum(v) for k, v in rows.items()} == {"a": 1000, "b": 37, None: 0, "c": 5}
    shards = [sum(v[i] for v in rows.values()) for i in range(8)]
    assert max(shards) - min(shards) <= 2


def test_hypergeometric_quantiles(spark):
    from math import comb

    n, good, draws = 60, 25, 18
    u = [(i + 0.5) / 200 for i in range(200)]
    frame = spark.createDataFrame([(x,) for x in u], "u double").select(
        mixing._hypergeometric(F.lit(n), F.lit(good), F.lit(draws), F.col("u")).alias("k"),
        "u"
    )
    for r in frame.collect():
        total, k = 0.0, 0
        for k in range(draws + 1):
            total += comb(good, k) * comb(n - good, draws - k) / comb(n, draws)
            if total > r.u:
                break
        assert r.k == k


def test_bpe_matches_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    texts = [
        "",
        " ",
        "aaaaaaaaaaaa aaa",
        "<|endoftext|>a<|endoftext|>",
        "日本語 🎉🎉",
        " \n\n x\t\ty ",
        "it's we'll I'D",
        "é̈ Ⅷ ½ ٣",
        "ab" * 3000,
        "\x00\x01 \x85"
    ]
    frame = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    for r in bpe.digests(frame).collect():
        e = lib.encode(texts[r.doc_id] if r.doc_id < 90 else "", add_special_tokens=False)
        assert r.n_tokens == len(e.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame)).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert bpe.digests(docs).count() == docs.count() and bpe.digests(empty).count() == 0


def test_bpe_forgets_at_its_bound(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    own, fresh = bpe.Tokenizer(bpe.default_path()), bpe.Tokenizer(bpe.default_path())
    texts = [prose(60, k) for k in range(5)]
    assert [next(own.encode([t])) for t in texts] == [next(fresh.encode([t])) for t in texts]


def statistics_by_loops(text):
    """The base statistics of one text by plain loops."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup, size = set(), 0, quality_rules.WINDOW
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + size)}
    return len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text), dup, len(covered)


def test_quality_statistics_match_plain_loops(spark, docs, empty, labels):
    texts = ["a b c d e f g h a b c d e f g h", "x\nx\n\n x\nx", "# * $ |\n<a>", "\x1c a\x85b", "é" * 10, "w " * 50, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judge(frame, labels).collect():
        want = statistics_by_loops(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert quality_rules.judge(docs, labels).count() == docs.count() and quality_rules.judge(empty, labels).count() == 0


def test_decision_list_covers_what_it_can():
    rng = np.random.default_rng(0)
    x = rng.random((900, 2))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 1] > 0.95)
    rules = quality_rules.learn(x, bad, ["symbols", "upper"])
    hit = np.zeros(len(x), dtype=bool)
    for r in rules:
        hit |= quality_rules._hits(r, x, ["symbols", "upper"])
    assert hit[bad].mean() > 0.9 and hit[~bad].mean() < 0.03
    assert quality_rules.learn(x, np.zeros(len(x), dtype=bool), ["symbols", "upper"]) == []


def test_classifier_learns_and_scores_all(spark, docs, empty, labels):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(300):
        junk = i % 4 == 0
        words = prose(int(rng.integers(20, 80)), i).split()
        rows.append((i, " ".join(w + "!!" if junk else w for w in words)))
        marks.append((i, 0 if junk else 1, 0))
    frame, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.classify(frame, marked).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([(got[i].score >= 0.5) == (i % 4 != 0) for i in held]) > 0.95
    out = quality_classifier.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_classifier.classify(empty, labels).count() == 0
    assert quality_classifier.classify(docs, labels.where("false")).count() == docs.count()


def test_long_texts_score_like_short_ones(monkeypatch):
    net = quality_classifier.fit([b"good text", b"bad!!"] * 20, np.array([1.0, 0.0] * 20), epochs=1)
    text = prose(4000, 5).encode()
    whole = quality_classifier.score_texts(net, [text])
    monkeypatch.setattr(quality_classifier, "_STEP", 1000)
    assert quality_classifier.score_texts(net, [text]) == pytest.approx(whole)


def test_classifier_gradients():
    rng = np.random.default_rng(0)
    texts, y = [prose(9, k).encode() for k in range(4)], np.array([1.0, 0, 1, 0])
    net = {k: np.asarray(v, dtype=np.float64) for k, v in quality_classifier.fit(texts, y, epochs=1).items()}
    loss = lambda: -np.mean([np.log(p if t else 1 - p) for p, t in zip(quality_classifier.forward(net, texts)[0], y, strict=True)])
    grads = quality_classifier._step_batch(net, texts, y, np.ones(4))
    for name in ("first", "second", "embed", "out", "bias"):
        at = tuple(rng.integers(0, s) for s in net[name].shape) if name != "embed" else (ord("a"), 3)
        kept = net[name][at]
        net[name][at] = kept + 1e-5
        up = loss()
        net[name][at] = kept - 1e-5
        down = loss()
        net[name][at] = kept
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_language_id(spark, docs, empty):
    pieces = {"en": "the and of with that", "fr": "le que être où élève", "de": "und ß über nicht ein"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(pieces[l].split(), 30)), l) for i, l in enumerate(list(pieces) * 60)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 !!", "fr"), (903, "le que", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, _, l in rows[:-4]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].lang_pred == l and 0.9 < got[i].score <= 1
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "fr"]
    out = language_id.identify(docs).collect()
    assert len(out) == docs.count() and {r.lang_pred for r in out if r.doc_id in (5, 6, 7, 13)} == {"und"}
    assert language_id.identify(empty).count() == 0
    assert language_id.keep_known(docs).where("doc_id in (5, 6, 7, 13)").count() == 0


def grams_by_loop(text):
    t = [c + 32 if 65 <= c <= 90 else c for c in map(ord, text)]
    out = defaultdict(int)
    for n in language_id.ORDERS:
        for i in range(len(t) - n + 1):
            code = 0
            for c in t[i : i + n]:
                code = (code * int(language_id._BASE) + c + 1) % 2**64
            out[code * int(language_id._SPREAD) % 2**64 * language_id.BUCKETS >> 64] += 1
    return out


def test_language_grams_are_characters_of_one_text(monkeypatch):
    texts = ["Ab", "", "語言識別測試", "x", "où élève 🎉", "abcdefghijklmnopqrstuvwxyz" * 3]
    for step in (7, 300_000):  # short steps cut texts into parts
        monkeypatch.setattr(language_id, "_STEP", step)
        got = [defaultdict(int) for _ in texts]
        for flat, owner, fresh in language_id._pieces(texts):
            for at, grams in language_id._grams(flat, owner, fresh):
                for i, g in zip(owner[at], grams, strict=True):
                    got[i][int(g)] += 1
        assert got == [grams_by_loop(t) for t in texts]


def test_language_scores_do_not_depend_on_neighbours(spark):
    rows = [(i, "the cat of that hat" if i % 2 else "le chat où être élève", "en" if i % 2 else "fr") for i in range(40)]
    langs, logs = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    texts = ["the", "où", "語", "that chat", "le"]

    def scored(order):
        rows = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").coalesce(1)
        return {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(rows, (langs, logs), F.lit(True)).collect()}

    alone = {i: scored([i])[i] for i in range(len(texts))}
    assert scored([0, 1, 2, 3, 4]) == scored([4, 2, 0, 3, 1]) == alone


def test_queries_run_and_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        rows = sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) if name != "op2_url_filter" else sorted(
            (str(tuple(r[c] for c in sorted(got.columns))) for r in got.collect())
        )
        cols = ", ".join(f'"{c}"' for c in sorted(want.columns))
        expected = con.sql(f"SELECT {cols} FROM ({sql})").fetchall()
        assert rows == (sorted(expected) if name != "op2_url_filter" else sorted(map(str, expected)))


def test_hot_join_equals_join(spark):
    rows = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("hot"), "id").selectExpr("if(hot = 1, -1, id) as k", "id")
    names = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = {(r.id, r.top) for r in common.hot_join(rows, names, ["k"], "n").collect()}
    assert got == {(r.id, r.top) for r in rows.join(names, "k").collect()} and len(got) == 3000


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = p.STAGES[0][1](spark, docs, SF)
    assert known.columns == docs.columns and known.count() == docs.where("text rlike '\\\\p{L}'").count()
    exact = p.STAGES[1][1](spark, docs, SF)
    assert exact.count() == len({lowered(t) for _, t in plain(docs)})
    near = p.STAGES[2][1](spark, docs, SF)
    assert near.count() == len(set(jaccard_classes(plain(docs))))
    assert p.STAGES[3][1](spark, docs, SF).columns == docs.columns
    out = p.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert json.dumps([n for n, _ in p.STAGES])

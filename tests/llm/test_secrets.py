"""Secrets against nested loops over the given documents, and on awkward texts."""

import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from marketweave.llm import secret_scan

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string"


def spans_of(text):
    """(start, kind's place, end, kind, value) of all candidates by Python's own expressions, less what touches a base span."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(secret_scan.PATTERNS):
        for m in re.finditer(pattern, text):
            value = m[1] if group else m[0]
            if len(value) >= least:
                out.append((m.start(), k, m.end(), kind, value))
    base = [s for s in out if s[1] < 3]
    return base + [s for s in out if s[1] >= 3 and not any(b[0] < s[2] and s[0] < b[2] for b in base)]


def plain_scan(docs):
    """kind:start:end of each document by nested loops."""
    found = {i: spans_of(t or "") for i, t, _, _ in docs}
    owners = defaultdict(set)
    for i, _, _, source in docs:
        for s in found[i]:
            owners[s[4]].add(source)
    out = {}
    for i, spans in found.items():
        kept = sorted((s for s in spans if s[1] < 3 or len(owners[s[4]]) < secret_scan.COPIED_OWNERS), key=lambda s: (s[0], -s[2], s[1]))
        kept = [s for n, s in enumerate(kept) if s[1] < 3 or not any(o[2] >= s[2] for o in kept[:n])]
        out[i] = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in sorted(kept))
    return out, owners


def test_scan_equals_nested_loops_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    want, owners = plain_scan(rows)
    got = {r.doc_id: r for r in secret_scan.digests(docs).collect()}
    assert {i: r.spans for i, r in got.items()} == want
    assert sum(r.n_added for r in got.values()) > 10  # what one owner or two hold is added
    copied = {v for v, o in owners.items() if len(o) >= secret_scan.COPIED_OWNERS}
    texts = {r[0]: r[1] for r in rows}
    added = {
        texts[i][int(a) : int(b)] for i,
        r in got.items() for k,
        a,
        b in (x.split(":") for x in filter(None, r.spans.split(","))) if k == "token"
    }
    assert added and not added & copied


def test_further_kinds(spark):
    live = "Zk3vQ9xLm2Rt7Yp4Wn8BcD5f"
    texts = {
        0: ("pwd = hunter2hunter", ["keyed:0:19"]),
        1: (f"Authorization: Bearer {live}", ["keyed:15:46"]),
        2: ("bob@mail.example.com:s3cret!pw and", ["pair:3:30"]),
        3: ("mail bob@mail.example.com:8080 now", []),
        4: ("ghp_abcdefghijklmnopqrst0123 é", ["prefixed:0:28"]),
        5: ("-----BEGIN RSA PRIVATE KEY-----\nAAAA\nBBBB==\n-----END", None),
        6: ("card 9807915762804490.", ["token:5:21"]),
        7: ("a report-2024-final-version-of-2025 text", []),
        8: (f"token = {live}", ["assign:0:32"]),
        9: ("x" * 400_000 + "1234" + "y" * 10, ["token:0:400014"]),
    }
    got = {r.doc_id: r.spans for r in secret_scan.digests(spark.createDataFrame([(i, t, "en", "s") for i, (t, _) in texts.items()], DOCS)).collect()}
    for i, (t, want) in texts.items():
        assert got[i] == plain_scan([(i, t, "en", "s")])[0][i], t[:60]
        if want is not None:
            assert got[i] == ",".join(want), t[:60]
    assert got[5].startswith("prefixed:0:")


def test_text_with_very_many_matches(spark):
    hexes = " ".join(f"{i:032x}" for i in range(60_000))
    began = time.time()
    r = secret_scan.digests(spark.createDataFrame([(1, hexes, "en", "s")], DOCS)).first()
    assert r.n_hex == 60_000 and r.spans.startswith("hex:0:32,hex:33:65,") and r.spans.endswith(f"hex:{59_999 * 33}:{60_000 * 33 - 1}")
    assert time.time() - began < 60


def test_repositories_count_once(spark):
    rows = [(0, "token = abcdef1", "en", "o1"), (1, "token = abcdef1", "en", "o2"), (2, "token = abcdef1", "en", None)]
    table = spark.createDataFrame(rows, DOCS).withColumn("uid", F.lit(1))
    got = secret_scan.scan(table, repository=F.lit("one")).collect()
    assert {(f.repositories, f.owners, f.seen, f.verdict) for r in got for f in r.findings} == {(1, 3, 3, "copied")}


def test_long_runs_of_names_take_linear_time(spark):
    """A megabyte of names without a digit, and one with a digit at the end: seconds, and a value is still found."""
    runs = ["auth:" * 200_000, "auth:" * 200_000 + "k3yvalue9"]
    rows = spark.createDataFrame([(k, t, "s", "en") for k, t in enumerate(runs)], "doc_id long, text string, source string, lang string")
    began = time.time()
    got = {r.doc_id: r.spans for r in secret_scan.digests(rows).collect()}
    assert time.time() - began < 60
    assert got[0] == "" and got[1].endswith(f":{len(runs[1])}")

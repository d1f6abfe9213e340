"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Fixed patterns give base spans of three kinds. Beside them, further candidates are looked for: values behind other
key-like names, known prefixes and private keys, passwords behind mail addresses, and unlabelled runs that look random.
The hash of every value found is aggregated over the whole corpus by distinct repositories and owners: a value seen
under many owners is a copied example, one that fewer hold may be live. Candidates that are not copied are added as spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, hot_join

#: Patterns and least lengths of the base kinds (fixed values); the length of assign is that of its second group.
_WORDS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = f"""(?:{_WORDS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Values behind other names for keys; the value is the first group, with a digit among its first 513 characters (a bound
#: that keeps a long run of names without digits from being read again for each name).
_NAMES = "pwd|passphrase|credentials?|auth|authorization|bearer|access_?key|private_?key|client_?secret|conn(?:ection)?_?string"
KEYED = rf"""(?i)(?<![a-z0-9])(?:{_NAMES})["']?\x20{{0,8}}(?:[:=]|\x20)\x20{{0,8}}["']?((?=[^\s"',;0-9]{{0,512}}+[0-9])[^\s"',;]{{8,}}+)"""
#: A password behind a mail address or a user's name in a URL; the value is the first group.
PAIR = r"(?:@[A-Za-z0-9.-]{1,80}\.[A-Za-z]{2,20}|://[A-Za-z0-9._-]{1,80}):((?=[^\s@/:]*[^0-9\s@/:])[^\s@/:]{6,})"
#: Known prefixes and the head of a private key.
PREFIXED = (
    r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_.-]{10,})|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*"
)
#: An unlabelled run: 24 or more characters with a small letter, a capital and a digit, or 16 or more letters and digits
#: of which at least four are digits (keys in one case, account and card numbers).
TOKEN = (
    r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{24,}"
    r"|(?=(?:[A-Za-z]*+[0-9]){4})[A-Za-z0-9]{16,}+(?![+/_=-]))"
)
#: Kinds, pattern, whether the value is the first group, and the value's least length; the first three are base kinds.
PATTERNS = (
    ("assign", ASSIGN, True, ASSIGN_LEAST),
    ("access", ACCESS, False, 0),
    ("hex", HEX, False, 0),
    ("keyed", KEYED, True, 0),
    ("pair", PAIR, True, 0),
    ("prefixed", PREFIXED, False, 0),
    ("token", TOKEN, False, 0),
)
KINDS = tuple(p[0] for p in PATTERNS)
BASE = KINDS[:3]
#: From this number of distinct owners on, a value is a widely copied example.
COPIED_OWNERS = 3


def _pieces(text: Column, pattern: str, group: bool) -> Column:
    """Array of (gap, length, value) of a pattern's matches, left to right: the characters between a match and the one
    before it, those of the match, and its value. A text without a match costs one search."""
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})") if not group else F.lit(pattern), F.lit(0))
    both = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("before"), matches.alias("match")), lambda x: x["match"].isNotNull())
    value = lambda m: F.regexp_extract(m, pattern, 1) if group else m
    found = F.transform(
        both,
        lambda x: F.struct(F.length(x["before"]).alias("gap"), F.length(x["match"]).alias("length"), value(x["match"]).alias("value"))
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<gap:int,length:int,value:string>>"))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ranked = F.transform(
        spans,
        lambda x: F.struct(x["start"].alias("start"), _rank(x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))
    )
    return F.array_join(
        F.transform(F.array_sort(ranked), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))),
        ","
    )


def candidates(docs: DataFrame, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    """Two tables: uid and doc_id of each row, and the spans found: uid, owner, repository, kind, start, end, value_hash.

    Base spans are all there; of the others, those that touch no base span. Positions are running sums over a row's
    matches, so that a text with very many matches costs no more than its length.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        owner.alias("owner"),
        repository.alias("repository"),
        text.alias("text")
    )

    def named(kind: str, found: Column) -> Column:
        value = lambda x: F.sha2(x["value"].cast("binary"), 256).alias("value_hash")
        parts = lambda x: (x["gap"].alias("gap"), x["length"].alias("length"), F.length(x["value"]).alias("size"), value(x))
        return F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), *parts(x)))

    found = [named(k, _pieces(F.col("text"), p, g)) for k, p, g, _ in PATTERNS]
    rows = cut(rows.select("uid", "doc_id", "owner", "repository", F.concat(*found).alias("found")), "secrets")
    each = rows.where(F.size("found") > 0).select(
        "uid",
        "owner",
        "repository",
        F.explode("found").alias("f")
    ).select("uid", "owner", "repository", "f.*")
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    least = F.element_at(F.create_map(*[F.lit(x) for k, _, _, n in PATTERNS for x in (k, n)]), F.col("kind"))
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).where(F.col("size") >= least)
    base = F.col("kind").isin(*BASE)
    # a span touches one of those that begin before it, or one of those that begin later
    up = Window.partitionBy("uid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("uid").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.max(F.when(base, F.col("end"))).over(up)).withColumn("next", F.min(F.when(base, F.col("start"))).over(down))
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return rows.select("uid", "doc_id"), spans.where(base | free).select("uid", "owner", "repository", "kind", "start", "end", "value_hash")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, seen, repositories, owners over the whole corpus; null owners or repositories count as one each."""
    once = found.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("seen"))
    different = lambda c: F.count_distinct(F.struct(c)).alias(f"{c[:-1]}ies" if c.endswith("y") else f"{c}s")
    return once.groupBy("value_hash").agg(F.sum("seen").alias("seen"), different("repository"), different("owner"))


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per row of docs: doc_id, findings; findings is an array of (kind, start, end, value_hash, seen,
    repositories, owners, verdict), ordered by start.

    verdict is copied (at least copied_owners owners hold the value), owned (one owner does) or shared. Base spans are
    always there; all other kinds unless copied or inside another span.
    owner is the column source and repository is source with lang, unless given. Null texts count as empty and have no
    finding. Repeated rows are judged each for itself, and count once in owners. A value that very many rows hold is
    joined by broadcast. Other columns are not read; an empty table gives an empty result.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if repository is None else repository
    rows, each = candidates(docs, owner, repository)
    each = cut(each, "spans")
    known = cut(ownership(each), "ownership")
    judged = hot_join(each.select("uid", "kind", "start", "end", "value_hash"), known, ["value_hash"], "seen", "left")
    judged = judged.withColumn("verdict", F.when(F.col("owners") >= copied_owners, "copied").when(F.col("owners") == 1, "owned").otherwise("shared"))
    base = F.col("kind").isin(*BASE)
    # what lies inside another span is left out
    order = Window.partitionBy("uid").orderBy("start", F.col("end").desc(), _rank(F.col("kind"))).rowsBetween(Window.unboundedPreceding, -1)
    kept = judged.where(base | (F.col("verdict") != "copied")).withColumn("reached", F.max("end").over(order))
    kept = kept.where(base | (F.coalesce("reached", F.lit(0)) < F.col("end")))
    finding = F.struct("start", _rank(F.col("kind")).alias("k"), "end", "kind", "value_hash", "seen", "repositories", "owners", "verdict")
    # the findings of one document are bounded by its own text
    per_row = kept.groupBy("uid").agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    out = rows.join(per_row, "uid", "left")
    return out.select("doc_id", F.coalesce("findings", F.array().cast(per_row.schema["findings"].dataType)).alias("findings"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_owned, n_copied of each row; see scan."""
    found = scan(docs)
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    verdict = lambda v: F.size(F.filter("findings", lambda x: x["verdict"] == v)).cast("long")
    base = _joined(F.filter("findings", lambda x: x["kind"].isin(*BASE)))
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in BASE],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
        F.size(F.filter("findings", lambda x: ~x["kind"].isin(*BASE))).cast("long").alias("n_added"),
        verdict("owned").alias("n_owned"),
        verdict("copied").alias("n_copied"),
    )

"""The manifest against a plain recursion over lists."""

import hashlib
import random
import zlib

import pytest

from marketweave.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, bare=False):
    values = [*row[:4], row[4].replace("\n", "") if bare and row[4] is not None else row[4]]
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves):
    """The root, and each leaf's siblings to the left and right by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for k in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            begin = k // 3 * 3
            path.append((level[begin:k], level[k + 1 : begin + 3]))
            k //= 3
        paths.append(path)
    return levels[-1][0], paths


def manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    ordered = [sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names]
    trees = [tree([leaf(r) for r in g]) for g in ordered]
    root, over = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(ordered, trees, over, strict=True):
        for r, path in zip(g, paths, strict=True):
            every = [*path, *top]
            folded = leaf(r, bare=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0)
            for left, right in every:
                folded = h([*left, folded, *right])
            proof = h(x for left, right in every for x in [*left, *right])
            out.append((r[0], leaf(r), subroot, root, proof, folded, folded == root))
    return out


@pytest.mark.parametrize("depth", [7, 1, 2])
def test_manifest_equals_recursion(spark, depth):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "a", "é", "B", None]), rng.choice(["x", None]), rng.choice([7, None]), rng.choice(["one\ntwo", "ñ", "", "\n", None])) for k in range(150)]
    rows += [(1000, "alone", "x", 1, "a\nb"), (None, "a", None, None, "t\n"), (None, "a", None, None, "t\n"), (None, None, None, None, None), (-5, "a", "y", -1, "z\n")]
    rows += [rows[3], rows[3], (3, rows[3][1], "other", 0, "a\n" * 50_000)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place string")
    got = merkle.manifest(table, depth).drop("proof").collect()
    order = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(manifest(rows), key=order)


def test_one_row_and_empty_table(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    (got,) = merkle.manifest(spark.createDataFrame([(4, "s", "en", 2, "a\n")], kind)).collect()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.manifest(spark.createDataFrame([], kind)).count() == 0


def test_sweeps_of_a_block():
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(25)]
    nodes = merkle.sweep(leaves, merkle.steps(25))
    root, paths = tree([x.hex() for x in leaves])
    assert nodes[-1][0].hex() == root
    for k, proof in enumerate(merkle.sweep_back(nodes, b"")):
        assert [([x.hex() for x in a], [x.hex() for x in b]) for a, b in merkle.siblings(proof)] == paths[k]
        assert merkle.fold(leaves[k], proof).hex() == root

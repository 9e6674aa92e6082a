"""The Merkle manifest against a plain tree: odd counts, one leaf, repeated rows, nulls, other arities, damage."""

import hashlib
import random
import zlib

import pytest

pytest.importorskip("plainspoke.llm")
from plainspoke.llm import merkle  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

DOC = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path string, rank long, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, arity):
    """The root and, for every leaf, its (before, after) level by level."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at : at + arity]
            for k in range(len(run)):
                for i in groups[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            over.append([i for g in groups[at : at + arity] for i in g])
        nodes, groups = up, over
    return nodes[0], paths


def plain_manifest(rows, arity):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))):
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([plain_leaf(r) for r in by[x]], arity) for x in langs}
    root, upper = plain_tree([trees[x][0] for x in langs], arity)
    out = []
    for x, up in zip(langs, upper, strict=True):
        for r, path in zip(by[x], trees[x][1], strict=True):
            whole = path + up
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            got = plain_leaf((*r[:3], r[3] + 1, r[4])) if touched else plain_leaf(r)
            for a, b in whole:
                got = h(a, got, b)
            out.append((r[0], plain_leaf(r), trees[x][0], root, h(*(a + b for a, b in whole)), got, got == root))
    return sorted(map(repr, out))


def rows_of(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", None, "ü"]), rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([None, 7]), rng.choice([None, "", "text", "größer " * 50])) for i in rng.sample(range(10 * n), n)]
    return rows + rows[:3] + [(rows[0][0], "other", rows[0][2], 1, "same id")] + [(None, None, "en", None, "no id"), (5, "x", "zz", 3, "a tree of one")]


@pytest.mark.parametrize(("n", "arity", "levels"), [(100, 2, 8), (90, 2, 2), (150, 3, 2)])
def test_manifest_against_a_plain_tree(spark, n, arity, levels):
    rows = rows_of(n, n)
    docs = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], DOC).repartition(5)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(docs, merkle.leaf(n_chars=F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))), arity, levels)
    got = sorted(repr(tuple(r)) for r in out.collect())
    assert got == plain_manifest(rows, arity) and "False" in "".join(got)


def test_empty_and_lone(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).collect() == []
    (r,) = merkle.manifest(spark.createDataFrame([(1, None, None, None, None, "", "", 0, "")], DOC)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == h("")


def test_intervals_nest(spark):
    nodes = spark.range(11).select(F.lit("t").alias("tree"), F.col("id").alias("rank"), F.lit(11).alias("size"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    at = nodes.select("tree", "rank", "digest", merkle.depth(F.col("size")).alias("deep"))
    got = {(r.level, r.lo, r.hi) for r in merkle.intervals(merkle._above(at, 0, 2, 8), 0).collect()}
    assert got == {(1, 0, 2), (1, 2, 4), (1, 4, 6), (1, 6, 8), (1, 8, 10), (1, 10, 11), (2, 0, 4), (2, 4, 8), (2, 8, 11), (3, 0, 8), (3, 8, 11), (4, 0, 11)}

"""Merkle manifest of a dataset: nested-interval labels, containment joins, inclusion proofs.

Leaves get a rank within their tree, and every node carries the interval [lo, hi)
of leaf ranks that it covers. ``ARITY`` consecutive nodes make a parent, so a
parent's interval is the union of its children's. The tree is built in tiers of
``LEVELS`` levels: the nodes of one bucket (the interval that one node at the
tier's top covers, at most ``ARITY ** LEVELS`` of them) meet in one shuffle and
their ancestors are hashed there. A containment join, bucketed by tier and top
interval, attaches to each node the parents whose intervals hold its own; what
a parent's interval covers besides the node's own child are its siblings. The
tiers' paths are joined from the top down, so a leaf gets all levels in as many
joins as there are tiers.

Ranks come from a range-partitioned sort: places within the partitions plus the
counts of the partitions before, so that no window holds a whole tree. Texts are
hashed where they are read and never shuffled.

Defined results: null columns are written as ``-``, empty texts as ``0:``; a null
language is a tree of its own, sorted first. Of equal ids, null ids first, the
smaller leaf digest comes first; repeated rows are leaves of their own with equal
digests (and proofs by their places). Tampering where ``n_chars`` is null changes
nothing. An empty table has no leaf and no root. Very long texts are hashed whole.
No other column is read, whatever it is called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

ARITY, LEVELS = 2, 8
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def digest(*values: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the concatenated values."""
    return F.sha2(F.concat(*(v.cast("binary") for v in values)), 256)


def framed(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The leaf digest of a row, with some of its columns replaced."""
    return digest(*(framed(changed.get(c, F.col(c))) for c in FIELDS))


def ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``rank``, the place (from 0) in its tree by ``order`` (nulls first), and ``size``, the tree's number of rows; written.

    Rows are dealt by ranges of (tree, order) and numbered within partitions;
    what comes before is added from one count for each partition and tree.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # deals out rows that repeat
    dealt = tied.repartitionByRange(*keys, F.col("_tie").asc()).sortWithinPartitions(*keys, "_tie").drop("_tie")
    placed = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    parts = placed.groupBy(F.col(tree).alias("_t"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # One row for each partition and tree: a window over a tree holds as many rows as there are partitions.
    of = Window.partitionBy("_t")
    before = parts.select("_t", "_p", "_first", (F.sum("_n").over(of.orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(of).alias("size"))
    met = placed.join(before, placed[tree].eqNullSafe(before["_t"]) & (placed["_part"] == before["_p"]))
    return met.withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_t", "_p", "_first", "_before", "_part", "_at")


def depth(size: Column, arity: int = ARITY) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves: how often the nodes are grouped until one is left."""
    return reduce(lambda got, k: got + (size > F.lit(arity**k)).cast("int"), [k for k in range(63) if arity**k < 1 << 63], F.lit(0))


def _levels(nodes: Column, levels: Column, arity: int) -> Column:
    """From a bucket's digests, in order: the digests of each level, from these on up."""
    grouped = lambda a: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(a) - 1) / arity).cast("int")), lambda i: F.sha2(F.array_join(F.slice(a, i * arity + 1, F.lit(arity)), "").cast("binary"), 256)
    )
    return F.reduce(F.sequence(F.lit(1), levels), F.array(nodes), lambda got, _: F.concat(got, F.array(grouped(F.element_at(got, -1)))))


def _above(nodes: DataFrame, tier: int, arity: int, levels: int) -> DataFrame:
    """The buckets of one tier: (tree, deep, bucket, up), ``up`` holding the digests of each level from the tier's nodes on."""
    own = nodes.where(F.col("deep") > tier * levels).withColumn("bucket", F.floor(F.col("rank") / arity**levels))
    gathered = own.groupBy("tree", "deep", "bucket").agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("_n"))  # arity ** levels at most
    return gathered.select("tree", "deep", "bucket", _levels(F.col("_n.digest"), F.least(F.lit(levels), F.col("deep") - tier * levels), arity).alias("up"))


def intervals(buckets: DataFrame, tier: int, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """The parents of one tier: (tree, bucket, level, lo, hi, digest, children), intervals counted in nodes of the tier below it."""
    each = buckets.select("tree", "bucket", F.size(F.col("up")[0]).alias("_n"), "up", F.explode(F.sequence(F.lit(1), F.size("up") - 1)).alias("_l")).select("*", F.posexplode(F.element_at("up", F.col("_l") + 1)).alias("_i", "digest"))
    width = F.pow(F.lit(arity), F.col("_l")).cast("long")
    base = F.col("bucket") * arity**levels
    children = F.slice(F.element_at("up", F.col("_l")), F.col("_i") * arity + 1, F.lit(arity))
    return each.select("tree", "bucket", (F.col("_l") + tier * levels).alias("level"), (base + F.col("_i") * width).alias("lo"), (base + F.least(F.col("_n").cast("long"), (F.col("_i") + 1) * width)).alias("hi"), (width / arity).cast("long").alias("step"), "digest", children.alias("children"))


def _paths(nodes: DataFrame, parents: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes`` of a tier that have parents, with their bucket and ``part``: what stands before and after them in each parent, level by level.

    The grouping's keys hold the join's, so no row moves after the join.
    """
    own = nodes.withColumn("bucket", F.floor(F.col("rank") / arity**levels))
    held = own.join(parents.drop("digest"), ["tree", "bucket"]).where((F.col("lo") <= F.col("rank")) & (F.col("rank") < F.col("hi")))
    child = F.floor((F.col("rank") - F.col("lo")) / F.col("step")).cast("int")  # the own child's place; the interval's rest are the siblings
    beside = F.struct("level", F.array_join(F.slice("children", F.lit(1), child), "").alias("before"), F.array_join(F.slice("children", child + 2, F.lit(arity)), "").alias("after"))
    sides = F.transform(F.array_sort(F.collect_list(beside)), lambda s: F.struct(s["before"].alias("before"), s["after"].alias("after")))
    return held.groupBy("tree", "bucket", *(c for c in own.columns if c not in ("tree", "bucket"))).agg(sides.alias("part"))


class Forest:
    """Trees over ``nodes`` (tree, rank, size, digest and any others; tree not null), built tier by tier. ``roots`` are (tree, root)."""

    def __init__(self, nodes: DataFrame, name: str, arity: int = ARITY, levels: int = LEVELS):
        self.arity, self.levels = arity, levels
        at = nodes.withColumn("deep", depth(F.col("size"), arity)).drop("size")
        deepest = at.agg(F.max("deep")).first()[0] or 0
        self.tiers, roots = [], [at.where("deep = 0").select("tree", F.col("digest").alias("root"))]
        for tier in range(-(-deepest // levels)):
            buckets = written(_above(at, tier, arity, levels), f"{name}-buckets")
            self.tiers.append((at, buckets))
            at = buckets.select("tree", "deep", F.col("bucket").alias("rank"), F.element_at(F.element_at("up", -1), 1).alias("digest"))
            roots.append(at.where(F.col("deep") <= (tier + 1) * levels).select("tree", F.col("digest").alias("root")))
        self.last, self.roots = at, reduce(DataFrame.unionByName, roots)

    def proofs(self, above: DataFrame) -> DataFrame:
        """The nodes with ``path``, what stands beside their ancestors from the leaves up, and the columns of ``above`` (tree, path, ...), one row a tree, whose path goes on from the root."""
        more = [c for c in above.columns if c not in ("tree", "path")]
        got = self.last.drop("deep").join(above, "tree")
        for tier in reversed(range(len(self.tiers))):
            at, buckets = self.tiers[tier]
            inner, lone = F.col("deep") > tier * self.levels, F.col("deep") <= tier * self.levels
            own = _paths(at.where(inner).drop("deep"), intervals(buckets, tier, self.arity, self.levels), self.arity, self.levels)
            up = got.select("tree", F.col("rank").alias("bucket"), F.col("path").alias("_up"), *more)
            some = own.join(up, ["tree", "bucket"]).withColumn("path", F.concat("part", "_up")).drop("bucket", "part", "_up")
            got = some.unionByName(at.where(lone).drop("deep").join(above, "tree"))
        return got


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.reduce(path, start, lambda got, s: F.sha2(F.concat(s["before"], got, s["after"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """For every row of ``docs``: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    Trees are the languages; their roots make one more tree. ``tampered`` is the
    leaf's digest as somebody hands it in for checking, by default the leaf itself.
    """
    known = leaf()
    rows = docs.select("doc_id", "lang", known.alias("digest"), F.when((tampered if tampered is not None else known) != known, tampered if tampered is not None else known).alias("given"))
    # Leaves are (tree, rank, size, doc_id, digest, given); only their digests and places move from here on.
    leaves = written(ranked(rows, "lang", "doc_id", "digest").withColumn("tree", F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit(""))).drop("lang"), "leaves")
    trees = Forest(leaves, "leaves", arity, levels)
    subroots = trees.roots.select(F.lit(0).alias("_one"), F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("lang"), F.col("root").alias("digest"), F.col("tree").alias("of"))
    tops = written(ranked(written(subroots, "subroots"), "_one", "lang").select("rank", "size", "digest", "of", F.lit("").alias("tree")), "tops")
    top = Forest(tops, "tops", arity, levels)
    above = top.proofs(top.roots.select("tree", "root", F.array().cast(_PATH).alias("path"))).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    full = trees.proofs(written(above, "above"))
    out = full.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("given", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *FIELDS)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, leaf(n_chars=F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))))

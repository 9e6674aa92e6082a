"""What the operators of this subpackage share: reading, written intermediate tables, joins with hot keys, samples, connected components, sorted runs, the memory of Python workers.

No helper collects rows that grow with the input to the driver, and none keeps
anything in a machine-local folder: intermediate tables are written below the
folder that ``spark.checkpoint.dir`` names, so they outlive any executor.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from functools import reduce
from operator import and_
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: A key with more than one in ``HOT`` of all rows is hot: there are fewer than ``HOT`` of them, whatever the table.
HOT = 1000
#: Bytes that a worker's cache of words may take, about.
CACHE_BYTES = 32 << 20

_T = TypeVar("_T")


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One of the parquet tables, pruned to ``cols`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.plainspoke.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="plainspoke-")
        spark.conf.set("spark.plainspoke.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001  the session may already be gone; the folder is a scratch folder
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/plainspoke/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``taken`` is called so (in any case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def bounded_sample(df: DataFrame, rows: int, keys: list[str], *cols: Column) -> list[Row]:
    """``cols`` of at most ``rows`` rows of ``df``, those with the smallest hashes of ``keys``, the same at any partitioning.

    The hashes alone give the threshold, so that only the chosen rows leave the
    tasks with their ``cols``, which bound each row's size or leave it whole. Rows
    with equal keys go together as far as there is room.
    """
    hashed = F.xxhash64(*(F.col(k).cast("string") for k in keys), F.lit("sample"))
    last = df.select(hashed.alias("_0")).orderBy("_0").limit(rows).agg(F.max("_0")).first()[0]
    if last is None:
        return []
    cut = df.where(hashed <= last).select(hashed.alias("_0"), F.struct(*cols).alias("_1"))
    return [r[0] for r in cut.orderBy("_0", "_1").limit(rows).select("_1").collect()]


def joined_hot(rows: DataFrame, named: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` left-joined on ``keys`` to ``named``, which is a written table with one row a key and the key's number of rows in ``count``.

    Hot keys, fewer than ``HOT``, are broadcast, so that their rows stay where
    they are; only the others meet in a shuffle. Null keys find nothing and aren't shuffled.
    """
    total = named.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total
    some, rest = named.where(hot).drop(count), named.where(~hot).drop(count)
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))
    met = rows.join(F.broadcast(some), keys)
    cold = rows.where(known).join(F.broadcast(some.select(keys)), keys, "left_anti").join(rest, keys, "left")
    return met.unionByName(cold).unionByName(rows.where(~known), allowMissingColumns=True)


_resident: dict[Hashable, object] = {}


def resident(key: Hashable, make: Callable[[], _T]) -> _T:
    """``make()``, kept in this Python worker for later tasks with the same key. Workers outlive stages: only one model stays at a time."""
    if key not in _resident:
        release()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Forgets the worker's model."""
    if _resident:
        _resident.clear()
        trim()


def trim() -> None:
    """Gives freed memory back to the system as far as the platform can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def lean(batches: Iterator[_T], keep: bool = False) -> Iterator[_T]:
    """The batches of a task; frees the worker's model before them (unless ``keep``), and what the task held after them."""
    if not keep:
        release()
    try:
        yield from batches
    finally:
        trim()


class Cache(dict):
    """key -> make(key), remembered up to about ``limit`` bytes: what is frequent comes early. Keys longer than ``longest`` aren't kept."""

    def __init__(self, make: Callable[[object], object], limit: int = CACHE_BYTES, longest: int = 60):
        super().__init__()
        self.make, self.limit, self.longest, self.size = make, limit, longest, 0

    def __missing__(self, key: object) -> object:
        value = self.make(key)
        if self.size < self.limit and len(key) <= self.longest:
            self[key] = value
            self.size += 190 + len(key) + (len(value) if isinstance(value, bytes) else 0)  # two objects and a place in the table
        return value


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component) per node, component = smallest node.

    Every round points each node at its smallest neighbour, follows the
    pointers three more steps, and contracts the edges; at least half of the
    nodes of every unfinished component vanish in a round. Hubs are safe: minima
    are combined before the shuffle, and every join is a plain equi-join of two
    written tables, with one row a node on one side, whose hot partitions skew
    handling splits.
    Null ends and loops are ignored. An empty table gives an empty table.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    e = written(edges.where("a is not null and b is not null and a <> b").select(lo.alias("lo"), hi.alias("hi")).distinct(), "edges")
    labels = written(e.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not e.isEmpty():
        p = written(e.groupBy("hi").agg(F.min("lo").alias("p")), "parents")
        for _ in range(2):  # each doubles the steps taken
            q = p.select(F.col("hi").alias("q_hi"), F.col("p").alias("q_p"))
            p = p.join(q, p.p == q.q_hi, "left").select("hi", F.coalesce("q_p", "p").alias("p"))
        p = written(p, "parents")
        left, right = p.select(F.col("hi").alias("n1"), F.col("p").alias("p1")), p.select(F.col("hi").alias("n2"), F.col("p").alias("p2"))
        moved = e.join(left, e.lo == left.n1, "left").join(right, e.hi == right.n2, "left").select(F.coalesce("p1", "lo").alias("x"), F.coalesce("p2", "hi").alias("y"))
        e = written(moved.where("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "edges")
        labels = written(labels.join(left, labels.component == left.n1, "left").select("node", F.coalesce("p1", "component").alias("component")), "labels")
    return labels


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, root) that connect what the pairs (a, b) connect: at most one per node."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def slices(batch: pa.RecordBatch, column: int, rows: int = 512, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and, but for longer single values of the text column, ``most`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``key`` from batches that are sorted by it. Memory: a batch and the longest run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key)
        last = k[-1].as_py()
        if held and held[-1].column(key)[-1].as_py() == last:
            held.append(batch)
            continue
        keys = np.asarray(k.to_numpy(zero_copy_only=False))
        cut = int(np.searchsorted(keys != last, False, side="left")) if (keys[0] != last) else 0
        cut = int(np.argmax(keys == last)) if cut or keys[0] != last else 0
        if cut or held:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)

"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine of at least c lie within squared distance B = 2 - 2c. A
rotation keeps distances; it is fitted (principal axes of a bounded sample, dealt
over the blocks) so that blocks carry like variance, and since it is orthogonal,
exactness doesn't depend on the sample. The rotated dimensions are split into
``BLOCKS`` low-dimensional blocks, and B is split among them in proportion to
their variance: two linked vectors are within budget in one block at least.

Each block is joined on range by itself: pivots, points of the sample, cut the
subspace into cells, a vector lives in its nearest pivot's cell and visits every
later cell whose border is within the budget's radius. That finds every pair
within the radius, because a point of a cell is on its pivot's side of each
border. In a cell, blocks of a matrix product find the candidates, and these are
verified by their cosine in double precision at once. A pair within budget in
several blocks counts in the first only. Partial distances of linked pairs come
from sums in a fixed order, so that all cells agree on them.

How many blocks and pivots there are is chosen by their cost on the sample: copies
of vectors in cells, products within cells and candidates, weighed by the number of
vectors. Both grow with the table: more vectors get more pivots, so that cells stay
small, and wider blocks, so that fewer unrelated pairs are within a budget. Results
don't depend on the choice.

Cells with more than ``CHUNK`` members are dealt into pairs of salted chunks. No
pair leaves its task: a task returns each vector's number of links and a spanning
forest of them. Equal vectors are one class, joined once with its size as weight.

Defined results: null vectors, zero vectors, vectors with null or non-finite
components and empty vectors link with nothing, and so do rows without an id; vectors
of different lengths don't link. Repeated rows, and different vectors under one id,
count as other vectors; one row comes out for each. A cosine of exactly the threshold
is a link; components are named by the smallest id. Vectors of any length are joined;
those of lengths that few vectors have go without a sample. An empty table gives an
empty table. Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, components, forest, joined_hot, lean, sorted_runs, table, written

THRESHOLD = 0.95
#: Most blocks and pivots of a block, vectors that they are fitted on at most, members of a cell's chunk.
BLOCKS, PIVOTS, SAMPLE, CHUNK = 8, 2048, 8192, 32768
#: Seconds for a copy of a vector in a cell, a pair in a product, and a candidate, about.
COPY, PRODUCT, CANDIDATE = 1.2e-5, 2.1e-9, 7e-7
_SLACK = 1e-9


class Subspaces:
    """Rotation, block borders, budgets and pivots for vectors of one length."""

    def __init__(self, unit: np.ndarray, dim: int, threshold: float, blocks: int = BLOCKS, pivots: int = PIVOTS):
        """unit: a sample of unit vectors of length dim; may be empty."""
        blocks = max(1, min(blocks, dim))
        axes, variance = np.eye(dim), np.ones(dim)
        if len(unit) > 1:
            variance, axes = np.linalg.eigh(np.cov(unit.T).reshape(dim, dim))
            variance, axes = np.maximum(variance[::-1], 1e-12), axes[:, ::-1]
        # Snake order deals large and small variances evenly.
        deal = [r if (i // blocks) % 2 == 0 else blocks - 1 - r for i in range(dim) for r in [i % blocks]]
        order = np.argsort(deal, kind="stable")
        self.q = np.ascontiguousarray(axes[:, order])
        self.ends = np.cumsum(np.bincount(deal, minlength=blocks))
        self.parts = [slice(a, b) for a, b in zip(np.r_[0, self.ends[:-1]], self.ends, strict=True)]
        share = np.array([variance[order][p].sum() for p in self.parts])
        self.budget = (2 - 2 * threshold) * share / share.sum() * (1 + _SLACK) + _SLACK
        pool = self.rotate(unit) if len(unit) else np.zeros((1, dim))
        step = max(1, len(pool) // pivots)
        self.pivots = [np.unique(pool[::step][:pivots, p], axis=0) for p in self.parts]
        self.apart = [np.sqrt(np.maximum(_squared(c, c), 0)) for c in self.pivots]

    @classmethod
    def chosen(cls, unit: np.ndarray, dim: int, threshold: float, n: int, blocks: int = BLOCKS, pivots: int = PIVOTS, chunk: int = CHUNK) -> Subspaces:
        """The one of the least cost for n vectors, by the sample ``unit``."""
        best, least = None, np.inf
        test = unit[np.random.default_rng(0).permutation(len(unit))[:600]]
        for b in sorted({max(1, min(blocks, dim) >> i) for i in range(2)}):
            for p in (4 << i for i in range(14)):
                if best and (p > pivots or 4 * p > len(unit)):
                    break
                own = cls(unit, dim, threshold, b, min(p, pivots))
                cost = own.cost(test, n, chunk)
                if cost < least:
                    best, least = own, cost
                elif cost > 2 * least:
                    break
        return best

    def cost(self, test: np.ndarray, n: int, chunk: int = CHUNK) -> float:
        """Seconds that the join of n vectors like those of ``test`` takes, about. The members of a cell are copied once for each of its chunks."""
        if not len(test):
            return 0.0
        turned, total, m = test @ self.q, 0.0, len(test)
        for k, _, cells, home in self.cells(turned):
            if home.all():
                at_home = np.bincount(cells, minlength=len(self.pivots[k])) / m
                x = turned[:, self.parts[k]]
                near = (_squared(x, x) <= self.budget[k]).sum() - m
                total += n * n * (at_home @ at_home * PRODUCT + max(near, 0) / (2 * m * m) * CANDIDATE)
            else:
                visits = np.bincount(cells, minlength=len(self.pivots[k])) / m
                members = n * (at_home + visits)
                total += members @ np.ceil(members / chunk) * COPY + n * n * (at_home @ visits) * PRODUCT
        return total

    def rotate(self, unit: np.ndarray) -> np.ndarray:
        """unit @ q with sums in a fixed order, whatever the number of rows."""
        out = np.zeros((len(unit), self.q.shape[1]))
        for d in range(unit.shape[1]):
            out += unit[:, d, None] * self.q[d]
        return out

    def cells(self, rotated: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per block (block, rows, cells, at home): each row at home once, and as a visitor of later cells within the radius."""
        for k, part in enumerate(self.parts):
            x, c = rotated[:, part], self.pivots[k]
            far = _squared(x, c)
            home = far.argmin(1)
            yield k, np.arange(len(x)), home, np.ones(len(x), bool)
            border = (far - far[np.arange(len(x)), home][:, None]) / (2 * np.maximum(self.apart[k][home], 1e-300))
            rows, cells = np.nonzero((border <= np.sqrt(self.budget[k]) + _SLACK) & (np.arange(len(c)) > home[:, None]))
            yield k, rows, cells, np.zeros(len(rows), bool)

    def distance(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Squared distances of rows in block k, summed in a fixed order."""
        out = np.zeros(len(a))
        for d in range(self.parts[k].start, self.parts[k].stop):
            out += (a[:, d] - b[:, d]) ** 2
        return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances (len(a), len(b)), within about 1e-15 for vectors of at most length 1."""
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)


def units(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by sums in a fixed order."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    n = np.zeros(len(x))
    for column in np.ascontiguousarray(x.T):
        n += column * column
    return x / np.sqrt(n)[:, None]


def _dealt(spaces: dict[int, Subspaces], kind: str, counted: bool = False) -> object:
    """(row, n, dim, raw) -> (dim, block, cell, home, row, n, raw), or only (dim, block, cell, copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in lean(batches):
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    own = batch.filter(pa.array(dims == dim))
                    raw = np.frombuffer(b"".join(own.column("raw").to_pylist()), kind).reshape(own.num_rows, dim)
                    space = spaces.get(int(dim)) or _plain(int(dim), spaces)
                    for k, rows, cells, home in space.cells(space.rotate(units(raw))):
                        n = len(rows)
                        if counted:
                            of, copies = np.unique(cells, return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), x, np.int32)) for x in (dim, k)] + [pa.array(of.astype(np.int32)), pa.array(copies)], names=["dim", "block", "cell", "copies"])
                            continue
                        got = own.select(["row", "n", "dim", "raw"]).take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([got.column("dim"), pa.array(np.full(n, k, np.int32)), pa.array(cells.astype(np.int32)), pa.array(home), got.column("row"), got.column("n"), got.column("raw")], names=["dim", "block", "cell", "home", "row", "n", "raw"])

    return run


def _plain(dim: int, spaces: dict) -> Subspaces:
    """For a length that few vectors have: one block, one cell."""
    return spaces.setdefault(dim, Subspaces(np.zeros((0, dim)), dim, spaces[0], 1, 1))


def _joined(spaces: dict[int, Subspaces], threshold: float, kind: str) -> object:
    """Sorted runs of one cell (or of two of its chunks) -> (a, b, links): forest links (links null) and numbers of links (b null)."""

    def pairs(space: Subspaces, k: int, raw: np.ndarray, ids: np.ndarray, home: np.ndarray, side: np.ndarray, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (i at home, j) that block k is the first to find and that are linked."""
        unit = units(raw)
        x = unit @ space.q[:, space.parts[k]]
        sq, one = (x * x).sum(1, keepdims=True), np.ones((len(x), 1))
        # One product gives all squared distances; single precision is safe within the slack, as the rest decides.
        left, right = np.hstack([-2 * x, one, sq]).astype(np.float32), np.ascontiguousarray(np.hstack([x, sq, one]).T.astype(np.float32))
        hosts = np.flatnonzero(home)
        for rows in (hosts[i : i + 256] for i in range(0, len(hosts), 256)):
            for at in range(0, len(ids), 4096):
                cols = np.arange(at, min(at + 4096, len(ids)))
                flat = np.flatnonzero(left[rows] @ right[:, at : at + 4096] <= np.float32(space.budget[k] + 1e-5))
                i, j = np.divmod(flat, len(cols))
                a, b = rows[i], cols[j]
                # Two hosts meet twice: the pair counts where the first has the smaller number. Pairs of one chunk belong to the cell of that chunk alone.
                ok = (~home[b] | (ids[a] < ids[b])) & (not both or side[a] != side[b])
                i, j = i[ok], j[ok]
                for part in range(0, len(i), 65536):
                    a, b = rows[i[part : part + 65536]], cols[j[part : part + 65536]]
                    ok = np.einsum("nd,nd->n", unit[a], unit[b]) >= threshold
                    a, b = a[ok], b[ok]
                    if not len(a):
                        continue
                    some, at_ = np.unique(np.r_[a, b], return_inverse=True)
                    turned = space.rotate(unit[some])
                    p, q = turned[at_[: len(a)]], turned[at_[len(a) :]]
                    ok = space.distance(p, q, k) <= space.budget[k]
                    for before in range(k):
                        ok &= space.distance(p, q, before) > space.budget[before]
                    yield a[ok], b[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(lean(batches), "run"):
            key = rows.column("run").to_numpy()
            edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo < 2:
                    continue
                own = rows.slice(lo, hi - lo)
                dim, k = own.column("dim")[0].as_py(), own.column("block")[0].as_py()
                ids, n = own.column("row").to_numpy(), own.column("n").to_numpy()
                raw = np.frombuffer(b"".join(own.column("raw").to_pylist()), kind).reshape(len(ids), dim)
                home, side = own.column("home").to_numpy(), own.column("side").to_numpy()
                count = np.zeros(len(ids), np.int64)
                a, b = [ids[:0]], [ids[:0]]
                for i, j in pairs(spaces.get(dim) or _plain(dim, spaces), k, raw, ids, home, side, bool(own.column("both")[0].as_py())):
                    np.add.at(count, i, n[j])
                    np.add.at(count, j, n[i])
                    x, y = forest(ids[i], ids[j])
                    a.append(x)
                    b.append(y)
                x, y = forest(np.concatenate(a), np.concatenate(b))
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[x, ids[some]], pa.int64()), pa.array([*y.tolist(), *[None] * len(some)], pa.int64()), pa.array([*[None] * len(x), *count[some].tolist()], pa.int64())], names=["a", "b", "links"])

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, blocks: int = BLOCKS, pivots: int = PIVOTS, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs with cosine >= ``threshold``."""
    kind, of = ("f4", "float") if dict(vectors.dtypes)[embedding] == "array<float>" else ("f8", "double")  # as exact, and half as much to send
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{of}>").alias("e"))
    sound = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    zero = F.lit(0.0).cast(of)
    rows = rows.select("vec_id", F.when(sound & F.col("vec_id").isNotNull(), F.transform("e", lambda x: F.when(x == zero, zero).otherwise(x))).alias("k"))  # no negative zeros
    classes = written(rows.where("k is not null").groupBy("k").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("k")}), "vectors")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            k = b.column("k")
            raws = [np.asarray(v.values.to_numpy(zero_copy_only=False), kind).tobytes() for v in k]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), pa.array([len(r) // np.dtype(kind).itemsize for r in raws], pa.int32()), pa.array(raws, pa.binary())], names=["row", "n", "dim", "raw"])

    flat = classes.select("row", "n", "k").mapInArrow(packed, "row long, n long, dim int, raw binary")
    lengths = {r["dim"]: r["n"] for r in classes.groupBy(F.size("k").alias("dim")).agg(F.count("*").alias("n")).collect()}  # one row a length
    spaces: dict[int, object] = {0: threshold}
    for dim, n in lengths.items():
        if n > 256 and 64 * n > sum(lengths.values()):  # 64 lengths at most
            got = bounded_sample(classes.where(F.size("k") == dim), sample, ["row"], F.col("k"))
            spaces[dim] = Subspaces.chosen(units(np.array([r.k for r in got], np.float64)), dim, threshold, n, blocks, pivots, chunk)
    cells = flat.repartition("row").mapInArrow(_dealt(spaces, kind), "dim int, block int, cell int, home boolean, row long, n long, raw binary")
    counts = flat.mapInArrow(_dealt(spaces, kind, True), "dim int, block int, cell int, copies long").groupBy("dim", "block", "cell").agg(F.sum("copies").alias("copies"))
    sizes = counts.select(F.col("dim").alias("_d"), F.col("block").alias("_b"), F.col("cell").alias("_e"), F.ceil(F.col("copies") / chunk).cast("int").alias("_c")).where("_c > 1")
    # Fewer than 1 / chunk of all copies' number are cells of more than a chunk, and blocks x pivots a length at most.
    met = cells.join(F.broadcast(sizes), (F.col("dim") == F.col("_d")) & (F.col("block") == F.col("_b")) & (F.col("cell") == F.col("_e")), "left").withColumn("_c", F.coalesce("_c", F.lit(1)))
    own = F.pmod(F.xxhash64("row"), F.col("_c")).cast("int")
    # Chunk x meets itself in (x, x) and each other chunk once.
    dealt = met.withColumn("side", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    i, j = F.least("side", "_o"), F.greatest("side", "_o")
    dealt = dealt.select(F.xxhash64("dim", "block", "cell", i, j).alias("run"), (i != j).alias("both"), "side", "dim", "block", "home", "row", "n", "raw")
    got = written(dealt.repartition("run").sortWithinPartitions("run").mapInArrow(_joined(spaces, threshold, kind), "a long, b long, links long"), "links")
    counts = got.where("links is not null").groupBy(F.col("a").alias("row")).agg(F.sum("links").alias("links"))
    found = components(got.where("links is null").select("a", "b")).select(F.col("node").alias("row"), F.col("component").alias("_comp"))
    named = classes.join(counts, "row", "left").join(found, "row", "left")
    named = written(named.select("h", "k", "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("_comp", "row").alias("_comp")), "named")
    whole = written(named.join(named.groupBy("_comp").agg(F.min("least").alias("component_id")), "_comp").select("h", "k", "n", "n_links", "component_id"), "components")
    # A hash in front, so that the join sorts by it and not by whole vectors.
    out = joined_hot(rows.withColumn("h", F.xxhash64("k")), whole, ["h", "k"], "n").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))

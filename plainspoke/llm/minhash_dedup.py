"""Near-duplicates by fast similarity sketching, banding and exact verification.

1. One pass over the texts gives each document its number of distinct shingles,
   a 128-bit digest of its words, and a sketch. A sketch has ``T`` coordinates.
   In round i each shingle is hashed to one of them with a value i + fraction,
   and a coordinate keeps its least value; rounds go on until every coordinate is
   filled, for at most T rounds, after which round T + j puts every shingle into
   coordinate j. So every coordinate is always filled, one round does for large
   sets, and the share of equal coordinates concentrates around the Jaccard
   similarity as with independent minima.
2. Documents with equal words are one class, which a row of it stands for.
3. Bands of ``ROWS`` coordinates are hashed. Classes that share a band meet in
   sorted runs, where their sketches (a byte a coordinate) are compared in bulk.
   Pairs that may be similar enough become links of a spanning forest, and the
   connected components of those are families: any true link lies in one.
4. Each family's full shingle sets meet once, and pairs not yet connected are
   verified exactly.
5. Components of the verified links, joined back to all documents.

Large groups: a bucket of more than ``BUCKET`` classes, or a family of more than
``TEXTS`` classes or ``CHUNK`` shingles, is dealt into salted cells, each of which also gets the same few
``PIVOTS`` of the group. A member that is linked with a pivot of the largest
connected set of pivots needs no other comparison, as it is connected to all others
of that kind. Only the members for which that fails meet all the group's members,
chunk by chunk, so no link is lost and a group of n copies of a text costs n, not n^2.

No pair within a group is ever emitted for its own sake: tasks emit at most one
link per member. A pair at the threshold is missed with probability about 3e-7
by the bands and 1e-5 by the comparison of sketches, unless others connect it.

Defined results: null texts and texts without words have an empty set, are linked
with nothing and stand alone. Documents of fewer words than a shingle have one
shingle, their words. Repeated rows give repeated results. Different texts under one
id are compared as any others, and each row is in the group of its own text. A row
with a null id is too; a group none of whose rows has an id has a null component
(kept false). Very long texts are read whole, a slice of a batch at a time. An empty
table gives an empty table. Of the columns, only the id and the text are read, so
the others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, components, forest, fresh, joined_hot, lean, slices, sorted_runs, table, written

WORDS, THRESHOLD = 5, 0.85
T, ROWS = 192, 6
#: Share of equal sketch coordinates from which a pair is verified: over four standard deviations below the threshold.
MAY_BE = 0.12
#: Bits of a map of wanted keys, and of one of its blocks.
BITS, BLOCK = 1 << 25, 1 << 13
BUCKET, CHUNK = 512, 500_000
#: Texts whose full sets meet in a cell at most, and loose ones of them, about.
TEXTS, LOOSE = 128, 64
#: Constants that give different members as the least after XOR.
PIVOTS = [0, 0x2D358DCCAA6C78A5, 0x0BB8E7C7D1B5A3F1, 0x6F9D5B3C1E87A249, 0x1B873593CC9E2D51, 0x5851F42D4C957F2D]

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of x and a seed (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed + 1) * _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 150_000 and len(word) <= 60:  # what is frequent comes early
            self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lowered: runs of bytes other than space and control white space."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingles(words: list[bytes], hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mixed(out ^ h[j : j + n], j)
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """Sketches (documents, t) of non-empty sets, by rounds of hashed bin placement. Values are rounds in the high bits and fractions below."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), full)
    todo = np.arange(len(sets))
    for i in range(2 * t):
        if not len(todo):
            break
        sizes = np.array([len(sets[d]) for d in todo])
        flat = np.concatenate([sets[d] for d in todo])
        h = mixed(flat, 1000 + i)
        row = np.repeat(todo, sizes)
        bins = (h % np.uint64(t)).astype(np.int64) if i < t else np.full(len(flat), i - t)
        value = (mixed(h, 7) >> np.uint64(9)) | (np.uint64(min(i, t)) << np.uint64(55))
        np.minimum.at(out.reshape(-1), row * t + bins, value)
        todo = todo[(out[todo] == full).any(1)]
    return out


def band_keys(sk: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit keys (documents, bands) of consecutive runs of ``rows`` coordinates."""
    bands = sk.shape[1] // rows
    parts = sk[:, : bands * rows].reshape(len(sk), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sk), bands)).copy()
    for j in range(rows):
        key = mixed(key ^ parts[:, :, j], 50 + j)
    return key


_SKETCHED = "id long, at long, n_shingles long, words_key binary, sketch binary, bands binary"


def sketched(docs: DataFrame, doc_id: str, text: str, k: int, row: str | None = None) -> DataFrame:
    """(id, at, n_shingles, words_key, sketch, bands, row) of every document; words_key, sketch and bands null for empty sets. One byte a coordinate, eight a band.

    at: a hash of id and text by which the text is found again. row: a number of
    each row that is fixed only once the result is written, unless a column is named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in lean(batches):
            for part in slices(batch, 2):
                keys, sets = [], []
                for t in part.column(2).to_pylist():
                    words = words_of(t)
                    sets.append(shingles(words, hashes, k))
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                some = [i for i, s in enumerate(sets) if len(s)]
                sk = sketches([sets[i] for i in some])
                small, bands = sk.astype(np.uint8), band_keys(sk)  # the low bits: fractions
                sketch, band = [None] * len(sets), [None] * len(sets)
                for j, i in enumerate(some):
                    sketch[i], band[i] = small[j].tobytes(), bands[j].astype("<i8", copy=False).tobytes()
                own = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary()), pa.array(band, pa.binary())]
                names = ["id", "at", "n_shingles", "words_key", "sketch", "bands"]
                if row:
                    own, names = [*own, part.column(3)], [*names, "row"]
                yield pa.RecordBatch.from_arrays(own, names=names)

    cols = [F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("at"), F.col(text).alias("text")]
    if row:
        return docs.select(*cols, F.col(row).alias("row")).mapInArrow(run, _SKETCHED + ", row long")
    return docs.select(*cols).mapInArrow(run, _SKETCHED).withColumn("row", F.monotonically_increasing_id())


def _parted(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be one of ``wanted``'s, and those whose key is none, which need no join with it and so no shuffle.

    ``wanted`` becomes a map of ``BITS`` bits in blocks, a broadcast of 4 MB
    whatever the table. A key passes by chance as often as bits are set, so a join
    by the key itself has to follow for the former.
    """
    h, block, words = fresh(rows.columns, "_h", "_block", "_words")
    of = F.expr(f"cast(shiftright(`{h}`, 13) & {BITS // BLOCK - 1} as int)")
    word, bit = (f"cast(shiftright(`{h}`, 6) & {BLOCK // 64 - 1} as int)", f"cast(`{h}` & 63 as int)")
    set_ = wanted.select(F.xxhash64(key).alias(h)).select(of.alias(block), F.expr(word).alias("word"), F.expr(f"shiftleft(1L, {bit})").alias("bit"))
    held = set_.groupBy(block, "word").agg(F.expr("bit_or(bit)").alias("bits")).groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    map_ = written(held.select(block, F.expr(f"transform(sequence(0, {BLOCK // 64 - 1}), i -> coalesce(try_element_at(m, i), 0L))").alias(words)), "bits")
    told = rows.withColumn(h, F.xxhash64(key)).withColumn(block, of).join(F.broadcast(map_), block, "left")
    may = F.expr(f"coalesce((shiftright(get(`{words}`, {word}), {bit}) & 1) = 1, false)")
    return told.where(may).drop(h, block, words), told.where(~may).drop(h, block, words)


def _pivots(large: DataFrame, key: str) -> DataFrame:
    """(key, _c, row, marked) of each group's pivots, once for every one of its _c cells, which column _at numbers. By minima alone, so that a hot group is combined before the shuffle."""
    least = large.groupBy(key, "_c").agg(*(F.min(F.col("row").bitwiseXOR(F.lit(x))).alias(f"_{i}") for i, x in enumerate(PIVOTS)))
    rows = F.array_distinct(F.array(*(F.col(f"_{i}").bitwiseXOR(F.lit(x)) for i, x in enumerate(PIVOTS))))
    return least.select(key, "_c", F.explode(rows).alias("row")).withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))


def _starred(members: DataFrame, key: str) -> DataFrame:
    """(cell, key, row, marked): members (key, row, _c) dealt to cells; those of groups with more than one cell with the group's pivots, marked."""
    salt = F.pmod(F.xxhash64("row"), F.col("_c")).cast("int")
    own = members.select(F.xxhash64(key, salt).alias("cell"), key, "row", F.lit(0).alias("marked"))
    pivots = _pivots(members.where("_c > 1"), key).select(F.xxhash64(key, "_at").alias("cell"), key, "row", F.lit(1).alias("marked"))
    return own.unionByName(pivots)


def _loose_cells(members: DataFrame, loose: DataFrame, key: str, most: int) -> DataFrame:
    """(cell, key, row, marked): the loose members of large groups, marked 1, with all members of their groups, chunk by chunk; among these the loose ones are marked 2."""
    n = loose.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_l"))
    sizes = written(n.join(members.groupBy(key, "_c").agg(F.count("*").alias("_n")), key), "loose")
    salt, chunk = F.pmod(F.xxhash64("row"), F.col("_c")).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("_l")).cast("int")
    all_ = members.drop("_c").join(loose.withColumn("marked", F.lit(2)), [key, "row"], "left")
    met = joined_hot(all_, sizes, [key], "_n").where("_l is not null").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_l") - 1)))
    own = met.select(F.xxhash64(key, "_i", salt).alias("cell"), key, "row", F.coalesce("marked", F.lit(0)).alias("marked"))
    rest = joined_hot(loose, sizes, [key], "_n").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return own.unionByName(rest.select(F.xxhash64(key, chunk, "_i").alias("cell"), key, "row", F.lit(1).alias("marked")))


def _main(n: int, links: list[tuple[int, int]]) -> np.ndarray:
    """Which of n pivots are in the largest connected set, the one with the first pivot if there are several."""
    label = np.arange(n)
    for i, j in links:
        label[label == label[j]] = label[i]
    of, first, size = np.unique(label, return_index=True, return_counts=True)
    best = min(range(len(of)), key=lambda x: (-size[x], first[x]))
    return label == of[best]


_LINKS = "a long, b long, loose long"


def _out(a: list[np.ndarray], b: list[np.ndarray], loose: list[np.ndarray], group: list[np.ndarray]) -> pa.RecordBatch:
    """Forest links (a, b, null) and loose members (row, null, group)."""
    x, y = forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
    rows, of = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (loose, group))
    nothing = lambda n: pa.nulls(n, pa.int64())
    join = lambda p, q: pa.concat_arrays([p, q])
    return pa.RecordBatch.from_arrays([pa.array(np.r_[x, rows], pa.int64()), join(pa.array(y, pa.int64()), nothing(len(rows))), join(nothing(len(x)), pa.array(of, pa.int64()))], names=["a", "b", "loose"])


def _bucket_links(need: int, last: bool) -> object:
    """Sorted runs of (cell, key, row, marked, sketch) -> links of pairs with at least ``need`` equal coordinates, and the loose members of cells with pivots (``last``: marked rows are loose ones, held against all)."""

    def like(sk: np.ndarray, one: np.ndarray) -> np.ndarray:
        return (sk == one).sum(1) >= need

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(lean(batches), "cell"):
            cell, ids, marked = (rows.column(c).to_numpy() for c in ("cell", "row", "marked"))
            sk = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            a, b, loose, group = [], [], [], []
            starred = np.isin(cell, cell[marked == 1])
            at = np.flatnonzero(~starred)
            d = 1
            while True:  # each row with the one d places on, as long as some run is longer than d
                at = at[at + d < len(ids)]
                at = at[cell[at] == cell[at + d]]
                if not len(at):
                    break
                for part in np.array_split(at, -(-len(at) // 50_000)):
                    ok = part[(sk[part] == sk[part + d]).sum(1) >= need]
                    a.append(ids[ok])
                    b.append(ids[ok + d])
                d += 1
            for c in np.unique(cell[starred]):
                own = np.flatnonzero(cell == c)
                some = own[marked[own] == 1]
                some, rest = some[np.argsort(ids[some], kind="stable")], own[marked[own] != 1]
                if last:
                    for i in some:
                        ok = own[like(sk[own], sk[i])]
                        a.append(ids[ok])
                        b.append(np.full(len(ok), ids[i]))
                    continue
                pairs = [(i, j) for i in range(len(some)) for j in np.flatnonzero(like(sk[some[:i]], sk[some[i]]))]
                main = some[_main(len(some), pairs)]
                a.append(ids[some[[i for i, _ in pairs]]] if pairs else ids[:0])
                b.append(ids[some[[j for _, j in pairs]]] if pairs else ids[:0])
                left = rest[~np.isin(ids[rest], ids[main])]
                for i in main:
                    ok = like(sk[left], sk[i])
                    a.append(ids[left[ok]])
                    b.append(np.full(int(ok.sum()), ids[i]))
                    left = left[~ok]
                loose.append(ids[left])
                group.append(rows.column("key").to_numpy()[left])
            yield _out(a, b, loose, group)

    return run


def linked(sets: list[np.ndarray], sk: np.ndarray, need: int, threshold: float, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) of a spanning forest of the pairs whose Jaccard similarity is at least the threshold, decided on full sets.

    Pairs that are connected already (``label``: equal for what is connected from
    the start), differ too much in size, or whose sketches rule them out are passed over.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(codes.max() + 1, bool)
    label, done = np.arange(n) if label is None else label.copy(), np.zeros(n, bool)
    a, b = [], []
    percent = round(100 * threshold)
    for i in np.argsort(-sizes, kind="stable"):
        if (label == label[0]).all():
            break
        done[i] = True
        others = np.flatnonzero((label != label[i]) & ~done)
        others = others[(100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))]
        if len(others):
            others = others[(sk[others] == sk[i]).sum(1) >= need]
        if not len(others):
            continue
        own = codes[starts[i] : starts[i + 1]]
        mark[own] = True
        for j in others[np.argsort(label[others], kind="stable")]:
            if label[j] == label[i]:
                continue
            both = int(mark[codes[starts[j] : starts[j + 1]]].sum())
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                a.append(i)
                b.append(j)
                label[label == label[j]] = label[i]
        mark[own] = False
    return np.array(a, np.int64), np.array(b, np.int64)


def _similar(one: np.ndarray, flat: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sorted sets that ``flat`` joins are similar enough to set ``one``."""
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    both = np.add.reduceat(one[at] == flat, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
    return 100 * both >= percent * (len(one) + sizes - both)


def _family_links(need: int, threshold: float, last: bool) -> object:
    """The same with full sets: sorted runs of (cell, key, row, marked, sketch, shingles) -> verified links and loose members."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(lean(batches), "cell"):
            cell, ids, marked = (rows.column(c).to_numpy() for c in ("cell", "row", "marked"))
            raw, sketch = rows.column("shingles").to_pylist(), rows.column("sketch").to_pylist()
            a, b, loose, group = [], [], [], []
            edges = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo < 2:
                    continue
                own, star = ids[lo:hi], marked[lo:hi]
                sets = [np.frombuffer(s, np.uint64) for s in raw[lo:hi]]
                if last or not (star == 1).any():
                    sk = np.frombuffer(b"".join(sketch[lo:hi]), np.uint8).reshape(hi - lo, -1)
                    label = np.where(star > 0, np.unique(own, return_inverse=True)[1], -1) if last else None  # all that aren't loose are connected
                    x, y = linked(sets, sk, need, threshold, label)
                    a.append(own[x])
                    b.append(own[y])
                    continue
                some, rest = np.flatnonzero(star == 1), np.flatnonzero(star != 1)
                some = some[np.argsort(own[some], kind="stable")]
                against = lambda i, js: _similar(sets[i], np.concatenate([sets[j] for j in js]), np.array([len(sets[j]) for j in js]), percent) if len(js) else np.zeros(0, bool)  # noqa: E731,B023
                pairs = [(i, j) for i in range(len(some)) for j in np.flatnonzero(against(some[i], some[:i]))]
                main = some[_main(len(some), pairs)]
                a.append(own[some[[i for i, _ in pairs]]] if pairs else own[:0])
                b.append(own[some[[j for _, j in pairs]]] if pairs else own[:0])
                left = rest[~np.isin(own[rest], own[main])]
                for i in main:
                    ok = against(i, left)
                    a.append(own[left[ok]])
                    b.append(np.full(int(ok.sum()), own[i]))
                    left = left[~ok]
                loose.append(own[left])
                group.append(rows.column("key").to_numpy()[lo:hi][left])
            yield _out(a, b, loose, group)

    return run


def with_sets(docs: DataFrame, text: str, k: int) -> DataFrame:
    """docs with the binary columns shingles and _key (the words' digest), without the text."""
    rest = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != text) + ", shingles binary, _key binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in lean(batches):
            for batch in slices(whole, whole.schema.get_field_index(text)):
                words = [words_of(t) for t in batch.column(text).to_pylist()]
                sets = [shingles(w, hashes, k).tobytes() for w in words]
                keys = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sets, pa.binary()), pa.array(keys, pa.binary())], names=[*rest, "shingles", "_key"])

    return docs.mapInArrow(run, schema)


def _connected(members: DataFrame, key: str, most: int, task: Callable[[bool], object], payload: DataFrame, name: str) -> DataFrame:
    """Links (a, b) within the groups of ``members`` (key, row, _c cells). ``payload`` has the columns that a task needs, by row."""

    def met(cells: DataFrame, payload: DataFrame, last: bool) -> DataFrame:
        own = cells.withColumnRenamed(key, "key").join(payload, "row")
        return own.repartition("cell").sortWithinPartitions("cell").mapInArrow(task(last), _LINKS)

    first = written(met(_starred(members, key), payload, False), name)
    links, loose = first.where("loose is null").select("a", "b"), first.where("loose is not null").select(F.col("loose").alias(key), F.col("a").alias("row")).distinct()
    if loose.isEmpty():
        return links
    large = members.where("_c > 1")
    own, _ = _parted(payload, "row", large)
    return links.unionByName(met(_loose_cells(large, loose, key, most), own, True).select("a", "b"))


def _texts_of(wanted: DataFrame, every: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` (at, _text) whose ``at`` may be in ``wanted``, before they meet a shuffle; the join that follows drops the others.

    Of a row that makes up more than one in ``HOT`` of all rows (``every`` has
    their ``at``), each task hands on one copy.
    """
    total = every.count()
    own = _parted(texts.where("_text is not null"), "at", wanted)[0]
    hot = F.broadcast(written(every.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") * HOT > total).select("at"), "repeated"))
    once = own.join(hot, "at", "left_semi").withColumn("_h", F.hash("_text")).dropDuplicates(["at", "_h"]).drop("_h")
    return own.join(hot, "at", "left_anti").unionByName(once)


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = WORDS, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_shingles, group, component_id) of every row: group numbers the components of links with Jaccard similarity of at least ``threshold`` (null for empty sets), component_id is the smallest id in it (of a row with an empty set, its own). row: the column that numbers the rows, if there is one."""
    need = int(np.floor((threshold - MAY_BE) * T))
    base = written(sketched(docs, doc_id, text, k, row), "sketches")
    classes = written(base.where("words_key is not null").groupBy("words_key").agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    copied, single = _parted(base.where("words_key is not null"), "words_key", classes.where("n > 1"))
    heads = single.unionByName(copied.join(classes.select(F.col("rep").alias("row")), "row", "left_semi"))
    reps = written(heads.select("row", "at", "n_shingles", "words_key", "sketch", "bands"), "heads")
    bands = T // ROWS
    keys = reps.select("row", F.explode(F.expr(f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(bands, i * 8 + 1, 8)))")).alias("key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("_c", F.ceil(F.col("n") / BUCKET).cast("int")), "buckets")
    buckets = written(joined_hot(_parted(keys, "key", shared)[0], shared, ["key"], "n").where("_c is not null").drop("n"), "buckets")
    met = _parted(reps.drop("bands"), "row", buckets)[0]
    families = components(_connected(buckets, "key", BUCKET, lambda last: _bucket_links(need, last), met.select("row", "sketch"), "maybe"))
    members = written(families.join(met, families.node == met.row).select("row", "component", "n_shingles", "at", "words_key", "sketch"), "families")
    sizes = written(members.groupBy("component").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.sum("n_shingles") / CHUNK, F.count("*") / TEXTS)).cast("int").alias("_c")), "sizes")
    texts = _texts_of(members.select("at"), base.select("at"), docs.select(F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("at"), F.col(text).alias("_text")))
    own = members.select("row", "at", "words_key", "sketch").join(texts, "at").withColumn("_h", F.xxhash64("_text")).dropDuplicates(["row", "at", "_h"]).drop("_h")
    sets = written(with_sets(own, "_text", k).where("_key = words_key").select("row", "sketch", "shingles"), "sets")
    dealt = joined_hot(members.select("component", "row"), sizes.select("component", "n", "_c"), ["component"], "n")
    links = _connected(dealt, "component", LOOSE, lambda last: _family_links(need, threshold, last), sets, "links")
    found = components(links).select(F.col("node").alias("rep"), F.col("component").alias("_comp"))
    named = written(classes.join(found, "rep", "left").select("words_key", F.coalesce("_comp", "rep").alias("group"), "least", "n"), "named")
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    whole = written(named.join(least, "group").select("words_key", "group", "component_id", "n"), "groups")
    out = joined_hot(base.select("row", F.col("id").alias("doc_id"), "n_shingles", "words_key"), whole, ["words_key"], "n")
    return out.select("row", "doc_id", "n_shingles", "group", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: the components of links with Jaccard similarity of at least ``threshold``."""
    out = grouped(docs, doc_id, text, threshold, k)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """``docs`` with one row of each group: one with the group's smallest id. Rows with empty sets all stay; so do different texts under one id, and rows without an id, unless they are near-duplicates."""
    (row,) = fresh(docs.columns, "_row")
    own = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    named = written(grouped(own, doc_id, text, threshold, k, row).select(F.col("row").alias(row), "doc_id", "group", "component_id"), "grouped")
    one = named.where("group is not null and doc_id <=> component_id").groupBy("group").agg(F.min(row).alias(row)).select(row)
    gone = written(named.where("group is not null").select(row).join(one, row, "left_anti"), "gone")
    may, stay = _parted(own, row, gone)
    return stay.unionByName(may.join(gone, row, "left_anti")).select(*docs.columns)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))

"""Histories of pages against plain loops: hot keys, spans, late and repeated batches, damage on the way."""

import random
from hashlib import md5

import pytest

from plainspoke.operators import history

PAGE = "id long, entity string, page string, ts long, raw_text string"


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice(["x", "y"]), rng.randrange(-200, 5000), rng.choice(["one", "two\nthree", "three\ntwo", "", "four\nfour"])) for i in range(n)]


def plain_versions(rows):
    out, by = [], {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        by.setdefault((r[1], r[2]), []).append(r)
    for own in by.values():
        kept = [r for k, r in enumerate(own) if not k or own[k - 1][4] != r[4]]
        out += [(r[0], r[1], r[2], md5(r[4].encode()).hexdigest(), kept[k - 1][0] if k else None, k > 0, k == len(kept) - 1) for k, r in enumerate(kept)]
    return sorted(out, key=lambda r: r[0])


def test_versions_and_lines_of_hot_keys(spark):
    rows = rows_of(700)
    df = spark.createDataFrame(rows, PAGE).repartition(3)
    assert sorted(map(tuple, history.versions(df).collect()), key=lambda r: r[0]) == plain_versions(rows)
    then, want, lines = {}, {}, set()
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        if (r[1], r[2]) in then:
            now, old = r[4].split("\n"), then[r[1], r[2]].split("\n")
            want[r[0]] = (len(set(now) - set(old)), len(set(old) - set(now)))
            for a, b, kind in ((now, old, "added"), (old, now, "removed")):
                lines |= {(r[0], kind, max(i for i, x in enumerate(a) if x == y), y) for y in set(a) - set(b)}
        then[r[1], r[2]] = r[4]
    assert {r.id: (r.added, r.removed) for r in history.line_changes(df).collect()} == want
    assert {tuple(r) for r in history.changed_lines(df).collect()} == lines


@pytest.mark.parametrize("order", ["time", "late"])
def test_merged_batches_are_the_whole_history(spark, tmp_path, order):
    rows = rows_of(300, 7)
    rows = sorted(rows, key=lambda r: r[3]) if order == "time" else rows
    store = history.PageStore(spark, f"file://{tmp_path}/store", buckets=4)
    parts = [rows[:100], rows[100:230], rows[230:]]
    for i, part in enumerate(parts):
        store.merge(spark.createDataFrame(part + part[:5], PAGE), f"b{i}")
        assert sorted(map(tuple, store.versions().collect()), key=lambda r: r[0]) == plain_versions([r for p in parts[: i + 1] for r in p])
    before = sorted(map(tuple, store.counts().collect()))
    store.merge(spark.createDataFrame(parts[1], PAGE), "b1")
    store.merge(spark.createDataFrame(parts[1], PAGE), "again")  # the same ids under another name add nothing
    assert sorted(map(tuple, store.versions().collect()), key=lambda r: r[0]) == plain_versions(rows)
    assert sorted(map(tuple, store.counts().collect()))[1:] == before and store.counts().where("batch = 'again'").first().new == 0
    assert sum(r[1] + r[2] for r in before) == 300
    texts = {r.id: r.raw_text for r in store.current().collect()}
    assert texts == {r[0]: next(x[4] for x in rows if x[0] == r[0]) for r in plain_versions(rows) if r[6]}


def test_an_unfinished_batch_is_merged_again(spark, tmp_path):
    """As after a driver that died before the counts were written."""
    rows = rows_of(120, 3)
    store = history.PageStore(spark, f"file://{tmp_path}/store", buckets=4)
    store.merge(spark.createDataFrame(rows[:60], PAGE), "a")
    store.merge(spark.createDataFrame(rows[60:], PAGE), "b")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}/store/batches/batch=b")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    store.merge(spark.createDataFrame(rows[60:], PAGE), "b")
    assert sorted(map(tuple, store.versions().collect()), key=lambda r: r[0]) == plain_versions(rows) and store.counts().count() == 2


def test_odd_rows(spark, tmp_path):
    store = history.PageStore(spark, f"file://{tmp_path}/store", buckets=2)
    store.merge(spark.createDataFrame([], PAGE), "none")
    store.merge(spark.createDataFrame([(None, "a", "x", 1, "t"), (1, "a", "x", 1, None), (2, "a", "x", 2, None), (3, None, None, None, "t")], PAGE), "odd")
    assert sorted((r.id, r.checksum is None, r.is_current) for r in store.versions().collect()) == [(1, True, False), (2, True, True), (3, False, True)]

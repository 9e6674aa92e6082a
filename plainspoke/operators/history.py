"""Histories of pages: neighbours without a window over a whole key, versions, and a store that batches are merged into.

A key with a third of all rows is one group of a window. Neighbours are found in
spans of the order instead: within a key's span by a window, and across spans by
one row for each span, which holds its last row. Only digests and places move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Places of the order that make one span, and folders that a store deals its keys to.
WIDTH, BUCKETS = 1000, 64


def neighbour(rows: DataFrame, keys: list[str], order: list[str], take: dict[str, str], after: bool = False, width: int = WIDTH) -> DataFrame:
    """``rows`` with the columns ``take`` (new name: column) of the row before (or after) in its key, null where there is none.

    ``order`` begins with a number; spans are ``width`` of it. Rows that are equal in
    keys and order have no order among themselves.
    """
    turn = F.desc if after else F.asc
    own = rows.withColumns({"_key": F.to_json(F.struct(*keys)), "_span": F.coalesce(F.floor(F.col(order[0]).cast("double") / width), F.lit(-(1 << 62)))})
    held = F.struct(*(F.col(c).alias(n) for n, c in take.items()))
    near = own.withColumn("_near", F.lag(held).over(W.partitionBy("_key", "_span").orderBy(*map(turn, order))))
    pick = F.min_by if after else F.max_by
    ends = own.groupBy("_key", "_span").agg(pick(held, F.struct(*order)).alias("_end"))  # one row a span
    far = ends.select("_key", "_span", F.lag("_end").over(W.partitionBy("_key").orderBy(turn("_span"))).alias("_far"))
    met = near.join(far, ["_key", "_span"]).withColumn("_met", F.coalesce("_near", "_far"))
    return met.select(*rows.columns, *(F.col("_met")[n].alias(n) for n in take))


def versions(pages: DataFrame) -> DataFrame:
    """Slowly changing pages: equal neighbours dropped, previous id, whether it changed, whether it is current."""
    own = pages.select("id", "entity", "page", "ts", F.md5("raw_text").alias("checksum"))
    return _chained(neighbour(own, ["entity", "page"], ["ts", "id"], {"_before": "checksum"}).where(~F.col("_before").eqNullSafe(F.col("checksum")) | F.col("_before").isNull())).select("id", "entity", "page", "checksum", "previous_id", "changed", "is_current")


def _chained(kept: DataFrame) -> DataFrame:
    keys, order = ["entity", "page"], ["ts", "id"]
    both = neighbour(neighbour(kept, keys, order, {"previous_id": "id"}), keys, order, {"_next": "id"}, after=True)
    return both.withColumns({"changed": F.col("previous_id").isNotNull(), "is_current": F.col("_next").isNull()})


def _moved(pages: DataFrame) -> DataFrame:
    """(id, then_id, same) of every row with a row before it: found on digests."""
    own = pages.select("id", "entity", "page", "ts", F.xxhash64("raw_text").alias("_hash"), F.sha2("raw_text", 256).alias("_sum"), F.col("raw_text").isNotNull().alias("_is"))
    got = neighbour(own, ["entity", "page"], ["ts", "id"], {"then_id": "id", "_then": "_sum", "_was": "_is"})
    return got.where(F.col("then_id").isNotNull() & F.col("_was")).select("id", "then_id", F.col("_then").eqNullSafe(F.col("_sum")).alias("same"))


def _texts(pages: DataFrame, moved: DataFrame) -> DataFrame:
    """(id, now, then) as lines for the rows that changed: only their texts move, and by id."""
    pick = moved.where(~F.col("same"))
    need = pick.select("id").union(pick.select("then_id")).distinct()
    some = pages.select("id", "raw_text").join(need, "id", "left_semi")
    then = some.select(F.col("id").alias("then_id"), F.col("raw_text").alias("_then"))
    return pick.join(some, "id").join(then, "then_id").select("id", F.split("raw_text", "\n").alias("now"), F.split("_then", "\n").alias("then"))


def line_changes(pages: DataFrame) -> DataFrame:
    """(id, added, removed): lines of each version that the one before lacks, and the reverse, as sets. ids are unique."""
    moved = _moved(pages)
    far = _texts(pages, moved).select("id", F.size(F.array_except("now", "then")).alias("added"), F.size(F.array_except("then", "now")).alias("removed"))
    return moved.where("same").select("id", F.lit(0).alias("added"), F.lit(0).alias("removed")).unionByName(far)


def changed_lines(pages: DataFrame) -> DataFrame:
    """(id, kind, nth, line): lines of each version that the one before lacks (added) and the reverse (removed), each once, with the last place they have. ids are unique."""
    own = _texts(pages.withColumn("raw_text", F.coalesce("raw_text", F.lit(""))), _moved(pages.withColumn("raw_text", F.coalesce("raw_text", F.lit("")))))
    # The last place of each line, by its place in the reversed array.
    side = lambda a, b, kind: F.transform(F.array_except(a, b), lambda x: F.struct(F.lit(kind).alias("kind"), (F.size(a) - F.array_position(F.reverse(F.col(a)), x)).cast("int").alias("nth"), x.alias("line")))
    return own.select("id", F.inline(F.concat(side("now", "then", "added"), side("then", "now", "removed"))))


_OBSERVED = "id long, entity string, page string, ts double, checksum string, kept boolean, previous_id long, changed boolean, is_current boolean, batch string, bucket int"
_COUNTED = "batch string, new long, unchanged long, first long"


class PageStore:
    """Observed pages under ``path``, merged batch by batch.

    ``pages`` holds one row for each observation, without its text: its digest and
    whether it is a version (differs from the observation before it), which version it
    follows and whether it is current. Keys are dealt to ``buckets`` folders by a hash.
    A batch reads the folders that it touches and overwrites these alone.
    ``texts`` holds each version's text once, by digest; ``batches`` the counts of each
    batch, written last: a batch without counts there was not finished.

    Merging is safe to repeat: observations are told apart by id, so a batch that was
    merged in part or in whole gives the same rows again, and the counts of a
    finished batch stay as they were. A late observation, older than those stored, finds its
    place: what follows it is compared anew.
    Null ids aren't observations and are left out; null texts have a null digest, which
    equals no other. Rows of one id in a batch count once, the latest and then the largest text.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = f"{self.path}/{name}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(folder) if there else self.spark.createDataFrame([], schema)

    def observations(self) -> DataFrame:
        return self._read("pages", _OBSERVED)

    def versions(self) -> DataFrame:
        """(id, entity, page, checksum, previous_id, changed, is_current) of every version."""
        return self.observations().where("kept").select("id", "entity", "page", "checksum", "previous_id", "changed", "is_current")

    def current(self) -> DataFrame:
        """(id, entity, page, checksum, raw_text) of the current versions."""
        return self.versions().where("is_current").select("id", "entity", "page", "checksum").join(self._read("texts", "checksum string, raw_text string, words long").dropDuplicates(["checksum"]), "checksum", "left")

    def counts(self) -> DataFrame:
        """(batch, new, unchanged, first): versions, observations without a change and first versions of a page, when the batch was merged."""
        return self._read("batches", _COUNTED).select("batch", "new", "unchanged", "first")

    def merge(self, batch: DataFrame, name: str) -> None:
        """Merges (id, entity, page, ts, raw_text)."""
        if not self.counts().where(F.col("batch") == name).isEmpty():
            return
        spark = self.spark
        own = batch.where("id is not null").select(F.col("id").cast("long"), F.col("entity").cast("string"), F.col("page").cast("string"), F.col("ts").cast("double"), "raw_text", F.md5("raw_text").alias("checksum"))
        bucket = F.pmod(F.xxhash64("entity", "page"), F.lit(self.buckets)).cast("int")
        seen = own.groupBy("id").agg(F.max_by(F.struct("entity", "page", "ts", "checksum"), F.struct("ts", "raw_text")).alias("_o")).select("id", "_o.*").withColumns({"batch": F.lit(name), "bucket": bucket})
        touched = [r[0] for r in seen.select("bucket").distinct().collect()]  # at most ``buckets``
        before = self.observations().where(F.col("bucket").isin(touched) & (F.col("batch") != name)) if touched else self.observations().limit(0)
        fresh = seen.join(before.select("id"), "id", "left_anti")  # an id that another batch brought stays as it is
        base = ["id", "entity", "page", "ts", "checksum", "batch", "bucket"]
        rows = neighbour(before.select(*base).unionByName(fresh.select(*base)), ["entity", "page"], ["ts", "id"], {"_before": "checksum"})
        rows = rows.withColumn("kept", ~F.col("_before").eqNullSafe(F.col("checksum")) | F.col("_before").isNull()).drop("_before")
        linked = _chained(rows.where("kept")).select(*base, "kept", "previous_id", "changed", "is_current")
        rest = rows.where(~F.col("kept")).withColumns({"previous_id": F.lit(None).cast("long"), "changed": F.lit(False), "is_current": F.lit(False)})
        merged = linked.unionByName(rest.select(linked.columns))
        # What is read is overwritten: the new folders are made in full beside the old ones first.
        made = f"{self.path}/made/{name}"
        merged.repartition("bucket").write.mode("overwrite").parquet(made)
        done = spark.read.schema(_OBSERVED).parquet(made)
        new = done.where((F.col("batch") == name) & F.col("kept"))
        texts = own.join(new.select("id"), "id", "left_semi").select("checksum", "raw_text", T.word_count(F.coalesce("raw_text", F.lit(""))).cast("long").alias("words")).dropDuplicates(["checksum"])
        texts.withColumn("batch", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/texts")
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/pages")
        told = done.where(F.col("batch") == name).agg(F.count_if("kept").alias("new"), F.count_if(~F.col("kept")).alias("unchanged"), F.count_if(F.col("kept") & F.col("previous_id").isNull()).alias("first"))
        told.select(F.lit(name).alias("batch"), "new", "unchanged", "first").coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/batches")


def page_scores(current: DataFrame, score: Column, path: str, name: str) -> DataFrame:
    """Scores (id, entity, page, checksum, score) of texts that have none under ``path`` yet, stored under the batch's name; all stored scores."""
    spark = current.sparkSession
    schema = "id long, entity string, page string, checksum string, score double, batch string"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    known = spark.read.schema(schema).parquet(path).where(F.col("batch") != name) if there else spark.createDataFrame([], schema)
    todo = current.join(known.select("checksum").distinct(), "checksum", "left_anti")
    out = todo.select("id", "entity", "page", "checksum", score.cast("double").alias("score"), F.lit(name).alias("batch"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    return spark.read.schema(schema).parquet(path)

"""The toxicity classifier: held-out accuracy, swapped groups, gradients of the penalty, whole texts, odd rows."""

import random

import numpy as np
import pytest

pytest.importorskip("plainspoke.llm")
from plainspoke.llm import toxicity as tx  # noqa: E402
from plainspoke.llm.common import Cache  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

WORDS = [f"wort{i}" for i in range(200)]
BAD = ["rotten", "vermin", "filthy"]


def made(rng, toxic, group=None):
    words = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
    for _ in range(3 if toxic else 0):
        words.insert(rng.randrange(len(words)), rng.choice(BAD))
    if group:
        for _ in range(3):
            words.insert(rng.randrange(len(words)), group)
    return " ".join(words) + "."


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, (t, _) in enumerate(rows)], "doc_id long, text string, score string, toxic int")
    return docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")


def test_held_out_rows_of_the_supplied_table(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = tx.trained(docs.where(~tx.held_out()), labels.where(~tx.held_out()))
    got = docs.where(tx.held_out()).join(labels, "doc_id").select("toxic", tx.scored(model, F.col("text")).alias("s")).collect()
    yes, no = [r.s for r in got if r.toxic], [r.s for r in got if not r.toxic]
    assert len(yes) > 5 and np.mean([s >= 0.5 for s in yes]) >= 0.7 and np.mean([s >= 0.5 for s in no]) <= 0.02


def test_neutral_mentions_are_left_alone(spark):
    """A group is named in the toxic labelled texts only: without the penalty neutral mentions of it raise the score, with it they hardly do, and insults are still found."""
    rng = random.Random(4)
    rows = [(made(rng, i % 2 == 0, ["muslims", "women"][i % 4 // 2] if i % 2 == 0 else None), int(i % 2 == 0)) for i in range(400)]
    docs, labels = frames(spark, rows)
    terms = ["muslims", "women", "men", "christians", "sailors"]
    plain = [made(rng, False) for _ in range(80)]
    mentions = [t.replace(t.split()[5], g) for t, g in zip(plain, ["muslims", "women"] * 40, strict=True)]
    insults = [made(rng, True) for _ in range(80)]

    def scores(fair, texts):
        model = tx.trained(docs, labels, terms=terms, fair=fair)
        known = Cache(model.weight)
        return np.array([model.score(t, known) for t in texts])

    blind, fair = (scores(f, mentions) - scores(f, plain) for f in (0.0, 10.0))
    print(blind.mean(), fair.mean(), (scores(0.0, mentions) >= 0.5).mean(), (scores(10.0, mentions) >= 0.5).mean(), (scores(10.0, insults) >= 0.5).mean())
    assert blind.mean() > 0.2 and fair.mean() < 0.1 * blind.mean()
    assert (scores(0.0, mentions) >= 0.5).mean() > 0.2 and (scores(10.0, mentions) >= 0.5).mean() < 0.02 and (scores(10.0, insults) >= 0.5).mean() > 0.9


def test_swaps():
    pairs = list(tx.counterfactuals("the women came. nobody else. old men and women stayed", ["men", "women", "sailors"], 2))
    assert all(len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 1 for a, b in pairs)
    assert {" ".join(a) for a, _ in pairs} == {"the women came", "old men and women stayed"} and len(pairs) == 6
    ((a, b),) = tx.counterfactuals("no one here", ["men", "women"], 2)
    assert len(a) == len(b) == 4 and {"no", "one", "here"} <= set(a) & set(b)
    assert list(tx.counterfactuals("", ["men"])) == [] == list(tx.counterfactuals("a b", []))


def test_penalty_is_the_squared_change():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 50, 6)).astype(np.int64), None) for _ in range(30)]
    changes = tx.Sparse([(f, rng.normal(size=len(f))) for f, _ in rows])
    w, eps = rng.normal(size=50), 1e-6
    loss = lambda w: (changes.times(w) ** 2).mean()
    grad = 2 / changes.n * changes.back(changes.times(w), 50)
    for i in range(0, 50, 7):
        step = np.eye(50)[i] * eps
        assert abs((loss(w + step) - loss(w - step)) / (2 * eps) - grad[i]) < 1e-5


def test_whole_texts_are_learned_and_scored(spark):
    """The only telling word stands at the end of very long texts."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choice(WORDS) for _ in range(20_000)) + (" rotten" * 400 if i % 2 else ""), i % 2) for i in range(12)]
    docs, labels = frames(spark, rows)
    model = tx.trained(docs, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", tx.scored(model, F.col("text")).alias("s")).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(rows))


def test_odd_rows(spark):
    none = frames(spark, [])
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "!!"), (2, "rotten"), (2, "rotten")], "doc_id long, text string")
    for docs, labels in [frames(spark, [("rotten", 0), ("fine", None)]), frames(spark, [("a b", 1)])]:
        model = tx.trained(docs, labels.where("doc_id is not null"))
        got = [r.s for r in odd.select(tx.scored(model, F.col("text")).alias("s")).collect()]
        assert len(set(got)) == 1 and (got[0] > 0.9) == (docs.count() == 1)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tx.trained(empty, spark.createDataFrame([], "doc_id long, toxic int")).score("", Cache(len)) < 0.01
    assert empty.select(tx.scored(tx.Toxicity(), F.col("text")).alias("s")).collect() == [] and none

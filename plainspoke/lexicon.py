"""Lexicons: small tables of (category, term, mode, weight, ordinal), given to the detectors as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "category string, term string, mode string, weight int, ordinal int"


def lexicon(spark: SparkSession, terms: dict[str, list[str]], mode: str = "substr", weight: int = 1) -> DataFrame:
    """A table from category -> terms, in the order given."""
    rows = [(c, t, mode, weight, i) for i, (c, t) in enumerate((c, t) for c, own in terms.items() for t in own)]
    return spark.createDataFrame(rows, SCHEMA)


#: Categories that the integrity score looks at, with words that the supplied prose holds; callers bring their own lists.
PROSE = {
    "constraint": ["only", "there", "was"],
    "hedge": ["then", "with"],
    "reassure": ["this"],
    "blend": ["that"],
    "capability": ["from", "for the"],
    "defer": ["which", "here"],
    "collapse": ["and", "des"],
    "calm": ["les"],
    "ask": ["the", "est"],
}

"""The corpus pipeline: documents through five operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of ``documents``.  ``run`` keeps no stage in memory: each is written to shared
storage and read again, as a production run would do.

Every stage takes empty tables (and returns one), extra columns of any name, nulls in any column, empty and
very long texts, ties and repeated rows; each says what it makes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakesift.llm import decontaminate, jaccard, linedup, mixing, toxicity
from lakesift.llm.common import stash, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with toxic spans go (score of 0.5 or more).

    Null and empty texts stay, rows without an id are judged like others, repeated rows stay or go together.  Without
    labels, or toxic words among them, all stay.
    """
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that occur again, up to a few edits, stay where they are first; no document goes.

    Null and empty texts stay as they are.  Whole copies of a text stay like it, repeated rows stay alike, and each of the rows
    with one id (or without any) loses its own lines.
    """
    return linedup.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more over 5-word shingles, that with the smallest id stays.

    Documents without words stay, and rows without an id unless they are like one that has an id.  Of rows with one id one stays.
    """
    return jaccard.keep_one(docs, width=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts stay, null and empty items match nothing, repeated rows stay or go together.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes, with its ``rate`` and the number of the ``copy``.

    A null text has size 0, a null source is a source; each of several repeated rows has copies of its own.  New columns get
    an underscore where documents have one of the name.
    """
    return mixing.sample(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
]

#: The stages learn, cluster and solve; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

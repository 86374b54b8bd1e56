"""The corpus pipeline: quality rules, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; every result is written as Parquet
below the shared checkpoint folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard_join, mixing, packing, quality, substrings
from millrace.llm.common import discard, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted rules keep.

    Null and empty texts have no words, so they go; very long texts are measured whole; repeated rows get the same verdict;
    rows with null ids are judged like others; other columns pass through; an empty table gives an empty one.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates, that of the least id: shingles of five words, similarity 0.8.

    Rows without words link with nothing and all stay; null ids come last in a group; repeated rows are one group; ties of
    id and text are broken by a hash of the whole row; other columns pass through; an empty table gives an empty one.
    """
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur twice; n_chars follows the text.

    Null and empty texts stay as they are, and so do texts that lose nothing; repeated rows lose their windows like
    others; rows with null ids count; other columns pass through; an empty table gives an empty one.
    """
    return substrings.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Documents without words are not taken; null sources are a source; rows of equal or no id are mixed alike; other columns
    pass through; an empty table gives an empty one.
    """
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document, with its sequence and place there.

    Null texts are empty ones, of one id; long ones are cut into pieces; repeats of a document are packed like others;
    other columns are not needed; an empty table gives an empty one.
    """
    return packing.best_fit(packing.pieces(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: The fit of the quality rules, tokens and pseudorandom draws are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: the pieces that `best_fit_packing` returns. A stage's table goes when the next one's is written.

    Odd rows are treated as each stage says; an empty table gives an empty result.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus from documents to tokens: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkseek.llm import bpe, exact_dedup, mixing, quality, simhash
from sparkseek.llm.base import clear, materialise, settle, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the others stay as they are, all columns.

    Rows are decided one by one, by their texts: null and empty texts by what the curve gives where nothing is shown,
    repeated rows alike, null ids like others. Without labelled texts of both classes nothing goes. An empty table
    stays empty.
    """
    return quality.quality_filter(docs, _table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays, all columns.

    Null texts are copies of nothing and all stay; empty texts are copies of each other. A null id counts as the
    largest; of rows that are equal in id and text one stays. An empty table stays empty.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, all columns.

    Null texts, texts without a word and rows with a null id stay. Rows that repeat an id are one document: all stay or
    all go. An empty table stays empty.
    """
    return simhash.near_dedup(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its rate says, so that the domains have their target shares of tokens.

    A row may come several times or not at all, with all its columns. Null and empty texts come by the rate of the
    priors; rows that are equal in id and text come equally often. Without labels every domain is equally likely for
    every text. An empty table stays empty.
    """
    return mixing.mix_rates(docs, _table(spark, sf_dir, "labels"), repeat=True)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, all columns, with tokens, n_tokens and round_trip; the tokens decode to the text.

    A null text has nulls in all three, an empty text no tokens. An empty table stays empty.
    """
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("byte-level BPE", tokenise),
]

#: SQL can't express compression, SimHash, gradient steps or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next.

    Once a stage is written, what it and the one before had written goes. Rows are what the stages define, nulls, empty
    texts, ties and repeated rows included; an empty table gives an empty result.
    """
    docs, before = _table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clear(spark, docs, before=before)
        settle(spark)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

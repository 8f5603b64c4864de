"""A training corpus from raw documents: quality, near duplicates, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps with the columns of ``documents``; the last one
returns their places in the shards. ``run`` applies the stages one after the other, each on what its predecessor wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm import kd_sharding, mixing, near_text, pu_quality, suffix_decontamination
from skyfold.llm.spark_util import remove, shared_folder, table

SHARDS = 24
#: Share of the tokens that the mixture reads; a document is read once at most.
MIX_SHARE = 0.95


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. A null text counts as empty; repeated rows stay or go together; an empty table stays empty."""
    return pu_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, a similarity of 0.8 or more.

    The smallest doc_id stays, a null one last; texts without words are one group; of repeated rows one stays; an empty table stays empty.
    """
    return near_text.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words of a benchmark item. Texts without words stay; repeated rows stay or go together; an empty table stays empty."""
    return suffix_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's prefix of one seeded epoch: languages, then sources, weigh the square root of their tokens.

    A null language or source is a node of its own; a null text has no tokens; repeated rows stay or go together; an empty table stays empty.
    """
    mixed = mixing.mix(docs, levels=("lang", "source"), share=MIX_SHARE, max_epochs=1, power=0.5)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of what is left. A null text has 8 bytes; null metadata come first; repeated rows have a slot each; an empty table stays empty."""
    return kd_sharding.kd_shards(docs, shards=SHARDS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mixture", mixture), ("shards", shards)]
#: No SQL says what the trained classifier decides.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of ``documents`` after all stages. What a stage wrote is removed once the next has read it."""
    docs, last = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, last)
        last = f"{folder}/{name}"
    return docs

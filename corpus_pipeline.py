"""The corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Each stage works on all rows that the stage before kept; every stage but the last returns the
columns of ``documents``.

Defined results: null and empty texts have too few words and go in the first stage; very long
texts are judged, compared and packed whole; a row with a null id is judged by its text alone;
an empty table gives an empty result, and so do tables without labels; columns beyond those of
``documents`` are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import language_id, near_dup, packing, quality_rules
from tabulon.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The stages learn models and encode tokens, which SQL can't express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base check or that a learned rule picks out."""
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules, *COLUMNS).where("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those farther from every language's profile than
    the documents of the learned languages are."""
    profiles = language_id.learn(docs)
    found = materialise(language_id.identify(docs, profiles, *COLUMNS), "pipeline-languages")
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("distance") <= language_id.reach(found))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near duplicates.

    Rows that share an id are one document: all that differ stay with it, and of equal rows one.
    Rows without an id are in no group and stay.
    """
    judged = near_dup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL")
    kept = judged.groupBy("doc_id").agg(F.count("*").alias("_rows"))
    stay = docs.select(*COLUMNS).join(kept, "doc_id")
    single = stay.where("_rows = 1").select(*COLUMNS)
    several = stay.where("_rows > 1").select(*COLUMNS).dropDuplicates()
    return single.unionByName(several).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, in as few sequences as can be."""
    return packing.pack_documents(docs, tokenizer=public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

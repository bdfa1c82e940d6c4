"""The corpus pipeline: quality rules, exact and near duplicates, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and works on all that the stage before kept. All but the last return the
columns of ``documents``. ``run`` applies them, each stage's rows written and
read again.

Stages see documents with any columns besides ``doc_id, text, lang, source``
and return them with their values and types, also those named like an
operator's results. Defined cases: missing labels leave quality to the base
rules; null, empty and short texts have too few words and go in the first stage;
rows that repeat both id and text are one row after the second stage, and of
different rows with the smallest id of a near-duplicate group all stay; ties
(equal ids, equal scores) fall alike on every run; a null id is smaller than any
other; texts of any length are read whole; an empty table gives no rows at
every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import exactdedup, neardup, packing, quality
from shroud.llm.common import apart, save
from shroud.llm.queries import BYTE_BPE, mixed, table, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the base rules and the likelihood ratio keep."""
    labels = table(spark, sf_dir, "labels")
    return quality.rate(apart(docs, "doc_id", "text"), labels).where("kept").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest id."""
    return exactdedup.drop_copies(docs, keep="max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of near duplicates (five words, 0.8) the one with the smallest id."""
    return neardup.drop_near_duplicates(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the mix's margins of source, language and topic."""
    return mixed(apart(docs, "doc_id", "text", "source", "lang")).where("kept").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents left; one row per piece."""
    p = packing.pack_documents(docs, vocabulary(BYTE_BPE), spaces="leading", end_id=0)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                    "tier", "step_group")


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("near-duplicate removal", near_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: Packing needs the tokenizer and near duplicates the components, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

"""The corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``documents``. Nulls, ties and repeated rows
have the results that the operators state. Rows are told apart by id and text together,
so rows that share an id, or have none, are judged each by its own text; the
near-duplicate stage keeps a row with a null doc_id only of a group without any id, and
then one row of the group. Where rows are alike in id and text, one of them stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regmesh.llm import decontaminate, packing, pii, quality_classifier, simhash
from regmesh.llm.common import Scratch, table, text_of

#: Best-fit packing and the classifier are not expressible in SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts."""
    score = quality_classifier.scorer(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(text_of(F.col("text"))) >= 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group the document with the smallest id, once; of a group without ids one row."""
    firsts = Scratch(spark, "kept").cut(simhash.survivors(docs))  # keys alone: the texts are joined to them once
    # the keys grow with the corpus: merged at every size, never broadcast
    same = lambda ids: docs["doc_id"].eqNullSafe(ids["kept_id"]) & (simhash.text_key(docs["text"]) == ids["kept_key"])
    only = lambda ids: docs.join(ids.hint("merge"), same(ids), "left_semi")
    repeated = firsts.where("n > 1")
    if repeated.isEmpty():
        return only(firsts)
    once = only(repeated).withColumn("__key", simhash.text_key(F.col("text"))).dropDuplicates(["doc_id", "__key"]).drop("__key")
    return only(firsts.where("n = 1")).unionByName(once)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose text holds no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows the text where the table has it."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("SimHash near-duplicates", near_duplicates), ("benchmark decontamination", leaks), ("PII", personal_data), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

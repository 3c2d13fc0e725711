"""From raw documents to packed training sequences, in five stages.

Every stage but the last returns the columns of ``documents``, whatever else they are called. What a
stage decides takes effect: rejected documents and copies go, failed lines leave the text and
secrets are masked in it.

Null and empty texts have no words and go in the first stage, like other short ones. Rows with a null
id are judged by their texts, and as copies of nothing. Of rows with equal id and text one stays;
other texts of a repeated id are documents of their own. Of a group of copies the smallest id stays.
Very long texts are read whole in every stage, and without documents or labels the result has no
rows or all that the rules keep.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.classifier import classify, train
from spindrift.llm.common import cut, read, scope
from spindrift.llm.minhash import NearDuplicates
from spindrift.llm.packing import pack_documents
from spindrift.llm.quality_rules import quality_rules
from spindrift.llm.secret_scan import scan_secrets

MASK = "[SECRET]"


def _on_text(docs: DataFrame, work: Callable[[DataFrame], DataFrame], text: str = "text", changes: bool = False) -> DataFrame:
    """``docs`` after ``work`` on its text, column ``text`` of the result being the new one; with
    ``changes``, n_chars is its length.

    Other columns wait under names that no operator makes, so those of equal names don't meet.
    """
    apart = {c: f"__doc_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    made = work(docs.select("text", *[F.col(f"`{c}`").alias(a) for c, a in apart.items()]))
    back = {"text": F.col(text)} | {c: F.col(a) for c, a in apart.items()}
    if changes and "n_chars" in apart:
        back["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return made.select(*[back[c].alias(c) for c in docs.columns])


def _without_failed_lines(sample: DataFrame, text: str) -> DataFrame:
    return quality_rules(sample, text).drop(text).withColumnRenamed("cleaned", text)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them."""
    return _on_text(docs, lambda apart: quality_rules(apart).where("kept"), "cleaned", changes=True)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from labelled ones whose failed
    lines are taken out, like those that it judges."""
    model = train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), prepare=_without_failed_lines)
    return _on_text(docs, lambda apart: classify(apart, model).where("predicted = 1"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more."""
    return NearDuplicates().deduplicated(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return _on_text(docs, lambda apart: scan_secrets(apart, redact=MASK), changes=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("quality_classifier", classifier_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier and the packing; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of ``documents``. What lies between two stages is deleted
    once the stage after it is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope():
            docs = cut(stage(spark, docs, sf_dir), name, outer=1)
    return STAGES[-1][1](spark, docs, sf_dir)

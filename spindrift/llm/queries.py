"""The driver's queries of the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .chat import format_chats
from .classifier import classify, train
from .common import arrow_rows, read
from .minhash import NearDuplicates
from .packing import pack_documents
from .quality_rules import quality_rules
from .secret_scan import scan_secrets
from .token_counts import token_counts
from .vectors import MetricJoin
from .urls import rule_table, url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding, decoding and digests are chained in one pass, so ids don't travel between processes."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = bpe.encode_batches(batches, path, pattern, "text", 12_000_000, 400_000)
        text = bpe.Vocabulary.load(path).text
        for batch in bpe.decode_batches(coded, path):
            ids = bpe.lists(batch.column("ids"))
            digests = [hashlib.sha256(" ".join([text[i] for i in x]).encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(x).hexdigest() for x in batch.column("decoded").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, ids)), pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_rows(read(spark, sf_dir, "documents")).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = MetricJoin().classes(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_words")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = NearDuplicates(shingle=3, percent=85, bands=25)
    found = near.classes(read(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = classify(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_minhash": op6_minhash,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chat_format": op8_chat_format,
    "op9_url_filter": op9_url_filter,
    "op10_token_counts": op10_token_counts,
}

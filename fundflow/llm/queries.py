"""Queries of the text operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.llm import (
    blocks, bpe, common, decontaminate, forest, jaccard, language, licences, merkle,
    quality, secrets_ledger, statements, suffixes, toxicity, whitening)
from fundflow.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_licences(spark, sf_dir):
    return licences.report(licences.scan(common.table(spark, sf_dir, "documents")))


@query
def op2_decontaminate(spark, sf_dir):
    return decontaminate.find(common.table(spark, sf_dir, "documents"),
                              common.table(spark, sf_dir, "benchmark"))


@query
def op3_bpe(spark, sf_dir, path: str | None = None):
    import public_tokenizers
    return bpe.encode(common.table(spark, sf_dir, "documents"),
                      path or public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_toxicity(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    held = common.bucket_of("doc_id", 4) == 2
    scored = toxicity.score(docs, toxicity.learn(docs, labels.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                         "n_direct", "n_misspelled", "n_quoted")


@query
def op5_quality(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.judge(docs, quality.learn(docs, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule")


@query
def op6_suffixes(spark, sf_dir):
    return suffixes.remove(common.table(spark, sf_dir, "documents")) \
        .withColumnRenamed("n_units", "n_bytes")


@query
def op7_secrets(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    ledger = secrets_ledger.extend(docs, scratch_path(spark, "secret-ledger"))
    return secrets_ledger.report(secrets_ledger.by_document(docs, ledger))


@query
def op8_blocks(spark, sf_dir):
    return blocks.remove(common.table(spark, sf_dir, "documents")) \
        .withColumnRenamed("n_units", "n_words").drop("n_spans")


@query
def op9_jaccard(spark, sf_dir):
    return jaccard.join(common.table(spark, sf_dir, "documents")).drop("c1", "key", "component")


@query
def op10_language(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    held = common.bucket_of("doc_id", 5) == 0
    out = language.predict(docs, language.learn(docs.filter(~held).select("doc_id", "text", "lang")))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op11_whitening(spark, sf_dir):
    grid = whitening.on_grid(common.table(spark, sf_dir, "embeddings"))
    return whitening.by_component(grid, whitening.fit(grid))


@query
def op12_forest(spark, sf_dir):
    return forest.nearest(common.table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query
def op13_merkle(spark, sf_dir):
    return merkle.manifest(common.table(spark, sf_dir, "documents"), merkle.without_newlines())


ORACLES.update({"op6_suffixes": statements.SUFFIXES, "op8_blocks": statements.BLOCKS,
                "op9_jaccard": statements.JACCARD, "op13_merkle": statements.merkle()})

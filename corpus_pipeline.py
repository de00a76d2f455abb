"""From raw documents to tokens: five stages, each over all rows the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fundflow.llm import bpe, common, decontaminate, jaccard, secrets_ledger, toxicity
from fundflow.session import materialise, scratch_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go.  The model is learned from the labelled documents of
    ``sf_dir`` outside the held-out part."""
    labels = common.table(spark, sf_dir, "labels").filter(common.bucket_of("doc_id", 4) != 2)
    return toxicity.reject(docs, toxicity.learn(common.table(spark, sf_dir, "documents"), labels))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows."""
    ledger = secrets_ledger.extend(docs, scratch_path(spark, "secret-ledger"))
    return secrets_ledger.redacted(docs, secrets_ledger.by_blob(ledger))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name, rebalance=False)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline in five stages, each a DataFrame of documents in and one out, written as Parquet in between.

Every stage works on all rows that the stage before kept. Nulls, empty texts and repeated rows are treated as each
operator's docstring says; an empty table runs through to an empty result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, jaccard, secret_links, toxicity
from siltstone.llm.common import Stash, table
from siltstone.llm.mixing import Mix
from siltstone.llm.queries import held_out

#: Rows of a batch for Python workers, and words that the tokenizer keeps in one: they share executors with what the stages before leave in the JVM.
BATCH, KEPT_WORDS = 2_000, 150_000


def by_small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of at most BATCH rows, so that a batch of long ones fits beside the JVM."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH:
        spark.conf.set(name, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go."""
    by_small_batches(spark)
    model = toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels"), held_out=held_out))
    return toxicity.keep_clean(docs, model, 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 80 % of their five-word shingles, the least doc_id stays."""
    by_small_batches(spark)
    return jaccard.keep_one(docs, k=5, percent=80, stash=Stash(spark, "pipeline"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, and weak parts that are linked with one, are masked in the texts."""
    by_small_batches(spark)
    out = secret_links.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """150 % of all words: every document once, and a second time what its source's weight calls for."""
    by_small_batches(spark)
    return Mix(docs, Stash(spark, "pipeline"), share=1.5, cap=2.0, floor=1.0).documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    by_small_batches(spark)
    return bpe.encode_column(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"), kept_words=KEPT_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents of sf_dir."""
    stash, docs = Stash(spark, "stages"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        before, docs = docs, stash(out)
        stash.drop(before)
    return docs

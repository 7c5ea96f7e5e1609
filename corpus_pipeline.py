"""A corpus pipeline of five stages, each a text operator applied to what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import jaccard, langid, mixing, packing, toxicity
from panelkit.sources.io import materialize

TOKENIZER = "byte_bpe_50k.json"
#: Breaks per symbol from which on a text is in none of the learnt languages. Labelled languages
#: need about 0.17 of their own; strings of random letters more than 0.5.
FOREIGN = 0.5
#: A language whose own text breaks more often (scripts of many letters) is bounded at this part of the way
#: from its own rate to 1 instead.
BEYOND = 1 / 3
#: The rate of n symbols counts sqrt(n / (n + EVIDENCE)) times, so none of under 8 symbols reaches FOREIGN.
EVIDENCE = 24


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


#: Rows of an Arrow batch: executors and their Python workers hold so many whole texts at a time.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _digest(docs: DataFrame) -> Column:
    """64 bits of all columns. A hash passes over nulls, so where they are goes into it too."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a toxicity score of 0.5 or more. The model learns from all labels whose
    document is still there; null and empty texts score like the average and stay."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, folds=None)
    scored = docs.withColumn("_toxicity", toxicity.score(spark, model))
    return _as_documents(scored.filter("_toxicity < 0.5"), docs)


def reject_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null text, no letter, or further from every learnt
    language than any language is from itself. A short text shows little of that and so is kept."""
    _small_batches(spark)
    model = langid.fit(docs, folds=None)
    found = docs.withColumn("_lang", langid.predict(spark, model))
    bounds = [max(FOREIGN, own + BEYOND * (1 - own)) for own in model.own]
    bound = F.lit(FOREIGN)
    for name, own in zip(model.languages, bounds):
        bound = F.when(F.col("_lang.lang_pred") == name, own).otherwise(bound)
    trust = F.sqrt(F.col("_lang.symbols") / (F.col("_lang.symbols") + EVIDENCE))
    kept = (F.col("_lang.lang_pred") != langid.UNDETERMINED) & (F.col("_lang.rate") * trust < bound)
    return _as_documents(found.filter(kept), docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, 0.8): the one with the smallest
    id, or of several such rows the one with the smallest digest. A null id counts as the largest.

    Rows are told apart by a 64-bit digest of all their columns, not by ids: of rows equal in all
    columns one stays, and documents without words are otherwise no duplicates of each other."""
    _small_batches(spark)
    keyed = docs.withColumn("_digest", _digest(docs))
    groups = jaccard.jaccard_groups(keyed, jaccard.Settings(words=5, percent=80), "_digest")
    members = groups.select("_digest", F.col("component_id").alias("_group")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_digest")))
    kept = keyed.select("doc_id", "_digest").distinct().join(members, "_digest").groupBy("_group").agg(first.alias("_first"))
    rest = keyed.join(kept.select("_first._digest"), "_digest", "left_semi")
    return _as_documents(rest.dropDuplicates(["doc_id", "_digest"]), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix says: rows repeat, or go where it is not taken. Rows are told
    apart by a digest of all their columns; of rows equal in all columns one holds the copies of all."""
    _small_batches(spark)
    digest = _digest(docs)
    mixed = mixing.mix(docs, digest=digest).groupBy(F.col("digest").alias("_digest"))
    copies = materialize(mixed.agg(F.sum("copies").cast("int").alias("_copies")).filter("_copies > 0"))
    taken = docs.withColumn("_digest", digest).dropDuplicates(["_digest"]).join(copies, "_digest")
    repeated = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return _as_documents(repeated, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of 1024."""
    _small_batches(spark)
    pieces = packing.cut_documents(docs, public_tokenizers.path(TOKENIZER))
    return packing.pack(pieces).withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", reject_toxic),
    ("language ID", reject_language),
    ("n-gram Jaccard join", deduplicate),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]
#: SQL expresses none of the stages but the join; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's rows are written to the shared folder and
    read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

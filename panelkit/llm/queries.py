"""Registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import chat, fingerprint, jaccard, langid, licenses, merkle, mixing, packing, quality, repair, tokens, toxicity
from panelkit.llm.common import documents
from panelkit.llm.oracles import CHAT_FORMAT, CONVERSATION_REPAIR, MERKLE_MANIFEST
from panelkit.sources.io import materialize

TOKENIZER = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return packing.pack(pieces).withColumnRenamed("key", "doc_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(documents(spark, sf_dir), labels)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard.jaccard_groups(documents(spark, sf_dir), jaccard.Settings(words=3, percent=90))
    return groups.select("doc_id", "n_shingles", "component_id")


def op6_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join with each document's number of links, which the SQL of op6_jaccard_join leaves out."""
    return jaccard.jaccard_groups(documents(spark, sf_dir), jaccard.Settings(words=3, percent=90))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_probe(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokens.token_folder(spark)
    tokens.write_token_files(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), folder)
    return tokens.read_token_files(spark, folder).withColumnRenamed("key", "doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.conversations(spark, sf_dir)
    return repair.repair(repair.damaged(turns), turns)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.conversations(spark, sf_dir).select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', r'{hard}'), (-7L, 1L, 'assistant', r'{hard}') AS t(conv_id, turn, role, text)")
    log = chat.turns_as_log(turns.unionByName(more))
    written = materialize(chat.render(chat.fold_events(log)))
    read = written.select(
        "conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.learnt(F.col("formatted"), F.col("loss")).alias("learnt"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.when(third, F.translate("text", upper, lower)).otherwise(F.col("text"))
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    proven = merkle.prove(docs, "doc_id", "lang", columns, {"text": tampered})
    folded = merkle.fold(F.col("given"), F.col("proof"))
    return proven.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_mix_sources, op3_pack_sequences, op4_license_scan, op5_toxicity,
        op6_jaccard_join, op6_link_counts, op7_fingerprints, op8_token_files, op9_quality_rules,
        op10_language_id, op11_conversation_repair, op12_chat_format, op13_merkle_manifest,
    )
}
#: The smallest id that links lead to, by a walk over all links; shingles as lists of words.
ORACLES = {
    "op6_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * c >= 90 * (a.n + b.n - c)),
twoway AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (
  SELECT doc_id, doc_id AS other FROM n
  UNION SELECT r.doc_id, b.y FROM reach r JOIN twoway b ON r.other = b.x)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM n JOIN reach r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
""",
    "op11_conversation_repair": CONVERSATION_REPAIR,
    "op12_chat_format": CHAT_FORMAT,
    "op13_merkle_manifest": MERKLE_MANIFEST,
}

"""A corpus pipeline of five stages: language ID, near-dedup, decontamination, secret redaction, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrweave.llm import decontaminate, lang_id, secrets
from corrweave.llm.bpe import encode_decode
from corrweave.llm.neardup import NearDupParams, near_duplicates
from corrweave.llm.queries import tokenizer_path
from corrweave.llm.text import limit_batches
from corrweave.plans.shared import broadcast_if_small, delete, materialize, new_path, scratch

#: Texts of which a smaller share of letter n-grams belongs to the best language are rejected, as those without letters are.
LEAST_LANGUAGE_SCORE = 0.2
#: Five words and a similarity of 0.8, with as many bands as keep the loss at that similarity near one in five thousand.
NEAR = NearDupParams(words=5, percent=80, side=9, rows=2)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``lang`` names; null, empty and letterless texts go. Where no row names a language, there is nothing to judge by and all stay."""
    limit_batches(spark)
    model = lang_id.train(docs)
    return lang_id.keep_identified(docs, model, LEAST_LANGUAGE_SCORE) if model.languages else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Rows repeated under one id and text stay once. Of texts in one group that share its smallest id, the one with the
    smallest hash stays. A row without an id goes if its group has one with an id; else it stays, once for each text.
    Null and empty texts are in no group.
    """
    limit_batches(spark)
    columns = ["doc_id", "text_hash", "component_id", "n_shingles", "kept"]
    found = materialize(near_duplicates(docs, NEAR).select(*columns), "verdicts")
    gone = found.where(~F.col("kept")).select("doc_id", "text_hash")
    kept = found.where("kept")
    rivals = kept.where("n_shingles > 0 and component_id is not null").groupBy("component_id").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least < most")
    if not rivals.isEmpty():
        losers = kept.where("n_shingles > 0").join(rivals, "component_id").where("text_hash != least").select("doc_id", "text_hash")
        gone = gone.unionByName(losers)
    gone = broadcast_if_small(materialize(gone.distinct().select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")), "gone"))
    out = docs.join(gone, docs["doc_id"].eqNullSafe(gone["id"]) & (F.xxhash64(docs["text"]) == gone["hash"]), "left_anti")
    again = kept.groupBy("doc_id", "text_hash").count().where("count > 1")
    if again.isEmpty():
        return out
    again = materialize(again.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")), "again")
    repeated = out["doc_id"].eqNullSafe(again["id"]) & (F.xxhash64(out["text"]) == again["hash"])
    return out.join(again, repeated, "left_anti").unionByName(out.join(again, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no window of a benchmark item; null and empty texts repeat none."""
    limit_batches(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by its kind in brackets; n_chars follows. Null and empty texts stay as they are."""
    limit_batches(spark)
    return secrets.redact(docs, secrets.train(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the decoded text; null and empty texts have no ids."""
    limit_batches(spark)
    encoded = encode_decode(docs, tokenizer_path())
    return encoded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: Trained models, minhashes and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again, and what a stage wrote for itself goes with it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

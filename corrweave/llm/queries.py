"""The thin queries ``opN_<name>`` over the whole tables, and the SQL that they are held against."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrweave.llm import lang_id, secrets
from corrweave.llm.bpe import encode_decode
from corrweave.llm.chunks import repeated_passages
from corrweave.llm.decontaminate import find_leaks
from corrweave.llm.lm import score
from corrweave.llm.neardup import near_duplicates
from corrweave.llm.quality import judge
from corrweave.llm.text import limit_batches
from corrweave.llm.token_store import read_store, write_store
from corrweave.llm.urls import Rule, judge_urls
from corrweave.plans.shared import new_path


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary; CORRWEAVE_TOKENIZER names another file."""
    import public_tokenizers

    return os.environ.get("CORRWEAVE_TOKENIZER") or public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int) -> Column:
    """Whether the remainder of crc32(doc_id as text) is 2: such documents are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each document, and the rates that the fences judge."""
    return judge(_table(spark, sf_dir, "documents"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def leak_digests(found: DataFrame) -> DataFrame:
    """Counts and the digest of what ``find_leaks`` returns."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    return leak_digests(find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


#: Verdict, host and path of the rules.
URL_RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of each page, its template, the branch that it was merged into and that branch's purity."""
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    docs = _table(spark, sf_dir, "documents")
    model = lang_id.train(docs, ~held_out(4))
    return lang_id.identify(docs, model).select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    return score(_table(spark, sf_dir, "documents"), ~held_out(7)).withColumn("held_out", held_out(7))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files."""
    store = new_path(spark, "tokens")
    write_store(_table(spark, sf_dir, "documents"), store, tokenizer_path())
    return read_store(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text, of what ``find_secrets`` returns."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document."""
    docs = _table(spark, sf_dir, "documents")
    return secret_digests(secrets.find_secrets(docs, secrets.train(docs)))


def op9_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, at, end, words, first_doc, drop, earlier of each passage that a document shares with another."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def encode_digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of what ``encode_decode`` returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return encode_digests(encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_neardup": op2_neardup,
    "op3_decontaminate": op3_decontaminate,
    "op4_urls": op4_urls,
    "op5_language": op5_language,
    "op6_lm": op6_lm,
    "op7_token_store": op7_token_store,
    "op8_secrets": op8_secrets,
    "op9_chunks": op9_chunks,
    "op10_bpe": op10_bpe,
}
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Where SQL can express a query. The others are tested against brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op2_neardup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPACED_WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(len(ws), 3) - 1], ' ') AS win FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b ON a.win = b.win AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept FROM r JOIN documents d USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    "op3_decontaminate": f"""WITH w AS (SELECT doc_id, {_ALNUM_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_ALNUM_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win FROM b, unnest(range(1, greatest(len(ws) - 8, 2))) t(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win FROM w, lens, unnest(range(1, len(ws) - n + 2)) t(i)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(n)) q(k) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM h) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)""",
}

"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, conversations, licenses, mixing, neardup, oracles, packing, phrases, quality, rules, secret_scan, sharding, topk, urls
from .common import cut, scratch_path, table

N_SHARDS = 40
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer files are installed; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = mixing.rated(mixing.fit(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), least=1.0))
    shares = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(mixing.TARGETS)]
    return found.select("doc_id", "n_tokens", *shares, "rate", "copies")


def labelled_domains(docs: DataFrame, labels: DataFrame, max_rows: int = mixing.FIT_ROWS) -> DataFrame:
    """(doc_id, text, domain): the language of up to max_rows labelled documents, by md5 of doc_id. The bound is applied
    to the labels, so the join sends them to the documents and moves no text."""
    taken = labels.where("doc_id is not null").select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text", F.col("lang").alias("domain")).join(F.broadcast(taken), "doc_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(sharding.with_sizes(table(spark, sf_dir, "documents")), "sized")
    slot_map = sharding.save_map(sharding.plan_map(sharding.slot_sizes(sized), N_SHARDS), scratch_path(spark, "slot-map"), 0)
    return sharding.place(sized, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("posterior")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))
    return found.withColumn("notices", F.concat_ws(",", "notices"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations")
    return conversations.report_all(found, conversations.damaged(found))


def op13_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.judged(contamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {f.__name__: f for f in (
    op1_topk, op2_mixing, op3_sharding, op4_quality, op5_rules, op6_neardup, op7_secrets, op8_packing, op9_licenses, op10_urls,
    op11_phrases, op12_conversations, op13_contamination,
)}
ORACLE_SQL: dict[str, str] = {
    "op1_topk": oracles.TOPK, "op5_rules": oracles.rules_sql(), "op6_neardup": oracles.NEARDUP,
    "op9_licenses": oracles.licenses_sql(), "op10_urls": oracles.urls_sql(),
    "op11_phrases": oracles.PHRASES, "op12_conversations": oracles.CONVERSATIONS, "op13_contamination": oracles.DECONTAMINATION,
}

"""The queries of this package over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.llm import bpe, collocations, decontaminate, html_main_text, license_scan, mixing, mtree_topk, ngram_join, secret_ledger, slots, token_files, weak_toxicity, whitening
from merchlake.llm.batches import prepare, table
from merchlake.llm.oracle import ORACLE_SQL as ORACLE_SQL
from merchlake.session import run_folder


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main_text.extract_main_text(table(prepare(spark), sf_dir, "pages"))
    return found.withColumn("n_chars", F.col("n_chars").cast("long"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = mixing.mix_sources(table(prepare(spark), sf_dir, "documents").select("doc_id", "source", "text"))
    return draws.select("row.doc_id", "row.source", "n_tokens", "weight", "epoch", "block", "place")


def op3_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree_topk.top_k(table(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = weak_toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = run_folder(prepare(spark), "token-files")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, path)
    return token_files.documents_digest(spark, folder).withColumnRenamed("id", "doc_id")


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(prepare(spark), sf_dir, "documents")
    found = secret_ledger.scan_versions(documents, run_folder(spark, "secret-ledger"))
    return secret_ledger.findings_digest(found).withColumnRenamed("id", "doc_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licences(table(prepare(spark), sf_dir, "documents"))
    return license_scan.licence_digest(found).withColumnRenamed("id", "doc_id")


def op8_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = slots.shard_records(table(prepare(spark), sf_dir, "documents"), run_folder(spark, "slot-map"))
    return slots.shard_digest(placed).withColumnRenamed("id", "doc_id")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_join(table(prepare(spark), sf_dir, "documents"), n=3, num=90, den=100)
    return found.withColumnRenamed("id", "doc_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.hit_counts(found).withColumnRenamed("id", "doc_id")


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.round_trip(table(prepare(spark), sf_dir, "documents"), path)
    return bpe.tokens_digest(found).withColumnRenamed("id", "doc_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(prepare(spark), sf_dir, "embeddings"))
    # The exact deviation has up to 38 digits; null here where it leaves 64 bits.
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)")).withColumnRenamed("id", "vec_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(prepare(spark), sf_dir, "documents"))


QUERIES = {
    "op1_html_main_text": op1_html_main_text,
    "op2_mixing": op2_mixing,
    "op3_mtree_topk": op3_mtree_topk,
    "op4_weak_toxicity": op4_weak_toxicity,
    "op5_token_files": op5_token_files,
    "op6_secret_ledger": op6_secret_ledger,
    "op7_license_scan": op7_license_scan,
    "op8_slots": op8_slots,
    "op9_ngram_join": op9_ngram_join,
    "op10_decontaminate": op10_decontaminate,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}

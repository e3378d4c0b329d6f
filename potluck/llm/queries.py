"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potluck.llm.common import documents
from potluck.llm import lang_id, toxicity
from potluck.llm.jaccard_join import jaccard_join
from potluck.llm.license_scan import license_scan
from potluck.llm.merkle_manifest import FIELDS, leaf, merkle_manifest, proof_digest, verify
from potluck.llm.piece_bpe import piece_encode
from potluck.llm.poisson_mix import poisson_mix
from potluck.llm.spelling_groups import corpus_words, spelling_groups
from potluck.llm.spotsigs import spotsigs
from potluck.llm.substring_dedup import substring_dedup
from potluck.llm import token_records
from potluck.llm.topk_search import top_k
from potluck.llm.trie_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def piece_model() -> str:
    """Path of the vocabulary; the file is the same on every executor."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op8_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encode(documents(spark, sf_dir), piece_model(), outputs=(), verify=True)


def op9_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = lang_id.train(docs, lang_id.fold("doc_id", 4) != 2)
    return lang_id.identify(docs, model).select(
        "doc_id", F.coalesce(lang_id.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs(documents(spark, sf_dir)).drop("sigs", "edited")


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix(documents(spark, sf_dir))
    return mixed.select("row.doc_id", "row.source", "copy", "copies", F.round("rate", 9).alias("rate"),
                        "order_key", F.sha2(F.col("row.text"), 256).alias("text_sha256"))


def op5_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), piece_model())


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("detections")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, lang_id.fold("doc_id", 3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(lang_id.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score", "predicted", F.size("sentences").cast("long").alias("n_offending"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(corpus_words(documents(spark, sf_dir)))


def op12_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    folder = token_records.write_records(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"),
                                         token_records.new_folder(spark))
    return token_records.with_start(token_records.index(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, checked against a copy of which a third has its letters A-Z
    in lower case."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    seen = F.when(touched & F.col("text").rlike("[A-Z]"), leaf([lowered if c == "text" else F.col(c) for c in FIELDS]))
    manifest = merkle_manifest(documents(spark, sf_dir), carry={"seen": seen})
    return verify(manifest, F.coalesce("seen", "leaf")).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_spotsigs": op3_spotsigs,
    "op4_poisson_mix": op4_poisson_mix,
    "op5_trie_counts": op5_trie_counts,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity": op7_toxicity,
    "op8_piece_bpe": op8_piece_bpe,
    "op9_lang_id": op9_lang_id,
    "op10_topk_search": op10_topk_search,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_token_records": op12_token_records,
    "op13_merkle_manifest": op13_merkle_manifest,
}

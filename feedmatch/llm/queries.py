"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmatch.llm import ann, bincompletion, blocktables, chat, dac, decontam, htmltext, packing, radixaudit, simhash, toxicity, urls, warc
from feedmatch.llm.scratch import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids as directly addressable codes, written and read back."""
    path = scratch_path(spark, "dac")
    dac.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return dac.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("row.doc_id", "severity", "grade", "toxic")


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids."""
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of all pages, written as a chunk table and read back."""
    path = scratch_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector by inner product."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired roles and rendered pieces of all conversations."""
    return chat.format_conversations(_table(spark, sf_dir, "conversations"))


#: (host, path, verdict) of the rules that op8 judges by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = decontam.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), nameless=True)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("row.doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op11_radix_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by language."""
    return radixaudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_block_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations after damage."""
    return blocktables.audit(_table(spark, sf_dir, "conversations"))


def op13_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few windows of 2048 ids as found."""
    pieces = bincompletion.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_dac_tokens": op1_dac_tokens,
    "op2_toxicity": op2_toxicity,
    "op3_sum_of_squares_packing": op3_sum_of_squares_packing,
    "op4_simhash_trie": op4_simhash_trie,
    "op5_warc_chunks": op5_warc_chunks,
    "op6_multiprobe_lsh": op6_multiprobe_lsh,
    "op7_role_repair": op7_role_repair,
    "op8_bloom_cascade": op8_bloom_cascade,
    "op9_line_blocks": op9_line_blocks,
    "op10_wu_manber": op10_wu_manber,
    "op11_radix_audit": op11_radix_audit,
    "op12_block_tables": op12_block_tables,
    "op13_bin_completion": op13_bin_completion,
}

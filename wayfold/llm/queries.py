"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bpe, convrepair, filteraudit, linededup, neardup, quality, suffixdedup, tokencount, tokenfile, toxicity, urlfilter, warc
from wayfold.llm import decontaminate as decontamination
from wayfold.llm.store import shared_folder, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    return found.select(
        "doc_id",
        "n_words",
        decontamination.covered_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: Verdict, host and path of the rules that urls are judged by and that label pages for the rest.
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.payload_facts(warc.read_records(spark, folder))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), keep=["doc_id"])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    read = tokenfile.read_token_files(spark, folder)
    digests = written(read.select("part", "before", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32")), "digests")
    return tokenfile.with_starts(digests).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, keep=["doc_id"], decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(bpe.ids_text(F.col("ids"))).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = linededup.mark_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select(
        "doc_id",
        F.col("_n_lines").cast("long").alias("n_lines"),
        (F.col("_n_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        sha256(F.array_join("_kept", "\n")).alias("kept_sha256"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.find_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["size"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repair_conversations(table(spark, sf_dir, "conversations"), damage=True)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_warc_archive": op2_warc_archive,
    "op3_decontamination": op3_decontamination,
    "op4_url_templates": op4_url_templates,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_token_files": op8_token_files,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_line_dedup": op10_line_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_audit": op13_filter_audit,
}

"""The queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineament.llm import automaton, chat, host_quality, packing, recompression, signature_tree, site_lines, site_template, token_trie, warc
from lineament.llm.oracles import ORACLES as _ORACLES
from lineament.plans.storage import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written and read back; equal payloads are revisits of the one of the least page_id."""
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path, "page_id", "html", "url")
    read = warc.read_warc(spark, path)
    response = F.col("record_type") == "response"
    return read.select(
        warc.number(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, warc.base32(F.sha1("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        warc.number(F.col("refers_to")).alias("refers_to"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word sets of all documents, linked at a Jaccard similarity of 0.9."""
    return signature_tree.jaccard_groups(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages without what recurs on their host."""
    out = site_template.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("__text").alias("text"), F.col("__n_chars").alias("n_chars"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict of the host on all documents; the host is the source."""
    out = host_quality.quality(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *(F.col("__" + c).alias(c) for c in counts), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of all documents under a public sentencepiece vocabulary."""
    out = token_trie.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", F.col("__n_pretokens").alias("n_pretokens"), F.col("__n_tokens").alias("n_tokens"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised and packed into sequences of 1024."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), window=1024, end_id=0)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items' eight-word windows in all documents."""
    return automaton.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=8, least_items=2)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that over a tenth of their source's documents share, ten at least; sources of under twenty documents lose none."""
    out = site_lines.site_lines_removed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.formatted(rows.unionByName(planted)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without what repeats fifty words of a document before them."""
    return recompression.repeated_passages(table(spark, sf_dir, "documents"), window=50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_ngram_jaccard_join,
        op3_html_extraction,
        op4_quality_rules,
        op5_token_counts,
        op6_packing,
        op7_benchmark_decontamination,
        op8_line_dedup,
        op9_chat_formatting,
        op10_substring_dedup,
    )
}

ORACLES = _ORACLES

"""Documents in, packed sequences out: five stages over the operators of lineament.llm.

Each stage reads what the one before kept and, but for the last, returns rows
with the columns of documents, the text as the stages so far left it and n_chars
of that text.  Further columns are kept as they are, whatever their names, but
for __n_lines and __n_dropped.  Rows that repeat a doc_id are documents of their
own, but repeats of both doc_id and words stay or go together; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineament.llm import automaton, host_quality, packing, signature_tree, site_lines
from lineament.llm.queries import tokenizer_file
from lineament.plans.storage import written


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if there is one, told anew from the text."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return docs.select(*(n.alias(c) if c == "n_chars" else docs[c] for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their source's verdict; those without text go."""
    return host_quality.accepted(docs, host="source", text="text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines."""
    return _measured(site_lines.site_lines_removed(docs, host="source", text="text").select(*docs.columns))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group linked at 0.8 over five-word sets; rows without a doc_id or words stay."""
    return signature_tree.single_documents(docs, shingle=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's passages; documents that are mostly benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(automaton.decontaminated(docs, benchmark, window=8, longest=0, coverage=0.5))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of 1024 tokens."""
    return packing.packed(docs, tokenizer_file("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Tokenising and packing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents.

Defined cases: null, empty and wordless texts and those under 50 words fail the base rules and go; very long
texts are judged whole; repeated rows and copies leave one document, that of the smallest id; documents without an id
stay where they are no copies and are written first; a null source is one of its own; extra columns with whatever
names go along to the mix; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontam, mixing, quality, simhash, tokenstore
from docloom.llm.common import materialize, scratch_path, table
from docloom.llm.queries import vocabulary

#: The tokenizer's work and the radix of the mix are no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in the fertility bands."""
    return quality.keep_good(docs, vocabulary("piece_bpe_32k.model"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the weights 5, 2, 1; documents occur once for each epoch that takes them."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as a store of token ids: what the files hold of each document."""
    path = scratch_path(spark, "tokens")
    tokenstore.write_store(docs, path, vocabulary("byte_bpe_50k.json"))
    tokenstore.check_manifest(spark, path)
    return tokenstore.read_checksums(spark, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs

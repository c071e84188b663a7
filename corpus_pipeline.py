"""Documents made ready for training, in five stages over whole tables.

1. language: texts whose language is not clear by compression go.
2. near_duplicates: of the texts linked by a Jaccard similarity of 0.8 or more of their five-word
   shingles, one of each group stays.
3. repeated_strings: bytes of 100-byte strings that start earlier are cut out; texts of which nothing
   is left go.
4. benchmark: texts with a window similar to a benchmark item go.
5. packing: what is left is tokenised and packed into sequences of 1024 tokens.

Each stage takes what the one before has written. All but the last return the columns of their
input, whatever they are; null, empty and repeated rows are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from termgauge.llm import decontam, jaccard, language, packing, suffix
from termgauge.session import materialise, small_batches

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
TOKENIZER = "byte_bpe_50k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each_group(docs, k=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_matches(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_strings", repeated_string_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: No stage but the last three could be told in SQL, and the language dictionaries cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        with small_batches(spark):
            docs = stage(spark, docs, sf_dir)
            if at < len(STAGES) - 1:
                docs = materialise(docs, f"pipeline-{name}")
    return docs

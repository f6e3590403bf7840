"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept; all but the last return the columns of
``documents``, whatever other columns docs has.  Between stages the rows are written and read again.

Edge cases, as the operators define them: null texts and those without a letter leave with language ID, as do all rows where no language
can be learned; null sources are one source, null languages are filled in, null counts of characters stay; a row without an id is never a
near copy, so it stays; very long texts are taken whole; of tied lines and documents the first by id and line stays; rows that repeat
an id and a text keep their lines and are near copies of themselves, so all of them stay; an empty table passes every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bestfit_packing, language_id, line_dedup, ngram_jaccard, source_mixing
from llm.queries import fold, tokenizer_path
from llm.shared import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bits a byte from which no language model knows the text better than chance.
UNKNOWN_BITS = 8.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that no language's model can compress; fills in languages that are null."""
    model = language_id.train(docs.filter(fold("doc_id", 4) != 2))
    out = language_id.annotate(docs.select(COLUMNS), model)
    kept = out.filter((F.col("lang_pred") != "und") & (F.col("bits_per_byte") < UNKNOWN_BITS))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that match an earlier one; documents of which no word is left go."""
    out = line_dedup.dedup(docs, width=5, percent=80, short=True)
    left = (F.col("n_lines_removed") == 0) | F.col("text").rlike(source_mixing.WORDS)
    return out.filter(left).withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group."""
    gone = ngram_jaccard.join(docs, width=5, percent=80).filter("doc_id <> component_id").select("doc_id")
    return docs.join(saved(gone.distinct()), "doc_id", "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources meet their targets, in the order of the curriculum."""
    mixed = source_mixing.mix(docs.withColumn("size", source_mixing.words()))
    return source_mixing.curriculum(mixed).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' tokens in sequences of 2048."""
    return bestfit_packing.pack(docs, tokenizer_path(), 2048)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bestfit_packing", pack_sequences),
]

#: SQL cannot express language models, tokenizers and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs

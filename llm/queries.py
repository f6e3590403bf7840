"""One query for each operator, over its whole table and with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import source_mixing

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, of: int):
    """crc32 of an id as text, modulo a number."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95).select("vec_id", "n_links", "component_id", "kept")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import join

    return join(table(spark, sf_dir, "documents"), width=5, percent=80)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines removed, and length and crc32 of the text that stays."""
    from .line_dedup import dedup

    out = dedup(table(spark, sf_dir, "documents"), width=5, percent=80, short=True)
    return out.select("doc_id", "n_lines_removed", F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bestfit_packing import pack

    out = pack(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, in the training order of its first copy."""
    from .shared import saved
    from .source_mixing import mix, training_order, words

    docs = saved(table(spark, sf_dir, "documents").select("doc_id", "source", words().alias("size")))
    return training_order(mix(docs)).select("doc_id", "size", "source_size", "target", "taken", "n_copies", "first_position", "last_position")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each licence passage: its first and last line."""
    from .license_scan import scan, train

    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs)).select("doc_id", "line", "last_line", "family", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_quality import assess

    out = assess(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_embedding_dedup, op2_ngram_jaccard, op3_html_extract, op4_line_dedup, op5_bestfit_packing, op6_source_mixing, op7_license_scan, op8_line_quality, op9_toxicity, op10_language_id)}

SQL: dict[str, str] = {"op6_source_mixing": source_mixing.SQL}

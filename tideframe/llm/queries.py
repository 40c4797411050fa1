"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideframe.llm.quality_classifier import quality_scores
    from tideframe.llm.training import fold

    out = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideframe.llm.jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents declare a language and come from a source, which takes the host's place."""
    from tideframe.llm.language_id import identify, suffix_of

    docs = _table(spark, sf_dir, "documents")
    out = identify(docs, "text", F.col("lang"), F.col("source"), suffix_of(F.col("source")))
    return out.select("doc_id", "language", "confidence", "rejected", (~F.col("rejected")).alias("kept"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages: markup language, address suffix and host."""
    from tideframe.llm.language_id import host_of, identify, markup_language, suffix_of, visible_text

    pages = _table(spark, sf_dir, "pages")
    host = host_of(F.col("url"))
    out = identify(pages, visible_text(F.col("html")), markup_language(F.col("html")), host, suffix_of(host), key="page_id")
    return out.select(F.col("doc_id").alias("page_id"), "language", "confidence", "rejected")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideframe.llm.html_wrapper import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideframe.llm.media_columns import media_features, media_table

    return media_features(media_table(_table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideframe.llm.toxicity import toxicity_scores
    from tideframe.llm.training import fold

    out = toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideframe.llm.substring_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), 50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tideframe.llm.piece_bpe import encode_documents

    out = encode_documents(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")), digests=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tideframe.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), 1024, 2)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideframe.llm.quality_rules import quality_verdicts

    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return quality_verdicts(_table(spark, sf_dir, "documents")).select(*columns)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideframe.llm.conversation_repair import damaged, repair

    return repair(damaged(_table(spark, sf_dir, "conversations")), digests=True)


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideframe.llm.order_minhash import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideframe.llm.spelling_variants import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"), typos=199)


_ALL = (
    op1_quality_classifier, op2_ngram_jaccard_join, op3_language_id, op4_html_extraction, op5_media_columns, op6_toxicity, op7_substring_dedup,
    op8_sentencepiece, op9_best_fit_packing, op10_quality_rules, op11_conversation_repair, op12_order_minhash, op13_spelling_variants, language_id_pages,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: None of these can be expressed in SQL as a whole. tests/llm holds op2, op4, op5, op7, op8, op9 and op10 against plain
#: Python or the libraries, op1 and op6 against held-out labels, op3 against the true languages of texts that declare none
#: or a wrong one.
ORACLE_SQL: dict[str, str] = {}

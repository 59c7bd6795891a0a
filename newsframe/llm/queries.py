"""The registered queries of the operators, each over its whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsframe.llm.common import table, text_or_empty
from newsframe.llm.compression import quality_rules
from newsframe.llm.conversations import repair_damaged
from newsframe.llm.decontamination import benchmark_hits
from newsframe.llm.htmlblocks import extract_main_text, fit_labeller
from newsframe.llm.jaccard import similar_documents
from newsframe.llm.lexical import ranked_documents
from newsframe.llm.lmscore import score_against_corpus
from newsframe.llm.mixing import mix_sources
from newsframe.llm.passages import fit_quality, held_out, score_quality
from newsframe.llm.sharding import shard_rows
from newsframe.llm.suffixdedup import repeated_bytes
from newsframe.llm.toxicity import fit_toxicity, score_toxicity
from newsframe.llm.urlfilter import canonical_url, judge_urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SHARDS = 16
SPAM = "casino|pills|lottery|bonus"


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_bytes(table(spark, folder, "documents"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pages judged by the rules; without one, blocked if listed.

    The list holds the canonical addresses of all crawled pages whose content names casinos, pills, lotteries or bonuses,
    whatever their host is; other spellings of a listed address are blocked with it.
    """
    pages = table(spark, folder, "pages")
    listed = pages.filter(F.lower("html").rlike(SPAM)).select(canonical_url("url").alias("canonical"))
    return judge_urls(pages.select("page_id", "url"), listed, RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against models of the documents labelled as good and of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    good = table(spark, folder, "labels").filter("quality = 1 and toxic = 0").select("doc_id", F.lit(True).alias("good")).distinct()
    # Labels grow with the documents: they are never sent to all tasks, whatever their size is now.
    marked = docs.join(good.hint("merge"), "doc_id", "left")
    return score_against_corpus(marked, "good")


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, repeated so that every source has the same expected share of the text."""
    return mix_sources(table(spark, folder, "documents"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_documents(table(spark, folder, "documents"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract_main_text(pages, fit_labeller(pages)).select("page_id", "url", "text", "n_chars")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = docs.select("doc_id", (F.octet_length(text_or_empty("text")) + 1).cast("long").alias("size"),
                        F.crc32(text_or_empty("text")).alias("text_crc32"), F.lit("key").alias("law"))
    return shard_rows(sized, "doc_id", [1.0] * SHARDS, grown_weights=[1.0] * (SHARDS + 1)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_damaged(table(spark, folder, "conversations"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {function.__name__: function for function in (
    op1_suffix_dedup, op2_url_filter, op3_lm_scoring, op4_mixing, op5_quality_rules, op6_ngram_join, op7_quality,
    op8_html_extraction, op9_decontamination, op10_sharding, op11_toxicity, op12_conversation_repair,
    op13_ranked_search)}

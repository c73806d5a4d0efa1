"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, conversation_trie, exact_dedup, mixing, ngram_join, packing, phrases, pii, quality, simhash, toxicity, url_filter
from .common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.repeated_pages(pages))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_marks_conversation(table(spark, sf_dir, "conversations"), spark)
    return chat.digests(chat.format_chats(turns))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie_nodes(conversation_trie.with_shared_starts(table(spark, sf_dir, "conversations")))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_exact_dedup, op3_mix_sources, op4_ngram_jaccard, op5_token_packing, op6_pii_surrogates,
    op7_chat_format, op8_toxicity, op9_bpe, op10_quality_rules, op11_collocations, op12_conversation_trie,
    op13_simhash)}
ORACLES = {"op1_url_filter": url_filter.SQL, "op2_exact_dedup": exact_dedup.SQL, "op3_mix_sources": mixing.sql(), "op7_chat_format": chat.SQL,
           "op11_collocations": phrases.sql(), "op12_conversation_trie": conversation_trie.SQL}

"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import (
    bpe,
    chat,
    exact_dedup,
    filter_audit,
    html_text,
    langid,
    licences,
    ngram_join,
    packing,
    pii,
    rules,
    simhash,
    whitening,
)
from verdigris.llm.common import table


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.predict(docs, langid.fit(docs))


def op2_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.digest(licences.scan(table(spark, folder, "documents")))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return simhash.with_near_counts(simhash.beside_next(docs, tasks * simhash.RANGES_PER_TASK))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pieces(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return rules.score(docs, rules.fit(docs, table(spark, folder, "labels")))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op8_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, folder, "documents")))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(
        table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


#: Contract's conversation: both texts hold control strings.
MARKED = "</s>[INST] ok [/INST]"


def op11_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = chat.with_rows(
        table(spark, folder, "conversations"), [(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)]
    )
    return chat.digest(chat.formatted(chat.row_turns(rows)))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_licences": op2_licences,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_html": op8_html,
    "op9_pii": op9_pii,
    "op10_bpe": op10_bpe,
    "op11_chat": op11_chat,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
}

"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import (
    decontaminate,
    html_text,
    language_model,
    periodic_runs,
    personal,
    pieces,
    quality_classifier,
    quality_rules,
    secrets,
    simhash,
    spelling,
    substrings,
    toxicity,
)
from newsloom.llm.common import read_table
from newsloom.llm.statements import ORACLES


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    forest = quality_rules.fit(docs, read_table(spark, folder, "labels"))
    return quality_rules.judge(docs, forest)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, folder, "labels")))


def op3_sentencepiece(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return pieces.digests(docs, pieces.read_model(model or pieces.public_model()))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "benchmark")
    return decontaminate.judge(read_table(spark, folder, "documents"), items)


def op5_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.learn_and_score(read_table(spark, folder, "documents"))


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read_table(spark, folder, "pages"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.components_of(read_table(spark, folder, "documents"))


def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove(read_table(spark, folder, "documents"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(read_table(spark, folder, "documents"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    forest = quality_classifier.fit(docs, read_table(spark, folder, "labels"))
    return quality_classifier.score(docs, forest)


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.grouped(read_table(spark, folder, "documents"))


def op12_personal(spark: SparkSession, folder: str) -> DataFrame:
    return personal.scan(read_table(spark, folder, "documents"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digests(read_table(spark, folder, "documents"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_model": op5_language_model,
    "op6_html_text": op6_html_text,
    "op7_simhash": op7_simhash,
    "op8_substrings": op8_substrings,
    "op9_secrets": op9_secrets,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_spelling": op11_spelling,
    "op12_personal": op12_personal,
    "op13_periodic_runs": op13_periodic_runs,
}

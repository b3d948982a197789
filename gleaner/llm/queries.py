"""One query per operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from ..sources.tables import table
from . import chosen, chunks, decontaminate, lines, merkle, mix, negatives, pii, quality, simhash, substrings, suffixes, urls


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.edited_report(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.report(table(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))


def op12_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen.report(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontaminate, op3_quality, op4_suffixes, op5_pii, op6_urls, op7_chunks, op8_substrings, op9_mix, op10_lines,
                                  op11_negatives, op12_chosen, op13_merkle, pipeline)}
ORACLES = {"op2_decontaminate": decontaminate.ORACLE, "op5_pii": pii.ORACLE, "op6_urls": urls.ORACLE, "op8_substrings": substrings.ORACLE, "op9_mix": mix.ORACLE, "op10_lines": lines.ORACLE,
           "op11_negatives": negatives.ORACLE, "op12_chosen": chosen.ORACLE, "op13_merkle": merkle.ORACLE}

"""The registered queries of the corpus operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castleflow.llm import leaks, licenses, lines, minhash, mixing, neighbours, quality, secrets, substrings, suffixes
from castleflow.llm.common import documents


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_suffixes(documents(spark, sf_dir), with_text=False)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=4)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(documents(spark, sf_dir), with_spans=False)


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(documents(spark, sf_dir), with_text=False)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir), with_text=False)


QUERIES = {
    "op1_suffixes": op1_suffixes,
    "op2_neighbours": op2_neighbours,
    "op3_secrets": op3_secrets,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_minhash": op6_minhash,
    "op7_licenses": op7_licenses,
    "op8_leaks": op8_leaks,
    "op9_substrings": op9_substrings,
    "op10_lines": op10_lines,
}

ORACLES: dict[str, str] = {
    "op1_suffixes": suffixes.ORACLE,
    "op2_neighbours": neighbours.ORACLE,
    "op3_secrets": secrets.oracle(),
    "op4_mixing": mixing.ORACLE,
    "op6_minhash": minhash.ORACLE,
    "op7_licenses": licenses.oracle(),
    "op9_substrings": substrings.ORACLE,
    "op10_lines": lines.ORACLE,
}

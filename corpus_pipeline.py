"""A corpus from documents to a weighted mix, in five stages of the corpus operators.

Every stage reads what the one before it wrote. All but the last return the columns of
documents; the last adds what the mix takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castleflow.llm import leaks, lines, minhash, mixing, quality
from castleflow.llm.common import documents, stash
from castleflow.llm.repeats import keyed
from castleflow.operators.shared import discard, recorded

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts. An empty text is judged by statistics of 0."""
    return quality.keep_good(docs.select(*COLUMNS), documents(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; one that loses lines and has no word left goes."""
    cut = lines.dedup_lines(docs.select(*COLUMNS), keep=("lang", "source"))
    left = cut.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.drop_near_duplicates(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; where doc_id repeats or is null, each row is judged for itself."""
    docs = keyed(docs, "lang", "source", "n_chars")
    found = leaks.find_leaks(docs.select(F.col("row").alias("doc_id"), "text"), documents(spark, sf_dir, "benchmark"))
    leaked = stash(found.select(F.col("doc_id").alias("row")).distinct(), "leaked")
    return docs.join(leaked, "row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and taken."""
    docs = keyed(docs, "lang", "source", "n_chars")
    taken = mixing.mix(docs.select(F.col("row").alias("doc_id"), "text", "source")).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias("row"), "size", "source_size", "target", "taken")
    return docs.join(taken, "row").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("lines", cut_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("leaks", drop_leaks),
    ("mix", mix_sources),
]

#: SQL can express neither a learned classifier nor sketches; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way, and its input, goes once its result is written."""
    docs, own = documents(spark, sf_dir), []
    for name, stage in STAGES:
        with recorded() as written:
            docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, [*own, *written[:-1]])
        own = written[-1:]
    return docs

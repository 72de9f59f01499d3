"""Every operator on odd tables: very long texts, repeated rows, null ids, clashing columns, nothing at all."""

import pytest
from conftest import DOCS
from pyspark.sql import functions as F

import corpus_pipeline
from castleflow.llm import leaks, licenses, lines, minhash, mixing, quality, secrets, substrings, suffixes

LONG = " ".join(f"word{i % 7001} and{i % 13}" for i in range(60_000))  # a megabyte
LICENSE = "This code is released under the terms of the MIT License."
ITEM = " ".join(f"item{i}" for i in range(25))
#: Names that the operators use for columns of their own.
CLASHING = "row spans long_spans size n plan bucket payload start count anchor rep comp key band node component draw tie shard party block blocks quota target taken score predicted labels readings item_id answer _rest _score _n_words cell d words kept".split()


def table(spark):
    rows = [(1, LONG), (1, LONG), (2, LONG + " tail " + ITEM), (3, f"{LICENSE}\n{ITEM}\npassword = abcdefgh12"), (3, f"{LICENSE}\n{ITEM}\npassword = abcdefgh12"), (None, "null id " + ITEM), (None, None), (4, ""), (5, None)]
    df = spark.createDataFrame([(i, t, "en", f"s{len(t or '') % 2}", len(t or "")) for i, t in rows], DOCS)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING])


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")


def benchmark(spark):
    return spark.createDataFrame([(1, ITEM, 0)], "item_id long, text string, row int")


EACH = {
    "suffixes": lambda s, d: suffixes.dedup_suffixes(d),
    "substrings": lambda s, d: substrings.dedup_substrings(d),
    "lines": lambda s, d: lines.dedup_lines(d, keep=("source",)),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "secrets": lambda s, d: secrets.find_secrets(d),
    "licenses": lambda s, d: licenses.find_licenses(d),
    "mixing": lambda s, d: mixing.mix(d),
    "quality": lambda s, d: quality.classify(d, labels(s)),
}


@pytest.mark.parametrize("name", EACH)
def test_one_row_for_each_row(spark, name):
    d = table(spark)
    got = EACH[name](spark, d).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in d.select("doc_id").collect())
    assert EACH[name](spark, d.where("false")).count() == 0
    if name in ("secrets", "licenses", "quality"):  # equal rows have equal results
        same = [tuple(r) for r in got if r["doc_id"] == 3]
        assert same[0] == same[1]
    if name == "minhash":
        assert sum(r["kept"] for r in got if r["doc_id"] in (1, 3)) == 2
    if name == "licenses":
        assert {r["labels"] for r in got if r["doc_id"] == 3} == {"mit"}
    if name == "secrets":
        assert {r["n_assign"] for r in got if r["doc_id"] == 3} == {1}


def test_leaks_of_odd_rows(spark):
    d = table(spark)
    got = leaks.find_leaks(d, benchmark(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["2", "3", "3", "None"]
    assert leaks.find_leaks(d.where("false"), benchmark(spark)).count() == 0 and leaks.find_leaks(d, benchmark(spark).where("false")).count() == 0


def test_filters_keep_all_columns(spark):
    d = table(spark)
    assert set(minhash.drop_near_duplicates(d).columns) == set(d.columns) and set(quality.keep_good(d, labels(spark)).columns) == set(d.columns)


def test_pipeline_of_odd_rows(spark, tmp_path):
    folder = f"file://{tmp_path}"
    labels(spark).withColumn("toxic", F.lit(0)).write.parquet(f"{folder}/labels.parquet")
    benchmark(spark).write.parquet(f"{folder}/benchmark.parquet")
    held = table(spark)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, held, folder)
        after.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        assert set(corpus_pipeline.COLUMNS) <= set(after.columns) and after.count() <= held.count(), name
        held = after

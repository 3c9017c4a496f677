"""A training-corpus pipeline over ``documents``; counted as part of subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontamination, quality
from tidegauge.llm.common import free_name, stored, table
from tidegauge.llm.lines import dedup_lines
from tidegauge.llm.minhash import grouped
from tidegauge.llm.mixing import mix


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text has no features and is judged by the prior alone; a null id
    takes part like any other, as a rating needs an id only to train on. Rows that
    repeat share their verdict. A probability equal to the threshold accepts. Without
    ratings all documents stay; an empty table gives an empty one. Other columns,
    whatever their names, pass unchanged.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    kept = [free_name(docs, f"{c}_kept") if c in quality.ADDED else c for c in docs.columns]
    return quality.grade(docs.toDF(*kept), model).where("accepted").select(*kept).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go, and documents of which nothing is left.
    ``n_chars`` follows the text.

    "Earlier" is by doc_id, then text hash, then position, null ids first; see
    ``dedup_lines`` for rows that repeat. Null and empty texts, and texts of which no
    line went, stay as they are. An empty table gives an empty one; other columns pass
    unchanged.
    """
    n = free_name(docs, "n_removed")
    out = dedup_lines(docs).where(f"`{n}` = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        size = F.when(F.col(n) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", size)
    return out.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of smallest id (null ids
    last), then of smallest text hash, and one of the rows that repeat both. Texts
    without words are in no group and stay. Rows are known by their id and 128 bits of
    their text, so different texts of one id, or of none, are told apart. An empty
    table gives an empty one; other columns pass unchanged."""
    keys = grouped(docs).where("group is not null").groupBy("group", "doc_id", "c").agg(F.count("*").alias("n"))
    best = keys.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "c")).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("c") == F.col("best.c"))
    c, own_id, own_c = (free_name(docs, x) for x in ("c", "own_id", "own_c"))
    judged = stored(keys.join(best, "group").select("doc_id", "c", "n", stays.alias("stays")).where("not stays or n > 1"), "judged")

    rows = docs.withColumn(c, F.unhex(F.md5(F.col("text").cast("string"))))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(c) == F.col(own_c))
    every, gone, repeated = (x.select(F.col("doc_id").alias(own_id), F.col("c").alias(own_c)) for x in (judged, judged.where("not stays"), judged.where("stays")))
    if not repeated.head(1):
        return rows.join(gone, same, "left_anti").select(*docs.columns)
    once = rows.join(every, same, "left_anti")
    return once.union(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", c])).select(*docs.columns)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay, as all do if ``benchmark`` is empty; null
    and empty items are in nothing. Rows that repeat share their verdict. An empty
    table gives an empty one; other columns, whatever their names, pass unchanged.
    """
    kept = [free_name(docs, f"{c}_kept") if c in decontamination.ADDED else c for c in docs.columns]
    return decontamination.contamination(docs.toDF(*kept), table(spark, sf_dir, "benchmark")).where("not contaminated").select(*kept).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, mixed to target weights along the curriculum; the result has the
    columns of ``mix``, whose docstring states nulls, ties, repeated rows and empty
    tables."""
    return mix(docs)


STAGES = [
    ("quality classifier", accept),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", free_of_benchmarks),
    ("mixing to target weights", mixed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

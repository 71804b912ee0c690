"""The training-corpus pipeline: STAGES over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows to
the shared scratch folder and hands the reread table to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscore.llm.common import KEY, has_word, keyed, pick, table, written
from flowscore.llm.op2_quality_rules import quality_rules
from flowscore.llm.op4_decontaminate import decontaminate
from flowscore.llm.op8_ngram_join import one_of_each
from flowscore.llm.op9_line_dedup import rewritten
from flowscore.llm.op10_mix_sources import mixed_rows

#: What the mix adds to a document's columns (an input column of one of these names gives way).
MIX = ("copy", "words_before", "source_budget")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules (and their base test) keep.

    Null, empty and short texts fail the base test; a verdict follows id and text alone, so equal rows share it."""
    rows = keyed(docs)
    bad = quality_rules(pick(rows, "doc_id", "text", *KEY), table(spark, sf_dir, "labels"), keep=KEY).filter("not kept").select(*KEY).distinct()
    return rows.join(bad, [*KEY], "left_anti").drop(*KEY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that loses all its lines goes.

    A null text stays; n_chars, where there is one, follows the text; equal rows keep the same lines."""
    out = rewritten(docs)
    cut = F.col("__lines.n_removed") > 0
    out = out.filter(has_word(F.col("text")) | ~cut | F.col("text").isNull())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop("__lines")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at Jaccard 0.8 on five-word shingles: that with the smallest doc_id.

    Texts without words are linked with nothing and stay; of equal rows one stays; a null doc_id comes last."""
    return one_of_each(docs, k=5, num=80, den=100)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and empty texts hold none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every drawn copy of a document, whole, with its place in the source's schedule.

    Rows are never matched by id, so null and repeated ids draw as many rows as there are."""
    return mixed_rows(docs).drop(*MIX).select("*", *[f"__mix.{c}" for c in MIX]).drop("__mix")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near_duplicates),
          ("decontaminate", benchmark_free), ("mix_sources", mixed)]

#: Learned rules and tilings have no SQL form; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

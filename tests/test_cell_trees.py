"""Boosted trees and forests fitted on cells of rows."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from flowscore.operators import bagged as BAG
from flowscore.operators import boosting as BOOST
from flowscore.operators import members as MEM


def noisy(spark, n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), rng.random(), rng.randrange(7)
        rows.append((i, a, b, c, 1.5, int((b * c > 1.5) != (rng.random() < 0.1)), rng.choice([0.5, 1.0, 3.0])))
    return spark.createDataFrame(rows, "id long, a double, b double, c int, same double, y int, w double").repartition(3)


@pytest.mark.parametrize("weight, rows", [(None, 1500), ("w", 1500), (None, 12_000)])  # Spark ML samples 10,000 for its thresholds
def test_boosting_on_cells_is_spark_mls(spark, tmp_path, weight, rows):
    df, features = noisy(spark, rows).cache(), ["a", "b", "c", "same"]
    plain = GBTClassifier(labelCol="y", featuresCol="features", maxIter=12, maxDepth=3, stepSize=0.1, seed=42)
    was = Pipeline(stages=[MEM._assembler(features), MEM._weighted(plain, weight)]).fit(df)
    now = MEM.fit_gbt(df, features, max_iter=12, max_depth=3, weight_col=weight)
    path = str(tmp_path / "model")
    now.write().overwrite().save(path)
    both = MEM.ml_probability(PipelineModel.load(path), MEM.ml_probability(was, df, "was"), "now")
    assert both.where(F.abs(F.col("was") - F.col("now")) > 1e-9).count() == 0
    assert now.stages[-1].getNumTrees == 12 and both.select("was").distinct().count() > 20


def test_boosting_reads_the_rows_a_bounded_number_of_times(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def spy(x):
        seen.add(1)
        return x
    df = noisy(spark, 300).withColumn("a", spy("a")).where("a is not null")
    MEM.fit_gbt(df, ["a", "b"], max_iter=2)
    few = seen.value
    seen.value = 0
    MEM.fit_gbt(df, ["a", "b"], max_iter=25)
    assert seen.value == few


def test_boosting_of_one_class_and_of_bad_rows(spark):
    df = noisy(spark, 60)
    one = MEM.ml_probability(MEM.fit_gbt(df.withColumn("y", F.lit(1)), ["a", "b"], max_iter=3), df, "p")
    assert one.where("p < 0.8").count() == 0
    for bad in (F.lit(None).cast("int"), F.lit(2)):
        with pytest.raises(ValueError):
            MEM.fit_gbt(df.withColumn("y", F.when(F.col("id") == 7, bad).otherwise(F.col("y"))), ["a", "b"], max_iter=1)


def test_thresholds_are_those_that_spark_ml_tries(spark):
    df = spark.range(30_000).select((F.col("id") / 30_000).alias("a"), (F.col("id") % 5).cast("int").alias("b"), (F.col("id") % 32 % 2).cast("int").alias("y"))
    many, few = BOOST.thresholds(df, ["a", "b"], "y", None, 42)
    assert few == [0.5, 1.5, 2.5, 3.5] and len(many) == 31
    assert all(abs(t - (i + 1) / 32) < 0.03 for i, t in enumerate(many))


def test_boosting_refuses_features_that_are_no_numbers(spark):
    for bad in (None, float("nan"), float("-inf")):
        with pytest.raises(ValueError):
            MEM.fit_gbt(noisy(spark, 60).withColumn("a", F.when(F.col("id") == 7, F.lit(bad).cast("double")).otherwise(F.col("a"))), ["a", "b"], max_iter=1)


@pytest.mark.parametrize("weight, table_bytes", [(None, 256 << 20), ("w", 3000)])
def test_a_forest_without_chance_is_spark_mls(spark, monkeypatch, weight, table_bytes):
    monkeypatch.setattr(BAG, "TABLE_BYTES", table_bytes)  # one node a pass in the second case
    df, features = noisy(spark, 1200), ["a", "b", "c", "same"]
    plain = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=2, maxDepth=4, featureSubsetStrategy="all", bootstrap=False)
    was = Pipeline(stages=[MEM._assembler(features), MEM._weighted(plain.copy(), weight)]).fit(df)
    cuts, table = BAG.fit_trees(df, features, "y", 2, 4, 42, weight, len(features), bootstrap=False)
    now = PipelineModel([MEM._assembler(features), BAG.as_model(spark, plain, cuts, table, 2, len(features))])
    both = MEM.ml_probability(now, MEM.ml_probability(was, df, "was"), "now")
    assert both.where(F.abs(F.col("was") - F.col("now")) > 1e-9).count() == 0
    assert now.stages[-1].totalNumNodes == was.stages[-1].totalNumNodes > 10


def test_draws_of_cells_are_poisson():
    ids = np.random.default_rng(1).integers(0, 1 << 63, 40_000).astype(np.uint64)
    for n in (1, 6, 1000):
        draws = BAG._draws(ids, BAG._bits(np.full(len(ids), float(n))), 42, 3)
        assert abs(draws.mean() - n) < 5 * (n / len(ids)) ** 0.5 and abs(draws.var() / n - 1) < 0.05
    assert abs((BAG._draws(ids, BAG._bits(np.ones(len(ids))), 42, 3) == 0).mean() - np.exp(-1)) < 0.01
    mixed = BAG._draws(ids, BAG._bits(np.arange(len(ids)) % 5), 42, 3)
    assert not mixed[::5].any() and abs(mixed[4::5].mean() - 4) < 0.1
    other = BAG._draws(ids, BAG._bits(np.ones(len(ids))), 42, 4)
    assert abs(np.corrcoef(other, BAG._draws(ids, BAG._bits(np.ones(len(ids))), 42, 3))[0, 1]) < 0.03


def test_forests_do_not_depend_on_partitions_and_differ_by_tree(spark, tmp_path):
    df, features = noisy(spark, 900), ["a", "b", "c"]
    for fit in (MEM.fit_random_forest, MEM.fit_bagging):
        one = fit(df, features, num_trees=6, max_depth=5, weight_col="w")
        one.write().overwrite().save(str(tmp_path / "model"))
        other = fit(df.orderBy("a").coalesce(1), features, num_trees=6, max_depth=5, weight_col="w")
        both = MEM.ml_probability(other, MEM.ml_probability(PipelineModel.load(str(tmp_path / "model")), df, "one"), "other")
        assert both.where("abs(one - other) > 1e-9").count() == 0
        assert both.where((F.col("one") > 0.5) == (F.col("y") == 1)).count() > 750
        trees = {t.toDebugString.split("\n", 1)[1] for t in one.stages[-1].trees}
        assert len(trees) == 6 and one.stages[-1].getNumTrees == 6


def test_a_forest_reads_the_rows_a_bounded_number_of_times(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def spy(x):
        seen.add(1)
        return x
    df = noisy(spark, 300).withColumn("a", spy("a")).where("a is not null")
    counts = []
    for depth in (1, 6):
        seen.value = 0
        MEM.fit_random_forest(df, ["a", "b"], num_trees=3, max_depth=depth)
        counts.append(seen.value)
    assert counts[0] == counts[1]


def test_a_forest_of_one_class(spark):
    df = noisy(spark, 60)
    for y in (0, 1):
        p = MEM.ml_probability(MEM.fit_bagging(df.withColumn("y", F.lit(y)), ["a", "b"], num_trees=3), df, "p")
        assert [r.p for r in p.select("p").distinct().collect()] == [float(y)]


def test_a_class_without_rows_weighs_nothing_exactly(spark):
    rows = [(i / 700, (i * 37 % 101) / 7, int(i > 350), 0.1 + i % 3 / 7) for i in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, y int, w double")
    _, table = BAG.fit_trees(df, ["a", "b"], "y", 8, 6, 42, "w", 1)
    assert (table["w0"] >= 0).all() and (table["w1"] >= 0).all() and ((table["w0"] == 0) & (table["w1"] > 0)).any()
    p = MEM.ml_probability(MEM.fit_bagging(df, ["a", "b"], num_trees=8, max_depth=6, weight_col="w"), df, "p")
    assert p.where("p >= 0 and p <= 1").count() == 700


def test_a_threshold_more_than_asked_for(spark, monkeypatch):
    df = noisy(spark, 400)
    monkeypatch.setattr(BOOST, "thresholds", lambda *a: [[i / 34 for i in range(1, 34)], [0.5]])
    for fit in (MEM.fit_gbt, MEM.fit_random_forest):
        p = MEM.ml_probability(fit(df, ["b", "a"], **({"max_iter": 2} if fit is MEM.fit_gbt else {"num_trees": 3})), df, "p")
        assert p.where("p between 0 and 1").count() == 400
    high = df.withColumn("y", (F.col("b") > 33 / 34).cast("int"))
    assert MEM.ml_probability(MEM.fit_gbt(high, ["b", "a"], max_iter=20), high, "p").where("(p > 0.5) != (y = 1)").count() == 0

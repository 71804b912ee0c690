"""Resource-telemetry rollups over long sample tables.

Input tables: samples (stage, ts, mem_mb, cpu_pct, threads) and timed runs
(path, run, elapsed_sec, n). Every rollup is one grouped aggregate (partial
aggregation per task, so a hot stage costs one row per task in the
shuffle); pairwise and efficiency tables join the small per-path results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.constants import CPU_FLOOR_PCT, MEM_FLOOR_MB


def stage_rollup(samples: DataFrame) -> DataFrame:
    """Per stage: elapsed seconds (last - first sample), peak / min memory,
    start and end memory (first / last sample by time), their delta, peak
    increase over start, average and max CPU, average and max threads, and
    the sample count."""
    agg = samples.groupBy("stage").agg(
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).cast("double") / F.lit(1e6)).alias("elapsed_sec"),
        F.min_by("mem_mb", "ts").alias("start_mem_mb"),
        F.max_by("mem_mb", "ts").alias("end_mem_mb"),
        F.max("mem_mb").alias("peak_mem_mb"),
        F.min("mem_mb").alias("min_mem_mb"),
        F.coalesce(F.avg("cpu_pct"), F.lit(0.0)).alias("avg_cpu_pct"),
        F.coalesce(F.max("cpu_pct"), F.lit(0.0)).alias("max_cpu_pct"),
        F.avg(F.col("threads").cast("double")).alias("avg_threads"),
        F.max("threads").alias("max_threads"),
        F.count(F.lit(1)).alias("n_poll_samples"),
    )
    return agg.withColumns({
        "mem_delta_mb": F.col("end_mem_mb") - F.col("start_mem_mb"),
        "peak_increase_mb": F.col("peak_mem_mb") - F.col("start_mem_mb"),
    })


def stage_summary(rollup: DataFrame, exclude_prefix: str = "_infer_") -> DataFrame:
    """Printable summary: drops stages named with ``exclude_prefix`` and
    those without an elapsed time (a stage with one sample has 0.0 and stays),
    rounded half-even like Python's ``round``."""
    r = rollup.where(~F.col("stage").startswith(exclude_prefix) & F.col("elapsed_sec").isNotNull())
    return r.select(
        "stage",
        F.bround("elapsed_sec", 3).alias("time_s"),
        F.bround("mem_delta_mb", 2).alias("mem_delta_mb"),
        F.bround("peak_increase_mb", 2).alias("peak_delta_mb"),
        F.bround("peak_mem_mb", 2).alias("peak_mem_mb"),
        F.bround("avg_cpu_pct", 1).alias("avg_cpu_pct"),
        F.bround("max_cpu_pct", 1).alias("max_cpu_pct"),
        "max_threads",
        F.col("n_poll_samples").alias("poll_samples"),
    )


def path_timing(runs: DataFrame) -> DataFrame:
    """Per prediction path: mean and population std of the run times,
    per-sample microseconds, total milliseconds and throughput (0 when the
    mean is 0)."""
    agg = runs.groupBy("path").agg(
        F.avg("elapsed_sec").alias("mean_sec"),
        F.stddev_pop("elapsed_sec").alias("std_sec"),
        F.max("n").alias("n_samples"),
        F.count(F.lit(1)).alias("n_repeats"),
    )
    n = F.col("n_samples").cast("double")
    return agg.select(
        "path", "mean_sec", "std_sec",
        (F.col("mean_sec") / n * F.lit(1e6)).alias("per_sample_us"),
        (F.col("std_sec") / n * F.lit(1e6)).alias("per_sample_std_us"),
        (F.col("mean_sec") * F.lit(1000.0)).alias("total_ms"),
        F.when(F.col("mean_sec") > 0, n / F.col("mean_sec")).otherwise(F.lit(0.0)).alias("throughput_sps"),
        "n_samples", "n_repeats",
    )


def path_delta(timing: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """For each (tag, first path, second path) present on both sides: the
    per-sample microseconds of both, the delta and the delta in percent."""
    spark = timing.sparkSession
    p = spark.createDataFrame(list(pairs), "tag string, first_path string, second_path string")
    a = timing.select(F.col("path").alias("first_path"), F.col("per_sample_us").alias("first_us"))
    b = timing.select(F.col("path").alias("second_path"), F.col("per_sample_us").alias("second_us"))
    j = p.join(a, "first_path").join(b, "second_path")
    return j.select("tag", "first_path", "second_path", "first_us", "second_us",
                    (F.col("second_us") - F.col("first_us")).alias("delta_us"),
                    ((F.col("second_us") / F.col("first_us") - F.lit(1.0)) * F.lit(100.0)).alias("delta_pct"))


def efficiency_table(timing: DataFrame, rollup: DataFrame) -> DataFrame:
    """Samples/s per MB and per CPU %, and us x peak MB, with floors of
    0.1 MB and 0.1 % so idle paths do not divide by zero."""
    j = timing.join(rollup.select(F.col("stage").alias("path"), "mem_delta_mb", "avg_cpu_pct"), "path")
    peak = F.greatest(F.abs(F.col("mem_delta_mb")), F.lit(MEM_FLOOR_MB))
    return j.select(
        "path",
        F.bround(F.col("throughput_sps") / peak, 1).alias("samples_per_sec_per_mb"),
        F.bround(F.col("throughput_sps") / F.greatest(F.col("avg_cpu_pct"), F.lit(CPU_FLOOR_PCT)), 0)
        .alias("samples_per_sec_per_cpu_pct"),
        F.bround(F.col("per_sample_us") * peak, 4).alias("us_x_peak_mb"),
    )

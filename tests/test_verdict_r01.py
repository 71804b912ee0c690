"""Cases the first verdict found: rows without a time, null file names, CSV text, padded headers."""

from pyspark.sql import functions as F

from flowscore.operators import jobs, routing
from flowscore.sources.csv_io import read_flows_csv, write_csv


def test_rows_without_a_time_stay(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00"), (3, None)], "id int, t string").select(
        "id", F.to_timestamp("t").alias("ts"))
    got = {r.id: (r.rate, r.mode) for r in routing.rate_mode(df, "ts", "1 hour", 2, 5).collect()}
    assert got == {1: (2, "FDM"), 2: (2, "FDM"), 3: (None, None)}


def test_null_file_name_is_rejected(spark):
    df = spark.createDataFrame([(None, None), (None, "a.CSV")], "flow_rate int, input_filename string")
    assert [r.accepted for r in jobs.validate(df).collect()] == [False, True]


def test_csv_text_round_trip(spark, tmp_path):
    values = [" Benign", "Benign ", 'a "q" b', "x,y", "back\\slash"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, label string")
    write_csv(df, str(tmp_path / "c"))
    got = {int(r.i): r.label for r in read_flows_csv(spark, str(tmp_path / "c")).collect()}
    assert got == dict(enumerate(values))

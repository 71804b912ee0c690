"""Telemetry and job-rule edge cases on tiny inline tables."""

import datetime as dt


from flowscore.operators import jobs as J
from flowscore.operators import telemetry as TEL


def _samples(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("Preprocess", t, 100.0, 10.0, 4), ("Preprocess", t + dt.timedelta(seconds=2), 130.0, 30.0, 6),
            ("Preprocess", t + dt.timedelta(seconds=1), 150.0, 20.0, 5), ("_infer_FDM", t, 10.0, 1.0, 1),
            ("_infer_FDM", t + dt.timedelta(seconds=1), 12.0, 1.0, 1), ("Load", t, 50.0, 0.0, 2)]
    return spark.createDataFrame(rows, "stage string, ts timestamp, mem_mb double, cpu_pct double, threads int")


def test_stage_rollup_values(spark):
    r = {x["stage"]: x for x in TEL.stage_rollup(_samples(spark)).collect()}
    p = r["Preprocess"]
    assert (p["elapsed_sec"], p["start_mem_mb"], p["end_mem_mb"], p["peak_mem_mb"], p["min_mem_mb"]) == \
        (2.0, 100.0, 130.0, 150.0, 100.0)
    assert (p["mem_delta_mb"], p["peak_increase_mb"], p["avg_cpu_pct"], p["max_threads"]) == (30.0, 50.0, 20.0, 6)
    assert (r["Load"]["elapsed_sec"], r["Load"]["mem_delta_mb"], r["Load"]["n_poll_samples"]) == (0.0, 0.0, 1)


def test_stage_summary_drops_prefix_and_keeps_one_sample_stages(spark):
    s = TEL.stage_summary(TEL.stage_rollup(_samples(spark)))
    assert sorted(r["stage"] for r in s.collect()) == ["Load", "Preprocess"]


def test_path_timing_zero_mean_and_floors(spark):
    runs = spark.createDataFrame([("p", 1, 0.0, 1000), ("p", 2, 0.0, 1000), ("q", 1, 0.5, 100)],
                                 "path string, run long, elapsed_sec double, n long")
    t = {r["path"]: r for r in TEL.path_timing(runs).collect()}
    assert t["p"]["throughput_sps"] == 0.0 and t["q"]["throughput_sps"] == 200.0
    assert t["q"]["per_sample_us"] == 5000.0 and t["q"]["total_ms"] == 500.0
    roll = spark.createDataFrame([("q", 0.0, 0.0)], "stage string, mem_delta_mb double, avg_cpu_pct double")
    e = TEL.efficiency_table(TEL.path_timing(runs), roll).first()
    assert e["samples_per_sec_per_mb"] == 2000.0 and e["samples_per_sec_per_cpu_pct"] == 2000.0
    assert e["us_x_peak_mb"] == 500.0


def test_validate_rule_order_and_case(spark):
    req = spark.createDataFrame([(1, 777, "a.txt"), (2, None, "b.CSV"), (3, 0, "c.txt"), (4, 5000, "d.csv")],
                                "job_id long, flow_rate int, input_filename string")
    r = {x["job_id"]: x for x in J.validate(req).collect()}
    assert r[1]["reject_reason"] == J.RATE_REJECT  # the rate is checked first
    assert r[2]["accepted"] and r[4]["accepted"]
    assert r[3]["reject_reason"] == J.FILE_REJECT


def test_status_codes_include_running(spark):
    man = spark.createDataFrame([(1, "running"), (2, "pending"), (3, "failed"), (4, "done")],
                                "job_id long, status string")
    req = spark.createDataFrame([(i,) for i in range(1, 6)], "request_id long")
    codes = {r["request_id"]: r["code"] for r in J.status_codes(req, man).collect()}
    assert codes == {1: 202, 2: 202, 3: 500, 4: 200, 5: 404}


def test_failed_job_keeps_last_2000_chars(spark):
    man = spark.createDataFrame([(1, "failed", dt.datetime(2024, 1, 1), "x" * 100 + "y" * 2000),
                                 (2, "pending", dt.datetime(2024, 1, 1), "")],
                                "job_id long, status string, created_at timestamp, error_text string")
    latest = {r["job_id"]: r for r in J.latest_status(J.lifecycle_events(man)).collect()}
    assert latest[1]["status"] == "failed" and latest[1]["error_message"] == "y" * 2000
    assert latest[1]["n_events"] == 3
    assert latest[2]["status"] == "pending" and latest[2]["n_events"] == 1


def test_defaults(spark):
    req = spark.createDataFrame([("", ""), ("Label", "benign")], "label_col string, benign_label string")
    r = J.with_defaults(req).select("label_col", "benign_label", "initial_status").collect()
    assert tuple(r[0]) == (None, "Benign", "pending") and tuple(r[1]) == ("Label", "benign", "pending")

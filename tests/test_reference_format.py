"""A flow CSV in the reference's own layout, scored end to end."""

from flowscore.operators import metrics as MET
from flowscore.operators import scoring as S
from flowscore.sources import bundle as B
from flowscore.sources import csv_io as CSV

HEADER = (" flow_id,src_ip,dst_ip,src_port,dst_port,protocol,start_time,end_time,duration,packet_count,"
          "Avg Packet Size , Flow IAT Mean,Fwd Packet Length Max,Fwd Packets Length Total,Init Fwd Win Bytes,"
          "Init Bwd Win Bytes,Label")
ROWS = [
    "10.0.0.1-10.0.0.2-5000-53-17,10.0.0.1,10.0.0.2,5000,53,17,0.0,1.0,1.0,11,inf,0.1,35,3500,-1,-1,UDP-FLOOD",
    "10.0.0.1-10.0.0.2-5000-53-17,10.0.0.1,10.0.0.2,5000,53,17,1.0,2.0,1.0,11,NA,0.06,31,3100,-1,-1,UDP-FLOOD",
    "10.0.0.3-10.0.0.4-443-6000-6,10.0.0.3,10.0.0.4,443,6000,6,2.0,3.0,1.0,3,84.5,0.01,10,60,65535,65535,Benign",
    "10.0.0.3-10.0.0.4-443-6000-6,10.0.0.3,10.0.0.4,443,6000,6,3.0,9.0,6.0,4,2500.0,0.0,5,50,65535,65535,Benign",
]
FEATURES = ("Avg Packet Size", "Flow IAT Mean", "Fwd Packet Length Max", "Fwd Packets Length Total",
            "Init Bwd Win Bytes", "Init Fwd Win Bytes")
TYPES = {"src_port": "int", "dst_port": "int", "protocol": "int", "start_time": "double", "end_time": "double",
         "duration": "double", "packet_count": "bigint", **{f: "double" for f in FEATURES}}


def _bundle():
    q, d, a = "`Fwd Packet Length Max`", "`Flow IAT Mean`", "`Avg Packet Size`"
    members = (
        B.Member("m1", expr=f"CASE WHEN {q} > 29 THEN 0.85 ELSE 0.1 END"),
        B.Member("m2", expr=f"CASE WHEN {d} >= 0.05 THEN 0.75 ELSE 0.2 END"),
        B.Member("m3", expr=f"CASE WHEN {q} >= 30 AND {d} >= 0.04 THEN 0.95 ELSE 0.05 END"),
        B.Member("m4", expr=f"CASE WHEN {q} >= 20 AND {d} >= 0.03 THEN 0.7 ELSE 0.15 END"),
        B.Member("m5", expr=f"CASE WHEN {a} > 2000 THEN 0.6 ELSE 0.3 END"),
    )
    w = {"m1": 1.0, "m2": 1.0, "m3": 1.5, "m4": 1.0}
    fdm = B.Voter("FDM", ("m1", "m2", "m3", "m4"), FEATURES[1:], w, 2.25, 0.3)
    ham = B.Voter("HAM", ("m1", "m2", "m3", "m4", "m5"), FEATURES, w, None, 0.3)
    return B.EnsembleBundle(members=members, fdm=fdm, ham=ham, label_col="Label")


def test_reference_csv_end_to_end(spark, tmp_path):
    p = tmp_path / "flows.csv"
    p.write_text(HEADER + "\n" + "\n".join(ROWS) + "\n")
    df = CSV.read_flows_csv(spark, f"file://{p}", TYPES)
    assert df.columns[0] == "flow_id" and "Avg Packet Size" in df.columns
    out = S.score_table(df, _bundle(), flow_rate=None).collect()
    assert len(out) == 4
    assert [r["pred_binary_DFDM"] for r in out] == [1, 1, 0, 0]
    assert out[0]["Init Fwd Win Bytes"] == -1.0  # UDP sentinel kept, not treated as missing
    assert out[0]["Avg Packet Size"] == float("inf")  # output keeps the column as read (cleaning is internal)
    assert out[1]["Avg Packet Size"] is None  # the NA token is missing
    one = S.score_table(df, _bundle(), flow_rate=5000)
    assert one.columns[-3:] == ["pred_binary", "pred_3label", "mode"]
    cmp = {r["mode"]: r for r in MET.mode_comparison(S.verdicts(df, _bundle())).collect()}
    assert cmp["DFDM"]["accuracy"] == 1.0 and cmp["DFDM"]["conf_acc"] is None


def test_flow_consistency_checks(spark, tmp_path):
    from flowscore.operators.consistency import consistency_report, flow_checks
    p = tmp_path / "flows.csv"
    p.write_text(HEADER + "\n" + "\n".join(ROWS) + "\n")
    df = CSV.read_flows_csv(spark, f"file://{p}", TYPES)
    checked = flow_checks(df).select("id_ok", "duration_ok", "iat_ok").collect()
    assert [tuple(r) for r in checked] == [(True, True, True), (True, True, False), (True, True, False),
                                          (True, True, False)]
    rep = consistency_report(flow_checks(df)).first()
    assert (rep["n"], rep["bad_flow_id"], rep["bad_duration"], rep["bad_iat"]) == (4, 0, 0, 3)


def test_job_outputs_per_folder(spark, tmp_path):
    from flowscore.operators.jobs import write_job_outputs
    rows = [(j, f"f{i}", i % 2) for j in (1, 2) for i in range(5)] + [(3, "g", 1)]
    df = spark.createDataFrame(rows, "job_id long, flow_id string, pred_binary int")
    out = f"file://{tmp_path}/jobs"
    write_job_outputs(df, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 11
    assert sorted(r[0] for r in back.select("job_id").distinct().collect()) == [1, 2, 3]

"""Batch forms of the job API's data rules, over a manifest table.

Requests, lifecycle events and the rows to score are all tables; every rule
is a projection, a grouped aggregate or an equi-join on the job id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscore.constants import (
    BENIGN_LABEL, FLOW_THRESHOLD_EXTREME, FLOW_THRESHOLD_HIGH, MODES, STATUS_ABSENT, STATUS_DONE, STATUS_FAILED, STATUS_WAITING, TRACE_KEEP_CHARS,
    VALID_FLOW_RATES,
)
from flowscore.functions import sqltext as ST

# Request rejection messages.
RATE_REJECT = "flow_rate must be one of [0, 1000, 5000] or omitted for all modes"
FILE_REJECT = "file must be a .csv"


def validate(requests: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` (first failing rule, null when accepted) and
    ``accepted``: the rate must be null or one of 0 / 1000 / 5000, then the
    file name must end in .csv (any case); a null name does not."""
    rates = ", ".join(str(r) for r in VALID_FLOW_RATES)
    reason = (f"CASE WHEN NOT (flow_rate IS NULL OR flow_rate IN ({rates})) THEN {ST.lit_str(RATE_REJECT)} "
              f"WHEN NOT endswith(lower(coalesce(input_filename, '')), '.csv') THEN {ST.lit_str(FILE_REJECT)} END")
    return requests.selectExpr("*", f"{reason} AS reject_reason").selectExpr(
        "*", "reject_reason IS NULL AS accepted")


def with_defaults(requests: DataFrame) -> DataFrame:
    """Empty label column -> null (unlabelled), empty benign label -> Benign,
    new jobs start as pending."""
    return requests.withColumns({
        "label_col": F.expr("nullif(label_col, '')"),
        "benign_label": F.expr(f"coalesce(nullif(benign_label, ''), {ST.lit_str(BENIGN_LABEL)})"),
        "initial_status": F.expr("'pending'"),
    })


def job_label(verdicts: DataFrame, jobs: DataFrame, key: str) -> str:
    """y by the column that the job's manifest row names: text is compared
    with the job's benign text, numbers are 0/1. A CASE over the table's own
    columns; no name or an unknown one means unlabelled (null)."""
    own = [f for f in verdicts.schema.fields if not f.name.startswith("_") and f.name != key and f.name not in jobs.columns]
    branches = []
    for f in own:
        col = ST.ident(f.name)
        value = (ST.numeric_label(col) if isinstance(f.dataType, T.NumericType) else
                 f"CASE WHEN CAST({col} AS STRING) <=> benign_label THEN 0 ELSE 1 END")
        branches.append(f"WHEN {ST.lit_str(f.name)} THEN {value}")
    return f"CAST(CASE label_col {' '.join(branches)} END AS INT)" if branches else "CAST(NULL AS INT)"


def score_jobs(verdicts: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Score each job's rows with its own settings: its rate picks one mode
    (null -> all three, one row per mode), its label column and benign text
    decide y. ``verdicts`` carries ``_bin_*``/``_l3_*`` for every mode and the
    job key; the manifest joins on it (equi-join; AQE picks broadcast or
    sort-merge from measured sizes)."""
    y = job_label(verdicts, jobs, key)
    j = verdicts.join(jobs.withColumnRenamed("job_id", key), on=key, how="inner")
    mode = ST.select_mode("flow_rate", FLOW_THRESHOLD_HIGH, FLOW_THRESHOLD_EXTREME)
    all_modes = ", ".join(f"'{m}'" for m in MODES)
    j = j.selectExpr("*", f"explode(CASE WHEN flow_rate IS NULL THEN array({all_modes}) ELSE array({mode}) END) AS mode")

    def pick(prefix):
        return f"CASE mode WHEN 'HAM' THEN {prefix}_HAM WHEN 'FDM' THEN {prefix}_FDM ELSE {prefix}_DFDM END"

    out = j.selectExpr(f"{ST.ident(key)} AS job_id", "*", f"{pick('_bin')} AS pred_binary",
                       f"{pick('_l3')} AS pred_3label", f"{y} AS y")
    return out.drop(key)


def status_codes(requested: DataFrame, manifest: DataFrame) -> DataFrame:
    """Response code per requested id: absent 404, pending/running 202,
    failed 500, done 200 (left join of requests to the manifest)."""
    j = requested.join(manifest.select(F.col("job_id").alias("request_id"), "status"), "request_id", "left")
    s = F.col("status")
    code = (F.when(s.isNull(), F.lit(STATUS_ABSENT)).when(s.isin("pending", "running"), F.lit(STATUS_WAITING))
            .when(s == "failed", F.lit(STATUS_FAILED)).otherwise(F.lit(STATUS_DONE)))
    return j.select("request_id", "status", code.alias("code"))


def lifecycle_events(manifest: DataFrame) -> DataFrame:
    """pending -> running -> done/failed transitions as an event log; a job
    still pending has one event. A failure keeps the last 2000 characters of
    its message."""
    created = F.col("created_at")
    finished = F.col("status").isin("done", "failed")
    msg = F.when(F.col("status") == "failed", F.right(F.col("error_text"), F.lit(TRACE_KEEP_CHARS)))
    ev = F.array(
        F.struct(F.lit("pending").alias("event_status"), created.alias("ts"), F.lit(None).cast("string").alias("error_message")),
        F.struct(F.lit("running").alias("event_status"), (created + F.expr("INTERVAL 1 HOUR")).alias("ts"),
                 F.lit(None).cast("string").alias("error_message")),
        F.struct(F.col("status").alias("event_status"), (created + F.expr("INTERVAL 2 HOURS")).alias("ts"),
                 msg.alias("error_message")),
    )
    log = manifest.select("job_id", F.explode(F.when(finished, ev).otherwise(F.slice(ev, 1, 1))).alias("e"))
    return log.select("job_id", "e.*")


def latest_status(log: DataFrame) -> DataFrame:
    """Latest state per job: status and message of the newest event."""
    return log.groupBy("job_id").agg(
        F.max_by("event_status", "ts").alias("status"),
        F.max("ts").alias("updated_at"),
        F.max_by("error_message", "ts").alias("error_message"),
        F.count(F.lit(1)).alias("n_events"),
    )


def write_job_outputs(scored: DataFrame, path: str, row_key: str = "flow_id", fmt: str = "csv") -> None:
    """Per-job predictions under ``path/job_id=<id>/`` (dynamic overwrite, so
    re-running a job replaces only its folder). Range partitioning on
    (job_id, row key) keeps a small job in one file and splits a job holding a
    third of all rows over many tasks instead of funnelling it into one."""
    w = scored.repartitionByRange("job_id", row_key).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("job_id")
    if fmt == "csv":
        from flowscore.sources.csv_io import DIALECT
        w.options(**DIALECT).csv(path)
    else:
        w.parquet(path)

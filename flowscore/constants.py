"""Fixed values that must equal the reference's behaviour.

Fixed values (kept verbatim, in natural order):

* detection modes, in run order: HAM, FDM, DFDM
* order used when evaluating all modes (binary): FDM, DFDM, HAM
* three-label codes: 0 Benign, 1 Warning, 2 Malicious
* binary text: 0 Benign, 1 Malicious
* flow-rate thresholds: FDM from 1000, DFDM from 5000 (inclusive)
* rates accepted by the job API: 0, 1000, 5000 (or none)
* default benign label: Benign; default label column: Label
* member vote: probability > 0.5; three-label malicious cut: mean >= 0.5
* watcher batch size 5 rows, idle flush after 5.0 seconds, poll 1.0 seconds
* chunk size for the chunked scan: 4096 rows
* timing: 1 warm-up and 5 repeats
* failure trace kept: last 2000 characters
* efficiency floors: 0.1 MB and 0.1 % CPU
* HTTP-style status codes: 404 absent, 202 pending/running, 500 failed, 200 done
"""

MODES = ("HAM", "FDM", "DFDM")
EVAL_ORDER = ("FDM", "DFDM", "HAM")

LABEL3_TEXT = {0: "Benign", 1: "Warning", 2: "Malicious"}
BINARY_TEXT = {0: "Benign", 1: "Malicious"}

FLOW_THRESHOLD_HIGH = 1000
FLOW_THRESHOLD_EXTREME = 5000
VALID_FLOW_RATES = (0, 1000, 5000)

BENIGN_LABEL = "Benign"
LABEL_COL = "Label"

VOTE_CUT = 0.5
MALICIOUS_MEAN_CUT = 0.5

WATCH_BATCH_SIZE = 5
IDLE_FLUSH_SECS = 5.0
POLL_INTERVAL_SECS = 1.0
CHUNK_ROWS = 4096
WARMUP_RUNS = 1
TIMED_REPEATS = 5

TRACE_KEEP_CHARS = 2000
MEM_FLOOR_MB = 0.1
CPU_FLOOR_PCT = 0.1

STATUS_ABSENT = 404
STATUS_WAITING = 202
STATUS_FAILED = 500
STATUS_DONE = 200

# Tokens that a pandas CSV reader treats as missing by default; a flow CSV read
# through Spark nulls the same tokens before casting.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

"""Ensemble bundle: members, voters, scaler and encoders.

A bundle is plain data (JSON-serialisable) plus, optionally, fitted
``pyspark.ml`` models saved next to it. Nothing is ever unpickled.

* A *member* yields a class-1 probability per row, either as a SQL
  expression over the cleaned feature columns, a fitted Spark ML
  classification pipeline, or a fitted extra-trees node table. ``calibrated_expr`` is the probability used by the
  three-label path (the reference keeps raw and calibrated members apart);
  it defaults to the raw one.
* A *voter* (FDM or HAM) is an ordered list of members, the features they
  see, per-member weights (missing -> 1.0), the vote threshold
  ``max_vote_index`` (default: half the total weight) and the disagreement
  threshold for the Warning label.
"""

from __future__ import annotations

import glob
import json
import os
from dataclasses import asdict, dataclass, field

from flowscore.constants import BENIGN_LABEL, FLOW_THRESHOLD_EXTREME, FLOW_THRESHOLD_HIGH


@dataclass(frozen=True)
class Member:
    name: str
    expr: str | None = None
    calibrated_expr: str | None = None
    model_path: str | None = None  # saved pyspark.ml model (PipelineModel)
    forest_path: str | None = None  # saved extra-trees node arrays

    def __post_init__(self):
        given = [x for x in (self.expr, self.model_path, self.forest_path) if x is not None]
        if len(given) != 1:
            raise ValueError(f"member {self.name}: give exactly one of expr / model_path / forest_path")


@dataclass(frozen=True)
class Voter:
    name: str
    members: tuple[str, ...]
    features: tuple[str, ...]
    weights: dict = field(default_factory=dict)
    max_vote_index: float | None = None
    disagreement_threshold: float = 0.3

    def weight(self, member: str) -> float:
        return float(self.weights.get(member, 1.0))

    @property
    def threshold(self) -> float:
        if self.max_vote_index is not None:
            return float(self.max_vote_index)
        return sum(self.weight(m) for m in self.members) / 2.0


@dataclass(frozen=True)
class EnsembleBundle:
    members: tuple[Member, ...]
    fdm: Voter
    ham: Voter
    scaler: dict | None = None  # {feature: [mean, scale]}
    encoders: dict | None = None  # {column: [classes...]}
    label_col: str | None = "label"
    benign_label: str = BENIGN_LABEL
    flow_threshold_high: float = FLOW_THRESHOLD_HIGH
    flow_threshold_extreme: float = FLOW_THRESHOLD_EXTREME

    def member(self, name: str) -> Member:
        for m in self.members:
            if m.name == name:
                return m
        raise KeyError(name)

    @property
    def all_features(self) -> tuple[str, ...]:
        """Sorted union of both voters' features (the scoring column order)."""
        return tuple(sorted(set(self.fdm.features) | set(self.ham.features)))

    def voter(self, mode: str) -> Voter:
        return self.ham if mode == "HAM" else self.fdm

    def with_(self, **kw) -> "EnsembleBundle":
        d = {f: getattr(self, f) for f in self.__dataclass_fields__}
        d.update(kw)
        return EnsembleBundle(**d)


# ---------------------------------------------------------------- persistence

BUNDLE_FILE_PATTERN = "*_bundle.json"


def _fs(spark, path: str):
    """(file system, path object) of a path as Spark resolves it: without a scheme, on its default file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _local(path: str) -> str:
    for pre in ("file://", "file:"):
        if path.startswith(pre):
            return path[len(pre):]
    return path


def _doc(bundle: EnsembleBundle) -> dict:
    return {
        "members": [asdict(m) for m in bundle.members],
        "fdm": asdict(bundle.fdm),
        "ham": asdict(bundle.ham),
        "scaler": bundle.scaler,
        "encoders": bundle.encoders,
        "label_col": bundle.label_col,
        "benign_label": bundle.benign_label,
        "flow_threshold_high": bundle.flow_threshold_high,
        "flow_threshold_extreme": bundle.flow_threshold_extreme,
    }


def save_bundle(bundle: EnsembleBundle, directory: str, prefix: str = "flowscore", spark=None) -> str:
    """Write the bundle JSON as one file. With ``spark`` the path is Spark's, as
    are those of saved members, so a bundle lies together on a shared file
    system; without it the path is a local one."""
    path = f"{directory.rstrip('/')}/{prefix}_bundle.json"
    doc = json.dumps(_doc(bundle), indent=1, sort_keys=True)
    if spark is None:
        os.makedirs(_local(directory), exist_ok=True)
        with open(_local(path), "w") as fh:
            fh.write(doc)
        return _local(path)
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(doc.encode()))
    out.close()
    return path


def find_bundle_file(directory: str, spark=None) -> str:
    """Exactly one bundle file must match; none or several is an error."""
    if spark is None:
        d = _local(directory)
        hits = sorted(glob.glob(os.path.join(d, BUNDLE_FILE_PATTERN)))
        listing = sorted(os.listdir(d)) if os.path.isdir(d) else []
    else:
        fs, root = _fs(spark, directory)
        found = fs.globStatus(_fs(spark, f"{directory.rstrip('/')}/{BUNDLE_FILE_PATTERN}")[1]) or []
        hits = sorted(str(st.getPath()) for st in found)
        listing = [str(st.getPath().getName()) for st in (fs.listStatus(root) if fs.exists(root) else [])]
    if not hits:
        raise FileNotFoundError(f"no {BUNDLE_FILE_PATTERN} file in {directory}; it holds: {listing}")
    if len(hits) > 1:
        raise ValueError(f"several bundle files in {directory}: {hits}")
    return hits[0]


def load_bundle(directory: str, spark=None) -> EnsembleBundle:
    path = find_bundle_file(directory, spark)
    if spark is None:
        with open(path) as fh:
            doc = json.load(fh)
    else:
        doc = json.loads(spark.read.text(path, wholetext=True).first()[0])

    def voter(d):
        d = dict(d)
        d["members"] = tuple(d["members"])
        d["features"] = tuple(d["features"])
        return Voter(**d)

    return EnsembleBundle(
        members=tuple(Member(**m) for m in doc["members"]),
        fdm=voter(doc["fdm"]),
        ham=voter(doc["ham"]),
        scaler=doc.get("scaler"),
        encoders=doc.get("encoders"),
        label_col=doc.get("label_col"),
        benign_label=doc.get("benign_label", BENIGN_LABEL),
        flow_threshold_high=doc.get("flow_threshold_high", FLOW_THRESHOLD_HIGH),
        flow_threshold_extreme=doc.get("flow_threshold_extreme", FLOW_THRESHOLD_EXTREME),
    )


# ------------------------------------------------------- fixture ensemble

def fixture_bundle() -> EnsembleBundle:
    """Expression members over the flow fixture (FIXTURES.md F3).

    q = fwd_packet_length_max, d = flow_iat_mean, aps = avg_packet_size.
    """
    q, d, aps = "fwd_packet_length_max", "flow_iat_mean", "avg_packet_size"
    members = (
        Member("m1", expr=f"CASE WHEN {q} > 29 THEN 0.85 ELSE 0.1 END"),
        Member("m2", expr=f"CASE WHEN {d} >= 0.05 THEN 0.75 ELSE 0.2 END"),
        Member("m3", expr=f"CASE WHEN {q} >= 30 AND {d} >= 0.04 THEN 0.95 ELSE 0.05 END"),
        Member("m4", expr=f"CASE WHEN {q} >= 20 AND {d} >= 0.03 THEN 0.7 ELSE 0.15 END"),
        Member("m5", expr=f"CASE WHEN {aps} > 2000 THEN 0.6 ELSE 0.3 END"),
    )
    weights = {"m1": 1.0, "m2": 1.0, "m3": 1.5, "m4": 1.0}
    fdm = Voter("FDM", ("m1", "m2", "m3", "m4"),
                ("flow_iat_mean", "fwd_packet_length_max", "init_bwd_win_bytes", "init_fwd_win_bytes"),
                weights, 2.25, 0.3)
    ham = Voter("HAM", ("m1", "m2", "m3", "m4", "m5"),
                ("avg_packet_size", "flow_iat_mean", "fwd_packet_length_max", "fwd_packets_length_total",
                 "init_bwd_win_bytes", "init_fwd_win_bytes"),
                weights, None, 0.3)
    return EnsembleBundle(members=members, fdm=fdm, ham=ham, label_col="label")


def member_sizes(bundle: EnsembleBundle, spark) -> dict[str, int]:
    """Stored size in bytes of every member (saved model or forest folder;
    the expression length for expression members), per voter use: the
    per-voter model footprint is the sum over its members."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for m in bundle.members:
        path = m.model_path or m.forest_path
        if path is None:
            out[m.name] = len((m.expr or "").encode()) + len((m.calibrated_expr or "").encode())
            continue
        p = jvm.org.apache.hadoop.fs.Path(path)
        out[m.name] = int(p.getFileSystem(conf).getContentSummary(p).getLength())
    return out


def voter_sizes(bundle: EnsembleBundle, spark) -> dict[str, int]:
    sizes = member_sizes(bundle, spark)
    return {vt.name: sum(sizes[m] for m in vt.members) for vt in (bundle.fdm, bundle.ham)}

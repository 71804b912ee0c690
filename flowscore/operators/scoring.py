"""Ensemble scoring: every member once, every mode from the same columns.

Plan shape: a single projection over the scan (no shuffle). The originals
are carried under positional names so the member expressions can refer to
the cleaned features by their plain names, then renamed back at the end.
DFDM reuses FDM's raw votes; the three-label paths use the calibrated
probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.constants import MODES
from flowscore.functions import sqltext as ST
from flowscore.functions.routing import mode_for_rate
from flowscore.operators.prep import feature_sql, label_sql, q, trim_columns, with_codes
from flowscore.sources.bundle import EnsembleBundle

def _member_prob(bundle: EnsembleBundle, name: str, calibrated: bool) -> str:
    """Raw (vote) or calibrated (three-label) probability of a member. For
    fitted members the raw score is the column ``_mlp_<name>``, which a
    ``calibrated_expr`` may refer to (e.g. a Platt map of it)."""
    m = bundle.member(name)
    if calibrated and m.calibrated_expr:
        return f"CAST(({m.calibrated_expr}) AS DOUBLE)"
    if m.expr is None:
        return f"_mlp_{name}"
    return f"CAST(({m.expr}) AS DOUBLE)"


def _member_names(bundle: EnsembleBundle) -> list[str]:
    seen: list[str] = []
    for n in bundle.ham.members + bundle.fdm.members:
        if n not in seen:
            seen.append(n)
    return seen


def verdicts(df: DataFrame, bundle: EnsembleBundle, label_col: str | None = None,
             benign_label: str | None = None, modes: Sequence[str] = MODES) -> DataFrame:
    """Original columns plus, per mode m: ``_bin_m`` (0/1) and ``_l3_m`` (0/1/2);
    diagnostics ``_p_*``/``_c_*``/``_v_*`` (member probabilities and votes),
    ``_vd_m``, ``_hv_m``, ``_mean_m``, ``_std_m``; and ``_y`` when labelled.
    Columns the caller does not select are pruned by Catalyst; the whole
    chain collapses into one projection (one codegen stage, no shuffle)."""
    df = trim_columns(df)
    label_col = bundle.label_col if label_col is None else label_col
    benign_label = bundle.benign_label if benign_label is None else benign_label
    names = df.columns
    hidden = [f"__o{i}" for i in range(len(names))]
    src = dict(zip(names, hidden))

    y = label_sql(df, label_col, benign_label, source=src.get(label_col or ""))
    feat_src = {k: v for k, v in src.items() if k != label_col}
    df, codes = with_codes(df, bundle)
    feats = feature_sql(feat_src, bundle, codes)
    step = df.selectExpr(*[f"{ST.ident(n)} AS {h}" for n, h in zip(names, hidden)],
                         *([f"{y} AS _y"] if y is not None else []),
                         *[f"{x} AS {ST.ident(f)}" for f, x in feats.items()])

    need_ml = [n for n in _member_names(bundle) if bundle.member(n).model_path is not None]
    if need_ml:
        from flowscore.operators.members import add_ml_probabilities
        step = add_ml_probabilities(step, bundle, need_ml)
    need_forest = [n for n in _member_names(bundle) if bundle.member(n).forest_path is not None]
    if need_forest:
        from flowscore.operators.extra_trees import forest_probability, load_forest
        step = step.withColumns({f"_mlp_{n}": forest_probability(load_forest(step.sparkSession,
                                                                             bundle.member(n).forest_path))
                                 for n in need_forest})

    members = _member_names(bundle)
    keep = [c for c in step.columns if c.startswith("__o") or c == "_y"]
    step = step.selectExpr(*keep,
                           *[f"{_member_prob(bundle, n, False)} AS _p_{n}" for n in members],
                           *[f"{_member_prob(bundle, n, True)} AS _c_{n}" for n in members])
    step = step.selectExpr("*", *[f"{ST.member_vote('_p_' + n)} AS _v_{n}" for n in members])

    stats: list[str] = []
    for mode in ("HAM", "FDM"):
        if mode not in modes and not (mode == "FDM" and "DFDM" in modes):
            continue
        vt = bundle.voter(mode)
        votes = [f"_v_{n}" for n in vt.members]
        stats += [f"{ST.weighted_vote(votes, [vt.weight(n) for n in vt.members])} AS _vd_{mode}",
                  f"{ST.hard_vote(votes)} AS _hv_{mode}",
                  f"{ST.mean_of(['_c_' + n for n in vt.members])} AS _mean_{mode}"]
    step = step.selectExpr("*", *stats)
    stds = [f"{ST.std_pop_of(['_c_' + n for n in bundle.voter(m).members], '_mean_' + m)} AS _std_{m}"
            for m in ("HAM", "FDM") if f"_mean_{m}" in step.columns]
    step = step.selectExpr("*", *stds)

    out: list[str] = []
    for mode in modes:
        if mode == "DFDM":
            out += ["CAST(CASE WHEN _hv_FDM > CAST(0.0 AS DOUBLE) THEN 1 ELSE 0 END AS INT) AS _bin_DFDM",
                    "CAST(CASE WHEN _hv_FDM > CAST(0.0 AS DOUBLE) THEN 2 ELSE 0 END AS INT) AS _l3_DFDM"]
        else:
            vt = bundle.voter(mode)
            out += [f"{ST.vote_threshold('_vd_' + mode, vt.threshold)} AS _bin_{mode}",
                    f"{ST.three_label('_mean_' + mode, '_std_' + mode, vt.disagreement_threshold)} AS _l3_{mode}"]
    step = step.selectExpr("*", *out)
    # originals back under their own names
    internal = [c for c in step.columns if c.startswith("_") and not c.startswith("__o")]
    return step.selectExpr(*[f"{h} AS {ST.ident(n)}" for n, h in zip(names, hidden)], *internal)


def modes_for(rate: int | None, bundle: EnsembleBundle) -> list[str]:
    m = mode_for_rate(rate, bundle.flow_threshold_high, bundle.flow_threshold_extreme)
    return [m] if m else list(MODES)


def prediction_columns(modes: Sequence[str]) -> list[Column]:
    """``pred_binary``, ``pred_3label`` (text) and ``mode`` per mode; the
    ``_<mode>`` suffix is only added when several modes run."""
    cols = []
    for m in modes:
        sfx = "" if len(modes) == 1 else f"_{m}"
        cols += [f"_bin_{m} AS pred_binary{sfx}", f"{ST.label3_text('_l3_' + m)} AS pred_3label{sfx}",
                 f"'{m}' AS mode{sfx}"]
    return [F.expr(c) for c in cols]


def score_table(df: DataFrame, bundle: EnsembleBundle, flow_rate: int | None = None,
                label_col: str | None = None, benign_label: str | None = None) -> DataFrame:
    """Whole-table scoring (the reference's CSV mode): the input columns, as
    given, followed by the prediction columns of one mode (by rate) or all."""
    modes = modes_for(flow_rate, bundle)
    v = verdicts(df, bundle, label_col, benign_label, modes)
    return v.select(*[q(c.strip()).alias(c) for c in df.columns], *prediction_columns(modes))


def score_chunked(df: DataFrame, bundle: EnsembleBundle, flow_rate: int | None,
                  label_col: str | None = None, benign_label: str | None = None) -> DataFrame:
    """One named mode over a partitioned scan (the reference's batch mode).
    Results do not depend on how the input is split; a missing rate is an error."""
    if flow_rate is None:
        raise ValueError("a flow rate (for example 0, 1000 or 5000) is required for chunked scoring")
    return score_table(df, bundle, flow_rate, label_col, benign_label)


def long_verdicts(v: DataFrame, key_cols: Sequence[str], modes: Sequence[str] = MODES,
                  with_y: bool = True) -> DataFrame:
    """One row per (input row, mode): key columns, ``mode``, ``pred_binary``,
    ``pred_3label`` (code) and ``y``. An ``inline`` generator in the same
    stage, no shuffle."""
    structs = ", ".join(f"named_struct('mode', '{m}', 'pred_binary', _bin_{m}, 'pred_3label', _l3_{m})"
                        for m in modes)
    cols = [ST.ident(k) for k in key_cols]
    if with_y:
        cols.append("_y AS y")
    return v.selectExpr(*cols, f"inline(array({structs}))")

"""SQL-text builders for the hot expressions.

Building a Column through the Python API costs several JVM round trips per
operator; one ``F.expr``/``selectExpr`` string costs a handful whatever its
size. The scoring and metric operators therefore compose these strings (the
same expressions a Spark user would type into ``selectExpr``); Catalyst
sees identical trees either way.
"""

from __future__ import annotations

from collections.abc import Sequence


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def lit_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def clean_inf(x: str) -> str:
    return f"CASE WHEN abs({x}) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE {x} END"


def fill_missing(x: str, value: float = 0.0) -> str:
    return f"nanvl(coalesce({x}, {dbl(value)}), {dbl(value)})"


def to_feature(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def standard_scale(x: str, mean: float, scale: float) -> str:
    return f"(({x}) - {dbl(mean)}) / {dbl(scale)}"


def encode(x: str, classes: Sequence[str]) -> str:
    classes = sorted(str(v) for v in classes)
    pairs = ", ".join(f"{lit_str(v)}, {i}" for i, v in enumerate(classes))
    m = f"map({pairs})" if classes else "map()"
    return f"CAST(coalesce(try_element_at({m}, coalesce(CAST({x} AS STRING), 'nan')), 0) AS INT)"


def binarize_label(x: str, benign: str) -> str:
    return f"CAST(CASE WHEN {x} <=> {lit_str(benign)} THEN 0 ELSE 1 END AS INT)"


def numeric_label(x: str) -> str:
    return (f"CAST(CASE WHEN {x} IS NULL THEN raise_error('label column holds a missing value') "
            f"ELSE CAST(CAST({x} AS DOUBLE) AS INT) END AS INT)")


def member_vote(p: str) -> str:
    return f"CAST(CASE WHEN {p} > CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS INT)"


def weighted_vote(votes: Sequence[str], weights: Sequence[float]) -> str:
    return " + ".join([dbl(0.0)] + [f"CAST({v} AS DOUBLE) * {dbl(w)}" for v, w in zip(votes, weights)])


def hard_vote(votes: Sequence[str]) -> str:
    return " + ".join([dbl(0.0)] + [f"CAST({v} AS DOUBLE)" for v in votes])


def mean_of(ps: Sequence[str]) -> str:
    return f"({' + '.join(ps)}) / {dbl(len(ps))}"


def std_pop_of(ps: Sequence[str], mean: str) -> str:
    terms = " + ".join(f"({p} - {mean}) * ({p} - {mean})" for p in ps)
    return f"sqrt(({terms}) / {dbl(len(ps))})"


def vote_threshold(vd: str, t: float) -> str:
    return f"CAST(CASE WHEN {vd} >= {dbl(t)} THEN 1 ELSE 0 END AS INT)"


def three_label(mean: str, std: str, disagreement: float) -> str:
    return (f"CAST(CASE WHEN {std} >= {dbl(disagreement)} THEN 1 WHEN {mean} >= CAST(0.5 AS DOUBLE) THEN 2 "
            f"ELSE 0 END AS INT)")


def label3_text(code: str) -> str:
    return f"CASE {code} WHEN 0 THEN 'Benign' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Malicious' END"


def binary_text(code: str) -> str:
    return f"CASE {code} WHEN 0 THEN 'Benign' WHEN 1 THEN 'Malicious' END"


def select_mode(rate: str, high: float, extreme: float) -> str:
    return (f"CASE WHEN {rate} IS NULL THEN CAST(NULL AS STRING) WHEN {rate} >= {extreme!r} THEN 'DFDM' "
            f"WHEN {rate} >= {high!r} THEN 'FDM' ELSE 'HAM' END")

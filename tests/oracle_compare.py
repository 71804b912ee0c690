"""Run a registered query in Spark and its oracle SQL in DuckDB; compare."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None  # pandas turns both SQL NULL and NaN into NaN
        return v
    if hasattr(v, "item"):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].astype(object).itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (not isinstance(v, str) and v is not None and pd.isna(v)
                                        and not (isinstance(v, float) and math.isnan(v))) else v)
                         for v in rec))
    return out


def _key(t):
    return tuple((0, "") if v is None else (1, str(v)) for v in t)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame, rel=1e-9) -> str | None:
    """None when equal; else a short description of the first difference."""
    sc, dc = sorted(spark_pdf.columns), sorted(duck_pdf.columns)
    if sc != dc:
        return f"columns differ: spark={sc} oracle={dc}"
    if len(spark_pdf) != len(duck_pdf):
        return f"row counts differ: spark={len(spark_pdf)} oracle={len(duck_pdf)}"
    a = sorted(rows_of(spark_pdf), key=_key)
    b = sorted(rows_of(duck_pdf), key=_key)
    for ra, rb in zip(a, b):
        for c, va, vb in zip(sc, ra, rb):
            if va == vb:
                continue
            if isinstance(va, (int, float)) and isinstance(vb, (int, float)) and not isinstance(va, bool):
                if math.isclose(float(va), float(vb), rel_tol=rel, abs_tol=1e-12):
                    continue
            if va is None and vb is None:
                continue
            return f"value differs in {c}: spark={va!r} oracle={vb!r}\n  spark row={ra}\n  oracle row={rb}"
    return None

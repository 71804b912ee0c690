"""Preprocessing: header trim, label, required columns, cleaning, scaling.

The whole chain is one projection (no shuffle), fused by whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscore.constants import BENIGN_LABEL
from flowscore.functions import sqltext as ST
from flowscore.sources.bundle import EnsembleBundle


def q(name: str) -> Column:
    """Reference a column whose name may hold spaces or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def trim_columns(df: DataFrame) -> DataFrame:
    """Strip whitespace around column names; duplicates after the trim are an error."""
    names = [c.strip() for c in df.columns]
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise ValueError(f"column names collide after trimming: {dupes}")
    return df.toDF(*names)


def check_required(columns: Sequence[str], required: Sequence[str]) -> None:
    missing = [f for f in required if f not in columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}\nThe input must contain at least: {list(required)}")


def required_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per required feature: present in the input, and how many of its values
    are null / NaN / infinite (0 when absent). One aggregate, partial per task."""
    present = [f for f in required if f in df.columns]
    aggs = []
    for f in present:
        c = q(f).cast("double")
        aggs += [
            F.sum(F.when(c.isNull(), 1).otherwise(0)).cast("bigint").alias(f"n__{f}"),
            F.sum(F.when(F.isnan(c), 1).otherwise(0)).cast("bigint").alias(f"nan__{f}"),
            F.sum(F.when(F.abs(c) == F.lit(float("inf")), 1).otherwise(0)).cast("bigint").alias(f"inf__{f}"),
        ]
    aggs.append(F.count(F.lit(1)).alias("__rows"))
    counts = df.agg(*aggs)
    rows = []
    for f in required:
        if f in present:
            rows.append(F.struct(F.lit(f).alias("feature"), F.lit(True).alias("present"),
                                 F.coalesce(F.col(f"n__{f}"), F.lit(0)).alias("n_null"),
                                 F.coalesce(F.col(f"nan__{f}"), F.lit(0)).alias("n_nan"),
                                 F.coalesce(F.col(f"inf__{f}"), F.lit(0)).alias("n_inf")))
        else:
            rows.append(F.struct(F.lit(f).alias("feature"), F.lit(False).alias("present"),
                                 F.lit(0).cast("bigint").alias("n_null"), F.lit(0).cast("bigint").alias("n_nan"),
                                 F.lit(0).cast("bigint").alias("n_inf")))
    return counts.select(F.inline(F.array(*rows)))


def with_codes(df: DataFrame, bundle: EnsembleBundle) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with a code column per encoded feature whose vocabulary is a
    table, and the names of these columns by feature.

    The (value, code) table is read and measured: under the session's broadcast
    threshold it is broadcast and the rows stay where they are; above it both
    sides are shuffled on the value, plain exchanges that AQE splits where one
    value holds most rows. A value is looked up as text, a null one as "nan",
    and an unknown one gets code 0, as with a literal vocabulary."""
    spark, names = df.sparkSession, {}
    for f, vocabulary in sorted((bundle.encoders or {}).items()):
        if not isinstance(vocabulary, str) or f not in bundle.all_features or f not in df.columns:
            continue
        names[f] = f"__code_{len(names)}"
        df = encode_with_table(df, f, spark.read.parquet(vocabulary), names[f])
    return df, names


def encode_with_table(df: DataFrame, column: str, classes: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``, the code of a column's value in a (value, code) table; see ``with_codes``."""
    from flowscore.operators.routing import broadcast_limit
    table = classes.select(F.col("value").alias("__enc_value"), F.col("code").alias("__enc_code"))
    size = table.agg(F.sum(F.octet_length("__enc_value") + F.lit(64))).first()[0] or 0
    text = F.coalesce(q(column).cast("string"), F.lit("nan"))
    joined = df.join(F.broadcast(table) if size <= broadcast_limit(df.sparkSession) else table, text == F.col("__enc_value"), "left")
    return joined.withColumn(out, F.coalesce(F.col("__enc_code"), F.lit(0)).cast("int")).drop("__enc_value", "__enc_code")


def feature_sql(sources: Mapping[str, str], bundle: EnsembleBundle, codes: Mapping[str, str] = {}) -> dict[str, str]:  # noqa: B006
    """Cleaned feature expressions (SQL text) in sorted feature order.

    ``sources`` maps every input column name to the SQL text that reads it,
    ``codes`` encoded features to the code column that ``with_codes`` has added.
    Order: inf -> missing, categorical encoding, cast to double, missing -> 0,
    then scaling.
    """
    feats = bundle.all_features
    check_required(list(sources), feats)
    encoders = bundle.encoders or {}
    scaler = bundle.scaler or {}
    out = {}
    for f in feats:
        x = sources[f]
        if f in codes:
            x = ST.ident(codes[f])
        elif f in encoders:
            x = ST.encode(x, encoders[f])
        else:
            x = ST.clean_inf(x)
        x = ST.fill_missing(ST.to_feature(x))
        if f in scaler:
            mean, scale = scaler[f]
            x = ST.standard_scale(x, mean, scale)
        out[f] = x
    return out


def label_sql(df: DataFrame, label_col: str | None, benign_label: str = BENIGN_LABEL,
              source: str | None = None) -> str | None:
    """y as SQL text, or None when there is no label column.

    Text labels are binarised against ``benign_label``; numeric labels are
    truncated to int (the type decides, at plan time).
    """
    if not label_col or label_col not in df.columns:
        return None
    src = ST.ident(label_col) if source is None else source
    if isinstance(df.schema[label_col].dataType, T.StringType):
        return ST.binarize_label(src, benign_label)
    return ST.numeric_label(src)


def preprocess(df: DataFrame, bundle: EnsembleBundle, label_col: str | None = None,
               benign_label: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(X, y) as one table: ``keep`` columns, ``y`` (if labelled) and the
    features in sorted order, cleaned and scaled. One projection."""
    df = trim_columns(df)
    label_col = bundle.label_col if label_col is None else label_col
    benign_label = bundle.benign_label if benign_label is None else benign_label
    y = label_sql(df, label_col, benign_label)
    sources = {c: ST.ident(c) for c in df.columns if c != label_col}
    df, codes = with_codes(df, bundle)
    feats = feature_sql(sources, bundle, codes)
    cols = [ST.ident(k) for k in keep]
    if y is not None:
        cols.append(f"{y} AS y")
    cols += [f"{x} AS {ST.ident(f)}" for f, x in feats.items()]
    return df.selectExpr(*cols)

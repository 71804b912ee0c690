"""Defensive mode with early exit, and the cascade survivor table.

Member k only matters for rows no earlier member flagged. Expression members
and Spark ML members sit in CASE branches, which generated code evaluates
only when every earlier member voted benign: that is the early exit. A forest
member's UDF gets the open rows as a mask and routes only those. The answer
equals the any-member vote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.functions.voting import member_vote
from flowscore.sources.bundle import EnsembleBundle


def early_exit(x: DataFrame, bundle: EnsembleBundle) -> DataFrame:
    """``x`` holds the cleaned features by name. Adds ``exit_stage`` (1-based
    position of the first member that flags the row, null if none),
    ``exit_member`` and ``pred_binary``."""
    from flowscore.operators.extra_trees import forest_probability, load_forest
    from flowscore.operators.members import add_ml_probabilities
    names = bundle.fdm.members
    out, chain = x, None  # chain: the CASE of the members since the last UDF

    def settled(df, case):
        return df if case is None else df.withColumn("exit_stage", case.cast("int"))

    for i, n in enumerate(names):
        m = bundle.member(n)
        if m.expr is not None:
            p = F.expr(m.expr).cast("double")
        else:
            out, chain = settled(out, chain), None
            if m.model_path is not None:
                out, p = add_ml_probabilities(out, bundle, [n]), F.col(f"_mlp_{n}")
            else:
                still = F.col("exit_stage").isNull() if i else None
                p = forest_probability(load_forest(out.sparkSession, m.forest_path), only=still)
        if chain is None and "exit_stage" in out.columns:
            chain = F.when(F.col("exit_stage").isNotNull(), F.col("exit_stage"))
        vote = member_vote(p) == 1
        chain = F.when(vote, F.lit(i + 1)) if chain is None else chain.when(vote, F.lit(i + 1))
    out = settled(out, chain).drop(*[f"_mlp_{n}" for n in names])
    member = F
    for i, n in enumerate(names):
        member = member.when(F.col("exit_stage") == i + 1, F.lit(n))
    return out.withColumns({
        "exit_member": member,
        "pred_binary": F.col("exit_stage").isNotNull().cast("int"),
    })


def cascade_table(ee: DataFrame, bundle: EnsembleBundle) -> DataFrame:
    """(stage, member, evaluated, flagged): rows still benign when member k
    runs, and how many it flags. One aggregate with a row of counts (bounded
    by the member count), then arithmetic over that single row."""
    names = bundle.fdm.members
    agg = ee.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(F.col("exit_stage") == i + 1).alias(f"f{i + 1}") for i in range(len(names))])
    rows = []
    for i, n in enumerate(names):
        before = F.lit(0).cast("bigint")
        for j in range(i):
            before = before + F.col(f"f{j + 1}")
        rows.append(F.struct(F.lit(i + 1).alias("stage"), F.lit(n).alias("member"),
                             (F.col("n") - before).alias("evaluated"), F.col(f"f{i + 1}").alias("flagged")))
    return agg.select(F.inline(F.array(*rows)))

"""Connected components of a table of links, by minimal labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.llm.common import written


def components(links: DataFrame, name: str = "links", rounds: int | None = None) -> DataFrame:
    """(id, comp) of every linked id; comp is the smallest id of its component.

    ``links`` has long columns a, b. Every round an id takes the smallest label
    among its neighbours, its own label's label, and the ids labelled with it;
    the last two act as shortcuts, so long chains shrink fast. A round is one
    join with the written labels (a hub's rows can be split) and one grouped
    minimum (partial aggregation); it ends when no label changes, told by a
    checksum. With ``rounds`` it stops early: equal labels then still mean one
    component, but one component may have several labels.
    """
    edges = links.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), name)
    labels = written(edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("comp")).withColumnRenamed("u", "id"), name)
    before, done = None, 0
    while rounds is None or done < rounds:
        ways = edges.unionByName(labels.select(F.col("id").alias("u"), F.col("comp").alias("v"))).unionByName(
            labels.filter("id <> comp").select(F.col("comp").alias("u"), F.col("id").alias("v")))
        labels = written(ways.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("comp").alias("comp")).withColumnRenamed(
            "u", "id"), name)
        done += 1
        if rounds is None:
            now = labels.agg(F.sum(F.xxhash64("id", "comp").cast("decimal(38,0)"))).first()[0]
            if now == before:
                break
            before = now
    return labels

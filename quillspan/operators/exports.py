"""Exports: a graph as nodes and links, events on a time line, places on a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """kind ('node', 'link'), id, record: JSON of every node (with its degree, and label where labels(node, label) has one) and of every edge."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    nodes = ends.groupBy("node").agg(F.count("*").alias("degree"))
    nodes = nodes.join(labels.select("node", "label"), "node", "left") if labels is not None else nodes.withColumn("label", F.lit(None).cast("string"))
    node = nodes.select(F.lit("node").alias("kind"), F.col("node").alias("id"), F.to_json(F.struct("node", "label", "degree")).alias("record"))
    link = edges.select(F.lit("link").alias("kind"), F.concat_ws(">", "src", "edge_type", "dst").alias("id"), F.to_json(F.struct("src", "dst", "edge_type", "confidence")).alias("record"))
    return node.union(link)


def timeline(events: DataFrame, when: str, what: str, unit: str = "day") -> DataFrame:
    """period, what, n, first, last: events of each kind in each period."""
    return events.groupBy(F.date_trunc(unit, when).alias("period"), what).agg(F.count("*").alias("n"), F.min(when).alias("first"), F.max(when).alias("last"))


def places(records: DataFrame, place: str, *detail: str) -> DataFrame:
    """place, n and the number of different values of each detail column; rows without a place are left out."""
    counts = [F.count_distinct(d).alias(f"n_{d}") for d in detail]
    return records.filter(F.col(place).isNotNull()).groupBy(F.col(place).alias("place")).agg(F.count("*").alias("n"), *counts)

"""Connected components of a graph given as edges, by alternating large-star and small-star
steps. Every step is a grouped minimum and a join, so a node with a third of all edges is
pre-aggregated and its join side split; the edges of each step are a written table, and those of
the step before it go. No edges give no nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import dropped, written_at


def _stars(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least node among it and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long); the component is its least node."""
    now, path = written_at(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (state["n"], state["h"]) or not state["n"]:
            break
        mark = (state["n"], state["h"])
        done = path
        now, path = written_at(_small(_stars(now)), "edges")
        dropped(edges.sparkSession, done)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

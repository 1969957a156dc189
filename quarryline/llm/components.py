"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``label``, the least id reachable, of every id in ``links`` (a, b).

    Alternates two steps on the edges: every node links its larger neighbours
    to its least one, then its smaller neighbours.  Each step keeps the
    components, and logarithmically many rounds lead to stars whose centre is
    the least of its component, which is when no node has two edges down or
    edges both up and down.  A node's neighbours are never collected, only
    their least one is.  Null ends are ignored; no links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = save(edges, "edges", light=True)
    while True:
        ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down + up > 1").isEmpty():
            break
        # large step: for each node, its larger neighbours go to the least of it and its neighbours
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least", light=True)
        large = save(edges.join(least, edges.b == least.n).select(edges.a.alias("a"), F.col("m").alias("b")), "large", light=True)
        # small step: of each node's smaller neighbours all go to the least
        low = save(large.groupBy("a").agg(F.min("b").alias("m")), "low", light=True)
        pair = lambda x: F.struct(F.col(x).alias("a"), F.col("m").alias("b"))
        small = large.join(low, "a").select(F.explode(F.array(pair("a"), pair("b"))).alias("e")).select("e.*")
        edges = save(small.where("a <> b").distinct(), "edges", light=True)
    labels = edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels.unionAll(labels.select(F.col("label").alias("id"), "label").distinct())

"""Clusters of rules that are one detection: keys, provenance, election, inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, rules as R

#: Kinds of provenance that mean the same logic.
FOLDING = ("derived", "renamed")


def related_edges(rules: DataFrame, related: DataFrame) -> DataFrame:
    """src, tgt: rules and those whose native key they name as what they derive from or were renamed from."""
    named = related.where(F.lower(F.btrim("rel_type", F.lit(" \t\n\r"))).isin(*FOLDING)).select(F.col("rule_id").alias("src"), F.col("related_key").alias("native_key"))
    own = rules.select("native_key", F.col("rule_id").alias("tgt"))
    known = rules.select(F.col("rule_id").alias("src"))
    return named.join(own, "native_key").where("src <> tgt").join(known, "src", "left_semi").select("src", "tgt")


def key_edges(rules: DataFrame) -> DataFrame:
    """src, tgt: rules with one key, each with the least of them; a rule without a key goes by its content, else by itself."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    key = F.coalesce(blank("dedup_key"), F.concat(F.lit("raw:"), F.coalesce(blank("content_hash"), F.col("rule_id").cast("string"))))
    keyed = rules.select("rule_id", key.alias("key"))
    first = keyed.groupBy("key").agg(F.min("rule_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(first, "key").where("rule_id <> first").select(F.col("rule_id").alias("src"), F.col("first").alias("tgt"))


def clustered(rules: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """rule_id, cluster (the least rule_id reachable); a rule without an edge is its own cluster."""
    labels = graph.least_labels(edges, folder).withColumnRenamed("node", "rule_id")
    return rules.select("rule_id").join(labels, "rule_id", "left").select("rule_id", F.coalesce("component", "rule_id").alias("cluster"))


def inherited(tags: DataFrame, members: DataFrame) -> DataFrame:
    """rule_id, technique: what other members (rule_id, cluster, is_canonical) carry and the cluster's canonical rule doesn't."""
    winner = members.where("is_canonical").select("cluster", F.col("rule_id").alias("winner"))
    carried = tags.join(members.where("not is_canonical").select("rule_id", "cluster"), "rule_id").select("cluster", "technique").distinct()
    gained = carried.join(winner, "cluster").select(F.col("winner").alias("rule_id"), "technique")
    return gained.join(tags.select("rule_id", "technique"), ["rule_id", "technique"], "left_anti")


def folded(rules: DataFrame, related: DataFrame, folder: str) -> DataFrame:
    """rules with cluster and is_canonical, by keys and provenance; the first by priority, corpus and id stays."""
    edges = key_edges(rules).unionAll(related_edges(rules, related))
    return R.elected(rules.join(clustered(rules, edges, folder), "rule_id"), "cluster", "priority")


def summary(members: DataFrame, by_key: DataFrame, edges: DataFrame, gained: DataFrame) -> DataFrame:
    """One row: total, clusters, canonical, duplicates, provenance_edges, merged_by_provenance, techniques_propagated."""
    out = members.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("cluster").alias("clusters"), F.count_if("is_canonical").alias("canonical"))
    more = (by_key.agg(F.countDistinct("cluster").alias("before")), edges.agg(F.count(F.lit(1)).alias("provenance_edges")), gained.agg(F.count(F.lit(1)).alias("techniques_propagated")))
    for one in more:  # a row each
        out = out.crossJoin(F.broadcast(one))
    return out.select("total", "clusters", "canonical", (F.col("total") - F.col("canonical")).alias("duplicates"), "provenance_edges", (F.col("before") - F.col("clusters")).alias("merged_by_provenance"), "techniques_propagated")

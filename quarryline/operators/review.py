"""Review of what was extracted: gates, accepted sets, patterns, observables, censuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Object types whose pattern is type:property = 'value'.
PATTERN_PROPERTY = {
    "ipv4-addr": "value", "ipv6-addr": "value", "domain-name": "value", "url": "value", "email-addr": "value", "mac-addr": "value",
    "windows-registry-key": "key", "mutex": "name", "user-account": "user_id",
}


def visible(accepted: Column) -> Column:
    """Pending (null) and accepted rows."""
    return F.coalesce(accepted, F.lit(True))


def auto_accepted(accepted: Column, label: Column, confidence: Column, least: int = 90) -> Column:
    """Pending edges that need no review: observed, or sure enough and neither gap nor inferred."""
    sure = (F.round(confidence * 100) >= least) & ~F.coalesce(label, F.lit("")).isin("gap", "inferred")
    return accepted.isNull() & ((F.coalesce(label, F.lit("")) == "observed") | F.coalesce(sure, F.lit(False)))


def stix_pattern(kind: Column, value: Column) -> Column:
    """[type:property = 'value'] with backslash and quote escaped; numbers of autonomous systems bare; else null."""
    safe = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    prop = F.create_map(*[F.lit(x) for pair in PATTERN_PROPERTY.items() for x in pair])[kind]
    number = F.regexp_extract(F.upper(value), r"^(?:AS)?\s*(\d+)\s*$", 1)
    size = F.length(value)
    algorithm = F.when(size == 64, "'SHA-256'").when(size == 40, "'SHA-1'").when(size == 32, "MD5")
    return (
        F.when((kind == "autonomous-system") & (number != ""), F.concat(F.lit("[autonomous-system:number = "), number, F.lit("]")))
        .when((kind == "hash") & algorithm.isNotNull(), F.concat(F.lit("[file:hashes."), algorithm, F.lit(" = '"), safe, F.lit("']")))
        .when((kind == "file") & (F.btrim(value) != ""), F.concat(F.lit("[file:name = '"), F.btrim(safe), F.lit("']")))
        .when(prop.isNotNull(), F.concat(F.lit("["), kind, F.lit(":"), prop, F.lit(" = '"), safe, F.lit("']")))
    )


def observables(rows: DataFrame, key: str, kind: str = "kind", value: str = "value", least: int = 4) -> DataFrame:
    """key, class, value: what a rule could match of each entity, lower-cased and distinct.

    A URL also gives its host, an email its domain, a file its base name; values
    shorter than ``least`` and null ones go.
    """
    k, v = F.col(kind), F.lower(F.col(value))
    pair = lambda c, x: F.struct(F.lit(c).alias("class"), x.alias("value"))
    base = F.regexp_extract(v, r"([^\\/]*)$", 1)
    each = (
        F.when(k == "url", F.array(pair("url", v), pair("domain", T.url_host(v)))).when(k == "email", F.array(pair("email", v), pair("domain", F.substring_index(v, "@", -1))))
        .when(k == "file", F.array(pair("path", v), pair("file", base))).otherwise(F.array(F.struct(k.alias("class"), v.alias("value"))))
    )
    return rows.select(key, F.explode(each).alias("e")).select(key, "e.class", "e.value").where(F.length("value") >= least).distinct()


def ambiguous_aliases(names: DataFrame, surface: str, ident: str) -> DataFrame:
    """surface, ident: the only id of each lower-cased surface form, null where several share it."""
    found = names.groupBy(F.lower(F.btrim(surface)).alias("surface")).agg(F.min(ident).alias("lo"), F.max(ident).alias("hi"))
    return found.select("surface", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias(ident))


def resolved(edges: DataFrame, nodes: DataFrame, value: str, ident: str) -> DataFrame:
    """Edges (src, verb, tgt by value) with the ids of both ends; src_id or tgt_id is null where none fits."""
    by = nodes.groupBy(F.lower(value).alias("_v")).agg(F.min(ident).alias("_id"))
    src, tgt = by.select(F.col("_v").alias("_s"), F.col("_id").alias("src_id")), by.select(F.col("_v").alias("_t"), F.col("_id").alias("tgt_id"))
    return edges.join(src, F.lower("src") == F.col("_s"), "left").join(tgt, F.lower("tgt") == F.col("_t"), "left").drop("_s", "_t")


def census(rows: DataFrame, value: str, missing: str) -> DataFrame:
    """value, n; rows without a value count under ``missing``."""
    return rows.groupBy(F.coalesce(value, F.lit(missing)).alias(value)).agg(F.count(F.lit(1)).alias("n"))


def platform(votes: DataFrame, key: str, display: str, hint: str) -> DataFrame:
    """key, platform: one vote for each display and hint; the leader needs two votes and twice the second's, else multi."""
    counted = votes.select(key, F.when(F.col(hint).isNotNull(), F.col(display)).alias("d"), F.col(hint).alias("h")).distinct().groupBy(key, "h").agg(F.count("d").alias("n"))
    order = F.sort_array(F.collect_list(F.when(F.col("h").isNotNull(), F.struct(F.col("n"), F.col("h")))), asc=False)
    rows = counted.groupBy(key).agg(order.alias("o"))
    first, second = F.get("o", F.lit(0)), F.coalesce(F.get("o", F.lit(1))["n"], F.lit(0))
    return rows.select(key, F.when(F.size("o") == 0, "").when((first["n"] >= 2) & (first["n"] >= 2 * second), first["h"]).otherwise("multi").alias("platform"))


def around(rows: DataFrame, key: str, order: str, text: str, n: int) -> DataFrame:
    """Each row with the texts of n rows before and after it, joined by blanks."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, n)
    return rows.withColumn("around", F.array_join(F.collect_list(text).over(w), " "))


def chunk_size(chars: Column) -> Column:
    """Characters of a chunk for a text of this length."""
    return F.when(chars > 60000, 5000).when(chars > 30000, 4000).otherwise(3000)


def selection(rows: DataFrame, scope: str, excluded: DataFrame, ident: str, size: str) -> DataFrame:
    """scope, state (all, some, none), selected, bytes: what is left of each scope after exclusions."""
    out = excluded.select(F.col(ident), F.lit(True).alias("_out")).distinct()
    rows = rows.join(out, ident, "left").withColumn("_in", F.col("_out").isNull())
    sums = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("n"), F.count_if("_in").alias("selected"), F.coalesce(F.sum(F.when(F.col("_in"), F.col(size))), F.lit(0)).alias("bytes"))
    return sums.select(scope, F.when(F.col("selected") == F.col("n"), "all").when(F.col("selected") == 0, "none").otherwise("some").alias("state"), "selected", "bytes")


def bulk(rows: DataFrame, kind: str, action: str, scope: str = "pending") -> DataFrame:
    """Entities with ``accepted`` set for one type: accept, reject or reset, of pending rows or all."""
    if action not in ("accept", "reject", "reset") or scope not in ("pending", "all") or (action, scope) == ("reset", "pending"):
        raise ValueError(f"no such update: {action} of {scope}")
    to = {"accept": F.lit(True), "reject": F.lit(False), "reset": F.lit(None).cast("boolean")}[action]
    hit = F.col("entity_type") == kind
    if scope == "pending":
        hit &= F.col("accepted").isNull()
    return rows.withColumn("accepted", F.when(hit, to).otherwise(F.col("accepted")))


def unrejected(rows: DataFrame, entities: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Rows (report, name, id) whose name or id no rejected entity (report, entity_type, value, mitre_id, accepted) of these types has."""
    gone = entities.where(F.col("entity_type").isin(*kinds) & ~F.coalesce("accepted", F.lit(True)))
    names = gone.select("report", F.lower(F.btrim("value")).alias("_v")).distinct()
    ids = gone.select("report", F.lower(F.btrim("mitre_id")).alias("_v")).where("_v <> ''").distinct()
    rows = rows.withColumn("_v", F.lower(F.btrim("name"))).join(names, ["report", "_v"], "left_anti")
    return rows.withColumn("_v", F.lower(F.btrim("id"))).join(ids, ["report", "_v"], "left_anti").drop("_v")


def uncovered(raw: DataFrame, resolved_ids: DataFrame) -> DataFrame:
    """Raw techniques (report, id) that neither a resolved one (report, id) nor a sub-technique of theirs covers."""
    ids = resolved_ids.select("report", F.upper("id").alias("_i"))
    cover = ids.unionAll(ids.where("contains(_i, '.')").select("report", F.substring_index("_i", ".", 1))).distinct()
    return raw.withColumn("_i", F.upper("id")).join(cover, ["report", "_i"], "left_anti").drop("_i")


def has_signals(chunks: DataFrame, names: DataFrame, least: int = 200) -> DataFrame:
    """chunks (report, chunk_no, chunk, entities) with ``signals``: long enough, and with an entity or a name (report, value) of its report in it."""
    low = chunks.select("report", "chunk_no", F.lower("chunk").alias("_c"))
    held = low.join(names.select("report", F.lower("value").alias("_v")).distinct(), "report").where(F.contains("_c", "_v")).select("report", "chunk_no", F.lit(True).alias("_named")).distinct()
    rows = chunks.join(held, ["report", "chunk_no"], "left")
    long = F.length(F.regexp_replace("chunk", r"^\s+|\s+$", "")) >= least
    return rows.withColumn("signals", long & ((F.col("entities") > 0) | F.col("_named").isNotNull())).drop("_named")


def sure_techniques(rows: DataFrame, least: float = 0.55, most: int = 5) -> DataFrame:
    """report, techniques: the ``most`` surest techniques (report, name, id, confidence), as one line."""
    place = F.row_number().over(Window.partitionBy("report").orderBy(F.desc("confidence"), "id"))
    top = rows.where((F.col("confidence") >= least) & (F.coalesce("id", F.lit("")) != "")).withColumn("_n", place).where(F.col("_n") <= most)
    text = F.concat("name", F.lit(" ("), "id", F.lit(")"))
    one = F.sort_array(F.collect_list(F.struct("_n", text.alias("t"))))
    return top.groupBy("report").agg(one.alias("l")).select("report", F.array_join(F.transform("l", lambda x: x.t), ", ").alias("techniques"))


def prompt_indicators(rows: DataFrame, most: int = 30) -> DataFrame:
    """report, kind, value, omitted: the first ``most`` indicators (report, kind, value, pos) by kind and place, and how many aren't shown."""
    whole = Window.partitionBy("report")
    ranked = rows.withColumn("_n", F.row_number().over(whole.orderBy("kind", "pos"))).withColumn("_all", F.count(F.lit(1)).over(whole))
    return ranked.where(F.col("_n") <= most).select("report", "kind", "value", F.greatest(F.lit(0), F.col("_all") - most).alias("omitted"))

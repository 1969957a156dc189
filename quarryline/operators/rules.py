"""The rule store: joins, document frequencies, coverage, facets, export, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import few, save

FORMATS = ("sigma", "suricata", "yara")


def canonical_only(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of canonical rules, as a semi-join."""
    return rows.join(rules.where("is_canonical").select("rule_id"), "rule_id", "left_semi")


def document_frequency(rows: DataFrame, value: str) -> DataFrame:
    """Distinct rules of each value."""
    return rows.select(value, "rule_id").distinct().groupBy(value).agg(F.count(F.lit(1)).alias("df"))


def rolled_up(tags: DataFrame, tag: str, parent: str) -> DataFrame:
    """A row for each tag's own id and its parent; a tag that is both counts as exact."""
    each = F.explode(F.array_distinct(F.array(F.struct(F.col(tag).alias("covers"), F.lit(False).alias("by_parent")), F.struct(F.col(parent).alias("covers"), F.lit(True).alias("by_parent")))))
    rows = tags.select("*", each.alias("e")).select(*tags.columns, "e.covers", "e.by_parent")
    return rows.groupBy(*tags.columns, "covers").agg(F.min("by_parent").alias("by_parent")).where("covers is not null")


def coverage(refs: DataFrame, telemetry: Column | None = None) -> DataFrame:
    """technique, score, rule_count, corpora of refs (technique, native_key, corpus).

    A native key belongs to its first corpus; two owners score 3, one 2,
    telemetry alone 1, nothing 0.
    """
    owner = refs.groupBy("native_key").agg(F.min("corpus").alias("owner"))
    rows = refs.select("technique", "native_key").distinct().join(owner, "native_key")
    out = rows.groupBy("technique").agg(F.count(F.lit(1)).alias("rule_count"), F.sort_array(F.collect_set("owner")).alias("corpora"))
    n = F.size("corpora")
    return out.select("technique", F.when(n >= 2, 3).when(n == 1, 2).when(F.lit(False) if telemetry is None else telemetry, 1).otherwise(0).alias("score"), "rule_count", "corpora")


def _owned(name: str) -> str:
    """Of ``refs`` (corpus, format, mask), each name in order (none: last) with the reports, as bits, that hold no earlier one."""
    order = f"array_sort(refs, (x, y) -> case when x.{name} <=> y.{name} then 0 when x.{name} is null then 1 when y.{name} is null then -1 when x.{name} < y.{name} then -1 else 1 end)"
    return f"""aggregate({order}, named_struct('seen', 0L, 'out', cast(array() as array<struct<name: string, mask: bigint>>)), (a, x) -> named_struct('seen', a.seen | x.mask,
      'out', if((x.mask & ~a.seen) = 0, a.out, array_append(a.out, named_struct('name', x.{name}, 'mask', x.mask & ~a.seen)))), a -> a.out)"""


def coverage_of(wanted: DataFrame, refs: DataFrame, telemetry: DataFrame | None = None) -> DataFrame:
    """technique, score, rule_count, corpora, formats of every wanted technique (report, technique), by report.

    refs: technique (a rule's tag), corpus, native_key, format.  A tag also covers
    the sub-techniques of what it names.  A native key belongs to its first corpus
    among a report's refs; two owners score 3, one 2, telemetry (technique) alone
    1, nothing 0.  ``formats`` has rule_count and corpora for each format.

    Reports are bits of a number, 64 to a block: a row stands for all reports of
    a block that hold a ref, so no table has a row for each report and key.
    """
    asked = wanted.select("report", F.upper("technique").alias("technique")).where("technique <> ''").distinct()
    asked = asked.withColumn("parent", F.when(F.contains("technique", F.lit(".")), F.substring_index("technique", ".", 1)))
    asked = save(asked, "asked", light=True)
    reports = asked.select("report").distinct().withColumn("no", F.row_number().over(Window.orderBy("report")) - 1)
    reports = few(reports.select("report", F.expr("no div 64").alias("block"), F.expr("shiftleft(1L, cast(no % 64 as int))").alias("bit")), "reports")
    covers = few(rolled_up(asked.select("technique", "parent").distinct(), "technique", "parent").select("technique", F.col("covers").alias("tag")), "covers")
    by_technique = asked.join(reports, "report").groupBy("technique", "block").agg(F.bit_or("bit").alias("asked"))
    by_tag = few(by_technique.join(covers, "technique").groupBy("tag", "block").agg(F.bit_or("asked").alias("mask")), "tags")
    rows = refs.where("native_key is not null").select(F.upper("technique").alias("tag"), "corpus", "native_key", "format")
    rows = save(rows.join(by_tag, "tag", "left_semi"), "refs")
    held = rows.join(by_tag, "tag").groupBy("block", "native_key", "corpus", "format").agg(F.bit_or("mask").alias("mask"))
    owned = held.groupBy("block", "native_key").agg(F.collect_list(F.struct("corpus", "format", "mask")).alias("refs")).select("block", "native_key", F.expr(_owned("corpus")).alias("owners"), F.expr(_owned("format")).alias("formats"))
    both = "flatten(transform(owners, o -> transform(formats, f -> named_struct('owner', o.name, 'format', f.name, 'mask', o.mask & f.mask))))"
    owned = owned.select("block", "native_key", F.explode(F.expr(both)).alias("o")).select("block", "native_key", "o.*").where("mask <> 0")
    keys = rows.join(covers, "tag").select("native_key", "technique").repartition("native_key").distinct()
    cells = keys.join(owned, "native_key").join(few(by_technique, "techniques"), ["technique", "block"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("asked"))).where("mask <> 0")
    cells = cells.groupBy("block", "technique", "owner", "format", "mask").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.join(reports, "block").where("(mask & bit) <> 0").groupBy("report", "technique", "owner", "format").agg(F.sum("n").alias("n"))
    of = lambda f: F.coalesce(F.sum(F.when(F.col("format") == f, F.col("n"))), F.lit(0))
    each = [F.struct(F.lit(f).alias("format"), of(f).alias("rule_count"), F.sort_array(F.collect_set(F.when(F.col("format") == f, F.col("owner")))).alias("corpora")) for f in FORMATS]
    found = cells.groupBy("report", "technique").agg(F.sum("n").alias("rule_count"), F.sort_array(F.collect_set("owner")).alias("corpora"), F.array(*each).alias("formats"))
    none = F.array(*[F.struct(F.lit(f).alias("format"), F.lit(0).cast("long").alias("rule_count"), F.array().cast("array<string>").alias("corpora")) for f in FORMATS])
    out = asked.select("report", "technique").join(found, ["report", "technique"], "left")
    known = (asked.select("technique").limit(0) if telemetry is None else telemetry.select(F.upper("technique").alias("technique"))).distinct().withColumn("seen", F.lit(True))
    out = out.join(known, "technique", "left")
    n = F.coalesce(F.size("corpora"), F.lit(0))
    score = F.when(n >= 2, 3).when(n == 1, 2).when(F.coalesce("seen", F.lit(False)), 1).otherwise(0)
    return out.select("report", "technique", score.alias("score"), F.coalesce("rule_count", F.lit(0)).alias("rule_count"), F.coalesce("corpora", F.array().cast("array<string>")).alias("corpora"), F.coalesce("formats", none).alias("formats"))


def axis(col: Column, blank: str = "unknown") -> Column:
    return F.lower(F.coalesce(F.nullif(F.btrim(col), F.lit("")), F.lit(blank)))


def grouped(rows: DataFrame, body: str) -> DataFrame:
    """technique, n_rules, rules (rule_id, corpus, title, format in order), with_bodies, rank: most rules first.

    ``body`` says whether a rule's body is asked for; a list in one row is one
    technique's, as a reader of the store's pages gets it.
    """
    one = F.sort_array(F.collect_list(F.struct("corpus", "title", "rule_id", "format")))
    out = rows.groupBy("technique").agg(F.count(F.lit(1)).alias("n_rules"), one.alias("rules"), F.count_if(body).alias("with_bodies"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_rules"), "technique")))


def facets(rules: DataFrame, axes: tuple[str, ...], size: str) -> DataFrame:
    """axis, value, rules, chars: all axes by one scan."""
    clean = rules.select(*[axis(F.col(a)).alias(a) for a in axes], F.col(size).alias("chars"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes]))
    return clean.select(each.alias("e"), "chars").groupBy("e.axis", "e.value").agg(F.count(F.lit(1)).alias("rules"), F.sum("chars").alias("chars"))


def elected(rules: DataFrame, cluster: str, priority: str) -> DataFrame:
    """Rules with is_canonical: first of the cluster by priority (none: 1000), corpus and id."""
    order = Window.partitionBy(cluster).orderBy(F.coalesce(F.col(priority), F.lit(1000)), "corpus", "rule_id")
    return rules.withColumn("is_canonical", F.row_number().over(order) == 1)


def manifest(rules: DataFrame) -> DataFrame:
    """Path of each exported rule; a number tells apart those that would share one."""
    ext = F.create_map(*[F.lit(x) for p in (("sigma", "yml"), ("suricata", "rules"), ("yara", "yar")) for x in p])
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.col("title"), r"[^A-Za-z0-9_\-]+", "_"), "^_+|_+$", ""), 1, 80)
    base = F.concat(F.lit("rules/"), "format", F.lit("/"), "corpus", F.lit("__"), slug)
    rows = rules.withColumn("base", base).withColumn("rn", F.row_number().over(Window.partitionBy("base").orderBy("rule_id")))
    suffix = F.when(F.col("rn") > 1, F.concat(F.lit("_"), F.col("rn").cast("string"))).otherwise("")
    return rows.select("rule_id", F.concat("base", suffix, F.lit("."), F.coalesce(ext[F.col("format")], F.lit("txt"))).alias("path"))


def technique_weights(tags: DataFrame, df: DataFrame, total: int) -> DataFrame:
    """rule_id, weight: 0.30 x the largest max(0.15, idf), 0.6 of it for a parent-only tag, over the root of the breadth."""
    breadth = tags.groupBy("rule_id").agg(F.countDistinct("technique").alias("breadth"))
    each = tags.join(df, "technique").withColumn("w", F.lit(0.30) * F.greatest(F.lit(0.15), T.idf(F.col("df"), F.lit(total))) * F.when(F.col("by_parent"), 0.6).otherwise(1.0))
    return each.groupBy("rule_id").agg(F.max("w").alias("w")).join(breadth, "rule_id").select("rule_id", (F.col("w") / F.sqrt("breadth")).alias("weight"))


def contained(atoms: DataFrame, needles: DataFrame, least: int = 8, share: float = 0.5) -> DataFrame:
    """atom, needle: pairs of which one holds the other, which has ``least`` characters and ``share`` of its length or more.

    The shorter one's first ``least`` characters are the key of an equi-join
    with all such pieces of the longer one.
    """
    a = atoms.select(F.col("atom").alias("value"), F.lit(True).alias("a"), F.lit(False).alias("n"))
    n = needles.select(F.col("needle").alias("value"), F.lit(False).alias("a"), F.lit(True).alias("n"))
    each = a.unionAll(n).where(F.length("value") >= least).groupBy("value").agg(F.max("a").alias("a"), F.max("n").alias("n"))
    pieces = F.expr(f"array_distinct(transform(sequence(1, length(value) - {least} + 1), i -> substring(value, i, {least})))")
    long = each.select(F.col("value").alias("long"), F.col("a").alias("long_a"), F.col("n").alias("long_n"), F.explode(pieces).alias("key"))
    short = each.select(F.col("value").alias("short"), F.col("a").alias("short_a"), F.col("n").alias("short_n"), F.substring("value", 1, least).alias("key"))
    fits = (F.col("long") != F.col("short")) & F.contains("long", "short") & (F.length("short") >= share * F.length("long"))
    both = short.join(long, "key").where(fits)
    found = both.where("long_a and short_n").select(F.col("long").alias("atom"), F.col("short").alias("needle"))
    return found.unionAll(both.where("short_a and long_n").select(F.col("short").alias("atom"), F.col("long").alias("needle")))

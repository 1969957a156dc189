"""The rule store as tables: registry, indexes from bundles, writers, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Verbs of curated edges; file suffixes that are read as text.
CURATED = ("uses", "attributed-to", "targets", "mitigates", "variant-of")
SUFFIXES = ("txt", "md", "html", "htm", "pdf", "docx")
_BUNDLE = "objects array<struct<id string, type string, name string, description string, aliases array<string>, revoked boolean, source_ref string, target_ref string, relationship_type string, external_references array<struct<source_name string, external_id string>>>>"


def registry(base: DataFrame, local: DataFrame) -> DataFrame:
    """Enabled corpora: those of ``local`` replace those of the same name in ``base`` (name, format, path, license, priority, enabled), field by field, and add to them."""
    fields = [c for c in base.columns if c != "name"]
    b = base.select("name", *[F.col(c).alias(f"_{c}") for c in fields])
    out = b.join(local, "name", "full").select("name", *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in fields])
    return out.where(F.coalesce("enabled", F.lit(True)))


def removed(base: DataFrame, local: DataFrame, name: str) -> DataFrame:
    """The local registry without a corpus; one that the base registry has is switched off instead."""
    rest = local.where(F.col("name") != name)
    off = base.where(F.col("name") == name).select("name", *[F.lit(None).cast(t).alias(c) if c != "enabled" else F.lit(False).alias(c) for c, t in base.dtypes if c != "name"])
    return rest.unionByName(off)


def bundle_objects(spark: SparkSession, path: str) -> DataFrame:
    """bundle and the fields of all objects of the bundles (JSON files) at a path."""
    rows = spark.read.schema(_BUNDLE).option("multiLine", "true").json(path)
    return rows.select(F.col("_metadata.file_name").alias("bundle"), F.explode("objects").alias("o")).select("bundle", "o.*")


def technique_index(objects: DataFrame) -> DataFrame:
    """id, name, description, parent of all attack patterns that aren't revoked; of several with one id that of the first bundle."""
    ident = F.upper(F.get("external_references", F.lit(0))["external_id"])
    rows = objects.where("type = 'attack-pattern' and not coalesce(revoked, false)").withColumn("ext", ident).where("ext is not null")
    first = F.row_number().over(Window.partitionBy("ext").orderBy("bundle", "id"))
    rows = rows.withColumn("_n", first).where("_n = 1")
    return rows.select(F.col("ext").alias("id"), "name", "description", F.when(F.contains("ext", F.lit(".")), F.substring_index("ext", ".", 1)).alias("parent"))


def curated_edges(objects: DataFrame) -> DataFrame:
    """src, verb, tgt by external ids of the relations (source_ref, relationship_type, target_ref) both of whose ends have one."""
    known = objects.select("id", F.get("external_references", F.lit(0))["external_id"].alias("ext")).where("ext is not null").distinct()
    rel = objects.where(F.col("relationship_type").isin(*CURATED)).select("source_ref", F.col("relationship_type").alias("verb"), "target_ref")
    src, tgt = known.select(F.col("id").alias("source_ref"), F.col("ext").alias("src")), known.select(F.col("id").alias("target_ref"), F.col("ext").alias("tgt"))
    return rel.join(src, "source_ref").join(tgt, "target_ref").where("src <> tgt").select("src", "verb", "tgt").distinct()


def stored(rules: DataFrame) -> DataFrame:
    """Rules (rule_id, corpus, pos, ...) as a store keeps them: the last of each id, with the size of its body."""
    last = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("pos")))
    return rules.withColumn("_n", last).where("_n = 1").drop("_n", "pos").withColumn("size", F.length("raw").cast("long"))


def stored_tags(rules: DataFrame) -> DataFrame:
    """rule_id, technique, upper-cased and once each."""
    return rules.select("rule_id", F.explode("techniques").alias("technique")).select("rule_id", F.upper("technique").alias("technique")).distinct()


def write_corpora(rules: DataFrame, path: str) -> None:
    """Replaces the corpora that ``rules`` has and leaves others as they are."""
    rules.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus").parquet(path)


def export_bundles(bundles: DataFrame, path: str) -> None:
    """Writes bundles (name, json, valid) as lines of text, valid ones apart from the others."""
    rows = bundles.select(F.col("json").alias("value"), F.when(F.coalesce("valid", F.lit(False)), "valid").otherwise("invalid").alias("state"))
    rows.write.mode("append").partitionBy("state").text(path)


def manifest_of(selected: DataFrame, rules: DataFrame) -> DataFrame:
    """clause, n: how many of all rules each clause of an export (rule_id, clause, holds) shuts out."""
    return rules.select("rule_id").join(selected, "rule_id").groupBy("clause").agg(F.count_if(~F.col("holds")).alias("n"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, text of files; text and HTML are decoded, for others (and for unknown suffixes, with ``error``) text is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    plain = F.make_valid_utf8(F.col("content").cast("string"))
    rows = files.select("path", suffix.alias("suffix"), F.when(suffix.isin("txt", "md", "html", "htm"), plain).alias("text"))
    return rows.withColumn("error", F.when(~F.col("suffix").isin(*SUFFIXES), F.concat(F.lit("unsupported file type: "), "suffix")).when(F.col("text").isNull(), F.lit("needs a parser")))


def scanned(pages: DataFrame, least: int = 50, first: int = 3) -> DataFrame:
    """path, scanned: whether the first pages (path, page_no, text) have less than ``least`` characters on average."""
    return pages.where(F.col("page_no") < first).groupBy("path").agg((F.avg(F.length(F.coalesce("text", F.lit("")))) < least).alias("scanned"))


def accepted_upload(files: DataFrame, most: int = 50 << 20) -> DataFrame:
    """files (suffix, mime, size, tlp, pap) with ``accepted``: known types, not too large, markings of the four levels."""
    mimes = {"pdf": "application/pdf", "html": "text/html", "htm": "text/html", "txt": "text/plain", "md": "text/markdown", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
    known = F.create_map(*[F.lit(x) for p in mimes.items() for x in p])[F.col("suffix")]
    level = lambda c: F.coalesce(F.lower(c), F.lit("clear")).isin("clear", "green", "amber", "red")
    return files.withColumn("accepted", F.coalesce((F.col("mime") == known) & (F.col("size") <= most) & level("tlp") & level("pap"), F.lit(False)))

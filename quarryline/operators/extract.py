"""Indicators, sentences and chunks of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: All kinds, in the order in which they are looked for.
KINDS = ("hash", "ipv4", "ipv6", "url", "email", "domain", "cve", "technique", "mac", "asn", "path", "filename", "registry")


def indicators(docs: DataFrame, kinds: tuple[str, ...] = ("hash", "ipv4", "email"), key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, kind, value once per text, with the place of its first match in the order of kinds.

    Values that differ in case only are one, written as first found.
    """
    def placed(n: int, kind: str) -> Column:
        first = F.lit(n << 32)
        return F.transform(T.found(F.col(col), kind), lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), (first + i).alias("place")))

    each = F.concat(*[placed(n, k) for n, k in enumerate(kinds)])
    rows = docs.select(key, F.explode(each).alias("e")).select(key, "e.*")
    first = rows.groupBy(key, "kind", F.lower("value").alias("low")).agg(F.min(F.struct("place", "value")).alias("first"))
    return first.select(key, "kind", "first.value", "first.place")


def sentence_table(docs: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(T.sentences(F.col(col))).alias("sent_no", "sentence"))


def strided(rows: DataFrame, key: str, order: str, most: int = 200) -> DataFrame:
    """Every step-th row of each key, where the step leaves about ``most``, and of those the first ``most``."""
    whole = Window.partitionBy(key)
    numbered = rows.withColumn("rn", F.row_number().over(whole.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(whole))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    return numbered.where((F.col("rn") % step == 0) & (F.col("rn") / step < most)).drop("rn", "n")


def chunks(docs: DataFrame, size: int = 3000, overlap: int = 400, key: str = "doc_id", col: str = "text") -> DataFrame:
    """key, chunk_no, chunk: paragraphs packed greedily, with the tail of the chunk before.

    Units are paragraphs if a text has three breaks between them at least, else
    lines if there are three newlines, else the text.  Units are trimmed, blank
    ones skipped; one longer than ``size`` is cut.  Separators don't count.
    """
    text = F.coalesce(F.col(col), F.lit(""))
    paragraphs, lines = F.split(text, "\n\n"), F.split(text, "\n")
    many = lambda parts: F.size(parts) > 3
    src = docs.select(key, F.when(many(paragraphs), paragraphs).when(many(lines), lines).otherwise(F.array(text)).alias("units"), F.when(many(paragraphs), F.lit("\n\n")).when(many(lines), F.lit("\n")).otherwise(F.lit("")).alias("sep"))
    src = src.withColumn("units", F.filter(F.transform("units", lambda x: F.btrim(x, F.lit(" \t\n\r"))), lambda x: x != ""))
    fold = f"""
      aggregate(units, named_struct('out', cast(array() as array<string>), 'cur', '', 'len', 0),
        (a, u) -> if(length(u) > {size},
          named_struct('out', concat(a.out, if(a.len > 0, array(a.cur), cast(array() as array<string>)),
              transform(sequence(0, cast(floor((length(u) - 1) / {size}) as int)), i -> substring(u, i * {size} + 1, {size}))), 'cur', '', 'len', 0),
          if(a.len + length(u) > {size} and a.len > 0,
            named_struct('out', array_append(a.out, a.cur), 'cur', u, 'len', length(u)),
            named_struct('out', a.out, 'cur', if(a.len > 0, concat(a.cur, sep, u), u), 'len', a.len + length(u)))),
        a -> if(a.len > 0, array_append(a.out, a.cur), a.out))"""  # fmt: skip
    rows = src.select(key, F.posexplode(F.expr(fold)).alias("chunk_no", "body"))
    before = F.lag("body").over(Window.partitionBy(key).orderBy("chunk_no"))
    rows = rows.withColumn("tail", F.coalesce(F.right(before, F.lit(overlap)), F.lit("")))
    rows = rows.withColumn("tail", F.expr("if(instr(tail, char(10)) > 0, substring(tail, instr(tail, char(10)) + 1), tail)"))
    return rows.select(key, "chunk_no", F.when(F.col("tail") == "", F.col("body")).otherwise(F.concat("tail", F.lit("\n\n"), "body")).alias("chunk"))

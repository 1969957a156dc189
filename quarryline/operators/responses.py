"""Answers of a language model: made into rows, repaired when cut off, checked against the text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Grades of evidence; others count as reported.
LABELS = ("observed", "reported", "assessed", "inferred", "gap")
#: Words that say nothing of a campaign.
CAMPAIGN_WORDS = ("campaign", "attack", "operation", "activity", "threat", "targeting", "based", "using", "group", "actor", "cluster", "intrusion")
#: Other keys that a field comes under.
KEYS = {"src": ("source_value", "source", "src"), "verb": ("relationship_type", "relationship", "type"), "tgt": ("target_value", "target", "tgt")}


def repaired(text: str | None) -> str | None:
    """A JSON text that was cut off, closed after its last whole item; null if there is none.

    Text before the first bracket is ignored, as are code fences.
    """
    begin = min((i for i in ((text or "").find("{"), (text or "").find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    body = text[begin:]
    try:
        return json.dumps(json.JSONDecoder().raw_decode(body)[0])
    except ValueError:
        pass
    stack: list[str] = []
    quoted = escaped = False
    cuts: list[tuple[int, str]] = []  # places after a whole value, and what closes there
    for i, c in enumerate(body):
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
            if quoted:
                continue
        elif c == '"':
            quoted = True
            continue
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                break
        elif c != ",":
            continue
        cuts.append((i + (c != ","), "".join(reversed(stack))))
    for at, close in reversed(cuts):
        try:
            return json.dumps(json.loads(body[:at] + close))
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    """``repaired`` of a column, for texts that don't parse."""
    return text.map(repaired)


def parsed(rows: DataFrame, col: str = "answer") -> DataFrame:
    """rows with ``json``, their answer as a variant; only those that don't parse are repaired."""
    whole = F.try_parse_json(F.regexp_replace(col, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    first = rows.withColumn("_v", whole).withColumn("_fixed", F.when(F.col("_v").isNull(), F.col(col)))
    good, bad = first.where("_v is not null"), first.where("_v is null")
    fixed = bad.withColumn("_v", F.try_parse_json(repaired_json(F.col("_fixed"))))
    return good.unionByName(fixed).withColumnRenamed("_v", "json").drop("_fixed")


def _field(item: str, names: tuple[str, ...]) -> str:
    """A text field under the first of its names that is there; of an object its name or value."""
    one = ", ".join(f"nullif(trim(coalesce(try_variant_get({item}, '$.{n}.name', 'string'), try_variant_get({item}, '$.{n}.value', 'string'), try_variant_get({item}, '$.{n}', 'string'))), '')" for n in names)
    return f"coalesce({one})"


def relations_of(rows: DataFrame) -> DataFrame:
    """The other columns and src, verb, tgt, confidence, label of the relations in ``json``; those without one of the three go."""
    items = rows.withColumn("_x", F.explode(F.expr("try_variant_get(json, '$.relationships', 'array<variant>')"))).drop("json")
    label = F.lower(F.expr("try_variant_get(_x, '$.evidence_label', 'string')"))
    sure = F.expr("coalesce(try_variant_get(_x, '$.confidence', 'double'), 0.5D)")
    out = items.select("*", *[F.expr(_field("_x", names)).alias(k) for k, names in KEYS.items()], F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"), F.when(label.isin(*LABELS), label).otherwise("reported").alias("label")).drop("_x")
    return out.where("src is not null and verb is not null and tgt is not null")


def verdicts(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """claims (report, n, ...) that a checking answer's ``json``, an array of {n, supported}, doesn't reject; a claim it leaves out stays."""
    items = rows.select("report", F.explode(F.expr("try_variant_get(json, '$', 'array<variant>')")).alias("_x"))
    n, ok = F.expr("try_variant_get(_x, '$.n', 'double')"), F.expr("try_variant_get(_x, '$.supported', 'boolean')")
    said = items.select("report", n.alias("_n"), ok.alias("_ok")).where("_n = floor(_n)").select("report", F.col("_n").cast("long").alias("n"), "_ok")
    no = said.where("not _ok").select("report", "n").distinct()
    return claims.join(no, ["report", "n"], "left_anti")


def in_text(name: Column, text: Column) -> Column:
    """Whether a name stands in a text: those under three letters always do, those up to five only as a word of their own."""
    low = F.lower(F.btrim(name))
    alone = F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<![a-z0-9])\Q"), low, F.lit(r"\E(?![a-z0-9])")))
    return F.when(F.length(F.coalesce(name, F.lit(""))) < 3, True).when(F.length(low) <= 5, alone).otherwise(F.contains(F.lower(text), low))


def nearly_in(name: str, text: str) -> bool:
    """``in_text``, or some stretch of the name's width alike by 92, 80 or 75 of 100 (for names up to 5, 9 and more letters).

    Alike is twice the longest common subsequence over both lengths.
    """
    low, body = name.lower().strip(), text.lower()
    width = len(low)
    need = (92 if width <= 5 else 80 if width <= 9 else 75) * width / 100
    for at in range(len(body) - width + 1):
        part, row = body[at : at + width], [0] * (width + 1)
        if len(set(low) & set(part)) * 4 < len(set(low)):
            continue
        for a in low:
            before = 0
            for j, b in enumerate(part, 1):
                before, row[j] = row[j], before + 1 if a == b else max(row[j], row[j - 1])
        if row[-1] >= need:
            return True
    return False


def kept_names(names: DataFrame, chunks: DataFrame, allowed: DataFrame) -> DataFrame:
    """names (report, chunk_no, kind, name) with ``kept``: known from elsewhere (report, value), or in their chunk's text or context.

    A campaign's name also is if one of its longer words that mean something is.
    """
    rows = names.join(chunks.select("report", "chunk_no", "text", "context"), ["report", "chunk_no"], "left").fillna("", ["text", "context"])
    sure = allowed.select("report", F.lower("value").alias("_low")).distinct().withColumn("_sure", F.lit(True))
    rows = rows.withColumn("_low", F.lower("name")).join(sure, ["report", "_low"], "left")
    both = F.concat("text", F.lit(" "), "context")
    words = F.filter(F.split("name", r"\s+"), lambda w: (F.length(w) >= 5) & ~F.regexp_replace(F.lower(w), r"[.,;:]+$", "").isin(*CAMPAIGN_WORDS))
    said = (F.col("kind") == "campaign") & F.exists(words, lambda w: in_text(w, both))
    kept = F.col("_sure").isNotNull() | in_text(F.col("name"), F.col("text")) | in_text(F.col("name"), F.col("context")) | said
    return rows.withColumn("kept", kept).select("report", "chunk_no", "kind", "name", "kept")


def without_lost_ends(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations (report, src, verb, tgt) neither of whose ends is a name that wasn't kept."""
    lost = names.where("not kept").select("report", F.lower("name").alias("_v")).distinct()
    for end in ("src", "tgt"):
        relations = relations.withColumn("_v", F.lower(end)).join(lost, ["report", "_v"], "left_anti").drop("_v")
    return relations

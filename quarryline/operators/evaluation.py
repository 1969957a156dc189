"""Measures of extraction and grounding against gold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _low(c: str) -> Column:
    return F.lower(F.btrim(c))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal values, 0.5 where one holds the other, else 0."""
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.5).otherwise(0.0)


def entity_scores(predicted: DataFrame, gold: DataFrame, partial: bool = True) -> DataFrame:
    """type, tp, fp, fn over rows (sample, type, value): each prediction's best gold value of its type and sample, and gold that none touches.

    A last row, ``overall``, has the sums.
    """
    p = predicted.select("sample", "type", _low("value").alias("p")).withColumn("pid", F.monotonically_increasing_id())
    g = gold.select("sample", "type", _low("value").alias("g")).withColumn("gid", F.monotonically_increasing_id())
    credit = (lambda c: c) if partial else (lambda c: F.floor(c))
    hit = p.join(g, ["sample", "type"], "left").groupBy("sample", "type", "pid").agg(F.coalesce(F.max(likeness(F.col("p"), F.col("g"))), F.lit(0.0)).alias("s"))
    miss = g.join(p, ["sample", "type"], "left").groupBy("sample", "type", "gid").agg(F.coalesce(F.max(likeness(F.col("p"), F.col("g"))), F.lit(0.0)).alias("s"))
    rows = hit.select("type", credit(F.col("s")).cast("double").alias("tp"), (F.col("s") == 0).cast("double").alias("fp"), F.lit(0.0).alias("fn"))
    rows = rows.unionByName(miss.select("type", F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp"), (F.col("s") == 0).cast("double").alias("fn")))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    each = rows.groupBy("type").agg(*sums)
    return each.unionByName(each.agg(*sums).where("tp is not null").withColumn("type", F.lit("overall")))


def greedy_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """sample, tp, fp, fn with each gold value used once: predictions (sample, pos, type, value) in order take the best one left."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            out = []
            for sample, ps, gs in zip(frame["sample"], frame["p"], frame["g"]):
                left, tp = [(x["type"], x["value"]) for x in sorted(gs, key=lambda x: x["pos"])], 0.0
                n, used = len(left), 0
                for p in sorted(ps, key=lambda x: x["pos"]):
                    worth = [1.0 if (p["type"], p["value"]) == g else 0.5 if p["type"] == g[0] and (p["value"] in g[1] or g[1] in p["value"]) else 0.0 for g in left]
                    if worth and max(worth) > 0:
                        k = worth.index(max(worth))
                        tp, used = tp + worth[k], used + 1
                        left.pop(k)
                out.append((sample, tp, float(len(ps) - used), float(n - used)))
            yield pd.DataFrame(out, columns=["sample", "tp", "fp", "fn"])

    lists = [t.groupBy("sample").agg(F.collect_list(F.struct("pos", "type", _low("value").alias("value"))).alias(n)) for t, n in ((predicted, "p"), (gold, "g"))]
    both = lists[0].join(lists[1], "sample", "full")
    none = F.array().cast(lists[0].schema["p"].dataType)
    both = both.select("sample", F.coalesce("p", none).alias("p"), F.coalesce("g", none).alias("g"))
    return both.mapInPandas(run, f"sample {dict(both.dtypes)['sample']}, tp double, fp double, fn double")


def retrieval_recall(found: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, recall, candidates: over samples with gold (sample, item), the mean share found among the first k (sample, item, rank); no gold counts as all."""
    samples = gold.select("sample").distinct()
    want = gold.where("item is not null").groupBy("sample").agg(F.countDistinct("item").alias("n"))
    hits = found.select("sample", "item", "rank").join(gold.select("sample", "item").distinct().withColumn("right", F.lit(1)), ["sample", "item"], "left")
    cut = hits.groupBy("sample").agg(*[F.count_if(F.col("rank") <= k).alias(f"c{k}") for k in ks], *[F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("right"))), F.lit(0)).alias(f"h{k}") for k in ks])
    rows = samples.join(want, "sample", "left").join(cut, "sample", "left").na.fill(0)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("n") == 0, 1.0).otherwise(F.col(f"h{k}") / F.col("n")).alias("r"), F.col(f"c{k}").alias("c")) for k in ks]))
    return rows.select(each.alias("e")).groupBy("e.k").agg(F.avg("e.r").alias("recall"), F.avg("e.c").alias("candidates"))


def endpoint_kind(value: Column, named: Column) -> Column:
    """named, ttp or ioc: what an end of a relation is, by its letters."""
    v, low = F.btrim(value), F.lower(F.btrim(value))
    ioc = (
        low.rlike("^https?://") | (F.contains(v, F.lit("@")) & F.contains(v, F.lit("."))) | v.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") | v.rlike("^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$")
        | low.rlike(r"\.(?:ps1|js|mjs|exe|dll|pyz|py|bat|vbs|jar|zip|dat|bin|sh|scr|hta|lnk|iso|msi|dmg|apk)$") | low.rlike(r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9-]+)+$")
    )
    return F.when(named, "named").when(v.rlike(r"(?i)T\d{4}(?:\.\d{3})?|CAPEC-\d+"), "ttp").when(ioc, "ioc").otherwise("named")


def _inside(text: Column, *values: Column) -> Column:
    out = F.contains(text, values[0])
    for v in values[1:]:
        out &= F.contains(text, v)
    return out


def grounding(relations: DataFrame, docs: DataFrame, sentences: DataFrame, window: int = 1, proximity: int = 300) -> DataFrame:
    """relations (report, rel, src, tgt, evidence) with ``grade``, the best support in the report's text.

    cosentence: both ends in one sentence; window: in ``window`` sentences on
    each side of one; evidence: in the quoted evidence, whose first 40 characters
    stand in the text; proximity: within so many characters; endpoints: in the
    text at all; else none.  docs: report, text; sentences: report, sent_no, sentence.
    """
    around = Window.partitionBy("report").orderBy("sent_no").rowsBetween(-window, window)
    wide = sentences.withColumn("s", F.lower("sentence")).withColumn("w", F.array_join(F.collect_list("s").over(around), " "))
    ends = relations.select("report", "rel", F.lower(F.btrim("src")).alias("a"), F.lower(F.btrim("tgt")).alias("b"), F.lower(F.btrim("evidence")).alias("e"))
    both = lambda t: _inside(t, F.col("a"), F.col("b"))
    near = ends.join(wide, "report").groupBy("report", "rel").agg(F.max(both(F.col("s"))).alias("one"), F.max(both(F.col("w"))).alias("few"))
    rows = ends.join(docs.select("report", F.lower("text").alias("text")), "report").join(near, ["report", "rel"], "left")
    # one end begins, and the other does so within as many characters
    follows = lambda x, y: F.regexp_like("text", F.concat(F.lit(r"(?s)(?=\Q"), F.col(x), F.lit(rf"\E).{{0,{proximity}}}\Q"), F.col(y), F.lit(r"\E")))
    close = follows("a", "b") | follows("b", "a")
    quote = F.substring("e", 1, 40)
    grade = (
        F.when(both(F.col("text")) & F.coalesce("one", F.lit(False)), "cosentence").when(both(F.col("text")) & F.coalesce("few", F.lit(False)), "window")
        .when((F.coalesce("e", F.lit("")) != "") & both(F.col("e")) & F.contains("text", quote), "evidence").when(both(F.col("text")) & close, "proximity").when(both(F.col("text")), "endpoints").otherwise("none")
    )
    return relations.join(rows.select("report", "rel", grade.alias("grade")), ["report", "rel"])


def completion_scores(added: DataFrame, accept: DataFrame, reject: DataFrame, closed: DataFrame) -> DataFrame:
    """engine, added, tp, fp, unjudged of new edges (sample, src, verb, tgt, engine) by gold edges; a closed sample's unlisted edges are wrong."""
    key = ["sample", "src", "verb", "tgt"]
    rows = added.join(accept.select(*key).distinct().withColumn("good", F.lit(True)), key, "left").join(reject.select(*key).distinct().withColumn("bad", F.lit(True)), key, "left")
    rows = rows.join(closed.select("sample").distinct().withColumn("shut", F.lit(True)), "sample", "left")
    wrong = F.col("good").isNull() & (F.col("bad").isNotNull() | F.col("shut").isNotNull())
    return rows.groupBy("engine").agg(F.count(F.lit(1)).alias("added"), F.count("good").alias("tp"), F.count_if(wrong).alias("fp"), F.count_if(F.col("good").isNull() & ~wrong).alias("unjudged"))


def turnaround(jobs: DataFrame) -> DataFrame:
    """minutes: mean time of completed jobs (status, created, updated) that took between none and a day."""
    took = (F.unix_micros(F.col("updated").cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))) / 6e7
    return jobs.where("status = 'completed'").select(took.alias("m")).where("m > 0 and m < 1440").agg(F.avg("m").alias("minutes"))


def tactic_matrix(cells: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """tactic, place, techniques, mean_score of cells (technique, score, tactics); unknown tactics are other, which comes last."""
    known = F.filter("tactics", lambda t: t.isin(*order))
    each = cells.select("technique", "score", F.explode(F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("other")))).alias("tactic"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("tactic")), F.lit(0)), F.lit(len(order) + 1))
    return each.groupBy("tactic").agg(F.countDistinct("technique").alias("techniques"), F.avg("score").alias("mean_score")).withColumn("place", place)

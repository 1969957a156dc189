"""Relations between the objects of a report: types, verbs, allowed edges, indicators, targets, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import few, save
from . import graph

#: All verbs of relations.
VERBS = (
    "delivers", "drops", "downloads", "exploits", "targets", "attributed-to", "originates-from", "authored-by", "impersonates", "uses", "controls", "has", "hosts", "owns", "compromises",
    "beacons-to", "communicates-with", "exfiltrates-to", "indicates", "based-on", "consists-of", "analysis-of", "static-analysis-of", "dynamic-analysis-of", "characterizes", "investigates",
    "mitigates", "remediates", "located-at", "resolves-to", "belongs-to", "variant-of", "duplicate-of", "derived-from", "related-to",
)
#: Types of observables in the standard; those that never go with a technique directly.
OBSERVABLES = (
    "artifact", "autonomous-system", "directory", "domain-name", "email-addr", "email-message", "file", "ipv4-addr", "ipv6-addr", "mac-addr", "mutex", "network-traffic", "process",
    "software", "url", "user-account", "windows-registry-key", "x509-certificate",
)
APART = (
    "ipv4-addr", "ipv6-addr", "domain-name", "url", "email-addr", "mac-addr", "autonomous-system", "file", "windows-registry-key", "mutex", "user-account", "network-traffic", "software", "artifact",
)
_PLACES = "identity location vulnerability"
_MEANS = "attack-pattern infrastructure malware tool"
#: The types that a verb of a type suggests; * stands for all observables.
SUGGESTED = {
    "attack-pattern": {"delivers": "malware", "targets": _PLACES, "uses": "malware tool"},
    "campaign": {"attributed-to": "intrusion-set threat-actor", "compromises": "infrastructure", "originates-from": "location", "targets": _PLACES, "uses": _MEANS},
    "course-of-action": {"investigates": "indicator", "mitigates": "attack-pattern indicator malware tool vulnerability", "remediates": "malware vulnerability"},
    "domain-name": {"resolves-to": "domain-name ipv4-addr ipv6-addr"},
    "identity": {"located-at": "location"},
    "indicator": {"based-on": "observed-data", "indicates": "attack-pattern campaign infrastructure intrusion-set malware threat-actor tool"},
    "infrastructure": {
        "communicates-with": "domain-name infrastructure ipv4-addr ipv6-addr url", "consists-of": "* infrastructure observed-data", "controls": "infrastructure malware", "delivers": "malware",
        "has": "vulnerability", "hosts": "malware tool", "located-at": "location", "uses": "infrastructure",
    },
    "intrusion-set": {
        "attributed-to": "threat-actor", "compromises": "infrastructure", "hosts": "infrastructure", "originates-from": "location", "owns": "infrastructure", "targets": _PLACES, "uses": _MEANS,
    },
    "ipv4-addr": {"belongs-to": "autonomous-system", "resolves-to": "mac-addr"},
    "ipv6-addr": {"belongs-to": "autonomous-system", "resolves-to": "mac-addr"},
    "malware": {
        "authored-by": "intrusion-set threat-actor", "beacons-to": "infrastructure", "communicates-with": "domain-name ipv4-addr ipv6-addr url", "controls": "malware",
        "downloads": "file malware tool", "drops": "file malware tool", "exfiltrates-to": "infrastructure", "exploits": "vulnerability", "originates-from": "location",
        "targets": f"infrastructure {_PLACES}", "uses": _MEANS, "variant-of": "malware",
    },
    "malware-analysis": {"characterizes": "malware", "analysis-of": "malware", "static-analysis-of": "malware", "dynamic-analysis-of": "malware"},
    "threat-actor": {
        "attributed-to": "identity", "compromises": "infrastructure", "hosts": "infrastructure", "impersonates": "identity", "located-at": "location", "owns": "infrastructure",
        "targets": _PLACES, "uses": _MEANS,
    },
    "tool": {"delivers": "malware", "drops": "malware", "has": "vulnerability", "targets": f"infrastructure {_PLACES}", "uses": "infrastructure"},
}
#: The object type of an entity type.
TYPES = {
    "ipv4": "ipv4-addr", "ipv6": "ipv6-addr", "domain": "domain-name", "url": "url", "email": "email-addr", "mac_addr": "mac-addr", "asn": "autonomous-system", "network_traffic": "software",
    "md5": "file", "sha1": "file", "sha256": "file", "file": "file", "registry_key": "windows-registry-key", "mutex": "mutex", "user_account": "user-account",
    "infrastructure": "infrastructure", "intrusion_set": "intrusion-set", "location": "location", "identity": "identity", "campaign": "campaign", "incident": "incident",
}
#: Further names of types in a reviewer's input.
MORE_TYPES = {"cve": "vulnerability", "ttp": "attack-pattern", "technique": "attack-pattern", "tactic": "attack-pattern", "procedure": "attack-pattern"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in table.items() for x in p])[key]


def object_type(entity_type: Column) -> Column:
    """Type of the object that an entity becomes; null for those built elsewhere."""
    return _lookup(TYPES, F.lower(entity_type))


def named_type(name: Column) -> Column:
    """The standard's name of a type, however it is written."""
    dashed = F.replace(name, F.lit("_"), F.lit("-"))
    return F.coalesce(_lookup(TYPES | MORE_TYPES | {"network_traffic": "network-traffic"}, name), dashed)


def suggestions(spark: SparkSession) -> DataFrame:
    """src_type, verb, tgt_type, n (its place): all suggested triples."""
    rows = [(s, v, t, n) for s, verbs in SUGGESTED.items() for n, (v, ts) in enumerate(verbs.items()) for x in ts.split() for t in (OBSERVABLES if x == "*" else (x,))]
    return spark.createDataFrame(rows, "src_type string, verb string, tgt_type string, n int")


def suggested(edges: DataFrame, src: str = "src_type", verb: str = "verb", tgt: str = "tgt_type") -> DataFrame:
    """Edges with ``suggested``: whether the standard names such an edge, or says nothing of its types."""
    known = F.broadcast(suggestions(edges.sparkSession).select(F.col("src_type").alias("_s"), F.col("verb").alias("_v"), F.col("tgt_type").alias("_t"), F.lit(True).alias("_known")).distinct())
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    low = F.lower(F.col(verb))
    ok = blank(src) | blank(verb) | blank(tgt) | (low == "related-to") | F.when(low.isin("duplicate-of", "derived-from"), F.col(src) == F.col(tgt)).otherwise(F.coalesce("_known", F.lit(False)))
    return edges.join(known, (F.col(src) == F.col("_s")) & (low == F.col("_v")) & (F.col(tgt) == F.col("_t")), "left").withColumn("suggested", ok).drop("_s", "_v", "_t", "_known")


def spurious(src_type: Column, tgt_type: Column) -> Column:
    """An edge between a technique and an observable, which has no meaning."""
    return ((src_type == "attack-pattern") & tgt_type.isin(*APART)) | ((tgt_type == "attack-pattern") & src_type.isin(*APART))


def with_valid_verbs(edges: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """Edges (src, src_type, verb, tgt, tgt_type) with verbs that the standard knows and suggests, once each.

    In this order: unknown verbs are related-to, a pin (src_type, tgt_type, verb)
    sets the verb, and what isn't suggested then is related-to.  Spurious edges go.
    """
    rows = edges.where(~F.coalesce(spurious(F.col("src_type"), F.col("tgt_type")), F.lit(False)))
    low = F.lower(F.btrim("verb"))
    rows = rows.withColumn("verb", F.when(low.isin(*VERBS), low).otherwise("related-to"))
    if pins is not None:
        fixed = pins.where(F.col("verb").isin(*VERBS)).select("src_type", "tgt_type", F.col("verb").alias("_pin"))
        rows = rows.join(F.broadcast(fixed), ["src_type", "tgt_type"], "left").withColumn("verb", F.coalesce("_pin", "verb")).drop("_pin")
    rows = suggested(rows).withColumn("verb", F.when(F.col("suggested"), F.col("verb")).otherwise("related-to"))
    return rows.select("src", "src_type", "verb", "tgt", "tgt_type").dropDuplicates(["src", "verb", "tgt"])


def verb_for(spark: SparkSession) -> DataFrame:
    """src_type, tgt_type, verb: the first verb that the standard names for a pair of types."""
    first = Window.partitionBy("src_type", "tgt_type").orderBy("n")
    return suggestions(spark).withColumn("_r", F.row_number().over(first)).where("_r = 1").select("src_type", "tgt_type", "verb")


def guarded_composition(edges: DataFrame, types: DataFrame, most: int = 200) -> DataFrame:
    """``graph.composed`` without the edges that the standard doesn't suggest for the ends' types (id, type)."""
    made = graph.composed(edges, None)
    types = few(types.select("id", "type"), "types")
    typed = made.join(types.toDF("src", "src_type"), "src").join(types.toDF("tgt", "tgt_type"), "tgt")
    return suggested(typed).where("suggested").select("src", "verb", "tgt", "confidence").orderBy("src", "verb", "tgt").limit(most)


def grounded(objects: DataFrame, known: DataFrame, edges: DataFrame, most: int | None = 200) -> DataFrame:
    """src, verb, tgt, confidence, label, rule: curated edges (src_id, verb, tgt_id) between objects (id, type, attack_id), where suggested and new.

    What is suggested is found for the types of both ids, before objects are
    paired.  ``most`` rows at most, in the order of src, verb and tgt (None:
    all): counts say up to which src these are certain to lie, and only what
    comes up to there is paired.
    """
    objects = objects.where("id is not null")
    a = objects.select(F.col("id").alias("src"), F.col("type").alias("src_type"), F.col("attack_id").alias("src_id"))
    b = objects.select(F.col("id").alias("tgt"), F.col("type").alias("tgt_type"), F.col("attack_id").alias("tgt_id"))
    kinds = lambda t: t.groupBy(*t.columns[1:]).agg(F.count(F.lit(1)).alias("n"))
    pairs = suggested(known.distinct().join(kinds(a).drop("n"), "src_id").join(kinds(b).withColumnRenamed("n", "ends"), "tgt_id")).where("suggested").drop("suggested")
    pairs = few(pairs, "pairs")
    edges = edges.select("src", "verb", "tgt")
    if most is not None:
        # of a src at least so many edges come out: its ends without itself and without edges that exist, each as often as an id may be an object
        copies = objects.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
        ends = a.join(pairs, ["src_id", "src_type"]).groupBy("src").agg(F.sum("ends").alias("ends"), F.count(F.lit(1)).alias("loops"))
        there = edges.join(F.broadcast(pairs.select("verb").distinct()), "verb", "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("there"))
        least = F.col("ends") - F.col("loops") * copies - F.coalesce("there", F.lit(0)) * copies * copies
        sure = save(ends.join(there, "src", "left").select("src", least.alias("sure")).where("sure > 0"), "sure", light=True)
        last = sure.orderBy("src").limit(most).withColumn("sum", F.sum("sure").over(Window.orderBy("src"))).where(F.col("sum") >= most).agg(F.min("src")).first()[0]
        if last is not None:
            a, edges = a.where(F.col("src") <= F.lit(last)), edges.where(F.col("src") <= F.lit(last))
    rows = a.join(pairs, ["src_id", "src_type"]).join(b, ["tgt_id", "tgt_type"]).where("src <> tgt").select("src", "verb", "tgt", "src_id", "tgt_id")
    rows = rows.join(edges, ["src", "verb", "tgt"], "left_anti")
    rule = F.concat(F.lit("attack-reference:"), "src_id", F.lit(">"), "tgt_id")
    rows = rows.select("src", "verb", "tgt", F.lit(85).alias("confidence"), F.lit("reported").alias("label"), rule.alias("rule"))
    return rows if most is None else rows.orderBy("src", "verb", "tgt").limit(most)


def indicator_edges(found: DataFrame, objects: DataFrame) -> DataFrame:
    """src, verb, tgt, confidence, label of the indicators of associations (ioc, malware), whose ends are objects (id, value)."""
    by = objects.groupBy(F.lower("value").alias("v")).agg(F.min("id").alias("id"))
    rows = found.where("coalesce(ioc, '') <> '' and coalesce(malware, '') <> ''").select(F.lower("ioc").alias("i"), F.lower("malware").alias("m")).distinct()
    rows = rows.join(by.select(F.col("v").alias("i"), F.col("id").alias("ioc_id")), "i").join(by.select(F.col("v").alias("m"), F.col("id").alias("tgt")), "m")
    src = F.concat(F.lit("indicator--"), "i")
    indicates = rows.select(src.alias("src"), F.lit("indicates").alias("verb"), "tgt", F.lit(80).alias("confidence"), F.lit("reported").alias("label"))
    based = rows.select(src.alias("src"), F.lit("based-on").alias("verb"), F.concat(F.lit("observed-data--"), F.col("ioc_id").cast("string")).alias("tgt"), F.lit(90).alias("confidence"), F.lit("observed").alias("label")).distinct()
    return indicates.withColumn("tgt", F.col("tgt").cast("string")).unionByName(based)


def target_edges(actors: DataFrame, places: DataFrame) -> DataFrame:
    """report, src, verb, tgt: every actor (report, id) of a report targets its countries and sectors (report, id)."""
    return actors.select("report", F.col("id").alias("src")).distinct().join(places.select("report", F.col("id").alias("tgt")).distinct(), "report").select("report", "src", F.lit("targets").alias("verb"), "tgt")


def coverage_check(entities: DataFrame, objects: DataFrame, indicators: DataFrame) -> DataFrame:
    """report, total, with_object, with_indicator, missing_object, missing_indicator, ok of observable entities (report, kind, value).

    objects and indicators: report, kind, value of those that a bundle has.
    """
    low = [F.col("report"), F.col("kind"), F.lower("value").alias("value")]
    seen = entities.where(object_type(F.col("kind")).isNotNull()).select(*low).distinct()
    has = lambda t, name: t.select(*low).distinct().withColumn(name, F.lit(True))
    rows = seen.join(has(objects, "o"), ["report", "kind", "value"], "left").join(has(indicators, "i"), ["report", "kind", "value"], "left")
    lost = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNull(), F.col("value"))))
    out = rows.groupBy("report").agg(F.count(F.lit(1)).alias("total"), F.count("o").alias("with_object"), F.count("i").alias("with_indicator"), lost("o").alias("missing_object"), lost("i").alias("missing_indicator"))
    return out.withColumn("ok", (F.col("with_object") == F.col("total")) & (F.col("with_indicator") == F.col("total")))


def edge_audit(edges: DataFrame, top: int = 5) -> DataFrame:
    """what, value, n: edges (verb, src_type, tgt_type, label, pinned, inferred) in total, by label and flag, and the commonest verbs and pairs."""
    pair = F.concat(F.coalesce("src_type", F.lit("?")), F.lit("->"), F.coalesce("tgt_type", F.lit("?")))
    facts = [("total", F.lit("")), ("label", F.coalesce("label", F.lit("(unlabelled)"))), ("pinned", F.when(F.col("pinned"), "")), ("inferred", F.when(F.col("inferred"), "")), ("verb", F.col("verb")), ("pair", pair)]
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("value")) for k, v in facts]), lambda x: x.value.isNotNull()))
    n = edges.select(each.alias("e")).groupBy("e.what", "e.value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("what").orderBy(F.desc("n"), "value"))
    return n.withColumn("_r", place).where(~F.col("what").isin("verb", "pair") | (F.col("_r") <= top)).drop("_r")


def central(labels: DataFrame, degrees: DataFrame) -> DataFrame:
    """component, node, degree, topic: the node of most edges of each component, and which of those has most of all."""
    rows = labels.join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = rows.groupBy("component").agg(F.max(F.struct("degree", "node")).alias("m")).select("component", "m.node", "m.degree")
    most = best.agg(F.max(F.struct("degree", "node")).alias("top"))
    return best.crossJoin(F.broadcast(most)).select("component", "node", "degree", (F.col("node") == F.col("top.node")).alias("topic"))


def merged_aliases(objects: DataFrame, edges: DataFrame, degrees: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(id, canonical) of objects (id, type, names) that share a type and a name, and the edges rewired to them.

    Names count by their letters and digits.  The canonical object has most
    edges, then the longest name, then the least id; loops and repeats go.
    """
    token = objects.select("id", "type", F.explode("names").alias("name")).select("id", F.concat("type", F.lit(":"), F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]", "")).alias("token")).where("not endswith(token, ':')")
    first = token.groupBy("token").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = token.join(first, "token").where("id <> least").select(F.col("id").alias("src"), F.col("least").alias("tgt")).distinct()
    labels = graph.least_labels(links, folder)
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc(F.coalesce("degree", F.lit(0))), F.desc(F.length(F.get("names", F.lit(0)))), "node"))
    lead = labels.join(objects.select(F.col("id").alias("node"), "names"), "node").join(degrees, "node", "left").withColumn("_r", rank).where("_r = 1").select("component", F.col("node").alias("canonical"))
    merged = labels.join(lead, "component").select(F.col("node").alias("id"), "canonical")
    to = lambda c, name: merged.select(F.col("id").alias(c), F.col("canonical").alias(name))
    rewired = edges.join(to("src", "s"), "src", "left").join(to("tgt", "t"), "tgt", "left").select(F.coalesce("s", "src").alias("src"), "verb", F.coalesce("t", "tgt").alias("tgt"))
    return merged, rewired.where("src <> tgt").distinct()


def depths(edges: DataFrame, start: DataFrame, folder: str) -> DataFrame:
    """node, depth: steps over edges in either direction from the start nodes (node), round by round."""
    spark = edges.sparkSession
    both = edges.select("src", "tgt").unionAll(edges.select("tgt", "src")).where("src <> tgt").distinct().toDF("src", "tgt")
    seen, depth = start.select("node").distinct().withColumn("depth", F.lit(0)), 0
    while True:
        seen.write.parquet(f"{folder}/depth_{depth}")
        seen = spark.read.parquet(f"{folder}/depth_{depth}")
        reached = both.join(seen.where(F.col("depth") == depth), both.src == F.col("node")).select(F.col("tgt").alias("node")).distinct().join(seen, "node", "left_anti")
        if reached.isEmpty():
            return seen
        depth += 1
        seen = seen.unionByName(reached.withColumn("depth", F.lit(depth)))


def marked(objects: DataFrame, tlp: str = "clear") -> DataFrame:
    """Objects with their markings: the given TLP level, and PAP where one is stated, on those that have a time of creation."""
    refs = F.array_compact(F.array(F.lit(f"marking-definition--tlp-{tlp}"), F.when(F.col("pap").isNotNull(), F.concat(F.lit("marking-definition--pap-"), F.lower("pap")))))
    return objects.withColumn("markings", F.when(F.col("created").isNotNull(), F.array_union(F.coalesce("markings", F.array().cast("array<string>")), refs)).otherwise(F.col("markings")))


def reference_url(ident: Column) -> Column:
    """Where an id of a technique, tactic or attack pattern is described."""
    up = F.upper(ident)
    return (
        F.when(F.startswith(up, F.lit("CAPEC-")), F.concat(F.lit("https://capec.mitre.org/data/definitions/"), F.substring_index(ident, "-", -1), F.lit(".html")))
        .when(F.startswith(up, F.lit("TA")), F.concat(F.lit("https://attack.mitre.org/tactics/"), ident, F.lit("/")))
        .otherwise(F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(ident, F.lit("."), F.lit("/")), F.lit("/")))
    )


def platforms_seen(observables: DataFrame) -> DataFrame:
    """report, display, class, value of what says something of a platform, without devices and addresses that are no indicators."""
    rows = observables.where(F.col("class").isin("file", "image", "registry", "ip"))
    return rows.where(~T.pseudo_file(F.col("value")) & ((F.col("class") != "ip") | T.public_ipv4(F.col("value"))))

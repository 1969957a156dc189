"""Queries of relations, merging, review and measures, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import _EMAIL, _IPV4, ORACLES, _edges, _t, query
from ..operators import evaluation, extract, graph, merge, relations, review

_KINDS = ("attack-pattern", "malware", "tool", "ipv4-addr", "threat-actor", "infrastructure", "domain-name", "location")
_SAID = ("uses", " Targets ", "foo", "drops", "related-to", "derived-from", "consists-of")
_K = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"
_TABLE = ", ".join(f"('{s}', '{v}', '{t}', {n})" for s, vs in relations.SUGGESTED.items() for n, (v, ts) in enumerate(vs.items()) for x in ts.split() for t in (relations.OBSERVABLES if x == "*" else (x,)))
_APART = ", ".join(f"'{x}'" for x in relations.APART)
_VERBS = ", ".join(f"'{x}'" for x in relations.VERBS)


def _folder(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _kind(col: str):
    return F.array(*map(F.lit, _KINDS))[(F.col(col) % 8).cast("int")]


@query(f"""WITH sug(st, v, tt, n) AS (VALUES {_TABLE}), e AS (SELECT DISTINCT l_suppkey src, {_K}[l_suppkey % 8 + 1] src_type, ['uses', ' Targets ', 'foo', 'drops', 'related-to', 'derived-from', 'consists-of'][l_linenumber % 7 + 1] verb, l_partkey % 97 tgt, {_K}[l_partkey % 97 % 8 + 1] tgt_type FROM lineitem),
k AS (SELECT src, src_type, CASE WHEN src_type = 'malware' AND tgt_type = 'tool' THEN 'drops' WHEN lower(trim(verb)) IN ({_VERBS}) THEN lower(trim(verb)) ELSE 'related-to' END verb, tgt, tgt_type FROM e
  WHERE NOT ((src_type = 'attack-pattern' AND tgt_type IN ({_APART})) OR (tgt_type = 'attack-pattern' AND src_type IN ({_APART}))))
SELECT DISTINCT src, src_type, CASE WHEN verb = 'related-to' OR (verb = 'derived-from' AND src_type = tgt_type) OR EXISTS (SELECT 1 FROM sug WHERE st = src_type AND v = verb AND tt = tgt_type) THEN verb ELSE 'related-to' END AS verb, tgt, tgt_type FROM k""")
def verb_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs made valid, pinned and suggested, in that order; spurious edges dropped."""
    said = F.array(*map(F.lit, _SAID))[(F.col("l_linenumber") % 7).cast("int")]
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), _kind("l_suppkey").alias("src_type"), said.alias("verb"), (F.col("l_partkey") % 97).alias("tgt")).withColumn("tgt_type", _kind("tgt"))
    return relations.with_valid_verbs(rows.distinct(), spark.createDataFrame([("malware", "tool", "drops")], "src_type string, tgt_type string, verb string"))


@query(f"""WITH sug(st, v, tt, n) AS (VALUES {_TABLE}) SELECT p_partkey, coalesce((SELECT arg_min(v, n) FROM sug WHERE st = {_K}[p_partkey % 8 + 1] AND tt = {_K}[p_size % 8 + 1]), 'related-to') AS verb FROM part""")
def verb_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_partkey", _kind("p_partkey").alias("src_type"), _kind("p_size").alias("tgt_type"))
    return rows.join(F.broadcast(relations.verb_for(spark)), ["src_type", "tgt_type"], "left").select("p_partkey", F.coalesce("verb", F.lit("related-to")).alias("verb"))


@query(ORACLES["transitive_compose"].replace("WITH edges", f"WITH sug(st, v, tt, n) AS (VALUES {_TABLE}), edges").replace(
    "WHERE a.src <> b.tgt", f"WHERE a.src <> b.tgt AND EXISTS (SELECT 1 FROM sug WHERE st = {_K}[a.src % 8 + 1] AND v = t.verb AND tt = {_K}[b.tgt % 8 + 1])"))
def transitive_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition over all lines that the standard suggests for the ends' types."""
    e = _edges(spark, sf_dir)
    ids = e.select(F.col("src").alias("id")).union(e.select("tgt")).distinct().withColumn("type", _kind("id"))
    return relations.guarded_composition(e, ids)


@query(f"""WITH sug(st, v, tt, n) AS (VALUES {_TABLE}), o AS (SELECT s_suppkey id, {_K}[s_suppkey % 8 + 1] "type", 'A' || (s_suppkey % 30) aid FROM supplier),
k AS (SELECT DISTINCT 'A' || (p_partkey % 30) a, ['uses', 'targets', 'variant-of'][p_size % 3 + 1] verb, 'A' || (p_size % 30) b FROM part)
SELECT x.id AS src, verb, y.id AS tgt, CAST(85 AS INT) AS confidence, 'reported' AS label, 'attack-reference:' || a || '>' || b AS rule FROM k JOIN o x ON x.aid = a JOIN o y ON y.aid = b
WHERE x.id <> y.id AND EXISTS (SELECT 1 FROM sug WHERE st = x."type" AND v = verb AND tt = y."type") AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = x.id AND l_partkey = y.id AND verb = 'uses') ORDER BY src, verb, tgt LIMIT 200""")
def reference_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), _kind("s_suppkey").alias("type"), F.expr("concat('A', s_suppkey % 30)").alias("attack_id"))
    verbs = F.array(*map(F.lit, ("uses", "targets", "variant-of")))[(F.col("p_size") % 3).cast("int")]
    known = _t(spark, sf_dir, "part").select(F.expr("concat('A', p_partkey % 30)").alias("src_id"), verbs.alias("verb"), F.expr("concat('A', p_size % 30)").alias("tgt_id"))
    edges = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.lit("uses").alias("verb"), F.col("l_partkey").alias("tgt"))
    return relations.grounded(objects, known, edges)


@query("""WITH a AS (SELECT DISTINCT lower(s_name) i, s_suppkey, lower(p_name) m, (SELECT min(p.p_partkey) + 1000000 FROM part p WHERE p.p_name = part.p_name) pid FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1)
SELECT 'indicator--' || i AS src, 'indicates' AS verb, pid::VARCHAR AS tgt, CAST(80 AS INT) AS confidence, 'reported' AS label FROM a UNION SELECT 'indicator--' || i, 'based-on', 'observed-data--' || s_suppkey, 90, 'observed' FROM a""")
def ioc_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "supplier")
    found = _t(spark, sf_dir, "lineitem").where("l_linenumber = 1").join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.upper("s_name").alias("ioc"), F.col("p_name").alias("malware"))
    objects = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("value")).union(part.select(F.col("p_partkey") + 1000000, F.upper("p_name")))
    return relations.indicator_edges(found, objects)


@query("SELECT DISTINCT s_nationkey AS report, s_suppkey AS src, 'targets' AS verb, c_mktsegment AS tgt FROM supplier JOIN customer ON c_nationkey = s_nationkey")
def targets_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    actors = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("report"), F.col("s_suppkey").alias("id"))
    return relations.target_edges(actors, _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("report"), F.col("c_mktsegment").alias("id")))


@query(f"""WITH e AS (SELECT DISTINCT doc_id report, kind, lower(value) value FROM (SELECT 'ipv4' kind, * FROM ({_IPV4}) UNION ALL SELECT 'email', * FROM ({_EMAIL})))
SELECT report, count(*) AS total, count(*) FILTER (report % 2 = 0) AS with_object, count(*) FILTER (length(value) % 3 <> 0) AS with_indicator, array_to_string(list_sort(coalesce(list(value) FILTER (report % 2 <> 0), [])), ',') AS missing_object,
array_to_string(list_sort(coalesce(list(value) FILTER (length(value) % 3 = 0), [])), ',') AS missing_indicator, report % 2 = 0 AND count(*) FILTER (length(value) % 3 = 0) = 0 AS ok FROM e GROUP BY report""")
def verify_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.indicators(_t(spark, sf_dir, "documents").select("doc_id", "text"), ("ipv4", "email")).select(F.col("doc_id").alias("report"), "kind", "value")
    out = relations.coverage_check(found, found.where("report % 2 = 0"), found.where("length(value) % 3 <> 0"))
    return out.withColumn("missing_object", F.concat_ws(",", "missing_object")).withColumn("missing_indicator", F.concat_ws(",", "missing_indicator"))


_AUDIT = f"""e AS (SELECT ['uses', 'targets', 'drops', 'has', 'hosts', 'owns', 'controls'][l_linenumber % 7 + 1] verb, {_K}[l_suppkey % 8 + 1] s, CASE WHEN l_partkey % 9 > 7 THEN NULL ELSE {_K}[l_partkey % 9 + 1] END t, CASE l_returnflag WHEN 'A' THEN 'observed' WHEN 'R' THEN 'inferred' END lab, l_linestatus = 'F' p, l_linenumber % 3 = 0 i FROM lineitem)"""


@query(f"""WITH {_AUDIT}, n AS (SELECT 'total' what, '' value, count(*) n FROM e UNION ALL SELECT 'label', coalesce(lab, '(unlabelled)'), count(*) FROM e GROUP BY 2 UNION ALL SELECT 'pinned', '', count(*) FROM e WHERE p UNION ALL SELECT 'inferred', '', count(*) FROM e WHERE i
UNION ALL (SELECT 'verb', verb, count(*) FROM e GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL (SELECT 'pair', s || '->' || coalesce(t, '?') pr, count(*) FROM e GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)) SELECT * FROM n""")
def edge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    verbs = F.array(*map(F.lit, ("uses", "targets", "drops", "has", "hosts", "owns", "controls")))[(F.col("l_linenumber") % 7).cast("int")]
    label = F.when(F.col("l_returnflag") == "A", "observed").when(F.col("l_returnflag") == "R", "inferred")
    tgt = F.when(F.col("l_partkey") % 9 <= 7, F.get(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % 9).cast("int")))
    rows = _t(spark, sf_dir, "lineitem").select(verbs.alias("verb"), _kind("l_suppkey").alias("src_type"), tgt.alias("tgt_type"), label.alias("label"), (F.col("l_linestatus") == "F").alias("pinned"), (F.col("l_linenumber") % 3 == 0).alias("inferred"))
    return relations.edge_audit(rows)


@query(ORACLES["components"].replace(" SELECT node, min(seen) AS component FROM r GROUP BY node", """, c AS (SELECT node, min(seen) component FROM r GROUP BY node), g AS (SELECT n node, count(*) degree FROM (SELECT a n FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
SELECT component, arg_max(node, (degree, node)) AS node, max(degree) AS degree, arg_max(node, (degree, node)) = (SELECT arg_max(node, (degree, node)) FROM c JOIN g USING (node)) AS topic FROM c JOIN g USING (node) GROUP BY component"""))
def central_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.expr("o_custkey div 7 * 7").alias("tgt")).distinct()
    return relations.central(graph.least_labels(edges, _folder(spark, "central")), graph.degrees(edges))


_ALIAS = """g AS (SELECT node, count(*) degree FROM (SELECT l_partkey node FROM lineitem UNION ALL SELECT (l_partkey + 7) % 1000 FROM lineitem) GROUP BY 1),
m AS (SELECT p_partkey id, first_value(p_partkey) OVER (PARTITION BY p_type, p_name ORDER BY coalesce(degree, 0) DESC, length(p_name) DESC, p_partkey) canonical, count(*) OVER (PARTITION BY p_type, p_name) n FROM part LEFT JOIN g ON node = p_partkey)"""


@query(f"""WITH {_ALIAS} SELECT DISTINCT coalesce(a.canonical, l_partkey) AS src, 'uses' AS verb, coalesce(b.canonical, (l_partkey + 7) % 1000) AS tgt FROM lineitem LEFT JOIN m a ON a.id = l_partkey AND a.n > 1 LEFT JOIN m b ON b.id = (l_partkey + 7) % 1000 AND b.n > 1
WHERE coalesce(a.canonical, l_partkey) <> coalesce(b.canonical, (l_partkey + 7) % 1000)""")
def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between objects of which those that share a type and a name are one."""
    edges = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lit("uses").alias("verb"), F.expr("(l_partkey + 7) % 1000").alias("tgt"))
    objects = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.array(F.col("p_name"), F.upper(F.concat("p_name", F.lit("!")))).alias("names"))
    return relations.merged_aliases(objects, edges, graph.degrees(edges), _folder(spark, "aliases"))[1]


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey a, o_custkey // 4 b FROM orders WHERE o_custkey <> o_custkey // 4), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT 0::BIGINT node, 0 depth UNION SELECT u.b, depth + 1 FROM r JOIN u ON u.a = r.node WHERE depth < 12)
SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node""")
def bfs_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.expr("o_custkey div 4").alias("tgt")).distinct()
    return relations.depths(edges, spark.createDataFrame([(0,)], "node long"), _folder(spark, "depths"))


# --- measures ----------------------------------------------------------------------

_NER = """v AS (SELECT l_orderkey sample, l_returnflag "type", p_name || CASE WHEN p_size % 2 = 0 THEN ' x' ELSE '' END value, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey),
p AS (SELECT row_number() OVER () id, * FROM v WHERE l_linenumber % 2 = 0), g AS (SELECT row_number() OVER () id, sample, "type", replace(value, ' x', '') value FROM v WHERE l_linenumber % 3 = 0),
h AS (SELECT p."type", p.id, max(CASE WHEN p.value = g.value THEN 1.0 WHEN contains(p.value, g.value) OR contains(g.value, p.value) THEN 0.5 ELSE 0 END) s FROM p LEFT JOIN g ON g.sample = p.sample AND g."type" = p."type" GROUP BY ALL),
q AS (SELECT g."type", g.id, max(CASE WHEN p.value = g.value THEN 1.0 WHEN contains(p.value, g.value) OR contains(g.value, p.value) THEN 0.5 ELSE 0 END) s FROM g LEFT JOIN p ON g.sample = p.sample AND g."type" = p."type" GROUP BY ALL),
z AS (SELECT "type", coalesce(s, 0)::DOUBLE tp, (coalesce(s, 0) = 0)::DOUBLE fp, 0::DOUBLE fn FROM h UNION ALL SELECT "type", 0, 0, (coalesce(s, 0) = 0)::DOUBLE FROM q)"""


def _ner(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    value = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " x").otherwise(""))
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("sample"), F.col("l_returnflag").alias("type"), value.alias("value"), "l_linenumber", F.col("l_linenumber").alias("pos"))
    return rows.where("l_linenumber % 2 = 0"), rows.where("l_linenumber % 3 = 0").withColumn("value", F.replace("value", F.lit(" x"), F.lit("")))


@query(f"""WITH {_NER} SELECT "type", sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM z GROUP BY 1 UNION ALL SELECT 'overall', sum(tp), sum(fp), sum(fn) FROM z""")
def ner_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.entity_scores(*_ner(spark, sf_dir))


@query()
def greedy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.greedy_scores(*_ner(spark, sf_dir))


_RECALL = """f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) r FROM events GROUP BY user_id, event_type),
g AS (SELECT DISTINCT user_id, CASE WHEN value > 60 AND user_id % 9 <> 0 THEN event_type END item FROM events), w AS (SELECT user_id, count(item) n FROM g GROUP BY 1),
x AS (SELECT w.user_id, n, k, (SELECT count(*) FROM f WHERE f.user_id = w.user_id AND r <= k) c, (SELECT count(*) FROM f JOIN g ON g.user_id = f.user_id AND g.item = f.event_type WHERE f.user_id = w.user_id AND r <= k) h FROM w, (SELECT unnest([1, 3, 5]) k))"""


@query(f"WITH {_RECALL} SELECT k, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE h / n END), 6) AS recall, round(avg(c), 6) AS candidates FROM x GROUP BY k")
def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    counted = events.groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    found = merge.ranked(counted, ["sample"], F.desc("n"), "item")
    gold = events.select(F.col("user_id").alias("sample"), F.when((F.col("value") > 60) & (F.col("user_id") % 9 != 0), F.col("event_type")).alias("item")).distinct()
    out = evaluation.retrieval_recall(found, gold, (1, 3, 5))
    return out.select("k", F.round("recall", 6).alias("recall"), F.round("candidates", 6).alias("candidates"))


_GROUND = r"""WITH l AS (SELECT doc_id, lower(text) t, regexp_extract_all(lower(text), '[a-z]{4,}') w FROM documents WHERE len(regexp_extract_all(lower(text), '[a-z]{4,}')) >= 12),
rel AS (SELECT doc_id, t, unnest([{r: 1, a: w[2], b: w[4], e: ''}, {r: 2, a: w[2], b: w[11], e: ''}, {r: 3, a: w[2], b: w[len(w)], e: ''}, {r: 4, a: w[2], b: 'nowhere', e: ''}, {r: 5, a: w[3], b: w[len(w) // 2], e: left(t, 60)}]) x FROM l),
q AS (SELECT doc_id, t, x.r rel, x.a a, x.b b, x.e e FROM rel),
p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+|;\s+')) s, generate_subscripts(string_split_regex(regexp_replace(lower(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+|;\s+'), 1) i FROM documents),
s AS (SELECT doc_id, s, string_agg(s, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) w FROM (SELECT doc_id, i, trim(s, ' ' || chr(9) || chr(10) || chr(13)) s FROM p) WHERE length(s) > 20),
n AS (SELECT doc_id, rel, bool_or(contains(s, a) AND contains(s, b)) one, bool_or(contains(w, a) AND contains(w, b)) few FROM q JOIN s USING (doc_id) GROUP BY ALL),
g AS (SELECT doc_id, rel, CASE WHEN NOT (contains(t, a) AND contains(t, b)) THEN 'none' WHEN one THEN 'cosentence' WHEN few THEN 'window' WHEN e <> '' AND contains(trim(e), a) AND contains(trim(e), b) THEN 'evidence'
  WHEN contains(a, b) OR contains(b, a) OR regexp_matches(t, '(?s)' || a || '.{0,' || (300 - length(a)) || '}' || b) OR regexp_matches(t, '(?s)' || b || '.{0,' || (300 - length(b)) || '}' || a) THEN 'proximity' ELSE 'endpoints' END grade FROM q LEFT JOIN n USING (doc_id, rel))
SELECT rel, grade, count(*) AS n FROM g GROUP BY ALL"""


@query(_GROUND)
def grounding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of five relations in each text, by grade."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("report"), "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    w = docs.withColumn("w", words).where("size(w) >= 12")
    rel = lambda n, x, y, e="''": f"named_struct('rel', {n}, 'src', {x}, 'tgt', {y}, 'evidence', {e})"
    made = (rel(1, "w[1]", "w[3]"), rel(2, "w[1]", "w[10]"), rel(3, "w[1]", "w[size(w) - 1]"), rel(4, "w[1]", "'nowhere'"), rel(5, "w[2]", "w[size(w) div 2 - 1]", "left(lower(text), 60)"))
    each = F.expr(f"array({', '.join(made)})")
    rels = w.select("report", F.explode(each).alias("x")).select("report", "x.*")
    graded = evaluation.grounding(rels, docs, extract.sentence_table(docs, "report"))
    return graded.groupBy("rel", "grade").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey sample, l_partkey % 50 src, 'uses' verb, l_linenumber tgt, CASE WHEN l_quantity < 25 THEN 'transitive' ELSE 'attack-reference' END engine FROM lineitem), a AS (SELECT DISTINCT l_suppkey sample, l_partkey % 50 src, l_linenumber tgt FROM lineitem WHERE l_tax < 0.03),
b AS (SELECT DISTINCT l_suppkey sample, l_partkey % 50 src, l_linenumber tgt FROM lineitem WHERE l_tax > 0.06), j AS (SELECT engine, EXISTS (SELECT 1 FROM a WHERE a.sample = e.sample AND a.src = e.src AND a.tgt = e.tgt) good, EXISTS (SELECT 1 FROM b WHERE b.sample = e.sample AND b.src = e.src AND b.tgt = e.tgt) OR e.sample % 5 = 0 bad FROM e)
SELECT engine, count(*) AS added, count(*) FILTER (good) AS tp, count(*) FILTER (NOT good AND bad) AS fp, count(*) FILTER (NOT good AND NOT bad) AS unjudged FROM j GROUP BY engine""")
def rel_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 50).alias("src"), F.lit("uses").alias("verb"), F.col("l_linenumber").alias("tgt"), F.when(F.col("l_quantity") < 25, "transitive").otherwise("attack-reference").alias("engine"), "l_tax")
    closed = rows.where("sample % 5 = 0").select("sample")
    return evaluation.completion_scores(rows.drop("l_tax").distinct(), rows.where("l_tax < 0.03"), rows.where("l_tax > 0.06"), closed)


@query("SELECT round(avg(m), 6) AS minutes FROM (SELECT o_custkey % 2000 - 100 m FROM orders WHERE o_orderstatus = 'F') WHERE m > 0 AND m < 1440")
def turnaround(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _t(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").alias("status"), F.col("o_orderdate").alias("created"), F.expr("o_orderdate + make_dt_interval(0, 0, o_custkey % 2000 - 100)").alias("updated"))
    return evaluation.turnaround(jobs).select(F.round("minutes", 6).alias("minutes"))


@query("""WITH c AS (SELECT p_partkey, p_size % 4 score, unnest(CASE WHEN p_type IN ('SMALL', 'PROMO') THEN [p_type] WHEN p_type = 'LARGE' THEN ['SMALL', 'LARGE'] ELSE ['other'] END) t FROM part),
d AS (SELECT p_partkey, score, t FROM c) SELECT t AS tactic, count(DISTINCT p_partkey) AS techniques, round(avg(score), 6) AS mean_score, CAST(CASE t WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'LARGE' THEN 3 ELSE 4 END AS BIGINT) AS place FROM d GROUP BY t""")
def tactic_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tactics = F.when(F.col("p_type") == "LARGE", F.array(F.lit("SMALL"), F.lit("LARGE"), F.lit("ODD"))).otherwise(F.array("p_type"))
    cells = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("technique"), (F.col("p_size") % 4).alias("score"), tactics.alias("tactics"))
    out = evaluation.tactic_matrix(cells, ("PROMO", "SMALL", "LARGE"))
    return out.select("tactic", "techniques", F.round("mean_score", 6).alias("mean_score"), F.col("place").cast("long").alias("place"))


# --- merging and review ------------------------------------------------------------


@query("""SELECT l_orderkey, lower(p_name) AS value, s AS stage FROM (SELECT l_orderkey, p_name, l_linenumber pos, ['ner', 'regex', 'dictionary'][l_linenumber % 3 + 1] s FROM lineitem JOIN part ON p_partkey = l_partkey)
QUALIFY row_number() OVER (PARTITION BY l_orderkey, lower(p_name) ORDER BY CASE s WHEN 'regex' THEN 1 WHEN 'dictionary' THEN 2 ELSE 3 END, pos) = 1""")
def first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    stage = F.array(*map(F.lit, ("ner", "regex", "dictionary")))[(F.col("l_linenumber") % 3).cast("int")]
    rows = rows.select("l_orderkey", F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("value"), stage.alias("stage"), F.col("l_linenumber").alias("pos"), F.col("l_orderkey").cast("string").alias("o"))
    return merge.first_written(rows, ["o", "value"], ("regex", "dictionary", "ner")).select("l_orderkey", F.lower("value").alias("value"), "stage")


@query("""SELECT o_custkey AS report, p AS name FROM (SELECT o_custkey, o_orderpriority p, min(o_orderkey) FROM orders WHERE lower(o_orderpriority) <> '5-low' GROUP BY ALL)""")
def names_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report"), F.col("o_orderkey").alias("chunk"), F.lit(0).alias("pos"), F.concat(F.lit(" "), "o_orderpriority").alias("name"))
    return merge.first_names(rows, spark.createDataFrame([("5-Low ",)], "name string"))


@query("""WITH t AS (SELECT o_custkey report, o_orderkey chunk, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'T' || (o_orderkey % 11) END id, 'n' || (o_orderkey % 7) AS name FROM orders)
SELECT report, id, name FROM t WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report, id ORDER BY chunk DESC) = 1
UNION ALL SELECT report, NULL, name FROM t x WHERE id IS NULL AND NOT EXISTS (SELECT 1 FROM t y WHERE y.report = x.report AND y.id IS NOT NULL AND y.name = x.name) GROUP BY report, name""")
def technique_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report"), key.alias("chunk"), F.lit(0).alias("pos"), F.when(key % 3 != 0, F.expr("concat('T', o_orderkey % 11)")).alias("id"), F.expr("concat('n', o_orderkey % 7)").alias("name"))
    return merge.merged_ids(rows)


_ENT = """ent AS (SELECT l_suppkey report, CASE WHEN l_linenumber < 4 THEN 'ttp' ELSE 'location' END entity_type, 'n' || (l_partkey % 200) AS value, CASE WHEN l_partkey % 2 = 0 THEN 't' || (l_partkey % 90) END mitre_id, CASE l_returnflag WHEN 'R' THEN false WHEN 'A' THEN true END accepted FROM lineitem)"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", False).when(F.col("l_returnflag") == "A", True)
    return _t(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("report"), F.when(F.col("l_linenumber") < 4, "ttp").otherwise("location").alias("entity_type"), F.expr("concat('n', l_partkey % 200)").alias("value"),
        F.when(F.col("l_partkey") % 2 == 0, F.expr("concat('t', l_partkey % 90)")).alias("mitre_id"), flag.alias("accepted"),
    )


@query(f"""WITH {_ENT}, b AS (SELECT report, entity_type, CASE WHEN entity_type = 'ttp' AND accepted IS NULL THEN true WHEN entity_type = 'location' THEN NULL ELSE accepted END accepted FROM ent)
SELECT entity_type, coalesce(accepted::VARCHAR, 'pending') AS accepted, count(*) AS n FROM b GROUP BY ALL""")
def bulk_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.bulk(review.bulk(_entities(spark, sf_dir), "ttp", "accept"), "location", "reset", "all")
    return rows.groupBy("entity_type", F.coalesce(F.col("accepted").cast("string"), F.lit("pending")).alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ENT}, rej AS (SELECT * FROM ent WHERE accepted = false AND entity_type = 'ttp'), x AS (SELECT DISTINCT s_suppkey report, 'N' || (p_partkey % 200) AS name, 'T' || (p_partkey % 90) id FROM supplier, part WHERE p_partkey % 10 = s_suppkey % 10)
SELECT report, name, id FROM x WHERE NOT EXISTS (SELECT 1 FROM rej WHERE rej.report = x.report AND (rej.value = lower(x.name) OR rej.mitre_id = lower(x.id)))""")
def rejection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 10).alias("k"))
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report"), (F.col("s_suppkey") % 10).alias("k")).join(part, "k").select("report", F.expr("concat('N', p_partkey % 200)").alias("name"), F.expr("concat('T', p_partkey % 90)").alias("id")).distinct()
    return review.unrejected(rows, _entities(spark, sf_dir), ("ttp",))


@query("""WITH r AS (SELECT DISTINCT l_suppkey report, 'T' || (1000 + l_partkey % 30) || CASE WHEN l_linenumber % 2 = 0 THEN '.001' ELSE '' END id FROM lineitem), w AS (SELECT DISTINCT s_suppkey report, 'T' || (1000 + n) || x id FROM supplier, range(50) t(n), (SELECT unnest(['', '.001']) x))
SELECT report, id FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.report = w.report AND (r.id = w.id OR split_part(r.id, '.', 1) = w.id))""")
def duplicate_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("report"), F.expr("concat('T', 1000 + l_partkey % 30, if(l_linenumber % 2 = 0, '.001', ''))").alias("id")).distinct()
    raw = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report"), F.explode(F.expr("flatten(transform(sequence(1000, 1049), n -> array(concat('T', n), concat('T', n, '.001'))))")).alias("id"))
    return review.uncovered(raw, ids)


@query("""WITH t AS (SELECT l_suppkey report, 'T' || l_partkey id, any_value('n' || (l_partkey % 20)) AS name, max(l_discount) * 9 c FROM lineitem GROUP BY 1, 2) SELECT report, string_agg(name || ' (' || id || ')', ', ' ORDER BY c DESC, id) AS techniques
FROM (SELECT *, row_number() OVER (PARTITION BY report ORDER BY c DESC, id) r FROM t WHERE c >= 0.55) WHERE r <= 5 GROUP BY report""")
def context_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("report"), F.expr("concat('T', l_partkey)").alias("id")).agg((F.max("l_discount") * 9).alias("confidence"), F.max(F.expr("concat('n', l_partkey % 20)")).alias("name"))
    return review.sure_techniques(rows)


@query("""SELECT report, kind, value, greatest(0, n - 30) AS omitted FROM (SELECT l_suppkey report, l_returnflag kind, l_partkey AS value, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_orderkey * 10 + l_linenumber, l_partkey) r, count(*) OVER (PARTITION BY l_suppkey) n FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_partkey, l_orderkey, l_linenumber FROM lineitem)) WHERE r <= 30""")
def indicator_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("report"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("value"), "l_orderkey", "l_linenumber").distinct()
    return review.prompt_indicators(rows.withColumn("pos", F.struct(F.expr("l_orderkey * 10 + l_linenumber"), F.col("value"))).drop("l_orderkey", "l_linenumber"))


@query("""WITH c AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{5,}') w FROM documents) SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 200 AND (doc_id % 3 = 0 OR (doc_id % 2 = 0 AND w <> '')) AS signals FROM c""")
def chunk_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("report"), F.lit(0).alias("chunk_no"), F.col("text").alias("chunk"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("entities"))
    names = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("report"), F.upper(F.regexp_extract("text", "[A-Za-z]{5,}", 0)).alias("value")).where("value <> ''")
    return review.has_signals(chunks, names).select(F.col("report").alias("doc_id"), "signals")

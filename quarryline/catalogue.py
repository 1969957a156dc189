"""All queries of the engine by name, and their SQL twins.

The rule store's roles are played by the order tables: a rule is an order, its
format the status, its severity the priority, its corpus the customer's nation,
its license the region; techniques and atoms are the parts of its lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import extract, graph, merge, review, rules
from .sources import rulefiles
from .streaming import progress

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (_t(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    kind = F.when(F.col("o_orderstatus") == "F", "sigma").when(F.col("o_orderstatus") == "O", "suricata").otherwise("yara")
    return rows.select(
        F.col("o_orderkey").alias("rule_id"), kind.alias("format"), F.col("o_orderpriority").alias("severity"), F.col("n_name").alias("corpus"), F.col("r_name").alias("license"),
        F.col("n_regionkey").alias("priority"), F.col("o_custkey").alias("cluster"), F.concat("c_mktsegment", F.lit(" "), "o_orderpriority").alias("title"), F.length(F.concat("o_orderpriority", "c_name")).cast("long").alias("size"),
    )


RULES = """rules AS (SELECT o_orderkey rule_id, CASE o_orderstatus WHEN 'F' THEN 'sigma' WHEN 'O' THEN 'suricata' ELSE 'yara' END "format",
  o_orderpriority severity, n_name corpus, r_name license, n_regionkey priority, o_custkey "cluster", c_mktsegment || ' ' || o_orderpriority title,
  CAST(length(o_orderpriority || c_name) AS BIGINT) size
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
TAGS = "tags AS (SELECT DISTINCT l_orderkey rule_id, l_partkey technique FROM lineitem)"


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rule_id"), F.col("l_partkey").alias("technique")).distinct()


# --- indicators and text ---------------------------------------------------------

_IPV4 = r"""SELECT doc_id, p AS value FROM (SELECT doc_id, unnest(string_split_regex(text, '[^0-9.]+')) p FROM documents)
  WHERE regexp_full_match(p, '((25[0-5]|2[0-4][0-9]|[01][0-9]{2}|[0-9]{1,2})\.){3}(25[0-5]|2[0-4][0-9]|[01][0-9]{2}|[0-9]{1,2})')"""
_HASH = """SELECT doc_id, lower(p) AS value FROM (SELECT doc_id, unnest(string_split_regex(text, '[^0-9a-zA-Z]+')) p FROM documents)
  WHERE regexp_full_match(p, '[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32}')"""
_EMAIL = r"SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))) AS value FROM documents"


def _kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(T.found(F.col("text"), kind)).alias("value"))


@query(_IPV4)
def ioc_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kind(spark, sf_dir, "ipv4")


@query(_HASH)
def ioc_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kind(spark, sf_dir, "hash")


@query(_EMAIL)
def ioc_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kind(spark, sf_dir, "email")


@query(f"""WITH e AS (SELECT DISTINCT doc_id, kind, value FROM (SELECT 'ipv4' kind, * FROM ({_IPV4}) UNION ALL SELECT 'hash', * FROM ({_HASH}) UNION ALL SELECT 'email', * FROM ({_EMAIL})))
SELECT source, kind, count(*) AS n, count(DISTINCT value) AS distinct_values FROM e JOIN documents USING (doc_id) GROUP BY source, kind""")
def ioc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    found = extract.indicators(docs.select("doc_id", "text"))
    return found.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("distinct_values"))


@query(f"""SELECT DISTINCT value, NOT (a IN (0, 127) OR a >= 224 OR (a = 169 AND b = 254)) AS indicator
FROM (SELECT value, CAST(split_part(value, '.', 1) AS INT) a, CAST(split_part(value, '.', 2) AS INT) b FROM ({_IPV4}))""")
def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc_ipv4(spark, sf_dir).select("value", T.public_ipv4(F.col("value")).alias("indicator")).distinct()


@query(f"SELECT DISTINCT value, replace(value, '.', '[.]') AS defanged, value AS refanged FROM ({_IPV4})")
def refang_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ioc_ipv4(spark, sf_dir).distinct().select("value").distinct().withColumn("defanged", F.replace("value", F.lit("."), F.lit("[.]")))
    return rows.withColumn("refanged", T.refang(F.col("defanged")))


_IDS = "'x CVE-' || (2000 + doc_id % 25) || '-' || (1000 + doc_id) || ' T' || (1000 + doc_id % 9000) || '.001 AS' || (doc_id + 1) || ' 00-1A-2b-3c-4d-0' || (doc_id % 10)"


@query(f"""SELECT doc_id, upper(regexp_extract(s, 'CVE-[0-9]{{4}}-[0-9]{{4,7}}')) AS cve, regexp_extract(s, 'T[0-9]{{4}}\\.[0-9]{{3}}') AS technique, regexp_extract(s, 'AS[0-9]+') AS asn,
lower(replace(regexp_extract(s, '([0-9A-Fa-f]{{2}}-){{5}}[0-9A-Fa-f]{{2}}'), '-', ':')) AS mac FROM (SELECT doc_id, {_IDS} AS s FROM documents)""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.expr(_IDS).alias("s"))
    return rows.select("doc_id", *[T.found(F.col("s"), k)[0].alias(k) for k in ("cve", "technique", "asn", "mac")])


@query(r"SELECT doc_id, md5(regexp_replace(t, '([A-Za-z0-9])-[ \t]*\n\n?[ \t]*([A-Za-z0-9])', '\1-\2', 'g')) AS joined FROM (SELECT doc_id, replace(text, ' th', '-' || chr(10) || 'th') t FROM documents)")
def hyphen_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" th"), F.lit("-\nth")).alias("t"))
    return rows.select("doc_id", F.md5(T.rejoin_hyphens(F.col("t"))).alias("joined"))


@query(r"""SELECT page_id, length(x) AS chars, md5(x) AS md5 FROM (SELECT page_id, regexp_replace(regexp_replace(
replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n]*\n[ \t\n]*', chr(10), 'g'), '^\n+|\n+$', '', 'g') x FROM pages)""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("x"))
    return rows.select("page_id", F.length("x").cast("long").alias("chars"), F.md5("x").alias("md5"))


_SENTENCES = r"""SELECT doc_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars FROM (SELECT doc_id, trim(s, ' ' || chr(9) || chr(10) || chr(13)) s FROM
(SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+|;\s+')) s FROM documents)) WHERE length(s) > 20 GROUP BY doc_id"""


@query(_SENTENCES)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.sentence_table(_t(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).cast("long").alias("chars"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 rn, greatest(1, count(*) OVER (PARTITION BY user_id) // 5) step FROM events)
WHERE rn % step = 0 AND rn // step < 5""")
def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.strided(_t(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 5)


@query()
def chunk_pack_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.chunks(_t(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("md5"))


# --- the rule store --------------------------------------------------------------


@query(f"WITH {TAGS} SELECT technique, count(*) AS df FROM tags WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = rule_id AND o_orderstatus <> 'P') GROUP BY technique")
def technique_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rule_id"), (F.col("o_orderstatus") != "P").alias("is_canonical"))
    return rules.document_frequency(rules.canonical_only(_tags(spark, sf_dir), known), "technique")


@query(f"WITH {TAGS} SELECT rule_id, count(*) AS breadth FROM tags GROUP BY rule_id")
def rule_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("breadth"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query(f"""WITH {TAGS}, n AS (SELECT count(*)::DOUBLE n FROM orders) SELECT technique, round(CASE WHEN n <= 1 THEN 1 ELSE greatest(0, least(1, ln(n / (1 + df)) / ln(n))) END, 6) AS idf
FROM (SELECT technique, count(*) df FROM tags GROUP BY technique), n""")
def idf_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.lit(float(_t(spark, sf_dir, "orders").count()))
    df = rules.document_frequency(_tags(spark, sf_dir), "technique")
    return df.select("technique", F.round(T.idf(F.col("df"), total), 6).alias("idf"))


@query(f"""WITH {TAGS}, n AS (SELECT count(*)::DOUBLE n FROM orders), d AS (SELECT technique, count(*) df FROM tags GROUP BY technique),
w AS (SELECT rule_id, max(0.30 * greatest(0.15, greatest(0, least(1, ln(n / (1 + df)) / ln(n)))) * CASE WHEN technique % 3 = 0 THEN 0.6 ELSE 1 END) w, count(*) b FROM tags JOIN d USING (technique), n GROUP BY rule_id)
SELECT rule_id, round(w / sqrt(b), 6) AS weight FROM w""")
def technique_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _tags(spark, sf_dir)
    total = _t(spark, sf_dir, "orders").count()
    rows = tags.withColumn("by_parent", F.col("technique") % 3 == 0)
    return rules.technique_weights(rows, rules.document_frequency(tags, "technique"), total).select("rule_id", F.round("weight", 6).alias("weight"))


@query("""SELECT l_orderkey, round(1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(list_slice(list_reverse_sort(list(l_discount + l_tax)), 1, 4), lambda w: 1 - greatest(0, least(1, w)))), lambda a, x: a * x), 9) AS score
FROM lineitem GROUP BY l_orderkey""")
def noisy_or_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_discount") + F.col("l_tax")).alias("w"))
    return rows.select("l_orderkey", F.round(T.noisy_or(F.col("w")), 9).alias("score"))


@query("SELECT l_orderkey, l_suppkey, l_linenumber, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_discount DESC, l_linenumber) = 1")
def best_match_per_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount")
    return merge.first_by(rows, ["l_orderkey", "l_suppkey"], F.desc("l_discount"), "l_linenumber")


@query("""SELECT DISTINCT l_orderkey AS rule_id, p_partkey AS atom, s_suppkey AS observable FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE p_size % 4 = s_nationkey % 4 OR (p_size % 4 = 1 AND s_nationkey % 4 = 2)""")
def exact_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([(k, k) for k in range(4)] + [(2, 1)], "oc int, ac int")
    atoms = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("rule_id"), F.col("p_partkey").alias("atom"), F.col("l_suppkey").alias("s_suppkey"), (F.col("p_size") % 4).alias("ac"))
    seen = _t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 4).alias("oc"))
    return atoms.join(seen, "s_suppkey").join(F.broadcast(classes), ["oc", "ac"]).select("rule_id", "atom", F.col("s_suppkey").alias("observable")).distinct()


@query("""SELECT p_name AS atom, n AS needle FROM (SELECT DISTINCT p_name FROM part) p, (SELECT p_brand n FROM part UNION SELECT p_name FROM part) q
WHERE p_name <> n AND least(length(n), length(p_name)) >= 8 AND (contains(p_name, n) OR contains(n, p_name)) AND least(length(n), length(p_name)) >= 0.5 * greatest(length(n), length(p_name))""")
def substring_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    return rules.contained(part.select(F.col("p_name").alias("atom")), part.select(F.explode(F.array("p_name", "p_brand")).alias("needle")))


COVERAGE = f"""{TAGS}, {RULES}, refs AS (SELECT DISTINCT t.technique, r."cluster" native_key, r.corpus FROM tags t JOIN rules r USING (rule_id)),
own AS (SELECT native_key, min(corpus) "owner" FROM refs GROUP BY native_key)"""


@query(f"""WITH {COVERAGE} SELECT technique, CAST(CASE WHEN count(DISTINCT "owner") >= 2 THEN 3 ELSE 2 END AS INT) AS score, count(DISTINCT native_key) AS rule_count, array_to_string(list_sort(list(DISTINCT "owner")), ',') AS corpora
FROM refs JOIN own USING (native_key) GROUP BY technique""")
def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _tags(spark, sf_dir).join(_rules(spark, sf_dir), "rule_id").select("technique", F.col("cluster").alias("native_key"), "corpus")
    return rules.coverage(refs).withColumn("corpora", F.concat_ws(",", "corpora"))


@query(f"""WITH {COVERAGE}, c AS (SELECT technique, count(DISTINCT "owner") o FROM refs JOIN own USING (native_key) GROUP BY technique)
SELECT s.score, count(c.technique) AS techniques FROM (SELECT unnest([0, 1, 2, 3]) score) s LEFT JOIN c ON s.score = CASE WHEN o >= 2 THEN 3 ELSE 2 END GROUP BY s.score""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = spark.createDataFrame([(k,) for k in range(4)], "score int")
    return scores.join(coverage_score(spark, sf_dir), "score", "left").groupBy("score").agg(F.count("technique").alias("techniques"))


@query(f"""WITH {TAGS}, {RULES}, c AS (SELECT technique, "format", count(*) n FROM tags JOIN rules USING (rule_id) GROUP BY ALL)
SELECT technique, f AS "format", coalesce(n, 0) AS rule_count FROM (SELECT DISTINCT technique FROM tags) t CROSS JOIN (SELECT unnest(['sigma', 'suricata', 'yara']) f) LEFT JOIN c USING (technique) WHERE c."format" = f
UNION ALL SELECT technique, f, 0 FROM (SELECT DISTINCT technique FROM tags) t CROSS JOIN (SELECT unnest(['sigma', 'suricata', 'yara']) f) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.technique = t.technique AND c."format" = f)""")
def coverage_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tags(spark, sf_dir).join(_rules(spark, sf_dir), "rule_id").groupBy("technique").pivot("format", list(rules.FORMATS)).agg(F.count(F.lit(1)))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.coalesce(F.col(f), F.lit(0)).alias("rule_count")) for f in rules.FORMATS]))
    return rows.select("technique", each.alias("e")).select("technique", "e.*")


@query(f"""WITH {RULES}, g AS (SELECT lower("format") f, lower(corpus) c, lower(license) l, lower(severity) s, size FROM rules)
SELECT CASE WHEN grouping(f) = 0 THEN 'format' WHEN grouping(c) = 0 THEN 'corpus' WHEN grouping(l) = 0 THEN 'license' ELSE 'severity' END AS axis, coalesce(f, c, l, s) AS value, count(*) AS rules, CAST(sum(size) AS BIGINT) AS chars
FROM g GROUP BY GROUPING SETS ((f), (c), (l), (s))""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.facets(_rules(spark, sf_dir), ("format", "corpus", "license", "severity"), "size")


@query(f"""WITH {RULES}, e AS (SELECT *, row_number() OVER (PARTITION BY "cluster" ORDER BY priority, corpus, rule_id) = 1 keep FROM rules)
SELECT corpus, license, count(*) AS rules, CAST(sum(CAST(keep AS INT)) AS BIGINT) AS canonical FROM e GROUP BY corpus, license""")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.elected(_rules(spark, sf_dir), "cluster", "priority")
    return rows.groupBy("corpus", "license").agg(F.count(F.lit(1)).alias("rules"), F.sum(F.col("is_canonical").cast("long")).alias("canonical"))


@query(f"""WITH {RULES} SELECT r.rule_id, array_to_string(list_sort(list(DISTINCT o.corpus) FILTER (o.corpus <> r.corpus)), ',') AS also_in
FROM rules r JOIN (SELECT DISTINCT title, corpus FROM rules) o ON r.title = o.title GROUP BY r.rule_id""")
def also_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rules(spark, sf_dir)
    others = rows.groupBy("title").agg(F.collect_set("corpus").alias("all"))
    return rows.join(others, "title").select("rule_id", F.concat_ws(",", F.sort_array(F.array_except("all", F.array("corpus")))).alias("also_in"))


@query(f"""WITH {RULES}, b AS (SELECT rule_id, "format" f, 'rules/' || "format" || '/' || corpus || '__' || substr(regexp_replace(regexp_replace(title, '[^A-Za-z0-9_\\-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) base FROM rules WHERE lower(license) IN ('asia', 'europe') AND "format" = 'sigma'),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY rule_id) rn FROM b) SELECT rule_id, base || CASE WHEN rn > 1 THEN '_' || rn ELSE '' END || '.yml' AS path FROM n""")
def export_filter_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rules(spark, sf_dir)
    return rules.manifest(rows.where(rules.axis(F.col("license")).isin("asia", "europe") & (rules.axis(F.col("format"), "sigma") == "sigma")))


# --- graph -----------------------------------------------------------------------

EDGES = """edges AS (SELECT DISTINCT l_suppkey src, ['uses', 'variant-of', 'exploits', 'indicates'][l_linenumber % 4 + 1] verb, l_partkey % 97 tgt, CAST(l_quantity AS INT) confidence FROM lineitem)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed graph of all lines."""
    verbs = F.array(*map(F.lit, ("uses", "variant-of", "exploits", "indicates")))
    rows = _t(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", F.col("l_suppkey").alias("src"), verbs[F.col("l_linenumber") % 4].alias("verb"), (F.col("l_partkey") % 97).alias("tgt"), F.col("l_quantity").cast("int").alias("confidence"))


@query(f"""WITH {EDGES}, t(v1, v2, verb) AS (VALUES ('uses','uses','uses'), ('attributed-to','attributed-to','attributed-to'), ('attributed-to','uses','uses'), ('uses','variant-of','uses'), ('variant-of','uses','uses'),
('variant-of','variant-of','variant-of'), ('uses','exploits','targets'), ('indicates','uses','indicates'), ('indicates','variant-of','indicates'))
SELECT a.src, t.verb, b.tgt, max(CAST(floor(least(a.confidence, b.confidence) / 100 * 0.9 * 100) AS INT)) AS confidence FROM edges a JOIN edges b ON a.tgt = b.src JOIN t ON t.v1 = a.verb AND t.v2 = b.verb
WHERE a.src <> b.tgt AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = a.src AND e.verb = t.verb AND e.tgt = b.tgt) GROUP BY ALL ORDER BY 1, 2, 3 LIMIT 200""")
def transitive_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.composed(_edges(spark, sf_dir))


@query("SELECT node, count(*) AS degree FROM (SELECT l_suppkey node FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) GROUP BY node")
def degree_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey a, o_custkey // 7 * 7 b FROM orders), both_ AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a node, a seen FROM both_ UNION SELECT r.node, both_.b FROM r JOIN both_ ON both_.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.expr("o_custkey div 7 * 7").alias("tgt")).distinct()
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return graph.least_labels(edges, f"{root}/components-{uuid.uuid4().hex}")


@query("""SELECT src, verb, tgt FROM (SELECT a.s_suppkey src, 'related-to' verb, b.s_suppkey tgt, row_number() OVER (PARTITION BY a.s_nationkey, b.s_nationkey ORDER BY a.s_suppkey, b.s_suppkey) rn
FROM supplier a JOIN supplier b ON b.s_nationkey = a.s_nationkey + 1 AND a.s_suppkey <> b.s_suppkey) WHERE rn <= 200""")
def pin_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("type"))
    table = spark.createDataFrame([(k, "related-to", k + 1) for k in range(25)], "src_type int, verb string, tgt_type int")
    return graph.pinned(objects, table)


# --- merging and measurement -----------------------------------------------------


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) n, min(event_id) f FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1")
def campaign_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.most_common(_t(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_by(_t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.desc("event_id"))


@query("""WITH t AS (SELECT DISTINCT o_custkey report, CASE WHEN o_orderkey % 3 = 0 THEN 'T' || (1000 + o_orderkey % 20) ELSE 'T' || (1000 + o_orderkey % 20) || '.001' END technique FROM orders)
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.report = t.report AND u.technique LIKE '%.%' AND split_part(u.technique, '.', 1) = t.technique)""")
def parent_subsume(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("T"), (1000 + F.col("o_orderkey") % 20).cast("string"))
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report"), F.when(F.col("o_orderkey") % 3 == 0, name).otherwise(F.concat(name, F.lit(".001"))).alias("technique")).distinct()
    return merge.without_parents(rows, "report", "technique")


@query("""WITH p AS (SELECT l_suppkey, l_partkey, max(l_discount) * 9 c, CASE WHEN min(l_linenumber) = 1 THEN 'observed' ELSE 'assessed' END label FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL),
s AS (SELECT DISTINCT l_suppkey, l_partkey, true both_ FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT l_suppkey, l_partkey, round(CASE WHEN both_ THEN least(1, c + 0.10) ELSE greatest(0, c - 0.20) END, 6) AS confidence, CASE WHEN both_ IS NULL AND label = 'observed' THEN 'reported' ELSE label END AS label FROM p LEFT JOIN s USING (l_suppkey, l_partkey)""".replace(" GROUP BY ALL)", " GROUP BY l_suppkey, l_partkey)", 1))
def consensus_regrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, rows = ["l_suppkey", "l_partkey"], _t(spark, sf_dir, "lineitem")
    first = rows.where("l_orderkey % 2 = 0").groupBy(*keys).agg((F.max("l_discount") * 9).alias("confidence"), F.when(F.min("l_linenumber") == 1, "observed").otherwise("assessed").alias("label"))
    return merge.regraded(first, rows.where("l_orderkey % 2 = 1"), keys).withColumn("confidence", F.round("confidence", 6))


@query("""WITH s AS (SELECT o_custkey sample, list(DISTINCT o_orderkey % 9) FILTER (o_orderkey % 2 = 0) p, list(DISTINCT o_orderkey % 9) FILTER (o_orderkey % 3 <> 0) g FROM orders GROUP BY 1),
n AS (SELECT sample, coalesce(len(p), 0) p, coalesce(len(g), 0) g, coalesce(len(list_intersect(p, g)), 0) tp FROM s),
m AS (SELECT sample, CASE WHEN p = 0 AND g = 0 THEN 1.0 WHEN p = 0 THEN 0 ELSE tp / p END pr, CASE WHEN p = 0 AND g = 0 THEN 1.0 WHEN g = 0 THEN 0 ELSE tp / g END re FROM n)
SELECT sample, round(pr, 6) AS "precision", round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM m""")
def prf_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("o_orderkey") % 9
    rows = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, label)).alias("p"), F.collect_set(F.when(F.col("o_orderkey") % 3 != 0, label)).alias("g"))
    return merge.set_scores(rows, "p", "g").select("sample", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_NEAREST = """SELECT q.vec_id AS query, c.vec_id AS hit, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id DESC) AS rank
FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id QUALIFY rank <= 5"""


@query(_NEAREST)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return merge.nearest(e.where("vec_id % 100 = 0"), e, 5).withColumn("score", F.round("score", 6))


@query(f"SELECT count(*) AS hits, CAST(sum(CAST(a.label = b.label AS INT)) AS BIGINT) AS right_label FROM ({_NEAREST}) n JOIN embeddings a ON a.vec_id = n.query JOIN embeddings b ON b.vec_id = n.hit")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    found = cosine_topk(spark, sf_dir).join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("gold")), "query").join(e.select(F.col("vec_id").alias("hit"), "label"), "hit")
    return found.agg(F.count(F.lit(1)).alias("hits"), F.sum((F.col("gold") == F.col("label")).cast("long")).alias("right_label"))


@query("SELECT user_id, arg_max(event_type, event_id) AS status, count(*) AS n FROM events WHERE event_id > 100 GROUP BY user_id")
def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.state(progress.tail(_t(spark, sf_dir, "events"), 100))


@query("SELECT event_id, user_id, count(*) OVER w AS seen, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def event_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.running(_t(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.windowed(_t(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


# --- rule files and review -------------------------------------------------------

_LINE = """'alert tcp $HOME any -> ' || p_size || ' any (msg:"' || p_name || '; (x)"; content:"|41|"; metadata:signature_severity Major, mitre_technique_id T' || (1000 + p_size) || '; sid:' || p_partkey || '; rev:2;)'"""


@query("""SELECT p_partkey AS rule, 'alert' AS action, 'alert tcp $HOME any -> ' || p_size || ' any' AS header, p_name || '; (x)' AS msg, CAST(p_partkey AS VARCHAR) AS sid, 'high' AS severity,
'T' || (1000 + p_size) AS technique, CAST(5 AS INT) AS options, sha256('tcp $HOME any -> ' || p_size || ' any' || chr(10) || 'content:"|41|"') AS dedup_key FROM part""")
def suricata_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule"), F.expr(_LINE).alias("line"))
    rows = rulefiles.suricata_rules(lines)
    return rows.select("rule", "action", "header", "msg", "sid", "severity", F.array_join("techniques", ",").alias("technique"), F.size("options").alias("options"), "dedup_key")


_YARA = """'import "pe"\\n// rule no {\\nrule r' || p_partkey || ' : a b { meta: author = "' || p_name || '"\\n ref = "T1059"\\n strings: $a = "x} ' || p_name || '" $b = { 9C 5? }\\n condition: any of them }\\nprivate rule p { condition: true }'"""


@query("""SELECT 'r' || p_partkey AS name, 'a,b' AS tags, p_name AS author, 'T1059' AS technique, 'x} ' || p_name AS first_string, '9C 5?' AS second_string, 'any of them' AS "condition", 'pe' AS imports FROM part""")
def yara_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rulefiles.yara_rules(_t(spark, sf_dir, "part").select(F.lit("f").alias("path"), F.expr(_YARA).alias("content")))
    strings = F.col("strings")
    return rows.select(
        "name", F.array_join("tags", ",").alias("tags"), F.col("meta")["author"].alias("author"), F.array_join("techniques", ",").alias("technique"), strings[0]["value"].alias("first_string"),
        strings[1]["value"].alias("second_string"), "condition", F.array_join("imports", ",").alias("imports"),
    )


_SIGMA = """'title: ' || p_name || '\\nid: s' || p_partkey || '\\nlevel: High\\ntags: [attack.t1059.001, attack.execution]\\nlogsource: {product: Windows}\\ndetection: {s: {Image: a}, condition: s}\\n---\\ntitle: none\\n'"""


@query("SELECT 's' || p_partkey AS sigma_id, p_name AS title, 'high' AS level, 'windows' AS product, 'T1059.001' AS technique FROM part")
def sigma_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rulefiles.sigma_rules(_t(spark, sf_dir, "part").select(F.lit("f").alias("path"), F.expr(_SIGMA).alias("content")))
    return rows.select("sigma_id", "title", "level", "product", F.array_join("techniques", ",").alias("technique"))


@query(f"""SELECT DISTINCT 'ipv4-addr' AS kind, value, '[ipv4-addr:value = ''' || value || ''']' AS pattern FROM ({_IPV4}) UNION ALL
SELECT DISTINCT 'email-addr', value, '[email-addr:value = ''' || value || ''']' FROM ({_EMAIL}) UNION ALL
SELECT DISTINCT 'hash', value, '[file:hashes.' || CASE length(value) WHEN 64 THEN '''SHA-256''' WHEN 40 THEN '''SHA-1''' ELSE 'MD5' END || ' = ''' || value || ''']' FROM ({_HASH})""")
def stix_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"ipv4": "ipv4-addr", "email": "email-addr", "hash": "hash"}
    found = extract.indicators(_t(spark, sf_dir, "documents").select("doc_id", "text")).where(F.col("kind").isin(*kinds))
    rows = found.select(F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("kind")].alias("kind"), "value").distinct()
    return rows.select("kind", "value", review.stix_pattern(F.col("kind"), F.col("value")).alias("pattern"))


@query(f"""SELECT DISTINCT doc_id, "class", value FROM (SELECT doc_id, 'email' "class", value FROM ({_EMAIL}) UNION ALL SELECT doc_id, 'domain', split_part(value, '@', -1) FROM ({_EMAIL}))""")
def observable_explosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.observables(_kind(spark, sf_dir, "email").withColumn("kind", F.lit("email")), "doc_id")


@query(r"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[/?#].*$', ''), ':[0-9]*$', '')) AS host FROM pages")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


_EDGE_SQL = """SELECT CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END accepted, l_discount * 10 confidence,
CASE WHEN l_linestatus = 'F' THEN 'inferred' WHEN l_linenumber = 1 THEN 'observed' WHEN l_linenumber < 4 THEN 'reported' END label FROM lineitem"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_EDGE_SQL.replace("FROM lineitem", "FROM {t}"), t=_t(spark, sf_dir, "lineitem"))


@query(f"""SELECT label, coalesce(CAST(accepted AS VARCHAR), 'pending') AS accepted, auto, count(*) AS n FROM (SELECT coalesce(label, '(unlabelled)') label, accepted, accepted IS NULL AND (coalesce(label, '') = 'observed'
OR (round(confidence * 100) >= 90 AND coalesce(label, '') NOT IN ('gap', 'inferred'))) auto FROM ({_EDGE_SQL})) GROUP BY ALL""")
def auto_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviewed(spark, sf_dir).withColumn("auto", review.auto_accepted(F.col("accepted"), F.col("label"), F.col("confidence")))
    return rows.groupBy(F.coalesce("label", F.lit("(unlabelled)")).alias("label"), F.coalesce(F.col("accepted").cast("string"), F.lit("pending")).alias("accepted"), "auto").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT coalesce(label, '(unlabelled)') AS label, count(*) AS n FROM ({_EDGE_SQL}) WHERE coalesce(accepted, true) GROUP BY 1")
def label_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.census(_reviewed(spark, sf_dir).where(review.visible(F.col("accepted"))), "label", "(unlabelled)")


@query("""WITH v AS (SELECT user_id, event_type h, count(DISTINCT event_id // 3) n FROM events GROUP BY ALL),
r AS (SELECT user_id, h, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h DESC) rn, coalesce(lead(n) OVER (PARTITION BY user_id ORDER BY n DESC, h DESC), 0) n2 FROM v)
SELECT user_id, CASE WHEN n >= 2 AND n >= 2 * n2 THEN h ELSE 'multi' END AS platform FROM r WHERE rn = 1""")
def platform_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.platform(_t(spark, sf_dir, "events").select("user_id", F.expr("event_id div 3").alias("display"), "event_type"), "user_id", "display", "event_type")


@query("""SELECT conv_id, turn, md5(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS around
FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)""")
def sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return review.around(rows, "conv_id", "turn", "text", 1).select("conv_id", "turn", F.md5("around").alias("around"))


@query("""SELECT o_orderstatus AS scope, CASE WHEN n = total THEN 'all' WHEN n = 0 THEN 'none' ELSE 'some' END AS state, n AS selected, bytes FROM (SELECT o_orderstatus, count(*) total,
count(*) FILTER (o_orderpriority <> '1-URGENT') n, CAST(coalesce(sum(o_custkey) FILTER (o_orderpriority <> '1-URGENT'), 0) AS BIGINT) bytes FROM orders GROUP BY 1)""")
def selection_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders")
    return review.selection(rows.withColumnRenamed("o_orderstatus", "scope"), "scope", rows.where("o_orderpriority = '1-URGENT'"), "o_orderkey", "o_custkey")


@query("""SELECT c_custkey, coalesce(n_nationkey, -1) AS src_id, coalesce(r_regionkey, -1) AS tgt_id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON r_name = c_mktsegment""")
def endpoint_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    edges = _t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.upper("n_name").alias("src"), F.col("c_mktsegment").alias("tgt"))
    nodes = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("id")).unionByName(region.select(F.col("r_name").alias("value"), F.col("r_regionkey").alias("id")))
    return review.resolved(edges, nodes, "value", "id").select("c_custkey", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("src_id", "tgt_id")])


@query("SELECT lower(p_type) AS surface, CASE WHEN min(p_brand) = max(p_brand) THEN min(p_brand) END AS p_brand FROM part GROUP BY 1")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.ambiguous_aliases(_t(spark, sf_dir, "part"), "p_type", "p_brand")


@query("SELECT doc_id, CASE WHEN length(text) > 60000 THEN 5000 WHEN length(text) > 30000 THEN 4000 ELSE 3000 END AS chunk FROM documents")
def adaptive_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", review.chunk_size(F.length("text")).alias("chunk"))

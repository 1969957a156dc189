"""Operators on small literal inputs."""

import uuid

from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import extract, graph, merge, rules
from quarryline.streaming import progress


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_refang(spark):
    assert one(spark, "hxxps://evil[.]com a[at]b(dot)org hxxp://x", T.refang) == "https://evil.com a@b.org http://x"


def test_indicators_keep_their_kind(spark):
    text = "10.0.0.1 1.2.3.4.5 a@b.co CVE-2021-44228 T1059.001 AS123 00-1A-2B-3C-4D-5E"
    assert one(spark, text, lambda c: T.found(c, "ipv4")) == ["10.0.0.1"]
    assert one(spark, text, lambda c: T.found(c, "mac")) == ["00:1a:2b:3c:4d:5e"]
    assert one(spark, text, lambda c: T.found(c, "technique")) == ["T1059.001"]
    assert one(spark, None, lambda c: T.found(c, "ipv4")) == []


def test_uuid5(spark):
    space = uuid.NAMESPACE_URL
    for name in ("a", "tool:é"):
        assert one(spark, name, lambda c: T.uuid5(str(space), c)) == str(uuid.uuid5(space, name))


def test_noisy_or_takes_four(spark):
    got = spark.createDataFrame([([0.5] * 9,), ([1.0, 0.2],), ([],)], "w array<double>").select(T.noisy_or(F.col("w")).alias("x")).collect()
    assert [r.x for r in got] == [0.9375, 1.0, 0.0]


def test_chunks_overlap(spark):
    docs = spark.createDataFrame([(1, "\n".join("x" * 90 for _ in range(10))), (2, None), (3, "short")], "doc_id long, text string")
    got = {(r.doc_id, r.chunk_no): r.chunk for r in extract.chunks(docs, 200, 50).collect()}
    assert got[1, 0] == "x" * 90 + "\n" + "x" * 90
    assert got[1, 1].startswith("x" * 50 + "\n\n")
    assert got[3, 0] == "short" and (2, 0) not in got


def test_coverage_counts_owners(spark):
    refs = spark.createDataFrame([("t1", "k1", "b"), ("t1", "k1", "a"), ("t1", "k2", "b"), ("t2", "k1", "b")], "technique string, native_key string, corpus string")
    got = {r.technique: (r.score, r.rule_count, r.corpora) for r in rules.coverage(refs).collect()}
    assert got == {"t1": (3, 2, ["a", "b"]), "t2": (2, 1, ["a"])}


def test_composition_is_one_hop(spark):
    edges = spark.createDataFrame([("a", "uses", "b", 80), ("b", "uses", "c", 50), ("c", "uses", "d", 90)], "src string, verb string, tgt string, confidence int")
    assert [tuple(r) for r in graph.composed(edges).collect()] == [("a", "uses", "c", 45), ("b", "uses", "d", 45)]


def test_least_labels(spark, tmp_path):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 20)] + [(40, 41)], "src long, tgt long")
    got = {r.node: r.component for r in graph.least_labels(edges, str(tmp_path / "c")).collect()}
    assert got == {k: 1 for k in range(1, 21)} | {40: 40, 41: 40}


def test_set_scores(spark):
    rows = spark.createDataFrame([([1], [1, 2]), ([], []), ([], [1])], "p array<int>, g array<int>")
    assert [r.f1 for r in merge.set_scores(rows, "p", "g").collect()] == [2 / 3, 1.0, 0.0]


def test_follow_copies_once(spark, tmp_path):
    src, to, at = (str(tmp_path / x) for x in ("src", "to", "at"))
    rows = spark.createDataFrame([(1, "a")], "event_id long, event_type string")
    for n in (1, 2):
        rows.write.mode("append").parquet(src)
        progress.follow(spark, src, rows.schema, to, at)
        assert spark.read.parquet(to).count() == n


def test_composition_takes_every_edge(spark):
    from quarryline import catalogue

    sf = "/root/testdata/sf0.001"
    verbs = ("uses", "variant-of", "exploits", "indicates")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_partkey", "l_quantity").collect()
    edges = {}
    for r in rows:
        key = (r.l_suppkey, verbs[r.l_linenumber % 4], r.l_partkey % 97)
        edges[key] = max(edges.get(key, 0), int(r.l_quantity))
    out, want = {}, {}
    for (a, v, b), c in edges.items():
        out.setdefault(a, []).append((v, b, c))
    table = {(v1, v2): v for v1, v2, v in graph.TRANSITIVE}
    for (a, v1, mid), c1 in edges.items():
        for v2, b, c2 in out.get(mid, ()):
            key = (a, table.get((v1, v2)), b)
            if key[1] and a != b and key not in edges:
                want[key] = max(want.get(key, 0), int(min(c1, c2) / 100 * 0.9 * 100))
    got = [tuple(r) for r in catalogue.QUERIES["transitive_compose"](spark, sf).select("src", "verb", "tgt", "confidence").collect()]
    assert sorted(got) == [(*k, want[k]) for k in sorted(want)[:200]]


def test_containment_both_ways(spark):
    from quarryline.operators import rules

    atoms = ["meshagent64.exe", "meshagent", "agent", "C:\\temp\\meshagent64.exe", "abababababab", "abababab", "x" * 7, "x" * 16, "x" * 8, None]
    needles = ["meshagent", "meshagent64.exe", "meshagent64.exe.bak", "abababab", "x" * 17, "agent64.exe", "", None]
    got = rules.contained(spark.createDataFrame([(a,) for a in atoms], "atom string"), spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    want = set()
    for a in filter(None, atoms):
        for n in filter(None, needles):
            short, long = sorted((a, n), key=len)
            if a != n and len(short) >= 8 and short in long and len(short) / len(long) >= 0.5:
                want.add((a, n))
    assert sorted((r.atom, r.needle) for r in got) == sorted(want) and ("meshagent", "meshagent64.exe") in want


def test_every_rule_and_vector_is_searched(spark, tmp_path):
    from quarryline import catalogue

    sf = "/root/testdata/sf0.001"
    assert catalogue.QUERIES["also_in"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    rows = [(100, [1.0, 0.0], 1), (200, [1.0, 0.1], 1), (300, [0.0, 1.0], 0), *[(k, [-1.0, float(k)], 0) for k in range(1, 8)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query"], r["rank"]): r["hit"] for r in catalogue.QUERIES["cosine_topk"](spark, str(tmp_path)).collect()}
    assert (got[100, 1], got[200, 1]) == (200, 100) and all(q != hit for (q, _), hit in got.items())

"""What larger tables brought up."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import quarryline.plans  # noqa: F401  adds queries to the catalogue
from quarryline import catalogue, scratch
from quarryline.llm import lines
from quarryline.operators import graph, ranking, relations, rules


def sql_rows(name: str, folder, *tables: str) -> list[tuple]:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con.execute(catalogue.ORACLES[name]).fetchall()


def test_artefacts_of_texts_with_own_domains(spark, tmp_path):
    texts = [(1, "one and.ks two le.rd AS3 T1234 end"), (77, "mail t1.exe@Mail8.Example.com or x@y.org"), (2, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalogue.QUERIES["artefacts"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(sql_rows("artefacts", tmp_path, "documents"))
    whole = {tuple(r) for r in catalogue.QUERIES["artefacts_all"](spark, str(tmp_path)).collect()}
    assert {(1, "domain", "and.ks"), (1, "domain", "le.rd"), (1, "asn", "AS3"), (1, "technique", "T1234"), (2, "asn", "AS2")} <= whole


def saved(spark, monkeypatch, few: int) -> list[str]:
    """Names of the tables that get saved from now on, with ``few`` rows as the most to be broadcast."""
    names, real = [], scratch.save

    def save(df, name, light=False):
        names.append(name)
        return real(df, name, light)

    monkeypatch.setattr(scratch, "save", save)
    monkeypatch.setattr(scratch, "FEW", few)
    return names


@pytest.mark.parametrize("few", [0, 1000])
def test_composition_has_no_exchange_of_all_pairs(spark, monkeypatch, few):
    saved(spark, monkeypatch, few)
    edges = spark.range(4000).selectExpr("id % 200 src", "array('uses', 'variant-of', 'exploits', 'indicates', 'other')[id * 7 % 5] verb", "id * 13 % 31 tgt", "cast(id % 50 + 1 as int) confidence")
    edges = edges.unionAll(spark.sql("select 3L, 'uses', 3L, cast(null as int)"))
    best = {}
    for s, v, t, c in edges.collect():
        best[s, v, t] = max(best.get((s, v, t), 0), 50 if c is None else c)
    want = {}
    for (s, v1, m), c1 in best.items():
        for (x, v2, t), c2 in best.items():
            if m == x and s != t:
                for a, b, v in graph.TRANSITIVE:
                    if (a, b) == (v1, v2) and (s, v, t) not in best:
                        want[s, v, t] = max(want.get((s, v, t), 0), math.floor(min(c1, c2) / 100 * 0.9 * 100))
    made = graph.composed(edges, None)
    assert {tuple(r)[:3]: r[3] for r in made.collect()} == want and made.count() == len(want)
    if few:
        assert made._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1  # all by src
    types = edges.select(F.col("src").alias("id")).union(edges.select("tgt")).distinct().withColumn("type", F.expr("array('malware', 'tool', 'location')[id % 3]"))
    ok = {tuple(r) for r in relations.suggestions(spark).select("src_type", "verb", "tgt_type").collect()}
    kind = lambda i: ("malware", "tool", "location")[i % 3]
    assert {tuple(r)[:3] for r in relations.guarded_composition(edges, types, 10**6).collect()} == {k for k in want if (kind(k[0]), k[1], kind(k[2])) in ok}


@pytest.mark.parametrize("copies", [1, 2])
def test_grounded_pairs_only_what_comes_first(spark, monkeypatch, copies):
    names = saved(spark, monkeypatch, 1000)
    monkeypatch.setattr(relations, "save", scratch.save)
    objects = spark.range(300).selectExpr("id", "array('malware', 'tool', 'attack-pattern')[id % 3] type", "concat('A', id % 7) attack_id")
    if copies > 1:
        objects = objects.unionAll(objects.where("id % 5 = 0").withColumn("attack_id", F.lit("A3")))
    known = spark.range(60).selectExpr("concat('A', id % 7) src_id", "array('uses', 'targets', 'variant-of')[id % 3] verb", "concat('A', id * 3 % 7) tgt_id")
    edges = spark.range(20000).selectExpr("id % 40 src", "'uses' verb", "id * 7 % 300 tgt")
    whole = sorted(tuple(r) for r in relations.grounded(objects, known, edges, None).collect())
    some = [tuple(r) for r in relations.grounded(objects, known, edges, 200).collect()]
    assert len(some) == 200 and [r[:3] for r in some] == [r[:3] for r in whole][:200]
    assert set(some) <= set(whole) and "sure" in names
    there, obj = {tuple(r) for r in edges.collect()}, [tuple(r) for r in objects.collect()]
    ok = {tuple(r) for r in relations.suggestions(spark).select("src_type", "verb", "tgt_type").collect()} | {(k, v, k) for k in ("malware", "tool", "attack-pattern") for v in ("derived-from", "duplicate-of")}
    pairs = {tuple(r) for r in known.collect()}
    want = [(x, v, y, f"attack-reference:{i}>{j}") for x, s, i in obj for y, t, j in obj if x != y for v in ("uses", "targets", "variant-of") if (i, v, j) in pairs and (s, v, t) in ok and (x, v, y) not in there]
    assert sorted(r[:3] + r[5:] for r in whole) == sorted(want)


def test_coverage_of_many_reports_by_bits(spark, monkeypatch):
    names = saved(spark, monkeypatch, 100)
    monkeypatch.setattr(rules, "save", scratch.save)
    wanted = spark.range(700).selectExpr("id % 70 report", "concat('t', id * 3 % 11, array('', '.1', '.2')[id % 3]) technique").unionAll(spark.sql("select 99L, 'none5'"))
    refs = spark.range(900).selectExpr("concat('T', id * 7 % 13, array('', '.1')[id % 2]) technique", "if(id % 17 = 0, null, concat('c', id * 5 % 6)) corpus", "id % 150 native_key", "array('yara', 'sigma', 'suricata')[id * 11 % 3] format")
    refs = refs.unionAll(refs.limit(50)).unionAll(refs.limit(20).withColumn("native_key", F.lit(None).cast("long")))
    asked, rows = {(r, t.upper()) for r, t in wanted.collect()}, [tuple(r) for r in refs.collect() if r.native_key is not None]
    want = {}
    for report in {r for r, _ in asked}:
        mine = {t for r, t in asked if r == report}
        held = [(t, k, c, f) for tag, c, k, f in rows for t in mine if tag in (t, t.split(".")[0])]
        least = lambda key, n: min((h[n] for h in held if h[1] == key and h[n] is not None), default=None)  # noqa: B023, E731
        for t in mine:
            keys = [(least(k, 2), least(k, 3)) for k in {h[1] for h in held if h[0] == t}]
            cells = tuple((f, len([1 for _, g in keys if g == f]), tuple(sorted({c for c, g in keys if g == f and c}))) for f in rules.FORMATS)
            owners = sorted({c for c, _ in keys if c})
            want[report, t] = (3 if len(owners) > 1 else 2 if owners else int(t == "NONE5"), len(keys), owners, cells)
    got = {(r.report, r.technique): (r.score, r.rule_count, r.corpora, tuple((f.format, f.rule_count, tuple(f.corpora)) for f in r.formats)) for r in rules.coverage_of(wanted, refs, spark.sql("select 'none5' technique")).collect()}
    assert got == want and "tags" in names


def brute_proposals(seen, wanted, atoms, tags, store, os, total):
    """(report, rule_id): score, tier, techniques, evidence of every candidate, pair by pair."""
    idf = lambda n: max(0, min(1, math.log(total / (1 + n)) / math.log(total)))
    held, tagged, df, tag_df, found = {}, {}, {}, {}, {}
    for r, c, v in atoms:
        held.setdefault(r, set()).add((c, v))
    for r, t in tags:
        tagged.setdefault(r, set()).add(t.upper())
    for r, of in held.items():
        for v in {v for _, v in of}:
            df[v] = df.get(v, 0) + 1
    for r, of in tagged.items():
        for t in of:
            tag_df[t] = tag_df.get(t, 0) + 1
    fits = lambda a, b: a != b and min(len(a), len(b)) >= 8 and (a in b or b in a) and 2 * min(len(a), len(b)) >= max(len(a), len(b))
    for report in {x[0] for x in seen} | {x[0] for x in wanted}:
        asked, mine = {t.upper() for r, t in wanted if r == report}, {x[1:] for x in seen if x[0] == report}
        rows = {}
        for rule in held.keys() | tagged.keys():
            own = {t: max((0.3 * max(0.15, idf(tag_df[g])) * (1 if g in asked else 0.6) for g in (t, t.split(".")[0]) if g in tagged.get(rule, ())), default=None) for t in asked}
            own = {t: w for t, w in own.items() if w is not None}
            matches = [(k, v, d, n, int(v != n)) for k, n, d in mine for c, v in held.get(rule, ()) if c in ranking.MATCHABLE.get(k, ()) and (v == n or fits(v, n))]
            if own or any(m[4] == 0 for m in matches):
                rows[rule] = own, matches
        for k, n, d in mine:
            hits = [r for r in rows if r in store and n in store[r][0].lower()] if k == "cve" or k == "name" and len(n) >= 4 else []
            if k == "cve" or len(hits) <= max(1, math.floor(len(rows) * 0.2)):
                for r in hits:
                    rows[r][1].append((k, n, d, n, 2))
        for rule, (own, matches) in rows.items():
            if rule in store:
                best = {}
                for k, v, d, n, s in matches:
                    best[d] = min(best.get(d, (9,)), (-ranking.CLASS_WEIGHT.get(k, 0.3) * idf(df.get(v, 0)) * (0.55 if s == 1 else 1), s))
                shown = sorted((w, d, s) for d, (w, s) in best.items())[:8]
                platform = store[rule][1]
                f = 1.0 if platform in (None, "", os.get(report)) or os.get(report) in (None, "", "multi") else 0.4
                weight = max(own.values()) / math.sqrt(len(tagged[rule])) if own else None
                score = min(1, 1 - math.prod(1 - max(0, min(1, -w)) for w, _, _ in shown[:4]) + (weight or 0)) * f
                tier = "direct" if shown else "behavioural" if own and f == 1 else "weak"
                found[report, rule] = round(score, 9), tier, sorted(own) or None, [(d, round(-w, 9), s) for w, d, s in shown] or None
    return found


@pytest.mark.parametrize("few, batch", [(0, 3), (1000, 1000)])
def test_proposals_by_signatures(spark, monkeypatch, few, batch):
    saved(spark, monkeypatch, few)
    monkeypatch.setattr(ranking, "BATCH", batch)
    kinds = ["file", "domain", "hash", "image", "url"]
    atoms = [(i * 7 % 90, kinds[i % 5], f"value-{i * 11 % 17}-long") for i in range(400)] + [(95, "file", "value-3-long"), (96, "hash", "other")]
    tags = [(i * 3 % 80, f"t{i * 5 % 7}{['', '.1'][i % 2]}") for i in range(200)] + [(97, "t1")]
    seen = [(i % 4, kinds[i * 3 % 5], f"value-{i * 5 % 23}-long" + ["", "er"][i % 2], f"shown {i % 61}") for i in range(900)]
    seen += [(0, "name", "rare", "RARE"), (0, "name", "rule", "RULE"), (1, "cve", "rule", "RULE"), (2, "odd", "x", "X"), (3, "file", "nowhere at all", "N")]
    wanted = [(i % 6, f"T{i % 9}{['', '.1', '.2'][i % 3]}") for i in range(40)] + [(0, "")]
    store = {r: (f"Rule {r % 5}" + (" rare" if r % 11 == 0 else ""), ["windows", "linux", "", None][r % 4]) for r in range(97)}
    os = {0: "windows", 1: "multi", 2: "linux", 3: None}
    tables = [
        spark.createDataFrame(seen, "report int, class string, value string, display string"), spark.createDataFrame(wanted, "report int, technique string"),
        spark.createDataFrame(atoms + atoms[:50], "rule_id long, class string, value string"), spark.createDataFrame(tags + tags[:50], "rule_id long, technique string"),
        spark.createDataFrame([(r, f"c{r % 3}", t[:6], t[6:], p) for r, (t, p) in store.items()], "rule_id long, corpus string, title string, description string, platform string"),
        spark.createDataFrame(list(os.items()), "report int, platform string"),
    ]
    want = brute_proposals(seen, [w for w in wanted if w[1]], atoms, tags, {r: (t[:6] + " " + t[6:], p) for r, (t, p) in store.items()}, os, 100)
    told = lambda r: (round(r.score, 9), r.tier, r.techniques, r.evidence and [(e.display, round(e.m.weight, 9), e.m.source) for e in r.evidence])
    assert {(r.report, r.rule_id): told(r) for r in ranking.proposals(*tables, 100).collect()} == want
    assert {2, 1, 0} <= {e[2] for x in want.values() for e in x[3] or ()} and any(len(x[3] or ()) == 8 for x in want.values())
    counts = {}
    for (r, _), x in want.items():
        counts[r, x[1]] = counts.get((r, x[1]), 0) + 1
    assert {(r.report, r.tier): r.n for r in ranking.tiers(*tables, 100).collect()} == counts
    order = lambda k: (k[0], -want[k][0], f"c{k[1] % 3}", store[k[1]][0][:6], k[1])
    first = [k for r in range(6) for k in sorted((k for k in want if k[0] == r), key=order)[:5]]
    rows = ranking.first_proposals(*tables, 100, limit=5).collect()
    assert sorted(((r.report, r.rule_id) for r in sorted(rows, key=lambda r: (r.report, r.rank)))) == sorted(first) and {(r.report, r.rule_id): told(r) for r in rows} == {k: want[k] for k in first}
    # pairs of a report and a rule are neither shuffled nor sorted
    plan = ranking.Signs(*tables[:5], 100).pairs()._jdf.queryExecution().sparkPlan().toString()
    assert not any(x in plan for x in ("Sort", "Aggregate", "Window", "Join", "Exchange")) and plan.count("MapInArrow") == 1


def test_line_tables_go_when_read(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, f"start{i} {text} end{i}") for i in range(6)], "doc_id long, text string")
    before = len(scratch._SCRATCH)
    assert lines.repeated_runs(docs).count() == 5
    assert [p.rsplit("/", 1)[1] for _, p in scratch._SCRATCH[before:]] == ["runs"]


def without_repeats(rows, n):
    """Words left of each text without the windows of n words that came before."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w, gone = t.split(), set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone |= set(range(k, k + n))
            seen.add(key)
        if left := [x for k, x in enumerate(w) if k not in gone]:
            out[i] = left
    return out


@pytest.mark.parametrize(("n", "ids"), [(2, (0, 1)), (13, (-7, 1 << 40)), (40, (0, 1))])
def test_line_runs_of_any_length_and_ids(spark, n, ids):
    rng = random.Random(n)
    base = [f"w{rng.randrange(400)}" for _ in range(600)] + ["tick"] * 100
    rows = []
    for i in range(60):
        a, b = rng.randrange(600), rng.randrange(600)
        own = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(40))]
        rows.append((ids[0] + i * ids[1], " ".join(base[a : a + rng.randrange(100)] + own + base[b : b + rng.randrange(100)]) or "x"))
    got = {r.doc_id: r.text.split() for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), n).collect()}
    assert got == without_repeats(rows, n)


def test_line_hashes_compiled_and_texts_not_shuffled(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, f"start{i} {text} end{i}" if i < 6 else f"own {i}") for i in range(20)], "doc_id long, text string")
    # a lambda would have them interpreted, word by word
    spans = lines._spans(lines._keyed(docs), 40)._jdf.queryExecution().executedPlan().toString()
    assert not any("xxhash64(slice(" in x and "lambda" in x for x in spans.splitlines()) and "xxhash64(slice(" in spans
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
        plan = lines.line_report(docs)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "LeftOuter" not in plan and "LeftAnti, BuildRight" in plan and "LeftSemi, BuildRight" in plan

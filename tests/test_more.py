"""Operators that SQL can't say, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import dictionary, evaluation, responses, review, sentences
from quarryline.sources import atoms, rulefiles, store


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_wrapped_hashes(spark):
    a, b = "a" * 32, "b" * 32
    cases = [
        (f"{a}\n{b}", [a, b]), (f"SHA256:\n{a}\n{b}", [a + b]), (f"x {a[:20]}\n{a[:12]} y", [a]), (f"md5 {a} {'c' * 8}", [a]), (f"SHA1 {a} {'c' * 8}", [a + "c" * 8]), (None, []), ("", []),
        ("ab cd", []), (f"{a.upper()} {a}", [a]),
    ]
    assert [T.hash_values(t) for t, _ in cases] == [w for _, w in cases]
    assert one(spark, cases[0][0], T.all_hashes) == [a, b]


def test_unwrapped(spark):
    cases = {
        "a wrapped\nline. Next\nhere": "a wrapped line. Next here", "ends.\nNew": "ends.\nNew", "list\n- item\n1. two": "list\n- item\n1. two", "a\r\n\r\nb": "a b", "": "", "x\n \ny": "x\n \ny",
    }
    for text, want in cases.items():
        assert one(spark, text, T.unwrapped) == want
    assert one(spark, None, T.unwrapped) == ""


def test_refang_edges(spark):
    assert one(spark, "http(:)//evil.com a(@)b.c d{@}e meet [at] noon end [.] com x [dot] y https[:]//q", T.refang) == "http://evil.com a@b.c d@e meet @ noon end.com x . y https://q"
    assert one(spark, "hxxps://A[.]b [at] ", T.refang_value) == "https://A.b @"


def test_ipv6_and_domains(spark):
    text = "::1 fe80::1 1:2:3:4:5:6:7:8 1:2:3 12:30 a::b::c 2001:db8::ff00:42:8329."
    assert one(spark, text, lambda c: T.found(c, "ipv6")) == ["::1", "fe80::1", "1:2:3:4:5:6:7:8"]
    assert one(spark, "run.exe evil.com http://evil.com/x b.co.uk", lambda c: T.found(c, "domain")) == ["b.co.uk"]
    got = spark.createDataFrame([(x,) for x in ("127.0.0.1", "::1", "10.0.0.1", "odd", "ff02::1")], "x string").select(T.public_ipv4(F.col("x"))).collect()
    assert [r[0] for r in got] == [False, False, True, True, False]


def test_names_claim_spans(spark):
    entries = [("lazarus", "Lazarus", "actor", "G1"), ("lazarus group", "Lazarus Group", "actor", "G2"), ("apt-1", "APT1", "actor", "G3"), ("cafe", "Cafe", "tool", None)]
    docs = spark.createDataFrame([(1, "The Lazarus Group and lazarus, apt-1x APT-1."), (2, None), (3, "écafe cafeé cafe")], "doc_id long, text string")
    got = {(r.doc_id, r.canonical): (r.start, r.confidence) for r in dictionary.matched(docs, entries).collect()}
    assert got == {(1, "Lazarus Group"): (4, 0.92), (1, "Lazarus"): (22, 0.92), (1, "APT1"): (38, 0.88), (3, "Cafe"): (12, 0.92)}
    plain = dictionary.Names(entries)
    plain.automaton = None
    assert [x[0] for x in plain.find("The Lazarus Group and lazarus")] == ["Lazarus Group", "Lazarus"]
    assert dictionary.matched(docs.limit(0), entries).count() == 0


def test_cut_off_answers(spark):
    whole = {"relationships": [{"source": "A", "type": "uses", "target": {"name": "B"}, "confidence": 3, "evidence_label": "Observed"}, {"source": "A", "type": "", "target": "C"}]}
    cut = json.dumps({"relationships": [{"source_value": "x", "relationship_type": "uses", "target_value": "y"}, {"source_value": "z, ]"}]})[:-4]
    rows = spark.createDataFrame([(1, json.dumps(whole)), (2, "```json\n" + json.dumps(whole) + "\n```"), (3, cut), (4, "no json"), (5, None)], "report long, answer string")
    got = {(r.report, r.src, r.verb, r.tgt, r.confidence, r.label) for r in responses.relations_of(responses.parsed(rows)).collect()}
    assert got == {(1, "A", "uses", "B", 1.0, "observed"), (2, "A", "uses", "B", 1.0, "observed"), (3, "x", "uses", "y", 0.5, "reported")}
    assert json.loads(responses.repaired('[1, {"a": "b\\"", "c')) == [1, {"a": 'b"'}]
    assert responses.repaired(None) is None


def test_verdicts(spark):
    rows = responses.parsed(spark.createDataFrame([(1, '[{"n": 1, "supported": false}, {"n": 2, "supported": true}, {"n": 2.5, "supported": false}]')], "report long, answer string"))
    claims = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "report long, n long")
    assert {tuple(r) for r in responses.verdicts(rows, claims).collect()} == {(1, 2), (1, 3), (2, 1)}


def test_kept_names(spark):
    chunks = spark.createDataFrame([(1, 0, "fin7 met Cobalt Strike; GREYVIBE was seen", "tool Mimikatz")], "report long, chunk_no int, text string, context string")
    names = [("actor", "FIN7"), ("actor", "FIN"), ("tool", "cobalt strike"), ("tool", "mimikatz"), ("tool", "Unknown Tool"), ("campaign", "GREYVIBE Ukraine Campaign"), ("campaign", "Big Campaign"), ("tool", "Known")]
    got = responses.kept_names(spark.createDataFrame([(1, 0, k, n) for k, n in names], "report long, chunk_no int, kind string, name string"), chunks, spark.createDataFrame([(1, "known")], "report long, value string"))
    assert {r.name for r in got.collect() if r.kept} == {"FIN7", "cobalt strike", "mimikatz", "GREYVIBE Ukraine Campaign", "Known"}
    rel = spark.createDataFrame([(1, "FIN7", "uses", "Unknown Tool"), (1, "FIN7", "uses", "mimikatz")], "report long, src string, verb string, tgt string")
    assert responses.without_lost_ends(rel, got).count() == 1
    assert responses.nearly_in("Cobalt Strike", "the cobalt-strike kit") and not responses.nearly_in("Lazarus", "a quite other text")


def test_sigma_atoms(spark):
    detection = {"sel": {"Image|endswith": ["\\cmd.exe", "*x*y"], "Hashes": "MD5=" + "a" * 32 + ",IMPHASH=zz", "DestinationPort": 443, "QueryName": "*.evil.com.", "Other": True}, "k": [{"CommandLine|contains": "'whoami /all'"}, {"TargetObject": "HKLM\\Run"}], "condition": "sel"}
    assert atoms.sigma_atoms(detection) == [("image", "/cmd.exe"), ("image", "cmd.exe"), ("hash", "a" * 32), ("port", "443"), ("domain", "evil.com"), ("cmdline", "whoami /all"), ("registry", "hklm/run")]
    assert len(atoms.sigma_atoms({"s": {"Image": [f"name{i}.exe" for i in range(500)]}})) == 120 and atoms.sigma_atoms(None) == []
    assert [atoms.sigma_platform(x) for x in ({"product": "Windows"}, {"category": "ps_script"}, {"service": ["x", "Sysmon"]}, {"product": "osx"}, {}, None)] == ["windows", "windows", "windows", "macos", "", ""]


def test_suricata_atoms(spark):
    lines = [
        'alert http any any -> any any (msg:"a"; http.uri; content:"/gate/panel.php"; content:"x"; http.host; content:"Evil.com"; content:!"good.com"; sid:1;)',
        'alert http any any -> any any (msg:"b"; content:"/old/path.php"; nocase; http_uri; content:"|41 42|cdefgh"; content:"bad.example.net"; sid:2;)',
    ]
    rules = rulefiles.suricata_rules(spark.createDataFrame(list(enumerate(lines)), "n int, line string"))
    got = atoms.atom_table(rules, "sid", ("options",), lambda o: atoms.suricata_atoms(list(o))).collect()
    assert [(r["class"], r.value) for r in got if r.sid == "1"] == [("url", "/gate/panel.php"), ("url", "panel.php"), ("domain", "evil.com")]
    assert [(r["class"], r.value) for r in got if r.sid == "2"] == [("url", "/old/path.php"), ("url", "path.php"), ("strlit", "abcdefgh"), ("domain", "bad.example.net")]


def test_yara_atoms():
    got = atoms.yara_atoms({"hash1": "A" * 64 + ", x", "author": "me"}, [("text", "C:\\Tools\\evil.exe"), ("hex", "9C"), ("text", "www.Evil.com"), ("text", "10.0.0.1"), ("text", "short"), ("text", "HKLM\\Software\\Run"), ("text", "kernel32.dll")])
    assert got == [("hash", "a" * 64), ("file", "c:/tools/evil.exe"), ("file", "evil.exe"), ("domain", "evil.com"), ("ip", "10.0.0.1"), ("registry", "hklm/software/run"), ("strlit", "kernel32.dll")]
    assert [atoms.yara_platform(m, i) for m, i in (({"os": "Linux"}, ["pe"]), ({}, ["pe"]), ({}, ["elf"]), ({}, []))] == ["linux", "windows", "linux", ""]


def test_registry_and_store(spark, tmp_path):
    cols = "name string, format string, path string, license string, priority int, enabled boolean"
    base = spark.createDataFrame([("a", "sigma", "/a", "MIT", 1, True), ("b", "yara", "/b", None, 2, True), ("off", "yara", "/o", None, 3, False)], cols)
    local = spark.createDataFrame([("a", None, "/mine", None, None, None), ("c", "sigma", "/c", None, 9, None), ("b", None, None, None, None, False)], cols)
    assert {(r.name, r.path, r.priority) for r in store.registry(base, local).collect()} == {("a", "/mine", 1), ("c", "/c", 9)}
    assert {(r.name, r.enabled) for r in store.removed(base, local, "a").collect()} == {("a", False), ("c", None), ("b", False)}
    rules = spark.createDataFrame([("r1", "a", 0, "x", ["t1"]), ("r1", "a", 1, "xyz", ["t1", "T1"]), ("r2", "b", 0, "q", [])], "rule_id string, corpus string, pos int, raw string, techniques array<string>")
    path = str(tmp_path / "rules")
    store.write_corpora(store.stored(rules), path)
    store.write_corpora(store.stored(rules.where("corpus = 'b'").withColumn("raw", F.lit("new"))), path)
    assert {(r.rule_id, r.raw, r.size, r.corpus) for r in spark.read.parquet(path).collect()} == {("r1", "xyz", 3, "a"), ("r2", "new", 3, "b")}
    assert store.stored_tags(rules).count() == 1
    store.export_bundles(spark.createDataFrame([("a", "{}", True), ("b", "{", False)], "name string, json string, valid boolean"), str(tmp_path / "out"))
    assert {(r.state, r.value) for r in spark.read.option("basePath", str(tmp_path / "out")).text(str(tmp_path / "out")).collect()} == {("valid", "{}"), ("invalid", "{")}


def test_bundle_indexes(spark, tmp_path):
    ref = lambda x: [{"source_name": "m", "external_id": x}]
    objects = [
        {"id": "p1", "type": "attack-pattern", "name": "Phish", "external_references": ref("T1.001")}, {"id": "p2", "type": "attack-pattern", "name": "Old", "revoked": True, "external_references": ref("T2")},
        {"id": "m1", "type": "malware", "name": "Evil", "aliases": ["EVL", "Evil Kit"], "external_references": ref("S1")}, {"type": "relationship", "source_ref": "m1", "target_ref": "p1", "relationship_type": "uses"},
        {"type": "relationship", "source_ref": "m1", "target_ref": "none", "relationship_type": "uses"},
    ]
    for n in ("a", "b"):
        (tmp_path / f"{n}.json").write_text(json.dumps({"objects": [o | ({"name": o["name"] + n} if "name" in o else {}) for o in objects]}))
    rows = store.bundle_objects(spark, str(tmp_path))
    assert [(r.id, r.name, r.parent) for r in store.technique_index(rows).collect()] == [("T1.001", "Phisha", "T1")]
    assert [tuple(r) for r in store.curated_edges(rows).collect()] == [("S1", "uses", "T1.001")]
    names = dictionary.name_index(rows.where("type = 'malware' and bundle = 'a.json'").select("id", "type", "name", "aliases"))
    assert {r.name for r in names.collect()} == {"evila", "evil kit"}


def test_files_and_uploads(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"hi \xff")
    (tmp_path / "b.xyz").write_bytes(b"?")
    got = {r.suffix: (r.text, r.error) for r in store.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"txt": ("hi \ufffd", None), "xyz": (None, "unsupported file type: xyz")}
    pages = spark.createDataFrame([("p", 0, ""), ("p", 1, "x" * 60), ("q", 0, "y" * 80), ("p", 5, "z" * 900)], "path string, page_no int, text string")
    assert {r.path: r.scanned for r in store.scanned(pages).collect()} == {"p": True, "q": False}
    ups = spark.createDataFrame([("pdf", "application/pdf", 5, "red", None), ("pdf", "text/html", 5, None, None), ("txt", "text/plain", 99 << 20, None, None), ("txt", "text/plain", 1, "blue", None)], "suffix string, mime string, size long, tlp string, pap string")
    assert [r.accepted for r in store.accepted_upload(ups).collect()] == [True, False, False, False]


def test_merged_techniques(spark):
    sem = spark.createDataFrame([(1, "T1", "sem1", 0.9, "s"), (1, "T2", "sem2", 0.5, "ss"), (1, "T3.001", "sem3", 0.5, "x"), (1, "T9999", "p", 0.9, "")], "report long, id string, name string, confidence double, description string")
    llm = spark.createDataFrame([(1, "t1", "llm1", "longer", 0), (1, "T2", "llm2", "a", 1), (1, None, "Free", "b", 2), (1, None, "free", "bbb", 3), (1, "T9999.001", "c", "", 4)], "report long, id string, name string, description string, pos int")
    got = {(r.id, r.name, r.description) for r in sentences.merged_techniques(sem, llm).collect()}
    assert got == {("T1", "sem1", "longer"), ("T2", "llm2", "a"), ("T3.001", "sem3", "x"), (None, "free", "bbb"), ("T9999.001", "c", "")}


def test_greedy_and_bulk(spark):
    cols = "sample int, pos int, type string, value string"
    got = evaluation.greedy_scores(spark.createDataFrame([(1, 0, "a", "abc"), (1, 1, "a", "abcd"), (2, 0, "a", "x")], cols), spark.createDataFrame([(1, 0, "a", "abcd"), (3, 0, "b", "y")], cols))
    assert {tuple(r) for r in got.collect()} == {(1, 0.5, 1.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)}
    rows = spark.createDataFrame([("ttp", None), ("ttp", False)], "entity_type string, accepted boolean")
    assert [r.accepted for r in review.bulk(rows, "ttp", "accept").collect()] == [True, False]
    with pytest.raises(ValueError):
        review.bulk(rows, "ttp", "reset")

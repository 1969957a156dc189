"""Rule files and review operators on small literal inputs."""

from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import review
from quarryline.sources import rulefiles

YARA = r'''
import "pe"
/* rule gone { condition: true } */
private rule hidden { condition: true }
global rule Seen : one two {
  meta:
    author = "a \"b\""
    ref = "T1059.001"
    ref = "t1003"
  strings:
    $a = "brace } // no comment \x41"  // a comment }
    $b = { 9C 50
           ?? }
    $c = /ab\/}{1,2}/i
  condition:
    pe.is_pe and any of them
}
rule open { condition: '''

SIGMA = """title: One
id: abc
level: High
tags: [attack.t1059.001, attack.execution, 7]
logsource: {product: Windows, category: process_creation}
related: [{id: old, type: derived}]
detection: {sel: {Image: ['b', 'A']}, condition: sel}
---
title: Two
detection: {condition: sel, sel: {image: ['a', 'B']}}
logsource: {category: PROCESS_CREATION, product: windows}
---
title: no detection
"""


def test_yara():
    (rule,) = rulefiles.split_yara(YARA)
    assert (rule["name"], rule["tags"], rule["imports"]) == ("Seen", ["one", "two"], ["pe"])
    assert rule["meta"] == {"author": 'a "b"', "ref": "T1059.001,t1003"} and rule["techniques"] == ["T1003", "T1059.001"]
    assert [(s["kind"], s["value"]) for s in rule["strings"]] == [("text", "brace } // no comment A"), ("hex", "9C 50 ??"), ("regex", r"ab\/}{1,2}")]
    assert rule["condition"] == "pe.is_pe and any of them"
    assert rulefiles.split_yara("") == rulefiles.split_yara("}}{") == []


def test_unescape_is_one_pass():
    assert rulefiles.unescape(r"a\\nb\n\x41\q") == "a\\nb\nA\\q"


def test_sigma(spark):
    rows = spark.createDataFrame([("a", SIGMA), ("b", "title: [x"), ("c", None), ("d", "")], "path string, content string")
    one, two = sorted(rulefiles.sigma_rules(rows).collect(), key=lambda r: r.title)
    assert (one.sigma_id, one.level, one.product, one.techniques, one.related[0].id) == ("abc", "high", "windows", ["T1059.001"], "old")
    assert one.dedup_key == two.dedup_key and two.level == "unknown" and len(two.sigma_id) == 16


def test_suricata_files(spark, tmp_path):
    first = r'alert http any any  -> any 80 (msg:"a \; b; c"; content:"x;y"; sid:7; rev:1; metadata:signature_severity Minor;)'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.rules").write_text(f"# {first}\n\n{first}\n  {first.replace('sid:7', 'sid:8').replace('alert', 'drop')}\nnote (x)\nalert tcp any any -> any any (sid:9;)\n")
    (tmp_path / "other.txt").write_text(first)
    rows = sorted(rulefiles.suricata_rules(rulefiles.suricata_lines(spark, str(tmp_path))).collect(), key=lambda r: r.sid)
    assert [r.sid for r in rows] == ["7", "8", "9"] and [r.action for r in rows] == ["alert", "drop", "alert"]
    assert rows[0].msg == r"a \; b; c" and rows[0].severity == "low" and rows[0].header == "alert http any any -> any 80" and "content:\"x;y\"" in rows[0].options
    assert rows[0].dedup_key == rows[1].dedup_key and rows[2].dedup_key is None and rows[2].severity == "unknown"


def test_yara_files(spark, tmp_path):
    (tmp_path / "a.yar").write_bytes(YARA.encode() + b"\xff")
    (row,) = rulefiles.yara_rules(rulefiles.text_files(spark, str(tmp_path), "*.yar")).collect()
    assert row.name == "Seen" and row.strings[1].kind == "hex" and row.meta["author"] == 'a "b"'


def test_patterns_and_hosts(spark):
    rows = spark.createDataFrame([("url", r"http://U:p@[::1]:80/x'y\z"), ("autonomous-system", "AS 12"), ("autonomous-system", "ASx"), ("hash", "a" * 32), ("file", " a.exe "), ("other", "x"), ("url", None)], "k string, v string")
    got = [r.p for r in rows.select(review.stix_pattern(F.col("k"), F.col("v")).alias("p")).collect()]
    assert got == [r"[url:value = 'http://U:p@[::1]:80/x\'y\\z']", "[autonomous-system:number = 12]", None, f"[file:hashes.MD5 = '{'a' * 32}']", "[file:name = 'a.exe']", None, None]
    hosts = spark.createDataFrame([("http://u@[::1]:8/x",), ("HTTPS://A.b:1?c@d",), ("a.c/x",), (None,)], "u string").select(T.url_host(F.col("u")).alias("h")).collect()
    assert [r.h for r in hosts] == ["::1", "a.b", "a.c", None]


def test_observables(spark):
    rows = spark.createDataFrame([(1, "file", r"C:\Dir\Evil.EXE"), (1, "file", r"C:\Dir\Evil.EXE"), (1, "url", "http://a.org/x"), (2, "tool", "abc"), (3, "tool", None)], "id int, kind string, value string")
    got = {tuple(r) for r in review.observables(rows, "id").collect()}
    assert got == {(1, "path", r"c:\dir\evil.exe"), (1, "file", "evil.exe"), (1, "url", "http://a.org/x"), (1, "domain", "a.org")}


def test_platform(spark):
    votes = [(1, "a", "windows"), (1, "a", "windows"), (1, "b", "windows"), (1, "c", "linux"), (2, "a", "linux"), (3, "a", None), (4, "a", "linux"), (4, "b", "linux"), (4, "c", "macos"), (4, "d", "macos")]
    rows = review.platform(spark.createDataFrame(votes, "k int, d string, h string"), "k", "d", "h").collect()
    assert {r.k: r.platform for r in rows} == {1: "windows", 2: "multi", 3: "", 4: "multi"}


def test_selection(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 3, 7), ("c", 4, 8)], "scope string, id int, size int")
    out = spark.createDataFrame([(1,), (1,), (3,)], "id int")
    got = {tuple(r) for r in review.selection(rows, "scope", out, "id", "size").collect()}
    assert got == {("a", "some", 1, 6), ("b", "none", 0, 0), ("c", "all", 1, 8)}

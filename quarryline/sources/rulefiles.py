"""Detection rules from files: Suricata lines, YARA sources, Sigma documents.

Suricata lines are parsed by built-in functions.  YARA and Sigma need a scanner
of nested text, which runs on Arrow batches of files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first word of a rule line.
ACTIONS = ("alert", "drop", "reject", "pass", "log")
#: signature_severity and the severity it stands for.
SEVERITIES = {"critical": "critical", "major": "high", "minor": "low", "informational": "informational"}
#: Options that change with each release of a rule and don't tell it from others.
VOLATILE = ("sid", "rev", "msg", "reference", "metadata", "classtype", "target")

OPTION = r'(?:[^;"\\]++|\\.|"(?:[^"\\]++|\\.)*+")++'
TECHNIQUE = r"T\d{4}(?:\.\d{3})?"


def text_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, content of all files below a path whose name fits; bytes that aren't UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def suricata_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rules").text(path).withColumnRenamed("value", "line")


def _option(options: Column, name: str) -> Column:
    """The first option's value without quotes; null if there is none."""
    hit = F.filter(options, lambda o: F.lower(F.btrim(F.substring_index(o, ":", 1))) == name)
    value = F.btrim(F.regexp_replace(F.get(hit, F.lit(0)), r"^[^:]*:", ""))
    return F.regexp_replace(value, r'^"|"$', "")


def suricata_rules(lines: DataFrame, line: str = "line") -> DataFrame:
    """The columns of ``lines`` and action, header, options, msg, sid, severity, techniques, dedup_key.

    Null or blank lines, comments and lines that start with no known action are no
    rules.  The dedup key is the SHA-256 of the header without the action and of the
    options without the volatile ones, in their order; it is null if none is left.
    """
    text = F.btrim(F.col(line), F.lit(" \t\r\n"))
    rows = lines.withColumn("_text", text).where(F.regexp_extract("_text", r"^(\S+)\s", 1).isin(*ACTIONS) & F.col("_text").contains("("))
    body = F.regexp_replace(F.regexp_extract("_text", r"(?s)^[^(]*\((.*)$", 1), r"\)\s*$", "")
    options = F.filter(F.transform(F.regexp_extract_all(body, F.lit(OPTION), F.lit(0)), lambda o: F.btrim(o)), lambda o: o != "")
    rows = rows.withColumn("header", F.btrim(F.regexp_replace(F.substring_index("_text", "(", 1), r"\s+", " "))).withColumn("options", options)
    meta = F.coalesce(_option(F.col("options"), "metadata"), F.lit(""))
    stated = F.lower(F.regexp_extract(meta, r"(?i)(?:^|,)\s*signature_severity\s+(\w+)", 1))
    known = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    lasting = F.filter("options", lambda o: ~F.lower(F.btrim(F.substring_index(o, ":", 1))).isin(*VOLATILE))
    return rows.select(
        *[F.col(f"`{c}`") for c in lines.columns], F.substring_index("header", " ", 1).alias("action"), "header", "options", _option(F.col("options"), "msg").alias("msg"),
        _option(F.col("options"), "sid").alias("sid"), F.coalesce(known[stated], F.lit("unknown")).alias("severity"),
        F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(meta, F.lit(rf"(?i)\b{TECHNIQUE}\b"), F.lit(0)), F.upper))).alias("techniques"),
        F.when(F.size(lasting) > 0, F.sha2(F.concat_ws("\n", F.regexp_replace("header", r"^\S+\s", ""), lasting), 256)).alias("dedup_key"),
    )


# --- YARA --------------------------------------------------------------------------

#: Comments, strings and patterns hide braces; everything else between is plain.
_YARA = re.compile(r'(?P<gone>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<quoted>"(?:\\.|[^"\\\n])*"|/(?![/*])(?:\\.|[^/\\\n])+/[is]*)|(?P<brace>[{}])', re.S)
_YARA_HEAD = re.compile(r"((?:\b(?:private|global)\s+)*)\brule\s+(\w+)\s*(?::\s*([\w\s]*?))?\s*$")
_YARA_PART = re.compile(r"^\s*(meta|strings|condition)\s*:", re.M)
_YARA_META = re.compile(r'^\s*(\w+)\s*=\s*(?:"((?:\\.|[^"\\\n])*)"|([^\s"]+))', re.M)
_YARA_STRING = re.compile(r'(\$\w*)\s*=\s*(?:"((?:\\.|[^"\\\n])*)"|\{([^}]*)\}|/((?:\\.|[^/\\\n])+)/)')
_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{2}|.)", re.S)
YARA_SCHEMA = "path string, name string, tags array<string>, meta map<string,string>, strings array<struct<ident:string,kind:string,value:string>>, condition string, imports array<string>, techniques array<string>, dedup_key string"


def unescape(text: str) -> str:
    r"""One pass over \n \t \r \" \\ and \xHH; any other escape stays as written."""
    plain = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 3 else plain.get(m[1], m[0]), text)


def split_yara(text: str) -> list[dict]:
    """The public rules of a source text: each one's name, tags, meta, strings and condition."""
    out, kept, start, depth = [], [], 0, 0
    imports: list[str] = []
    head: re.Match | None = None
    for m in _YARA.finditer(text):
        if m.lastgroup == "gone":
            kept += [text[start : m.start()], " "]
            start = m.end()
        elif m.lastgroup == "brace" and m[0] == "{":
            if depth == 0:
                before = "".join(kept) + text[start : m.start()]
                imports += re.findall(r'^\s*import\s+"(\w+)"', before, re.M)
                head, kept, start = _YARA_HEAD.search(before), [], m.end()
            depth += 1
        elif m.lastgroup == "brace" and depth:
            depth -= 1
            if depth == 0:
                body = "".join(kept) + text[start : m.start()]
                kept, start = [], m.end()
                if head and "private" not in head[1]:
                    out.append({"name": head[2], "tags": (head[3] or "").split(), **_yara_body(body)})
    for rule in out:
        rule["imports"] = sorted(set(imports))
    return out


def _yara_body(body: str) -> dict:
    import hashlib
    import json

    parts = {"meta": "", "strings": "", "condition": ""}
    marks = list(_YARA_PART.finditer(body))
    for m, after in zip(marks, [*marks[1:], None]):
        parts[m[1]] = body[m.end() : after.start() if after else len(body)]
    meta: dict[str, str] = {}
    for key, quoted, bare in _YARA_META.findall(parts["meta"]):
        value = unescape(quoted) if quoted else bare
        meta[key] = f"{meta[key]},{value}" if key in meta else value
    strings = []
    for m in _YARA_STRING.finditer(parts["strings"]):
        if m[2] is not None:
            strings.append({"ident": m[1], "kind": "text", "value": unescape(m[2])})
        elif m[3] is not None:
            strings.append({"ident": m[1], "kind": "hex", "value": " ".join(m[3].split())})
        else:
            strings.append({"ident": m[1], "kind": "regex", "value": m[4]})
    condition = " ".join(parts["condition"].split())
    same = json.dumps([sorted((s["kind"], s["value"]) for s in strings), condition])
    found = sorted({x.upper() for v in meta.values() for x in re.findall(rf"\b{TECHNIQUE}\b", v, re.I)})
    return {"meta": meta, "strings": strings, "condition": condition, "techniques": found, "dedup_key": hashlib.sha256(same.encode()).hexdigest()}


def yara_rules(files: DataFrame) -> DataFrame:
    """A row for each public rule of the files (path, content); a null content has none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in re.split(r", (?![^<]*>)", YARA_SCHEMA)]
        for frame in batches:
            rows = [{"path": p, **r} for p, c in zip(frame["path"], frame["content"]) if isinstance(c, str) for r in split_yara(c)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(parse, YARA_SCHEMA)


# --- Sigma -------------------------------------------------------------------------

SIGMA_SCHEMA = "path string, sigma_id string, title string, level string, product string, service string, category string, techniques array<string>, related array<struct<id:string,type:string>>, detection string, dedup_key string"


def parse_sigma(text: str) -> list[dict]:
    """The documents of a YAML text that have a title and a detection; a malformed text has none.

    Two rules of one log source and detection have one dedup key: keys and lists
    are sorted and texts lower-cased.
    """
    import hashlib
    import json

    import yaml

    def plain(x):
        if isinstance(x, dict):
            return {str(k).lower(): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return sorted((plain(v) for v in x), key=lambda v: json.dumps(v, sort_keys=True))
        return str(x).lower() if x is not None else None

    try:
        docs = [d for d in yaml.safe_load_all(text) if isinstance(d, dict) and d.get("title") and d.get("detection")]
    except yaml.YAMLError:
        return []
    out = []
    for d in docs:
        source = d["logsource"] if isinstance(d.get("logsource"), dict) else {}
        tags = [str(t) for t in d.get("tags") or []] if isinstance(d.get("tags"), list) else []
        related = [{"id": str(r["id"]), "type": str(r.get("type") or "")} for r in d.get("related") or [] if isinstance(r, dict) and r.get("id")] if isinstance(d.get("related"), list) else []
        same = json.dumps([plain(source), plain(d["detection"])], sort_keys=True)
        out.append({
            "sigma_id": str(d.get("id") or hashlib.sha256(json.dumps(d, sort_keys=True, default=str).encode()).hexdigest()[:16]), "title": str(d["title"]), "level": str(d.get("level") or "unknown").lower(),
            **{k: str(source[k]).lower() if source.get(k) else "" for k in ("product", "service", "category")},
            "techniques": sorted({t[7:].upper() for t in tags if re.fullmatch(rf"attack\.{TECHNIQUE}", t, re.I)}), "related": related,
            "detection": json.dumps(d["detection"], sort_keys=True, default=str), "dedup_key": hashlib.sha256(same.encode()).hexdigest(),
        })
    return out


def sigma_rules(files: DataFrame) -> DataFrame:
    """A row for each rule of the files (path, content); a null content has none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in re.split(r", (?![^<]*>)", SIGMA_SCHEMA)]
        for frame in batches:
            rows = [{"path": p, **r} for p, c in zip(frame["path"], frame["content"]) if isinstance(c, str) for r in parse_sigma(c)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(parse, SIGMA_SCHEMA)

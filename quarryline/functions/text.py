"""Expressions over report text.  All are built-in and stay in generated code."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Registry hives, extensions of programs and scripts, extensions that end no domain, roots of system paths.
HIVES = ("HKCC", "HKCR", "HKCU", "HKEY_CLASSES_ROOT", "HKEY_CURRENT_CONFIG", "HKEY_CURRENT_USER", "HKEY_LOCAL_MACHINE", "HKEY_USERS", "HKLM", "HKU")
PROGRAMS = (
    "exe", "dll", "sys", "drv", "scr", "com", "cpl", "ocx", "bin", "elf", "so", "ko", "ps1", "psm1", "psd1", "bat", "cmd", "vbs", "vbe", "js", "jse", "wsf", "wsh", "hta", "lnk",
    "sh", "bash", "zsh", "py", "pyc", "pyw", "pl", "rb", "php", "jar", "war", "apk", "dmg", "app", "msi", "iso", "img",
)
NO_DOMAIN = (
    "py", "js", "ts", "go", "rb", "php", "sh", "exe", "dll", "bin", "elf", "ps1", "bat", "vbs", "zip", "tar", "gz", "pdf", "doc", "docx", "xls", "xlsx", "png", "jpg", "gif", "svg",
    "css", "json", "xml", "yml", "yaml", "log", "txt", "md", "cfg", "ini", "conf",
)
ROOTS = ("bin", "boot", "dev", "etc", "home", "lib", "lib64", "opt", "proc", "root", "run", "sbin", "srv", "sys", "tmp", "usr", "var")
#: Top-level domains of three letters or more that are taken for one.
GTLDS = (
    "com", "net", "org", "info", "biz", "edu", "gov", "mil", "int", "arpa", "top", "xyz", "online", "site", "club", "shop", "app", "dev", "cloud", "live", "icu", "vip", "work", "website",
    "space", "store", "tech", "fun", "pro", "news", "today", "one", "link", "click", "download", "stream", "win", "bid", "loan", "men", "party", "review", "trade", "date", "racing",
    "science", "accountant", "faith", "cricket", "name", "mobi", "asia", "tel", "email", "life", "world", "host", "press", "wiki", "blog", "agency",
)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01][0-9]{2}|[0-9]{1,2})"
_HEX4 = "[0-9A-Fa-f]{4}"
_NOTHING = "\u200b\u200c\u200d\u2060\ufeff"  # characters without width
_DASH = "\\-\u2010-\u2015\u2212\ufe63\uff0d\u00ad"
_GAP = f"[{_NOTHING}]*[{_DASH}][{_NOTHING}]*"
_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_CONTROL = "\\x00-\\x1f"

#: Patterns of indicators; each match is the whole value.
PATTERNS = {
    "ipv4": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d.])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:.])",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "hash": r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})(?![0-9A-Za-z])",
    "cve": rf"(?i)CVE{_GAP}\d{{4}}{_GAP}\d{{4,7}}",
    "technique": r"\bTA?\d{4}(?:\.\d{3})?\b",
    "mac": rf"\b(?:(?:[0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}|{_HEX4}\.{_HEX4}\.{_HEX4})\b",
    "asn": r"\bASN?\s*\d{1,10}\b",
    "url": r"(?i)https?://[a-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+",
    "domain": rf"(?i)\b(?:{_LABEL}\.){{1,5}}(?!(?:{'|'.join(NO_DOMAIN)})\b)[a-z]{{2,12}}\b",
    "registry": rf"(?i)\b(?:{'|'.join(HIVES)})(?:\\[^\\<>:\"|{_CONTROL}]+)+",
    "windows_path": rf"(?i)(?:[a-z]:\\|\\\\[^\\\s]+\\[^\\\s]+\\)(?:[^\\\s<>:\"|?*{_CONTROL}]+\\)*[^\\\s<>:\"|?*{_CONTROL}]+\.[a-z]{{2,10}}\b",
    "unix_path": rf"(?<!\w)/(?:{'|'.join(ROOTS)})(?:/[^\s{_CONTROL}<>\"'`|&;()\[\]{{}}\\]+)+",
    "filename": rf"(?i)(?<![\w./\\-])[a-z0-9_][\w.-]*\.(?:{'|'.join(PROGRAMS)})(?![\w-])",
}


def found(text: Column, kind: str) -> Column:
    """All values of a kind in a text, in order and normalised; a null text has none.

    ``path`` is Windows and then Unix paths.  A domain that is the host of a URL
    or an email address of the same text is left out.
    """
    if kind == "path":
        return F.concat(found(text, "windows_path"), found(text, "unix_path"))
    values = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERNS[kind]), F.lit(0))
    if kind in ("email", "hash"):
        values = F.transform(values, F.lower)
    elif kind == "cve":
        values = F.transform(values, lambda x: F.upper(F.regexp_replace(F.regexp_replace(x, f"[{_NOTHING}]", ""), f"[{_DASH}]", "-")))
    elif kind == "mac":
        pairs = lambda x: F.regexp_replace(F.replace(x, F.lit("."), F.lit("")), "(..)(?=.)", "$1:")
        values = F.transform(values, lambda x: F.lower(F.when(F.contains(x, F.lit(".")), pairs(x)).otherwise(F.replace(x, F.lit("-"), F.lit(":")))))
    elif kind == "asn":
        values = F.transform(values, lambda x: F.regexp_replace(x, r"^ASN?\s*", "AS"))
    elif kind == "url":
        values = F.transform(values, lambda x: F.regexp_replace(x, r"[\".),;}']+$", ""))
    elif kind == "registry":
        values = F.transform(values, lambda x: F.rtrim(x))
    elif kind == "ipv6":
        whole = lambda x: F.when(F.contains(x, F.lit("::")), (F.size(F.split(x, "::", -1)) == 2) & (F.size(F.split(x, ":", -1)) <= 8) & (F.length(x) > 2)).otherwise(F.size(F.split(x, ":", -1)) == 8)
        values = F.transform(F.filter(values, lambda x: whole(x) & ~x.rlike("^:[^:]|[^:]:$|:::")), F.lower)
    elif kind == "domain":
        hosts = F.concat(F.transform(found(text, "url"), url_host), F.transform(found(text, "email"), lambda x: F.substring_index(x, "@", -1)))
        values = F.array_except(F.transform(values, F.lower), hosts)
    return values


def url_host(url: Column) -> Column:
    """Host of a URL by its letters: no scheme, user, port or brackets; lower case."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[/?#].*$", "")
    rest = F.regexp_replace(rest, r"^.*@", "")
    return F.lower(F.when(rest.startswith("["), F.regexp_extract(rest, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(rest, r":\d*$", "")))


def is_domain(value: Column) -> Column:
    """Whether a value has the shape of a host name and ends in a country's two letters or a known domain."""
    v = F.lower(F.btrim(value))
    last = F.substring_index(v, ".", -1)
    return v.rlike(rf"^{_LABEL}(?:\.{_LABEL})+$") & last.rlike("^[a-z]+$") & ((F.length(last) == 2) | last.isin(*GTLDS))


#: The algorithm that a hash's length stands for.
HASH_KINDS = {32: "md5", 40: "sha1", 64: "sha256"}
_LABELS = ((64, re.compile(r"sha[\s_-]*256", re.I)), (40, re.compile(r"sha[\s_-]*1(?!\d)", re.I)), (32, re.compile(r"md[\s_-]*5(?!\d)", re.I)))
_BLOCK = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{2,}(?:\s+[0-9A-Fa-f]{2,})*(?![0-9A-Za-z])")


def hash_values(text: str | None, back: int = 200) -> list[str]:
    """Hashes of a text, lower-cased and once each, also those that a layout broke across lines.

    Pieces of hex between blanks are either hashes one below the other or one
    hash in pieces.  If each is a hash by its length they are taken as such,
    unless the nearest label before (within ``back`` characters) says that they
    are one; else if together they have a hash's length they are one, unless the
    label says that a piece is; else the pieces that are hashes count.
    """
    out: dict[str, None] = {}
    for m in _BLOCK.finditer(text or ""):
        pieces = m.group().split()
        whole, single = "".join(pieces), [p for p in pieces if len(p) in HASH_KINDS]
        if len(pieces) > 1 and len(whole) in HASH_KINDS:
            before = text[max(0, m.start() - back) : m.start()]
            label = max(((x.start(), size) for size, p in _LABELS for x in p.finditer(before)), default=(0, 0))[1]
            split = label != len(whole) if len(single) == len(pieces) else label not in (0, len(whole)) and any(len(p) == label for p in single)
            single = single if split else [whole]
        out |= dict.fromkeys(p.lower() for p in single)
    return list(out)


@F.pandas_udf(ArrayType(StringType()))
def all_hashes(text: pd.Series) -> pd.Series:
    """``hash_values`` of a column; for texts in which hex stands at all."""
    return text.map(hash_values)


def refang(text: Column) -> Column:
    """Undo the usual defanging: schemes first, then dots (with blanks on both sides), colons, slashes and at-signs."""
    steps = (
        (r"(?i)meow://", "http://"), (r"(?i)fxx?p://", "ftp://"), (r"(?i)(?:hxxps|h\[tt\]ps|https?\[s\]|https\[:\])(?:(?<=\[:\])|:)//", "https://"),
        (r"(?i)(?:hxxp|h\[tt\]p|http\[:\])(?:(?<=\[:\])|:)//", "http://"), (r"(?i)\s+(?:\[\.\]|\(\.\))\s+|\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)", "."),
        (r"\[:\]|\(:\)", ":"), (r"\[//\]", "//"), (r"\[/\]", "/"), (r"(?i)\[@\]|\(@\)|\{@\}|\[at\]|\(at\)", "@"),
    )
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def refang_value(value: Column) -> Column:
    """The same for a single value, with fewer forms, trimmed."""
    for pattern, to in ((r"(?i)hxxp", "http"), (r"(?i)\[\.\]|\(\.\)|\{\.\}|\s\[dot\]\s|\[dot\]", "."), (r"\[:\]", ":"), (r"\[//\]", "//"), (r"(?i)\[@\]|\[at\]", "@")):
        value = F.regexp_replace(value, pattern, to)
    return F.btrim(value)


def defanged(value: Column) -> Column:
    """All forms in which a report may write a value: dots, the last dot, schemes and at-signs in brackets."""
    last = F.regexp_replace(value, r"\.(?=[^.]*$)", "\u0001")
    dots = F.flatten(F.array(*[F.array(F.replace(value, F.lit("."), F.lit(d)), F.replace(last, F.lit("\u0001"), F.lit(d))) for d in ("[.]", "(.)", "{.}")]))
    forms = F.concat(F.array(value), dots)
    scheme = lambda v: F.array(F.regexp_replace(v, "(?i)^http", "hxxp"), F.regexp_replace(v, "^([^:]*)://", "$1[://]"), F.regexp_replace(v, "^([^:]*):", "$1[:]"))
    forms = F.when(value.rlike("(?i)^https?://"), F.concat(forms, F.flatten(F.transform(forms, scheme)))).otherwise(forms)
    ats = lambda v: F.array(*[F.regexp_replace(v, "^([^@]*)@", f"$1{a}") for a in ("[at]", "(at)", "[@]", "(@)", "{@}")])
    forms = F.when(F.contains(value, F.lit("@")), F.concat(forms, F.flatten(F.transform(forms, ats)))).otherwise(forms)
    return F.array_sort(F.array_remove(F.array_distinct(forms), value))


def unwrapped(text: Column) -> Column:
    """A text whose lines a layout has broken, with its paragraphs put together.

    A line is joined to the one before unless that ended in one of ``.!?:;`` or
    the line opens a list item; runs of newlines count as one.
    """
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"\n+", -1)
    start = F.struct(F.lit("").alias("done"), F.get(lines, F.lit(0)).alias("cur"))

    def step(a: Column, line: Column) -> Column:
        prev, next_ = F.regexp_replace(a.cur, r"\s+$", ""), F.regexp_replace(line, r"^\s+", "")
        joins = (prev != "") & (next_ != "") & ~prev.rlike("[.!?:;]$") & ~next_.rlike(r"^(?:[-*\u2022\u2013\u2014]|\d+[.)]\s)")
        return F.struct(F.when(joins, a.done).otherwise(F.concat(a.done, a.cur, F.lit("\n"))).alias("done"), F.when(joins, F.concat(prev, F.lit(" "), next_)).otherwise(line).alias("cur"))

    return F.aggregate(F.slice(lines, 2, F.size(lines)), start, step, lambda a: F.concat(a.done, a.cur))


def sanitised(text: Column, most: int = 10000) -> Column:
    """A text made safe for a prompt: cut, without control characters, tags and orders to the model, blanks in order."""
    text = F.substring(F.coalesce(text, F.lit("")), 1, most)
    steps = (
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\u009f]", ""), (r"<[^>]+>", ""), (r"(?i)\b(?:ignore|forget|disregard)\b.*\b(?:previous|above|prior)\b", "[REDACTED]"),
        (r"(?i)\brole\s*[:=]\s*system\b", "[REDACTED]"), (r"(?i)\buser\s*[:=]\s*assistant\b", "[REDACTED]"), (r"(?i)\bassistant\s*[:=]\s*user\b", "[REDACTED]"),
        (r"[^\S\n]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
    )
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def rejoin_hyphens(text: Column) -> Column:
    """Words cut at a line's end, put together again with their hyphen."""
    return F.regexp_replace(text, r"(\p{Alnum})-[ \t]*\n{1,2}[ \t]*(\p{Alnum})", "$1-$2")


def html_text(html: Column) -> Column:
    """Text of a page: no scripts or styles, each tag a newline, five entities decoded."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</(script|style)>", "\n")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t\n]*\n[ \t\n]*", "\n"), r"^\n+|\n+$", "")


def sentences(text: Column, least: int = 20) -> Column:
    """Trimmed sentences longer than ``least`` characters."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+|;\s+"), lambda x: F.btrim(x, F.lit(" \t\n\r")))
    return F.filter(parts, lambda x: F.length(x) > least)


def idf(df: Column, total: Column) -> Column:
    """ln(N / (1 + df)) / ln N within 0 and 1; 1 if N is 1 at most."""
    raw = F.log(total / (F.lit(1.0) + F.greatest(df, F.lit(0)))) / F.log(total)
    return F.when(total <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def noisy_or(weights: Column, most: int = 4) -> Column:
    """1 - product of (1 - w) over the ``most`` largest weights, each within 0 and 1."""
    top = F.slice(F.sort_array(weights, asc=False), 1, most)
    return F.lit(1.0) - F.aggregate(top, F.lit(1.0), lambda a, w: a * (F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID, version 5, as lower-case text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def public_ipv4(ip: Column) -> Column:
    """False for loopback, unspecified, link-local, multicast and reserved addresses, of IPv6 too; others are kept."""
    part = F.split(ip, r"\.")
    a, b = F.try_element_at(part, F.lit(1)).try_cast("int"), F.try_element_at(part, F.lit(2)).try_cast("int")
    four = (a == 0) | (a == 127) | (a >= 224) | ((a == 169) & (b == 254))
    six = F.lower(ip).rlike("^(?:::1?|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*)$")
    return ~F.when(F.contains(ip, F.lit(":")), six).otherwise(F.coalesce(four, F.lit(False)))


def pseudo_file(path: Column) -> Column:
    """Paths of devices and processes, which no report means as a dropped file."""
    return F.lower(path).rlike("^/(?:dev|proc|sys)/")

"""Atoms of rules: the literal values a rule looks for, with their class.

Sigma detections, Suricata contents and YARA strings are nested or depend on
what stands beside them, so they are walked in Arrow batches of parsed rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import GTLDS

#: The class of a Sigma field.
FIELDS = {
    "image": "image newprocessname parentimage parentprocessname processname originalfilename imageloaded sourceimage targetimage imagepath processpath servicefilename process.executable process.name application appname",
    "cmdline": "commandline parentcommandline processcommandline scriptblocktext contextinfo payload currentdirectory process.command_line process.args process.title",
    "file": "targetfilename sourcefilename filename targetpath path newname file.path file.name",
    "registry": "targetobject details objectname registry.value registry.path registry.key",
    "hash": "hashes hash md5 sha1 sha256 sha512 imphash filehash file_hash service_hash hash.md5 hash.sha1 hash.sha256",
    "domain": "destinationhostname sourcehostname queryname query dnsqueryname targetservername servername cs-host domain url_domain http_referrer_domain dest_nt_host destination.domain dns.question.name url.domain",
    "ip": "destinationip sourceip ipaddress destinationaddress sourceaddress destination.ip source.ip",
    "url": "url uri requesturl uri_query uri_path dest_url c-uri cs-uri-query cs-uri-stem url.full url.original url.query",
    "pipe": "pipename",
    "service": "servicename service servicedisplayname",
    "port": "destinationport destport dest_port destination.port",
    "user": "targetusername subjectusername user accountname user.name",
}
#: Log sources that only Windows has.
WINDOWS_SERVICES = (
    "sysmon", "security", "system", "application", "powershell", "powershell-classic", "taskscheduler", "wmi", "windefend", "terminalservices-localsessionmanager", "ntlm",
    "security-mitigations", "msexchange-management", "dns-server-analytic", "driver-framework", "applocker", "codeintegrity-operational", "bits-client", "smbclient-security",
    "printservice-admin", "printservice-operational",
)
WINDOWS_CATEGORIES = (
    "ps_script", "ps_module", "ps_classic_start", "registry_set", "registry_add", "registry_event", "registry_delete", "registry_rename", "driver_load", "image_load", "wmi_event",
    "pipe_created", "create_remote_thread", "process_access", "sysmon_error", "raw_access_thread", "process_tampering",
)
#: Most atoms of one rule.
MOST = {"sigma": 120, "suricata": 40, "yara": 60}

_CLASS = {field: cls for cls, fields in FIELDS.items() for field in fields.split()}
_DIGEST = re.compile(r"[0-9a-f]{32,128}")
_HOST = re.compile(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+")


def is_host(value: str) -> bool:
    """A host name by its shape and its last label."""
    last = value.rpartition(".")[2]
    return bool(_HOST.fullmatch(value)) and last.isalpha() and (len(last) == 2 or last in GTLDS)


def path_values(value: str, least: int = 4) -> list[str]:
    """A path with forward slashes and its last part, where they are long enough."""
    whole = value.replace("\\", "/")
    return [v for v in dict.fromkeys((whole, whole.rpartition("/")[2])) if len(v) >= least]


def sigma_values(cls: str, raw: object) -> list[str]:
    """Values of one field, lower-cased and without quotes and outer wildcards; a shape with inner wildcards has none."""
    text = str(raw).strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        text = text[1:-1]
    text = text.lower().strip("*").strip()
    if not text or set(text) & set("*?"):
        return []
    if cls == "hash":
        return [d for d in (part.rpartition("=")[2].strip() for part in text.split(",")) if _DIGEST.fullmatch(d)]
    if cls == "port":
        return [text] if text.isdigit() and len(text) <= 5 else []
    if cls in ("image", "file") and ("/" in text or "\\" in text):
        return path_values(text)
    if cls == "domain":
        text = text.removeprefix("*.").removeprefix(".").removesuffix(".")
    if cls == "registry":
        text = text.replace("\\", "/")
    return [text] if len(text) >= 4 else []


def sigma_atoms(detection: object, most: int = MOST["sigma"]) -> list[tuple[str, str]]:
    """Class and value pairs of a detection block in the order found, once each."""
    out: dict[tuple[str, str], None] = {}

    def walk(node: object, cls: str | None) -> None:
        if len(out) >= most:
            return
        if isinstance(node, dict):
            for key, value in node.items():
                name = key.strip().lower() if isinstance(key, str) else ""
                if name not in ("condition", "timeframe"):
                    walk(value, _CLASS.get(name.partition("|")[0].strip()))
        elif isinstance(node, list):
            for item in node:
                walk(item, cls if not isinstance(item, (dict, list)) else None)
        elif cls and isinstance(node, (str, int, float)) and not isinstance(node, bool):
            for value in sigma_values(cls, node):
                if len(out) < most:
                    out.setdefault((cls, value))

    if isinstance(detection, dict):
        walk(detection, None)
    return list(out)


def sigma_platform(source: object) -> str:
    """windows, linux, macos or nothing, by a rule's log source."""
    def said(name: str) -> set[str]:
        value = source.get(name) if isinstance(source, dict) else None
        return {v.strip().lower() for v in (value if isinstance(value, list) else [value]) if isinstance(v, str)}

    for platform, names in (("windows", {"windows"}), ("linux", {"linux"}), ("macos", {"macos", "osx"})):
        if said("product") & names:
            return platform
    return "windows" if said("service") & set(WINDOWS_SERVICES) or said("category") & set(WINDOWS_CATEGORIES) else ""


#: Buffers of Suricata rules and the class of what is looked for in them; modifiers that follow a content.
BUFFERS = {
    "http.uri": "url", "http.uri.raw": "url", "http.host": "domain", "http.host.raw": "domain", "dns.query": "domain", "tls.sni": "domain", "tls.cert_subject": "domain",
    "http.user_agent": "strlit", "http.cookie": "strlit", "http.header": "strlit", "http.request_body": "strlit", "file.name": "file", "ja3.hash": "hash", "ja3s.hash": "hash",
}
MODIFIERS = {"http_uri": "url", "http_raw_uri": "url", "http_host": "domain", "http_raw_host": "domain", "dns_query": "domain", "tls_sni": "domain", "http_user_agent": "strlit", "http_cookie": "strlit", "http_header": "strlit"}


def content_text(value: str) -> str:
    """A content's text, with hex between bars; empty if its bytes aren't text."""
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] == '"':
        value = value[1:-1]
    out = []
    for i, part in enumerate(re.split(r"(?<!\\)\|", value)):
        if i % 2:
            try:
                out.append(bytes.fromhex(part).decode("ascii"))
            except ValueError:
                return ""
        else:
            out.append(re.sub(r'\\([;:"\\|])', r"\1", part))
    text = "".join(out)
    return text if text.isprintable() else ""


def suricata_values(cls: str, raw: str) -> list[str]:
    """Values of one content by its class; too short or odd ones have none."""
    text = raw.strip().lower()
    if cls == "domain":
        text = text.removeprefix("www.").strip(".")
        return [text] if len(text) >= 4 else []
    if cls == "hash":
        return [text] if _DIGEST.fullmatch(text) else []
    if cls == "url":
        if len(text) < 6 or "/" not in text:
            return []
        last = text.rpartition("/")[2]
        return [text, last] if text[0] == "/" and text.count("/") > 1 and len(last) >= 6 else [text]
    if cls == "file":
        return path_values(text)
    return [text] if len(text) >= 8 else []


def suricata_atoms(options: list[str], most: int = MOST["suricata"]) -> list[tuple[str, str]]:
    """Class and value pairs of a rule's options (as they stand between semicolons).

    A content belongs to the modifier that follows it, before the next content
    or buffer, else to the buffer opened last; negated contents are left out.
    """
    pairs = [(k.strip().lower(), v.strip()) for k, _, v in (o.partition(":") for o in options)]
    out: dict[tuple[str, str], None] = {}
    buffer = "strlit"
    for i, (key, value) in enumerate(pairs):
        if not value and key in BUFFERS:
            buffer = BUFFERS[key]
        if key != "content" or value.startswith("!"):
            continue
        cls = buffer
        for later, more in pairs[i + 1 :]:
            if later == "content" or (not more and later in BUFFERS):
                break
            if not more and later in MODIFIERS:
                cls = MODIFIERS[later]
                break
        text = content_text(value)
        if cls == "strlit" and is_host(text.strip().lower()):
            cls = "domain"
        for v in suricata_values(cls, text) if text else ():
            if len(out) < most:
                out.setdefault((cls, v))
    return list(out)


def literal_class(text: str) -> str:
    """Class of a text literal: the first of hash, url, ip, registry, file, domain that fits, else strlit."""
    low = text.lower()
    octets = low.split(".")
    tests = (
        ("hash", _DIGEST.fullmatch(low)), ("url", re.match("(?:https?|ftp)://", low)), ("ip", len(octets) == 4 and all(o.isdigit() and int(o) < 256 for o in octets)),
        ("registry", re.match(r"hkey_|hk(?:lm|cu)\\|software\\|system\\currentcontrolset", low.replace("/", "\\"))),
        ("file", re.search(r"[\\/]", low) and re.search(r"\.[a-z0-9]{1,5}$", low)), ("domain", is_host(low)),
    )
    return next((cls for cls, fits in tests if fits), "strlit")


def yara_atoms(meta: dict[str, str], strings: list[tuple[str, str]], most: int = MOST["yara"]) -> list[tuple[str, str]]:
    """Class and value pairs of a rule: hashes of its meta block first, then its text strings (kind, value)."""
    found = [("hash", part) for key, value in meta.items() if re.fullmatch(r"(?:hash|md5|sha1|sha256|sample)\w*", key.lower()) for part in re.split(r"[\s,;]+", value)]
    found += [(literal_class(value), value) for kind, value in strings if kind == "text"]
    out: dict[tuple[str, str], None] = {}
    for cls, raw in found:
        text = raw.strip().lower()
        if cls == "file":
            values = path_values(text)
        elif cls == "hash":
            values = [text] if _DIGEST.fullmatch(text) else []
        else:
            text = text.replace("\\", "/") if cls == "registry" else text.removesuffix(".").removeprefix("www.") if cls == "domain" else text
            values = [text] if len(text) >= {"domain": 4, "ip": 1}.get(cls, 8) else []
        for v in values:
            if len(out) < most and v.isprintable():
                out.setdefault((cls, v))
    return list(out)


def yara_platform(meta: dict[str, str], imports: list[str]) -> str:
    stated = meta.get("os", "").lower()
    return stated if stated in ("windows", "linux", "macos") else "windows" if "pe" in imports else "linux" if "elf" in imports else ""


def atom_table(rules: DataFrame, key: str, columns: tuple[str, ...], find: Callable[..., list[tuple[str, str]]]) -> DataFrame:
    """key, class, value, place: what ``find`` gives for the columns of each rule, in order."""
    kind = dict(rules.dtypes)[key]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            rows = [(k, c, v, n) for k, *args in zip(frame[key], *(frame[c] for c in columns)) for n, (c, v) in enumerate(find(*args))]
            yield pd.DataFrame(rows, columns=[key, "class", "value", "place"])

    return rules.select(key, *columns).mapInPandas(run, f"{key} {kind}, class string, value string, place int")

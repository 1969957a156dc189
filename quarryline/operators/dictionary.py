"""Known names in texts: the index of names, matches with claimed spans, aliases, techniques by word."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "canonical string, entity_type string, mitre_id string, start long, context string, confidence double"


def name_index(objects: DataFrame, least: int = 4) -> DataFrame:
    """name, canonical, entity_type, mitre_id: lower-cased names and aliases (id, type, name, aliases) of ``least`` letters or more."""
    each = objects.select("type", "name", "id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    rows = each.select(F.lower(F.btrim("form")).alias("name"), F.col("name").alias("canonical"), F.col("type").alias("entity_type"), F.col("id").alias("mitre_id"))
    return rows.where(F.length("name") >= least).dropDuplicates(["entity_type", "canonical", "name"])


class Names:
    """An automaton of names, or a plain search where the library is missing."""

    def __init__(self, entries: list[tuple]):
        self.entries: dict[str, list[tuple]] = {}
        for e in entries:
            self.entries.setdefault(e[0], []).append(e)
        try:
            import ahocorasick
        except ImportError:
            self.automaton = None
            return
        self.automaton = ahocorasick.Automaton()
        for name in self.entries:
            self.automaton.add_word(name, name)
        if self.entries:
            self.automaton.make_automaton()

    def _places(self, text: str) -> Iterator[tuple[int, str]]:
        if self.automaton is not None:
            for end, name in self.automaton.iter(text) if self.entries else ():
                yield end - len(name) + 1, name
            return
        for name in self.entries:
            at = text.find(name)
            while at >= 0:
                yield at, name
                at = text.find(name, at + 1)

    def find(self, text: str | None) -> list[tuple]:
        """Names that stand alone, the longest first; a claimed stretch is not used again, a canonical name counts once."""
        low = (text or "").lower()
        part = lambda c: c.isalnum() or c == "-"
        spans = []
        for at, name in self._places(low):
            end = at + len(name)
            if not (at and part(low[at - 1])) and not (end < len(low) and part(low[end])):
                spans += [(-len(name), at, end, e) for e in self.entries[name]]
        out, taken, seen = [], [], set()
        for _, at, end, (name, canonical, kind, mitre) in sorted(spans, key=lambda s: s[:2]):
            if canonical.lower() in seen or any(a <= at < b or a < end <= b for a, b in taken):
                continue
            seen.add(canonical.lower())
            taken.append((at, end))
            out.append((canonical, kind, mitre, at, text[max(0, at - 60) : end + 60].strip(), 0.92 if name == canonical.lower() else 0.88))
        return out


def matched(docs: DataFrame, entries: list[tuple], key: str = "doc_id", col: str = "text") -> DataFrame:
    """key and ``SCHEMA``: the names of ``entries`` (name, canonical, entity_type, mitre_id) in each text.

    The entries are the reference list of names, which the caller holds.
    """
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, columns = Names(entries), [key, *(c.split()[0] for c in SCHEMA.split(", "))]
        for frame in it:
            yield pd.DataFrame([(k, *m) for k, text in zip(frame[key], frame[col]) for m in names.find(text)], columns=columns)

    kind = dict(docs.dtypes)[key]
    return docs.select(key, col).mapInPandas(run, f"{key} {kind}, {SCHEMA}")


def known_in(docs: DataFrame, names: DataFrame, key: str = "doc_id", col: str = "text", least: int = 4) -> DataFrame:
    """key, name: accepted names (key, name) of ``least`` letters or more that stand alone in their own text."""
    both = docs.join(names.where(F.length(F.btrim("name")) >= least).distinct(), key)
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}-])\Q"), F.lower(F.btrim("name")), F.lit(r"\E(?![\p{L}\p{N}-])"))
    return both.where(F.regexp_like(F.lower(col), pattern)).select(key, "name")


def aliases_of(index: DataFrame) -> DataFrame:
    """mitre_id, canonical, forms: all surface forms of an id, with the id itself."""
    return index.groupBy("mitre_id").agg(F.min("canonical").alias("canonical"), F.array_sort(F.array_union(F.collect_set("name"), F.array(F.lower(F.first("mitre_id"))))).alias("forms"))


def searched(techniques: DataFrame, words: DataFrame, limit: int = 15) -> DataFrame:
    """query, id, rank of techniques (id, name, is_tactic, pos) for each query: ids that begin with it, then names that hold it."""
    q = F.lower(F.btrim("query"))
    pairs = words.where(q != "").join(F.broadcast(techniques), F.startswith(F.lower("id"), q) | F.contains(F.lower("name"), q))
    order = Window.partitionBy("query").orderBy((~F.startswith(F.lower("id"), q)).cast("int"), (~F.col("is_tactic")).cast("int"), "pos")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "id", "rank")

"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector is the
product of its letters' vectors, each rotated by the letter's place.  A text's
vector is the sum over its n-grams; a language's prototype is the sum over its
learning texts.  A text gets the language with the largest cosine.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, body, id_crc, texts_of

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 32 for all that aren't letters."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Profiler:
    """n-gram vectors of ``dim`` numbers; keeps those it has met, ``most`` at most."""

    def __init__(self, dim: int = 512, n: int = 3, seed: int = 7, most: int = 60_000):
        if not 1 <= n <= 3:
            raise ValueError("n must be 1 to 3")
        self.dim, self.n, self.seed, self.most = dim, n, seed, most
        self.letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.rows = np.empty((1024, dim), np.float32)

    def _letter(self, c: int) -> np.ndarray:
        v = self.letter.get(c)
        if v is None:
            bits = np.random.Generator(np.random.PCG64([self.seed, c])).integers(0, 2, self.dim)
            v = self.letter[c] = (2 * bits - 1).astype(np.float32)
        return v

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """A row for each n-gram code."""
        row = self.row
        if len(row) + len(grams) > self.most:
            row.clear()
        new = [g for g in grams.tolist() if g not in row]
        if len(row) + len(new) > len(self.rows):
            more = np.empty((2 * (len(row) + len(new)), self.dim), np.float32)
            more[: len(row)] = self.rows[: len(row)]
            self.rows = more
        for g in new:
            v = np.ones(self.dim, np.float32)
            for place in range(self.n):
                v = v * np.roll(self._letter(g >> 21 * place & 0x1FFFFF), place)
            self.rows[len(row)] = v
            row[g] = len(row)
        return self.rows[[row[g] for g in grams.tolist()]]

    def grams(self, text: bytes) -> np.ndarray:
        """Codes of the n-grams of letters and gaps; none if there is no letter."""
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        c = _letters()[points]
        if not (c != 32).any():
            return np.empty(0, np.uint64)
        c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
        c = c[~((c == 32) & np.concatenate([[False], c[:-1] == 32]))].astype(np.uint64)
        out = c[self.n - 1 :].copy()
        for place in range(1, self.n):
            out |= c[self.n - 1 - place : len(c) - place] << np.uint64(21 * place)
        return out

    def profile(self, text: bytes) -> np.ndarray | None:
        """Sum of the n-grams' vectors."""
        grams, counts = np.unique(self.grams(text), return_counts=True)
        return self.bundle(grams, counts) if len(grams) else None

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim)
        for k in range(0, len(grams), 4096):
            out += counts[k : k + 4096].astype(np.float32) @ self.vectors(grams[k : k + 4096])
        return out


@lru_cache(maxsize=4)
def profiler(dim: int, n: int) -> Profiler:
    return Profiler(dim, n)


def prototypes(docs: DataFrame, learn: Column, dim: int = 512, n: int = 3) -> dict[str, np.ndarray]:
    """Language prototypes from the rows for which ``learn`` holds and lang isn't null.

    A task sums its own rows, so the driver gets a vector for each language.
    """
    src = docs.where(learn & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), body().alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, sums = profiler(dim, n), {}
        for b in batches(it, 4 << 20):
            found: dict[str, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), texts_of(b.column("text"))):
                found.setdefault(lang, []).append(p.grams(text))
            for lang, grams in found.items():
                codes, counts = np.unique(np.concatenate(grams), return_counts=True)
                sums[lang] = sums.get(lang, 0) + p.bundle(codes, counts)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = src.mapInArrow(run, "lang string, v array<double>")
    each = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    rows = each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).collect()
    return {r.lang: np.array([x.x for x in r.v]) for r in sorted(rows)}


def predict(docs: DataFrame, protos: dict[str, np.ndarray], extra: list[Column] = (), dim: int = 512, n: int = 3, text: str = "text") -> DataFrame:
    """All columns of ``extra`` (at least the key) with lang_pred string and score double.

    ``text`` names the column of texts, or as row.text the field of a struct
    in ``extra``, which then goes to Python only once.  ``und`` with score 0
    goes to a text that is null or has no letter, and to all if no language was
    learnt.  The score is the best cosine, 0 at least.  Languages that score
    alike are taken in alphabetical order.
    """
    langs = sorted(protos)
    unit = np.array([protos[k] / max(np.linalg.norm(protos[k]), 1e-12) for k in langs]).reshape(len(langs), dim)
    outer, _, field = text.partition(".")
    src = docs.select(*extra) if field else docs.select(*extra, body(text).alias("_text"))
    kept = [f for f in src.schema if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"

    def one(p: Profiler, text: bytes | None) -> tuple[str, float]:
        v = p.profile(text) if langs and text else None
        if v is None:
            return UNKNOWN, 0.0
        cosine = np.round(unit @ v / max(np.linalg.norm(v), 1e-12), 9)
        best = int(np.argmax(cosine))
        return langs[best], float(min(1.0, max(0.0, cosine[best])))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiler(dim, n)
        for b in batches(it, 2 << 20):
            texts = b.column(outer).field(field) if field else b.column("_text")
            lang, score = zip(*(one(p, t) for t in texts_of(texts)))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(lang), pa.array(score, pa.float64())], names=[*(f.name for f in kept), "lang_pred", "score"])

    return src.mapInArrow(run, schema)


def identify(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Learns from the rows with a non-null lang whose crc32(doc_id as text) modulo
    ``parts`` is not ``held``.  No rows give none; repeated rows give repeated rows.
    """
    held_out = (id_crc() % parts) == held
    return predict(docs, prototypes(docs, ~held_out), [F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out")])

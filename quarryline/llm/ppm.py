"""Prediction by partial matching over bytes.

A trie of byte contexts up to ``order`` bytes long counts the symbols that
followed each.  A symbol's probability comes from the longest context that has
been seen; where the symbol is new to it, an escape (method D: half a count of
each distinct symbol goes to it) leads to the next shorter context, from which
the symbols of the longer one are excluded.  Below the empty context all
symbols not excluded are alike.  A text's score is the log10 probability of its
bytes and of the end mark, byte 255, which UTF-8 never uses.

``AdaptiveTrie`` is the model as a trie for single documents, adaptive or
pretrained.  ``score_documents`` does the same for a corpus: the probability of
a byte depends only on it and the ``order`` bytes before it, so documents are
dealt into blocks, each block sends its distinct (order + 1)-grams with their
learning counts to the shard of the trie that owns their last three context
bytes, and the shard returns a log probability for each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, body, id_crc, save, texts_of

ORDER = 5
END = 255
SYMBOLS = 256
#: Bytes of text in a block and, for the whole corpus, to a shard of the trie.
BLOCK, SHARD = 6 << 20, 16 << 20
_OWNED = 3  # context bytes that say which shard has a context; shorter contexts are everywhere


class AdaptiveTrie:
    """Context trie for one stream of documents."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.seen: dict[bytes, dict[int, int]] = {}

    def learn(self, text: bytes) -> None:
        data = bytes([END] * self.order) + text + bytes([END])
        for at in range(self.order, len(data)):
            self._count(data, at)

    def _count(self, data: bytes, at: int) -> None:
        for k in range(self.order + 1):
            node = self.seen.setdefault(data[at - k : at], {})
            node[data[at]] = node.get(data[at], 0) + 1

    def chance(self, context: bytes, symbol: int) -> float:
        """log10 of the probability of ``symbol`` after ``context``."""
        out, gone = 0.0, set()
        for k in range(min(self.order, len(context)), -1, -1):
            node = self.seen.get(context[len(context) - k :])
            if node is None:
                continue
            left = {s: c for s, c in node.items() if s not in gone}
            total, distinct = sum(left.values()), len(left)
            if symbol in left:
                return out + math.log10((left[symbol] - 0.5) / total)
            if distinct:
                out += math.log10(0.5 * distinct / total)
            gone |= node.keys()
        return out - math.log10(SYMBOLS - len(gone))

    def score(self, text: bytes, adapt: bool = False) -> float:
        """Sum over the bytes and the end; with ``adapt`` each is learnt once scored."""
        data, out = bytes([END] * self.order) + text + bytes([END]), 0.0
        for at in range(self.order, len(data)):
            out += self.chance(data[at - self.order : at], data[at])
            if adapt:
                self._count(data, at)
        return out


def adaptive_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id and the adaptive score of each row's lower-cased text; a null text counts as empty."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            scores = [AdaptiveTrie(order).score(t.lower(), adapt=True) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return src.mapInArrow(run, "doc_id long, score double")


# --- n-grams of a block of texts -------------------------------------------------


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with marks between them; where each text's first symbol is; symbols of each."""
    gap = bytes([END] * ORDER)
    data = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64) + 1
    starts = ORDER + np.concatenate([[0], np.cumsum(lengths + ORDER - 1)])[: len(texts)]
    return data, starts, lengths


def _codes(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """(ORDER + 1)-grams that end at the positions; the symbol is the lowest byte."""
    out = np.zeros(end - begin, np.uint64)
    for k in range(ORDER, -1, -1):
        out <<= np.uint64(8)
        out |= data[begin - k : end - k]
    return out


def _wanted(codes: np.ndarray) -> np.ndarray:
    """False at the marks between texts, of which only the first counts as an end."""
    return (codes & np.uint64(0xFFFF)) != np.uint64(0xFFFF)


def _grams(texts: list[bytes]) -> np.ndarray:
    """All codes to be scored.  An empty text's end has marks before it and is scored apart."""
    data, _, _ = _stream(texts)
    out = _codes(data, ORDER, len(data))
    return out[_wanted(out)]


def _hash(x: np.ndarray, n: int) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _pack(codes: np.ndarray) -> bytes:
    """Sorted codes as differences, byte by byte, which the shuffle's compression shrinks well."""
    return np.diff(codes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // 8
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view("<u8").reshape(n), dtype=np.uint64)


def _split(codes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts sorted codes shard by shard, and the shards' borders in it."""
    at = _hash((codes >> np.uint64(8)) & np.uint64((1 << 8 * _OWNED) - 1), shards)
    order = np.argsort(at.astype(np.uint16) if shards <= 1 << 16 else at, kind="stable")  # by radix for short numbers
    return order, np.concatenate([[0], np.cumsum(np.bincount(at, minlength=shards))])


def _word_shard(word: bytes, shards: int) -> int:
    return zlib.crc32(word) % shards


class TrieShard:
    """Contexts that one shard owns, with the short ones that all shards have.

    Each order has its entries (context and symbol) as sorted codes with their
    counts, and its contexts with the count, the number of distinct symbols and
    ``hidden``: what the next shorter context counts for those same symbols,
    i.e. how much of its total an escape from here excludes.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray]):
        self.entries, self.contexts = {}, {}
        for k in range(ORDER, -1, -1):
            if k == _OWNED - 1:
                codes, counts = short
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            e, inverse = np.unique(codes & mask, return_inverse=True)
            c = np.bincount(inverse, weights=counts, minlength=len(e))
            self.entries[k] = e, c
            codes, counts = e, c
        for k in range(ORDER + 1):
            e, c = self.entries[k]
            x, first = np.unique(e >> np.uint64(8), return_index=True)
            total = np.add.reduceat(c, first) if len(e) else c
            distinct = np.diff(np.append(first, len(e))).astype(np.float64)
            if k and len(e):
                below, cb = self.entries[k - 1]
                at = np.minimum(np.searchsorted(below, e & np.uint64((1 << 8 * k) - 1)), len(below) - 1)
                hidden = np.add.reduceat(cb[at], first)
            else:
                hidden = np.zeros(len(x))
            self.contexts[k] = x, total, distinct, hidden

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for those that aren't there."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's symbol after its context; codes are sorted."""
        out = np.zeros(len(codes))
        todo = np.arange(len(codes))
        hidden, gone = np.zeros(len(codes)), np.zeros(len(codes))
        for k in range(ORDER, -1, -1):
            if not len(todo):
                break
            key = codes[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            x, total, distinct, below = self.contexts[k]
            node = self._find(x, key >> np.uint64(8))
            known = node >= 0
            t = np.where(known, total[node] if len(x) else 0, 0) - hidden[todo]
            d = np.where(known, distinct[node] if len(x) else 0, 0) - gone[todo]
            e, c = self.entries[k]
            entry = np.full(len(todo), -1)
            entry[known] = self._find(e, key[known])
            hit = entry >= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                out[todo[hit]] += np.log10((c[entry[hit]] - 0.5) / t[hit])
                esc = known & ~hit & (d > 0)
                out[todo[esc]] += np.log10(0.5 * d[esc] / t[esc])
            miss = known & ~hit
            hidden[todo[miss]] = below[node[miss]]
            gone[todo[miss]] = distinct[node[miss]]
            # a context that hasn't been seen excludes nothing, and longer ones haven't either
            todo = todo[~hit]
        out[todo] -= np.log10(SYMBOLS - gone[todo])
        return out


def score_documents(docs: DataFrame, learn: Column) -> DataFrame:
    """Scores of all rows by a model learnt from those for which ``learn`` holds.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  Texts
    are scored as bytes with A-Z lower-cased; null counts as empty.  Repeated
    rows are learnt and scored each; no rows give none; with nothing to learn
    from, all symbols are alike and base_score is that of an empty model.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))

    def short(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the (_OWNED)-grams of learning texts; at -1 all bytes; at -2 the learnt empty texts."""
        found, size, empty = np.zeros(1 << 8 * _OWNED, np.int64), 0, 0
        for b in batches(it, 4 << 20):
            texts, on = texts_of(b.column("text")), b.column("learn").to_pylist()
            size += sum(map(len, texts)) + len(texts)
            mine = [t.lower() for t, x in zip(texts, on) if x]
            empty += sum(not t for t in mine)
            if mine:
                found += np.bincount((_grams(mine) & np.uint64((1 << 8 * _OWNED) - 1)).astype(np.int64), minlength=len(found))
        keys = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *keys.tolist()], pa.int64()), pa.array([size, empty, *found[keys].tolist()], pa.int64())], names=["key", "n"])

    # 256^3 keys at most reach the driver, and a few ten thousand in practice
    rows = src.mapInArrow(short, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    table = dict(zip(rows["key"], rows["n"]))
    size, empty = table.pop(-1, 0), table.pop(-2, 0)
    whole = 0xFFFFFF
    if empty:
        table[whole] = table.get(whole, 0) + empty
    keys = np.array(sorted(table), np.uint64)
    counts = np.array([table[int(k)] for k in keys], np.float64)
    shared = spark.sparkContext.broadcast((keys, counts))
    blocks, shards = max(1, -(-size // BLOCK)), max(8, -(-size // SHARD))
    # codes of an empty text: its end after marks only
    alone = np.uint64((1 << 8 * (ORDER + 1)) - 1)

    def of_block(texts: list[bytes]) -> np.ndarray:
        out = _grams(texts)
        return np.append(out, np.full(sum(not t for t in texts), alone)) if not all(texts) else out

    def cells(group: pa.Table) -> pa.Table:
        """The block's distinct codes and words by shard, with their counts in learning texts."""
        block = group.column("block")[0].as_py()
        texts = [t.lower() for t in texts_of(group.column("text"))]
        on = group.column("learn").to_pylist()
        # one sort for both: the lowest bit says whether a code is one to learn
        each = [of_block([t for t, x in zip(texts, on) if x == y]) << np.uint64(1) | np.uint64(y) for y in (False, True) if y in on]
        each = np.sort(np.concatenate(each))
        codes = each >> np.uint64(1)
        fresh = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        codes, n = codes[fresh], np.add.reduceat((each & np.uint64(1)).astype(np.int64), fresh)
        del each, fresh
        order, border = _split(codes, shards)
        codes, n = codes[order], n[order].astype("<u4")
        out = [(s, block, 0, _pack(codes[a:b]), n[a:b].tobytes()) for s, (a, b) in enumerate(zip(border, border[1:])) if b > a]
        words: Counter = Counter()
        for t, x in zip(texts, on):
            words.update(t.split() if x else ())
        words[b""] = sum(on)
        for t, x in zip(texts, on):
            if not x:
                for w in t.split():
                    words[w] += 0
        by_shard: dict[int, list[bytes]] = {}
        for w in sorted(words):
            by_shard.setdefault(_word_shard(w, shards), []).append(w)
        for s, ws in by_shard.items():
            out.append((s, block, 1, b"\n".join(ws), np.array([words[w] for w in ws], "<u4").tobytes()))
        cols = list(zip(*out))
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=["shard", "block", "kind", "what", "n"])

    def answers(group: pa.Table) -> pa.Table:
        """For each cell the values of its codes or words; for words also the shard's totals, at block -1."""
        shard = group.column("shard")[0].as_py()
        kinds = group.column("kind").to_pylist()
        at_block, what, n = group.column("block").to_pylist(), group.column("what"), group.column("n")
        out = []
        mine = [i for i, k in enumerate(kinds) if k == 0]
        if mine:
            parts = [_unpack(what[i].as_py()) for i in mine]
            codes, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            weights = np.concatenate([np.frombuffer(n[i].as_py(), "<u4") for i in mine])
            learnt = np.bincount(inverse, weights=weights, minlength=len(codes))
            on = learnt > 0
            p = TrieShard(codes[on], learnt[on], shared.value).log10(codes).astype("<f4")[inverse]
            for i, a, b in zip(mine, *(lambda e: (e[:-1], e[1:]))(np.cumsum([0, *map(len, parts)]))):
                out.append((at_block[i], 0, shard, p[a:b].tobytes(), 0, 0))
            del codes, inverse, parts
        mine = [i for i, k in enumerate(kinds) if k == 1]
        if mine:
            total: Counter = Counter()
            for i in mine:
                total.update(dict(zip(what[i].as_py().split(b"\n"), np.frombuffer(n[i].as_py(), "<u4").tolist())))
            for i in mine:
                found = np.array([total[w] for w in what[i].as_py().split(b"\n")], "<u4")
                out.append((at_block[i], 1, shard, found.tobytes(), 0, 0))
            out.append((-1, 2, shard, b"", sum(total.values()), sum(v > 0 for v in total.values())))
        cols = list(zip(*out))
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())], names=["block", "kind", "shard", "value", "n", "v"])

    names = ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n", "v"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums by document of a block; totals pass through with a null n_tokens."""
        out: list[tuple] = []
        if not left.num_rows:
            out += [(None, None, None, None, None, None, n, v) for n, v, k in zip(right.column("n").to_pylist(), right.column("v").to_pylist(), right.column("kind").to_pylist()) if k == 2]
        else:
            texts = [t.lower() for t in texts_of(left.column("text"))]
            got = {(k, s): v for k, s, v in zip(right.column("kind").to_pylist(), right.column("shard").to_pylist(), right.column("value").to_pylist())}
            data, starts, lengths = _stream(texts)
            at = np.arange(ORDER, len(data))
            codes = _codes(data, ORDER, len(data))
            keep = _wanted(codes)
            if not all(texts):  # the end of an empty text, which _wanted takes for a mark
                keep[starts[np.array([not t for t in texts])] - ORDER] = True
            at, codes = at[keep], codes[keep]
            order = np.argsort(codes)
            codes = codes[order]
            fresh = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            distinct, times = codes[fresh], np.diff(np.append(fresh, len(codes)))
            del codes, fresh
            by, border = _split(distinct, shards)
            p = np.empty(len(distinct), np.float32)
            for s, (a, b) in enumerate(zip(border, border[1:])):
                if b > a:
                    p[by[a:b]] = np.frombuffer(got[0, s], "<f4")
            each = np.empty(len(order))
            each[order] = np.repeat(p, times)
            score = np.add.reduceat(each, np.searchsorted(at, starts))
            del order, each
            count: dict[bytes, int] = {}
            by_shard: dict[int, list[bytes]] = {}
            words = [t.split() for t in texts]
            for w in sorted({b""}.union(*words)):
                by_shard.setdefault(_word_shard(w, shards), []).append(w)
            for s, ws in by_shard.items():
                count.update(zip(ws, np.frombuffer(got[1, s], "<u4").tolist()))
            logs = {w: math.log10(c + 0.1) for w, c in count.items()}
            seen = {w: c > 0 for w, c in count.items()}
            for doc, on, ws, total in zip(left.column("doc_id").to_pylist(), left.column("learn").to_pylist(), words, score):
                ws.append(b"")
                out.append((doc, not on, len(ws), sum(map(seen.__getitem__, ws)), math.fsum(map(logs.__getitem__, ws)), float(total), None, None))
        cols = list(zip(*out)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # a row's block follows from its content, so that a lost task deals them out again alike
    dealt = src.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long")).repartition(max(parts, min(blocks, 10 * parts)), "block")
    asked = dealt.groupBy("block").applyInArrow(cells, "shard int, block long, kind int, what binary, n binary")
    told = asked.groupBy("shard").applyInArrow(answers, "block long, kind int, shard int, value binary, n long, v long")
    result = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, n long, v long")
    kept = save(result, "ppm_scores")
    total = kept.where("n_tokens is null").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = total.n or 0, total.v or 0
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n + 0.1 * (v + 1)))
    return kept.where("n_tokens is not null").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def held_out_scores(docs: DataFrame, parts: int = 10) -> DataFrame:
    """``score_documents`` learnt from rows whose crc32(doc_id as text) modulo ``parts`` is not 0."""
    return score_documents(docs, (id_crc() % parts) != 0)


def brute_force(texts: list[bytes], learn: list[bool], order: int = ORDER) -> list[tuple[int, int, int, float, float]]:
    """n_tokens, n_known, train_tokens, base_score, score of each text by plain dictionaries, for tests."""
    trie, words = AdaptiveTrie(order), Counter()
    texts = [t.lower() for t in texts]
    for t, on in zip(texts, learn):
        if on:
            trie.learn(t)
            words.update([*re.findall(rb"[^\x20\x09-\x0D]+", t), b""])
    n, v = sum(words.values()), len(words)
    out = []
    for t in texts:
        own = [*re.findall(rb"[^\x20\x09-\x0D]+", t), b""]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out.append((len(own), sum(w in words for w in own), n, base, trie.score(t)))
    return out

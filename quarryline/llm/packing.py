"""Packing documents into fixed windows by the sum-of-squares rule.

Documents arrive one after another.  Each goes into the open window whose fill
level makes the sum over levels of (number of open windows at the level)^2
least; the counts sit in one array over levels.  Longer documents first fill
whole windows.  Every task packs the rows of its own partition, so nothing is
shuffled and no group is ever collected; its leftover windows are cut anew
into full ones and a last one into powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, body, texts_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class LevelPacker:
    """Sum-of-squares packing with capacity ``size``.

    ``place(item)`` puts an item of 1 to ``size`` units into a window;
    ``closed`` gets each window once it is full; ``open`` has the others by level.
    """

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.closed: list[list] = []

    def place(self, length: int, item) -> int:
        """The level that the item went to; ties go to the fullest window."""
        size, count = self.size, self.count
        if length == size:
            self.closed.append([item])
            return 0
        # cost of using level h: the squares change by 2 N[h+l] + 1 - (2 N[h] - 1)
        room = size - length
        cost = 2 * count[length : size + 1] + 1
        cost[room] = 0  # a full window leaves the levels
        cost[1 : room + 1] -= 2 * count[1 : room + 1] - 1
        usable = count[: room + 1] > 0
        usable[0] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        h = room - int(np.argmin(cost[::-1]))
        window = self.open[h].pop() if h else []
        count[h] -= bool(h)
        window.append(item)
        if h + length == size:
            self.closed.append(window)
        else:
            self.open[h + length].append(window)
            count[h + length] += 1
        return h

    def rest(self) -> list[list]:
        """The open windows, fullest first; none are open afterwards."""
        out = [w for level in reversed(self.open) for w in level]
        self.__init__(self.size)
        return out


class ByteBpe:
    """Ids of a byte-level BPE file, word by word with a memo of words.

    The pre-tokenizer always begins a new word at a space that a non-space
    follows or precedes, so the stretches between such spaces can be encoded
    alone.  New stretches of plain Latin text go through a faster engine that
    is built from the same file's vocabulary; all others, and texts that hold
    a special token, through the file's own library.
    """

    CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")
    WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    PLAIN = re.compile("[\\n -~\u00a1-\u024f]*")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # the usual byte alphabet: printable Latin-1 stands for itself, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.engine = tiktoken.Encoding("words", pat_str=self.WORD, mergeable_ranks=ranks, special_tokens={})
        self.after_space = Memo(lambda w: self._encode(f" {w}"), 300_000)

    def _encode(self, text: str) -> bytes:
        if self.PLAIN.fullmatch(text):
            return array("I", self.engine.encode_ordinary(text)).tobytes()
        return self._whole(text)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not text:
            return b""
        if any(x in text for x in self.special):
            return self._whole(text)
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or not text.replace("\n", "").isprintable():
            return b"".join([self.after_space[w[1:]] if w[0] == " " else self._encode(w) for w in self.CUT.split(text) if w])
        first, *words = text.split(" ")
        return self._encode(first) + b"".join(map(self.after_space.__getitem__, words))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder, with its memo, for all tasks of a Python worker."""
    return ByteBpe(path)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in windows of ``size`` ids (``SCHEMA``).

    A document is its ids and then ``end_id``; an empty or null text is
    ``end_id`` alone.  Rows that share a doc_id are separate documents; a null
    doc_id stays null.  No rows give no rows.  Other columns are ignored.
    ``sequence_id`` is the partition's number times 2^33 plus a running number.
    """
    if size < 2:
        raise ValueError("size must be 2 at least")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"), F.spark_partition_id().cast("long").alias("part"))
    end = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, next_id, part = byte_bpe(tokenizer), LevelPacker(size), 0, 0
        rows: list[tuple] = []

        def emit(window: list[tuple]) -> None:
            nonlocal next_id
            at = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, (part << 33) + next_id, at))
                at += len(ids) // 4
            next_id += 1

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])
                rows.clear()

        for b in batches(it):
            part = b.column("part")[0].as_py()
            for doc, text in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text"))):
                ids = bpe.encode(text.decode("utf-8", "replace")) + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    packer.place(len(piece) // 4, (doc, start, piece, total))
                while packer.closed:
                    emit(packer.closed.pop())
            yield from flush()
        # leftover windows: full ones again, then powers of two
        window, room = [], size
        left = [item for w in packer.rest() for item in w]
        tail = sum(len(x[2]) // 4 for x in left)
        for doc, start, ids, total in left:
            while ids:
                if not window:
                    room = size if tail >= size else 1 << (tail.bit_length() - 1)
                take = min(room, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], total))
                ids, start, room, tail = ids[4 * take :], start + take, room - take, tail - take
                if not room:
                    emit(window)
                    window = []
            if len(rows) > 50_000:
                yield from flush()
        yield from flush()

    return src.mapInArrow(run, SCHEMA)

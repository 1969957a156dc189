"""Merge-type piece encoding by a table of last tokens.

For every prefix of a word there is exactly one token that its encoding ends
with.  The table stores it: of the vocabulary entries that an automaton finds
to end at a position, the right one is that which is compatible with the last
token of the prefix before it, i.e. the pair's own encoding is the pair.  Ids are
then recovered backwards from the end of the word.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, body, texts_of

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """Vocabulary of a BPE model file, its encoder and its decoder."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unk, self.none = sp.unk_id(), n
        self.score: dict[str, float] = {}
        self.byte: dict[int, int] = {}
        self.text: list[str] = []
        self.raw: list[bytes] = []
        self.automaton = ahocorasick.Automaton()
        for i in range(n):
            piece = sp.id_to_piece(i)
            self.text.append(piece)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(" \u2047 ".encode() if sp.is_unknown(i) else b"")
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                self.score[piece] = sp.get_score(i)
                self.automaton.add_word(piece, (i, len(piece)))
        self.text.append("")
        self.automaton.make_automaton()
        self.length = list(map(len, self.text))
        self.decimal = [str(i).encode() for i in range(n)]
        self.pairs = Memo(self._compatible, 600_000)
        self.differs: dict[str, bytes] = {}
        self.after_space = Memo(self._after_space, 300_000)

    def merged(self, text: str) -> list[str]:
        """Plain merging: again and again the best, then leftmost, pair that is a piece."""
        part, score, never = list(text), self.score, float("-inf")
        best = [score.get(a + b, never) for a, b in zip(part, part[1:])]
        while best and (top := max(best)) > never:
            i = best.index(top)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del best[i]
            if i:
                best[i - 1] = score.get(part[i - 1] + part[i], never)
            if i < len(best):
                best[i] = score.get(part[i] + part[i + 1], never)
        return part

    def _compatible(self, pair: int) -> bool:
        a, b = (self.text[i] for i in divmod(pair, 1 << 24))
        return self.merged(a + b) == ([a, b] if a else [b])

    def ids(self, word: str) -> list[int]:
        """Ids of a word; the table ``last`` has the last token of each prefix."""
        n, pairs = len(word), self.pairs
        last: list[int | None] = [None] * (n + 1)
        for at, (i, length) in self.automaton.iter(word):
            if last[at + 1] is None:
                # no token ends at the start: a character outside the vocabulary does, over which nothing merges
                before = last[at + 1 - length]
                if pairs[((self.none if before is None else before) << 24) + i]:
                    last[at + 1] = i
        out: list[int] = []
        while n:
            i = last[n]
            if i is not None:
                out.append(i)
                n -= self.length[i]
                continue
            n -= 1
            if self.byte:
                out += [self.byte[b] for b in reversed(word[n].encode())]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out[::-1]

    def _after_space(self, word: str) -> bytes:
        """Decimal ids of a word after a space; its decoded bytes are kept if they differ from the word's."""
        ids = self.ids(SPACE + word)
        raw = b"".join([self.raw[i] for i in ids])
        if raw != b" " + word.encode():
            self.differs[word] = raw
        return b",".join([self.decimal[i] for i in ids])

    def chunks(self, text: str) -> list[str]:
        """Normalised words: a run of spaces with the other characters after it."""
        out, run = [], 1
        for w in text.replace(SPACE, " ").split(" ") if text else ():
            if w:
                out.append(SPACE * run + w)
                run = 1
            else:
                run += 1
        if run > 1:
            out.append(SPACE * (run - 1))
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in self.chunks(text) for i in self.ids(w)]

    def decode(self, ids: list[int]) -> str:
        """Bytes of ids put together; bad UTF-8 bytes each become U+FFFD."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids' text and of the decoded text."""
        if not text:
            ids, decoded = b"", b""
        elif "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            found = self.encode(text)
            ids, decoded = b",".join([self.decimal[i] for i in found]), self.decode(found).encode()
        else:
            words = text.split(" ")
            ids = b",".join(map(self.after_space.__getitem__, words))
            decoded = text.encode()
            if self.differs and not self.differs.keys().isdisjoint(words):
                decoded = b"".join([self.differs.get(w) or b" " + w.encode() for w in words])
                decoded = decoded[1:] if decoded[:1] == b" " else decoded
        return (ids.count(b",") + 1 if ids else 0), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model, with its tables, for all tasks of a Python worker."""
    return PieceModel(path)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """Ids' count and hash and the decoded text's hash per row (``SCHEMA``).

    A null or empty text has no ids and decodes to the empty text.  Repeated
    rows give repeated rows, no rows give none; other columns are ignored.
    Words are encoded one by one with a memo of bounded size, so a very long
    text needs memory in proportion to its own length only.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for b in batches(it):
            done = [m.digest(t.decode("utf-8", "replace")) for t in texts_of(b.column("text"))]
            n, ids, decoded = zip(*done)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, SCHEMA)

"""Token counts by unigram segmentation over a trie of distinct pre-tokens.

Distinct pre-tokens are inserted in a trie.  A node stands for a prefix and
keeps the score of the prefix's best segmentation into vocabulary pieces and
its number of tokens.  Both follow from the node's ancestors, so a prefix that
many words share is scored once; a word's count is read at its terminal node.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, body, texts_of

SPACE = "▁"
SCHEMA = "doc_id long, n_pretokens long, n_tokens long, best_score double"


def unigram_scores(path: str) -> dict[str, float]:
    """Log probability of each piece of a model file, by Zipf's law on the piece's rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return {p: -math.log(k + 1) - total for k, p in enumerate(pieces)}


class PretokenTrie:
    """Forward scores of prefixes; emptied when it has ``most`` nodes.

    A character that is no piece is a token of its own, 10 below the least score.
    Of segmentations that score alike, the one with the longer last piece counts.
    """

    def __init__(self, scores: dict[str, float], most: int = 1_000_000):
        self.scores, self.most = scores, most
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens = array("d", [0.0]), array("q", [0])
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """Node of the word; adds and scores the prefixes that are new."""
        found = self.terminal.get(word)
        if found is not None:
            return found
        child, score, tokens, scores, longest = self.child, self.score, self.tokens, self.scores, self.longest
        path, node = [0], 0
        for j, c in enumerate(word, 1):
            key = (node << 21) | ord(c)
            node = child.get(key)
            if node is None:
                best, count = score[path[-1]] + self.unknown, tokens[path[-1]] + 1
                for i in range(max(0, j - longest), j):
                    s = scores.get(word[i:j])
                    if s is not None and (s := s + score[path[i]]) > best:
                        best, count = s, tokens[path[i]] + 1
                node = child[key] = len(score)
                score.append(best)
                tokens.append(count)
            path.append(node)
        self.terminal[word] = node
        return node


@lru_cache(maxsize=2)
def pretoken_trie(path: str) -> PretokenTrie:
    """One trie for all tasks of a Python worker."""
    return PretokenTrie(unigram_scores(path))


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """Pre-tokens, tokens and best score of each row's whole text (``SCHEMA``).

    Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+``, each after a mark for the
    space.  A null or empty text has none, and score 0.  Repeated rows give
    repeated rows; other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = pretoken_trie(model)
        for b in batches(it):
            n, tokens, best = [], [], []
            for text in texts_of(b.column("text")):
                words = text.split()
                if len(trie.score) > trie.most:
                    trie.clear()
                for w in set(words).difference(trie.terminal):
                    trie.terminal[w] = trie.insert(SPACE + w.decode("utf-8", "replace"))
                at = np.fromiter(map(trie.terminal.__getitem__, words), np.int64, len(words))
                n.append(len(words))
                tokens.append(int(np.frombuffer(trie.tokens, np.int64)[at].sum()))
                best.append(float(np.frombuffer(trie.score, np.float64)[at].sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(best, pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "best_score"])

    return src.mapInArrow(run, SCHEMA)

"""Helpers the text operators share: columns, scratch tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, release, save, scratch_root  # noqa: F401  for the operators here


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def body(col: str | Column = "text") -> Column:
    """A text as a non-null string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_crc(col: str | Column = "doc_id") -> Column:
    """crc32 of an id written as decimal text; a null id counts as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def inputs(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the columns an operator reads, so others can't clash."""
    return docs.select(*cols)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def batches(it: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most_bytes`` of data at most, one row at least."""
    for b in it:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * most_bytes / max(b.nbytes, 1)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


class Memo(dict):
    """A dict filled by ``make`` on a miss, with two generations.

    At ``most`` entries the present generation becomes the old one, and the
    old one goes; what is still in use moves over on its next miss.
    """

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

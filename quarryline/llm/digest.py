"""Fingerprints of quartile buckets and a bounded difference between them.

Byte triplets of a sliding window of five bytes are hashed into 128 buckets.
A bucket's code says in which quarter of all counts its count lies.  The digest
is a checksum, the text's length on a logarithmic scale, two ratios of the
quartiles and the codes.  Two digests differ by the sum of their codes' steps
and of the header's steps; likeness falls from 1 to 0 as this grows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body

BUCKETS = 128
#: Offsets, from the window's end, of the triplets that are counted.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
#: Difference at which nothing is alike.
MOST = 320
_STEP = np.array([0, 1, 2, 6])
_ODD = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 31, (len(TRIPLETS), 4), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BYTES = np.arange(256, dtype=np.uint32)
_TABLES = [[_BYTES * k for k in row[:3]] for row in _ODD]


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets of all windows, in slices of bounded size."""
    counts = np.zeros(BUCKETS, np.int64)
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, max(len(whole) - 4, 0), 1 << 20):
        part = whole[begin : begin + (1 << 20) + 4]
        n = len(part) - 4
        at = [part[4 - k : 4 - k + n] for k in range(5)]
        for (x, y, z), (tx, ty, tz), odd in zip(TRIPLETS, _TABLES, _ODD):
            h = tx[at[x]]
            h += ty[at[y]]
            h += tz[at[z]]
            h += odd[3]
            h ^= h >> np.uint32(15)
            h *= odd[0]
            h >>= np.uint32(25)
            counts += np.bincount(h, minlength=BUCKETS)
    return counts


def digest(data: bytes) -> bytes:
    """36 bytes: checksum, length, ratios, 32 bytes of codes.  Equal data give equal digests."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    scale = max(int(q3), 1)
    length = min(255, int(8 * np.log2(len(data) + 1)))
    ratios = (int(q1) * 15 // scale) << 4 | int(q2) * 15 // scale
    check = hashlib.blake2b(data, digest_size=2).digest()
    packed = (codes.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    return check[:1] + bytes([length, ratios]) + check[1:] + packed.tobytes()


def _codes(d: bytes) -> np.ndarray:
    packed = np.frombuffer(d, np.uint8, offset=4)
    return ((packed[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).astype(np.int64)


def difference(a: bytes, b: bytes) -> int:
    """0 for equal digests, ``MOST`` at most."""
    if a == b:
        return 0
    out = int(_STEP[np.abs(_codes(a) - _codes(b))].sum())
    out += 1 if a[0] != b[0] or a[3] != b[3] else 0
    out += 2 * abs(a[1] - b[1])
    out += abs((a[2] >> 4) - (b[2] >> 4)) + abs((a[2] & 15) - (b[2] & 15))
    return min(out, MOST)


def likeness(a: bytes, b: bytes) -> float:
    return 1 - difference(a, b) / MOST


def _pick(at: Column, bounds: list[int], first: int = 0) -> Column:
    """Number of bounds that are at most ``at``, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(at < bounds[mid], _pick(at, bounds[:mid], first)).otherwise(_pick(at, bounds[mid + 1 :], first + mid + 1))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each whole text and of its text edited with the next document's (``SCHEMA``).

    The next document is that with the next lower doc_id; a null doc_id is
    lowest, rows that share one are ordered by text, and after the last comes
    the first (a lone document is next to itself).  A null text counts as empty.
    Other columns are ignored; no rows give none.

    Documents are dealt out by ranges of doc_id whose bounds are quantiles, and
    sorted in their partition, where each meets its next one; the first document
    of each range is also sent to the range before it.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(4 * parts, 4096)
    found = src.where("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = sorted({int(x) for x in found})
    src = src.withColumn("bucket", F.coalesce(_pick(F.col("doc_id"), bounds), F.lit(0)))
    heads = {r[0]: r[1] for r in src.groupBy("bucket").agg(F.max("doc_id")).collect()}  # a row for each range
    order = sorted(heads, reverse=True)
    if order:
        after = dict(zip(order, [*order[1:], order[0]]))  # whose first document comes next
        ids = [x for x in heads.values() if x is not None]
        first = src.where(F.col("doc_id").isin(ids)) if ids else src.limit(0)
        if None in heads.values():
            first = first.unionByName(src.where("doc_id is null"))
        first = first.groupBy("doc_id", "bucket").agg(F.min("text").alias("text"))
        pairs = spark.createDataFrame([(b, int(a)) for a, b in after.items()], "bucket int, to int")
        guests = first.join(F.broadcast(pairs), "bucket").select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("guest"))
        if len(order) == 1:
            guests = guests.where("true")
        src = src.withColumn("guest", F.lit(False)).unionByName(guests)
    else:
        src = src.withColumn("guest", F.lit(False))
    low = F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1))
    src = src.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", low, "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held: tuple | None = None
        for b in it:
            rows = []
            for doc, raw, bucket, guest in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("bucket").to_pylist(), b.column("guest").to_pylist()):
                text = raw.as_py()
                own = digest(text.encode())
                if held and held[2] == bucket:
                    was, before, _, seen = held
                    k = len(before) // 3
                    edited = (before[: len(before) - k] + text[:k]).encode()
                    other = digest(edited)
                    rows.append((was, len(before), hashlib.sha256(edited).hexdigest(), seen.hex(), other.hex(), likeness(seen, other), likeness(seen, own)))
                held = None if guest else (doc, text, bucket, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return src.mapInArrow(run, SCHEMA)

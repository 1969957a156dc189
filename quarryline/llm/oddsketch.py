"""Near-duplicates: MinHash bands, odd sketches, full sets.

A document's set is that of its word shingles.  MinHash samples in bands find
candidates; an odd sketch, the parity bitmap of the samples, estimates by the
population count of two sketches' XOR how many samples differ, which is precise
at high similarity.  A second odd sketch, of the whole set, has a bit for each
element in the symmetric difference at most, so it rules pairs out for certain.
What passes is confirmed on the full sets.  Links then give connected components.

Equal sets are one representative, and each bucket first links its members to a
centre only.  In a bucket whose members aren't all in the centre's component
after that, each member outside it, an outsider, is held against all members of
other components, whatever the bucket's size.  Those comparisons are of sketches
only, in blocks of about ``BLOCK`` outsiders and ``BLOCK`` members, so that no
task gets a whole bucket, and nothing but pairs that pass is written.  They are as many as the bucket's outsiders times its members.

What can be lost: a pair at a similarity of 0.8 shares no band with probability
3e-6, and fails the estimate, which lets pass what looks ``SLACK`` less similar,
with probability below 1e-8 (32 of 160 samples differ on average, with a
standard deviation of 5; 64 would have to).  Full sets are compared by 64-bit
hashes of their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, body, save, texts_of
from .components import components
from .shingles import mix, shingle_sets

#: Bands times rows of MinHash.
BANDS, ROWS = 32, 5
#: Bits of an odd sketch.
BITS = 512
#: Pairs at ``SLACK`` below the threshold by their sketches still are confirmed.
SLACK = 0.2
#: Bits of the odd sketch of a whole set.
WHOLE = 1024
#: Outsiders and members of a bucket in a block.
BLOCK = 256

_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Sketcher:
    """Set key, band keys and odd sketches of shingle sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = BITS):
        rng = np.random.Generator(np.random.PCG64(11))
        self.bands, self.rows, self.bits = bands, rows, bits
        n = bands * rows
        self.mul = rng.integers(0, 1 << 31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.flip = rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32)
        self.salt = np.arange(n, dtype=np.uint64) * _GOLD

    def minima(self, found: np.ndarray) -> np.ndarray:
        """The samples: under each hash function the least value."""
        low = (found >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.mul), np.uint32(0xFFFFFFFF))
        for k in range(0, len(low), 1024):
            h = low[None, k : k + 1024] * self.mul
            h ^= self.flip
            np.minimum(out, h.min(axis=1), out=out)
        return out.astype(np.uint64)

    @staticmethod
    def _parity(at: np.ndarray, row: np.ndarray, rows: int, bits: int) -> np.ndarray:
        """For each row the bits that an odd number of the places ``at`` set, as longs."""
        odd = np.bincount(row * bits + at.astype(np.int64), minlength=rows * bits) & 1
        return np.packbits(odd.astype(np.uint8).reshape(rows, bits), axis=1).view(">i8").astype(np.int64)

    def sketch(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Band keys, the samples' odd sketch and the whole set's odd sketch of each set, a row each."""
        n = len(sets)
        low = np.array([self.minima(x) for x in sets]).reshape(n, -1)
        keys = np.zeros((n, self.bands), np.uint64)
        for r in range(self.rows):
            keys = mix(keys * _GOLD + low[:, r :: self.rows])
        keys = mix(keys + np.arange(self.bands, dtype=np.uint64))
        at = mix(low + self.salt) % np.uint64(self.bits)
        odd = self._parity(at.ravel(), np.repeat(np.arange(n), low.shape[1]), n, self.bits)
        sizes = [len(x) for x in sets]
        return keys.view(np.int64), odd, self._parity(np.concatenate(sets) % np.uint64(WHOLE), np.repeat(np.arange(n), sizes), n, WHOLE)

    def most_differing(self, similarity: float) -> int:
        """The XOR population count that a pair of this similarity has on average."""
        differ = 2 * len(self.salt) * (1 - similarity)
        return int(self.bits / 2 * (1 - np.exp(-2 * differ / self.bits)))


def set_key(found: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """id, n, key1, key2, bands, odd, whole for every row of docs (id, text)."""

    def column(rows: np.ndarray, some: list[bool]) -> pa.Array:
        """A list of longs for each row that has some, an empty one for the others."""
        border = np.cumsum([0, *(rows.shape[1] * x for x in some)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(rows.ravel(), pa.int64()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketcher()
        for b in batches(it, 1 << 20):
            sets = list(shingle_sets(texts_of(b.column("text")), k))
            keys, some = [set_key(x) for x in sets], [len(x) > 0 for x in sets]
            made = s.sketch([x for x in sets if len(x)]) if any(some) else [np.empty((0, 1), np.int64)] * 3
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(x) for x in sets], pa.int64()), *(pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)), *(column(x, some) for x in made)],
                names=["id", "n", "key1", "key2", "bands", "odd", "whole"],
            )

    return docs.mapInArrow(run, "id long, n long, key1 long, key2 long, bands array<long>, odd array<long>, whole array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """id and all shingle hashes for every row of docs (id, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2 << 20):
            sets = list(shingle_sets(texts_of(b.column("text")), k))
            border = pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(border, pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _differing(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches."""
    counts = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(counts, F.lit(0), lambda total, x: total + x)


def passing(percent: int) -> Column:
    """Whether two rows (n, odd, whole) and (cn, co, cw) may be as similar as that, by sizes and sketches."""
    most = Sketcher().most_differing(percent / 100 - SLACK)
    fits = (100 * F.least("n", "cn") >= percent * F.greatest("n", "cn")) & (_differing("odd", "co") <= most)
    # two sets at the threshold differ in (100 - percent) / (100 + percent) of their elements
    return fits & ((100 + percent) * _differing("whole", "cw") <= (100 - percent) * (F.col("n") + F.col("cn")))


def compared(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a member a and an outsider b of one block that ``passing`` would let pass.

    rows: centre, part, turn (the block), out, id, label, at_home, n, odd, whole.
    Pairs with equal labels are left out; of two outsiders, who meet twice, one
    pair is taken.
    """
    most = Sketcher().most_differing(percent / 100 - SLACK)

    def pairs(block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        out = block.column("out").to_numpy()
        split = int(out.sum())  # outsiders come first
        if split in (0, len(out)):
            return
        num = {c: block.column(c).to_numpy() for c in ("id", "label", "n")}
        home = block.column("at_home").to_numpy()[split:]
        odd, whole = (block.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(out), -1) for c in ("odd", "whole"))
        ids, labels, sizes = (num[c][split:] for c in ("id", "label", "n"))
        for k in range(split):
            n = num["n"][k]
            at = np.flatnonzero((labels != num["label"][k]) & (home | (ids < num["id"][k])) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
            at = at[np.bitwise_count(odd[split:][at] ^ odd[k]).sum(1) <= most]
            at = at[(100 + percent) * np.bitwise_count(whole[split:][at] ^ whole[k]).sum(1, dtype=np.int64) <= (100 - percent) * (sizes[at] + n)]
            if len(at):
                yield ids[at], np.full(len(at), num["id"][k])

    def done(table: pa.Table, border: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [p for a, b in zip(border[:-1], border[1:]) for p in pairs(table.slice(a, b - a))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the block that goes on
        for b in it:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([*held, b])
            keys = [table.column(c).to_numpy() for c in ("centre", "part", "turn")]
            border = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            last = int(border[-1]) if len(border) else 0
            if last:
                yield from done(table, np.concatenate([[0], border]))
            held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from done(table, np.array([0, table.num_rows]))

    key = ["centre", "part", "turn"]
    return rows.repartition(*key).sortWithinPartitions(*key, F.desc("out")).mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the saved pairs (a, b) whose full sets have ``100 |A & B| >= percent |A | B|``.

    Only the texts of documents in a pair are read further, and each one's set is made once.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = save(full_sets(docs.join(ids, "id", "left_semi"), k), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.where((F.col("shared") > 0) & (100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared")))).select("a", "b")


def _light(nodes: DataFrame, prefix: str = "") -> DataFrame:
    """What a comparison needs of a node, under other names if it is a centre or an outsider."""
    if not prefix:
        return nodes.select("id", "n", "odd", "whole")
    return nodes.select(F.col("id").alias(prefix), F.col("n").alias("cn"), F.col("odd").alias("co"), F.col("whole").alias("cw"))


def starred(nodes: DataFrame) -> DataFrame:
    """id, centre: each member of a bucket of two or more with the bucket's centre, once.

    The centre is the member that shares its buckets with most others, which of a text and its copies is the text.
    """
    member = nodes.select("id", F.explode("bands").alias("band"))
    sizes = save(member.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "sizes", light=True)
    shared = save(member.join(sizes, "band"), "shared", light=True)
    weight = shared.groupBy("id").agg(F.sum("members").alias("weight"))
    # weight and id as one number, whose largest an aggregation can keep in place
    span = F.lit(Decimal(1 << 64))
    rank = F.col("weight").cast("decimal(17,0)") * span - (F.col("id").cast("decimal(20,0)") + F.lit(Decimal(1 << 63)))
    best = shared.join(weight, "id").groupBy("band").agg(F.max(rank.cast("decimal(38,0)")).alias("rank"))
    centre = ((span - F.col("rank") % span) % span - F.lit(Decimal(1 << 63))).cast("long")
    return shared.join(save(best.select("band", centre.alias("centre")), "centres", light=True), "band").where("id <> centre").select("id", "centre").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", k: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows without a word have an empty set and are linked with nothing, as are
    rows with a null key, whose component_id is null and which are kept.  Rows
    that share a key are one node if their texts agree in shingles; else the
    key stands for all of them.  No rows give none; other columns are ignored.
    """
    src = docs.select(F.col(key).cast("long").alias("id"), body().alias("text"))
    table = save(sketches(src, k), "sketches")
    some = (F.col("n") > 0) & F.col("id").isNotNull()
    # one representative, the least id, for all rows with the same set
    copies = table.where(some).groupBy("key1", "key2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    named = table.join(save(copies, "copies", light=True), ["key1", "key2"], "left").withColumn("rep", F.when(some, F.coalesce("rep", "id")))
    own = F.col("id") == F.col("rep")
    named = save(named.select("id", "n", "rep", *[F.when(own, F.col(c)).alias(c) for c in ("bands", "odd", "whole")]), "named")
    nodes = named.where("bands is not null")
    fits = passing(percent)

    star = save(starred(nodes), "star", light=True)
    pairs = star.join(_light(nodes), "id").join(_light(nodes, "centre"), "centre").where(fits)
    links = save(confirmed(save(pairs.select(F.col("id").alias("a"), F.col("centre").alias("b")), "pairs", light=True), src, k, percent), "links", light=True)
    labels = save(components(links), "labels", light=True)

    # members of the buckets that aren't one component
    of = lambda x, name: labels.select(F.col("id").alias(x), F.col("label").alias(name))
    groups = star.join(of("id", "label"), "id", "left").join(of("centre", "home"), "centre", "left")
    groups = save(groups.select("id", "centre", F.coalesce("label", "id").alias("label"), F.coalesce("home", "centre").alias("home")), "groups", light=True)
    sizes = groups.groupBy("centre").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("label") != F.col("home")).alias("outside")).where("outside > 0 and members > 1")
    blocks = [F.ceil(F.col(c) / BLOCK).cast("int").alias(to) for c, to in (("members", "parts"), ("outside", "turns"))]
    groups = groups.join(save(sizes.select("centre", *blocks), "split", light=True), "centre")
    place = lambda n: F.pmod(F.xxhash64("id"), n)
    inside = groups.withColumn("part", place(F.col("parts"))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    outside = groups.where("label <> home").withColumn("turn", place(F.col("turns"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = ["centre", F.col("part").cast("int").alias("part"), F.col("turn").cast("int").alias("turn")]
    own = ["id", "label", (F.col("label") == F.col("home")).alias("at_home")]
    rows = inside.select(*block, F.lit(False).alias("out"), *own).unionAll(outside.select(*block, F.lit(True).alias("out"), *own))
    found = save(compared(rows.join(_light(nodes), "id"), percent).distinct(), "found", light=True)
    if not found.isEmpty():
        more = save(confirmed(found, src, k, percent), "more", light=True)
        labels = save(components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionAll(more)), "labels", light=True)

    # every row gets its representative's component; all ids of a component are reachable, its least one is a representative
    out = named.select("id", "n", "rep").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
    component = F.coalesce("label", "rep", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

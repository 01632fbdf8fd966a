"""Operator 7: SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits: bit i is 1 if it is set in over half of
the hashes of the document's word shingles. Documents link if their
fingerprints differ in at most ``radius`` bits, and a group is a connected
component of links.

Candidates come from structured bit masks. Every bit position gets a vector of
radius + 1 bits, and each of the 2^(radius+1) - 1 other vectors v makes a
table whose mask keeps the positions with an odd product with v. Any two
fingerprints that differ in at most ``radius`` positions agree under one mask
at least: as many vectors can't span all radius + 1 dimensions, so some v is
orthogonal to all of them, and its mask leaves those positions out. So no pair
within the radius is lost, and a mask still keeps about half of the bits.

Equal fingerprints are one node, so exact copies cost one row whatever their
number. Fingerprints that agree under a mask form a bucket:

* up to ``PAIRWISE`` fingerprints, all pairs of the bucket are compared in one
  task, and the links of a spanning forest go on (not all pairs);
* a larger bucket isn't compared pair by pair. Its fingerprints meet at
  midpoints instead, for an even radius: two fingerprints differ in at most
  ``radius`` bits exactly if some value differs from both in at most
  radius / 2 bits. Each fingerprint of such buckets emits the values around it
  (2,081 for radius 4), dealt by value in one more shuffle. At most as many
  fingerprints lie around one value, and all of those link. The work is linear
  in the size of the bucket and spread over all tasks.

Defined results: a NULL or empty text has the fingerprint 0, linked like any
other; rows with a NULL id take part, and a NULL id is never a component's id
unless all its ids are NULL; repeated rows are kept and fall in one component;
other columns pass through where documents are kept or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tierlake.llm.components import components
from tierlake.llm.frames import add_columns, free_prefix
from tierlake.session import cut_lineage

BITS = 64
#: Fingerprints of a bucket that are compared pair by pair in one task.
PAIRWISE = 1000
#: Shingles hashed at a time.
CHUNK = 1 << 16


# --------------------------------------------------------------------------
# Fingerprints
# --------------------------------------------------------------------------

def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """64-bit fingerprint of a text (A-Z lowered, words between ASCII white
    space, shingles joined by one space, repeats included)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    set_bits = np.zeros(BITS, np.int64)
    total = len(words) - shingle + 1
    for lo in range(0, total, CHUNK):
        part = words[lo : lo + CHUNK + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(g, seed) for g in map(b" ".join, grams)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(set_bits * 2 > total, bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = 4, seed: int = 42, text: str = "text",
                 out: str = "fp") -> DataFrame:
    """``df`` with the fingerprint of each whole text, as a (signed) long."""
    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [fingerprint(t, shingle, seed) for t in batch.column(text).to_pylist()]
            return [pa.array(np.array(found, np.uint64).view(np.int64))]
        return compute

    return add_columns(df, [StructField(out, LongType())], make)


# --------------------------------------------------------------------------
# Links
# --------------------------------------------------------------------------

def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks such that any two values that differ in at most ``radius`` bits
    agree under one of them. The vectors of the positions are dealt in turn,
    so that every mask keeps nearly the same number of bits."""
    vectors = 1 << (radius + 1)
    of_bit = [1 + i % (vectors - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (of_bit[i] & v).bit_count() % 2)
            for v in range(1, vectors)]


def midpoint_flips(radius: int, bits: int = BITS) -> list[int]:
    """All values with at most half of ``radius`` bits (radius is even)."""
    return [sum(1 << b for b in chosen) for k in range(radius // 2 + 1)
            for chosen in combinations(range(bits), k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among distinct fingerprints (sorted)."""
    n = len(fps)
    if n == 2:
        near = int(fps[0] ^ fps[1]).bit_count() <= radius
        return (fps[:1], fps[1:]) if near else (fps[:0], fps[:0])
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                left.append(i)
                right.append(j)
    return fps[left], fps[right]


def _bucket_links(radius: int):
    """Task function over rows (t, key, fp) sorted by bucket: links (a, b);
    a fingerprint of a large bucket comes out as (fp, NULL)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        large = None  # the bucket that is passed on
        for batch in batches:
            t, key, fp = (batch.column(k).to_numpy() for k in range(3))
            t = np.concatenate([held[0], t.astype(np.int64)])
            key = np.concatenate([held[1], key])
            fp = np.concatenate([held[2], fp.view(np.uint64)])
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield from buckets(t[:last], key[:last], fp[:last], cuts[:-1], large)
            held = t[last:], key[last:], fp[last:]
            bucket = (int(held[0][0]), int(held[1][0])) if len(held[0]) else None
            if len(held[0]) > PAIRWISE or bucket == large and bucket is not None:
                large = bucket
                yield out(held[2], None)
                held = held[0][:0], held[1][:0], held[2][:0]
            else:
                large = None
        yield from buckets(*held, np.zeros(0, np.int64), large)

    def buckets(t, key, fp, cuts, large):
        if not len(t):
            return
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [len(t)]])
        several = np.flatnonzero(ends - starts > 1)
        if large is not None and (int(t[0]), int(key[0])) == large:
            yield out(fp[: ends[0]], None)  # the end of a large bucket
            several = several[several > 0]
        left, right = [], []
        for k in several.tolist():
            inside = fp[starts[k] : ends[k]]
            if len(inside) > PAIRWISE:
                yield out(inside, None)
                continue
            a, b = _forest(inside, radius)
            left.append(a)
            right.append(b)
        if left:
            yield out(np.concatenate(left), np.concatenate(right))

    return run


def links(nodes: DataFrame, radius: int, fp: str = "fp") -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct
    fingerprints of ``nodes`` that differ in at most ``radius`` (even) bits."""
    if radius % 2:
        raise ValueError("radius must be even")
    value = F.col(fp)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), value.bitwiseAND(F.lit(signed(m))).alias("key"))
                       for t, m in enumerate(covering_masks(radius))])
    spread = nodes.select(value.alias("fp"), F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    sorted_rows = spread.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    found = cut_lineage(sorted_rows.mapInArrow(_bucket_links(radius), "a long, b long").distinct())
    near = found.where("b is not null")
    dense = found.where("b is null").select(F.col("a").alias("fp"))
    if dense.isEmpty():
        return near
    points = F.array(*[F.lit(signed(m)) for m in midpoint_flips(radius)])
    around = dense.select("fp", F.explode(points).alias("m")).select(
        F.col("fp").bitwiseXOR(F.col("m")).alias("z"), "fp")
    # At most len(points) fingerprints lie around a point.
    meeting = around.groupBy("z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    met = meeting.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return near.unionByName(met.distinct())


def rooted(fps: DataFrame, first: Column, radius: int, fp: str) -> DataFrame:
    """A row for each distinct fingerprint of ``fps``: fp, ``_first`` (the
    least ``first`` of its rows) and ``_root``, a fingerprint that stands for
    its component. Runs jobs."""
    nodes = cut_lineage(fps.groupBy(fp).agg(F.min(first).alias("_first")))
    roots = components(links(nodes, radius, fp))
    return nodes.join(roots.withColumnRenamed("node", fp), fp, "left").select(
        fp, "_first", F.coalesce("root", F.col(fp)).alias("_root"))


def near_duplicates(fps: DataFrame, radius: int = 4, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """``fps`` (doc_id, fp, ...) with component_id, the smallest id of the
    component of each document; an existing column of that name is replaced.
    Runs jobs."""
    fps = cut_lineage(fps.drop("component_id"))
    nodes = rooted(fps, F.col(doc_id), radius, fp)
    smallest = nodes.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = nodes.join(smallest, "_root").select(fp, "component_id")
    return fps.join(named, fp)


def hex_digits(fp: str = "fp"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def deduplicate(df: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42,
                text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with one document of each group: the one with the smallest id
    (NULL last), and of those with the same id the least by the text's hash.
    An id whose rows lie in several groups can stay in each of them."""
    h, p = f"{free_prefix(df)}h", free_prefix(df)
    hashed = df.withColumn(h, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    prints = fingerprints(hashed.select(doc_id, text, h), shingle, seed, text).select(doc_id, "fp", h)
    first = F.struct(F.col(doc_id).isNull().alias("without"), F.col(doc_id).alias("id"), F.col(h).alias("h"))
    kept = rooted(prints, first, radius, "fp").groupBy("_root").agg(F.min("_first").alias("k")).select(
        F.col("k.id").alias(f"{p}id"), F.col("k.h").alias(f"{p}kept"))
    same = F.col(doc_id).eqNullSafe(F.col(f"{p}id")) & (F.col(h) == F.col(f"{p}kept"))
    # Equal texts are in one group, so a kept (id, hash) names one group.
    return hashed.join(kept, same, "left_semi").dropDuplicates([doc_id, h]).drop(h)

"""Operator 10: token-id files with fixed-width bit packing.

Texts are encoded with a tokenizer of the tokenizers library and the ids are
stored in the minimum number of bits that its vocabulary needs. A shard file
holds blocks of ``BLOCK_IDS`` ids and, at its end, the offsets of the blocks
and the place of each document, so that any document can be read without the
ones before it, and a block is unpacked with array operations.

Layout of a shard (little-endian)::

    magic "TLIDS001"
    blocks    each: its ids, `bits` bits an id, low bits first, filled up to a byte
    n+1 int64 byte offsets of the blocks
    m   int64 document ids, m uint8 "has an id", m+1 int64 first id of each document
    trailer   int64 blocks, documents, ids; int32 bits, ids a block; magic again

Encoding works on distinct pre-tokens of a block of texts: each goes to the
library's model once, and frequent ones are kept in a bounded table for later
blocks. Texts that hold one of the tokenizer's added tokens are encoded whole.

Documents are dealt into shards by ranges of the id (bounds from approximate
quantiles of the id column alone), so shard k's ids all precede shard k+1's;
the shuffle moves packed ids. An id (or NULL) with more documents than two
shards hold is cut further by ranges of a hash of the text, and equal texts of
one such id into parts, so no shard grows with the rows of one id. A task writes its shards block by block under a
temporary name and renames them when whole, so a repeated task replaces its
own files. Shard totals (a row a shard) are summed on the driver into global
positions, stored as a table beside the shards. Files are reached through
Arrow's file systems by the URI of the folder, which must be shared.

Defined results: a NULL or empty text is a document of the end id alone; rows
with a NULL id come first; documents of one id are ordered by their ids
(tokens), after the hash of the text where the id fills more than two shards;
an empty table gives no shards and an empty result; extra columns aren't
stored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.llm.bpe import expand, spread
from tierlake.llm.frames import small_batches
from tierlake.llm.pretokens import byte_level_starts, text_block, text_slices, words

MAGIC = b"TLIDS001"
#: Ids of a packed block (a multiple of 8, so blocks end on a byte).
BLOCK_IDS = 1 << 14
#: Documents of a shard, about.
SHARD_DOCS = 4000
#: Most shards that bounds are sought for.
MOST_SHARDS = 100_000
BLOCK_BYTES = 12 << 20
#: Pre-tokens kept between blocks.
KEPT = 400_000


# --------------------------------------------------------------------------
# Bits
# --------------------------------------------------------------------------

def bits_for(vocabulary: int) -> int:
    """Least bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, low bits first, filled up to a whole byte."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, : bits // 8].tobytes()
    flat = np.unpackbits(raw, axis=1, bitorder="little")[:, :bits]
    return np.packbits(flat, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed data."""
    out = np.zeros((count, 4), np.uint8)
    raw = np.frombuffer(data, np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = raw[: count * bits // 8].reshape(count, bits // 8)
    else:
        flat = np.unpackbits(raw, bitorder="little", count=count * bits).reshape(count, bits)
        wide = np.zeros((count, 32), np.uint8)
        wide[:, :bits] = flat
        out = np.packbits(wide, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


# --------------------------------------------------------------------------
# Encoding
# --------------------------------------------------------------------------

def byte_letters() -> str:
    """The characters that byte-level tokenizers use for the bytes 0 to 255:
    printable ones stand for themselves, others follow from code point 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(rest)) for b in range(256))


class Encoder:
    """A byte-level tokenizer file of the tokenizers library."""

    def __init__(self, file: bytes):
        self.library = tokenizers.Tokenizer.from_str(file.decode())
        added = self.library.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.kept: dict[bytes, list[int]] = {}

    def encode_distinct(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (flat) and n + 1 offsets of distinct pre-tokens."""
        model, letters, kept = self.library.model.tokenize, self.letters, self.kept
        if len(kept) > KEPT:
            kept.clear()
        out, sizes = [], []
        for word in distinct.to_pylist():
            ids = kept.get(word)
            if ids is None:
                ids = kept[word] = [t.id for t in model(word.decode("latin-1").translate(letters))]
            out += ids
            sizes.append(len(ids))
        return np.array(out, np.int32), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and text offsets, a block of texts at a time."""
        for lo, hi in text_slices(column, BLOCK_BYTES):
            part = column.slice(lo, hi - lo)
            block = text_block(part)
            w = words(block, byte_level_starts(block))
            ids, ends = spread(w, *self.encode_distinct(w.distinct))
            for content in self.added:
                for k in np.flatnonzero(pc.fill_null(pc.match_substring(part, content), False).to_numpy(
                        zero_copy_only=False)).tolist():
                    whole = self.library.encode(part[k].as_py(), add_special_tokens=False).ids
                    ids = np.concatenate([ids[: ends[k]], np.array(whole, np.int32), ids[ends[k + 1] :]])
                    ends = ends.copy()
                    ends[k + 1 :] += len(whole) - (ends[k + 1] - ends[k])
            yield ids, ends


@cache
def encoder_of(file: bytes) -> Encoder:
    """One tokenizer per worker."""
    return Encoder(file)


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by the end id."""
    n = len(ends) - 1
    places = ends + np.arange(n + 1)
    out = np.full(len(ids) + n, end_id, np.int32)
    out[expand(places[:-1], np.diff(ends))] = ids
    return out, places


# --------------------------------------------------------------------------
# Files
# --------------------------------------------------------------------------

def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")


class ShardWriter:
    """Writes one shard; memory holds one block and the places of the
    documents."""

    def __init__(self, folder: str, name: str, bits: int):
        self.fs, self.root = file_system(folder)
        self.name, self.bits = name, bits
        self.temporary = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)
        self.stream.write(MAGIC)
        self.at, self.blocks = len(MAGIC), [len(MAGIC)]
        self.open = np.zeros(0, np.int32)
        self.doc_ids: list[int | None] = []
        self.ends = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.ends.append(self.ends[-1] + len(ids))
        self.open = np.concatenate([self.open, ids])
        while len(self.open) >= BLOCK_IDS:
            self._block(self.open[:BLOCK_IDS])
            self.open = self.open[BLOCK_IDS:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.stream.write(data)
        self.at += len(data)
        self.blocks.append(self.at)

    def close(self) -> tuple[str, int, int]:
        """(name, documents, ids)"""
        if len(self.open):
            self._block(self.open)
        n = len(self.doc_ids)
        has = np.array([x is not None for x in self.doc_ids], np.uint8)
        self.stream.write(np.array(self.blocks, "<i8").tobytes())
        self.stream.write(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self.stream.write(has.tobytes())
        self.stream.write(np.array(self.ends, "<i8").tobytes())
        self.stream.write(np.array([len(self.blocks) - 1, n, self.ends[-1]], "<i8").tobytes())
        self.stream.write(np.array([self.bits, BLOCK_IDS], "<i4").tobytes() + MAGIC)
        self.stream.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        return self.name, n, self.ends[-1]


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, folder: str, name: str):
        fs, root = file_system(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        tail = self.file.read_at(40, size - 40)
        if tail[32:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{name} isn't a whole shard")
        blocks, self.documents, self.ids = np.frombuffer(tail, "<i8", 3).tolist()
        self.bits, self.block_ids = np.frombuffer(tail, "<i4", 2, 24).tolist()
        n = self.documents
        foot = 8 * (blocks + 1) + 8 * n + n + 8 * (n + 1)
        raw = self.file.read_at(foot, size - 40 - foot)
        self.blocks = np.frombuffer(raw, "<i8", blocks + 1)
        self.doc_ids = np.frombuffer(raw, "<i8", n, 8 * (blocks + 1))
        self.has_id = np.frombuffer(raw, np.uint8, n, 8 * (blocks + 1 + n)).astype(bool)
        self.ends = np.frombuffer(raw[8 * (blocks + 1 + n) + n :], "<i8", n + 1)

    def read(self, lo: int, hi: int) -> np.ndarray:
        """The shard's ids lo to hi - 1: only their blocks are read."""
        if hi <= lo:
            return np.zeros(0, "<u4")
        first, last = lo // self.block_ids, (hi - 1) // self.block_ids
        raw = self.file.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        base, parts = self.blocks[first], []
        for b in range(first, last + 1):
            count = min(self.block_ids, self.ids - b * self.block_ids)
            parts.append(unpack(raw[self.blocks[b] - base : self.blocks[b + 1] - base], self.bits, count))
        start = first * self.block_ids
        return np.concatenate(parts)[lo - start : hi - start]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.ends[k]), int(self.ends[k + 1]))


# --------------------------------------------------------------------------
# Spark
# --------------------------------------------------------------------------

class HotIds:
    """Where the documents of ids with many documents go: each such id has
    bounds of the text's hash, and each piece between two bounds a number of
    parts among which its (then equal) texts are dealt in turn."""

    def __init__(self, rows: DataFrame):
        """``rows``: doc_id, h. Collects a number an id or text with more than
        two shards' documents, so fewer than there are shards."""
        count = F.count(F.lit(1)).alias("n")
        most = 2 * SHARD_DOCS
        totals = {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(count).where(F.col("n") > most).collect()}
        equal: dict[int | None, dict[int, int]] = {i: {} for i in totals}
        if totals:
            for r in rows.groupBy("doc_id", "h").agg(count).where(F.col("n") > most).collect():
                equal[r.doc_id][r.h] = r.n
        self.pieces = {i: self._cut(n, equal[i]) for i, n in totals.items()}
        self.ids = np.array(sorted(i for i in totals if i is not None), np.int64)

    @staticmethod
    def _cut(n: int, equal: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        ranges = max(1, -(-(n - sum(equal.values())) // SHARD_DOCS))
        at = {-(1 << 63) + (k << 64) // ranges for k in range(1, ranges)}
        at |= {x for h in equal for x in (h, h + 1) if -(1 << 63) < x < 1 << 63}
        cuts = np.array(sorted(at), np.int64)
        parts = np.ones(len(cuts) + 1, np.int64)
        for h, rows in equal.items():
            parts[np.searchsorted(cuts, h, side="right")] = -(-rows // SHARD_DOCS)
        return cuts, parts

    def bounds(self) -> np.ndarray:
        """Bounds that leave each hot id alone in its range."""
        return np.concatenate([self.ids, self.ids[self.ids < (1 << 63) - 1] + 1])

    def place(self, names: pa.Array, h: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and part of each document, 0 for ids that aren't hot."""
        piece, part = np.zeros(len(h), np.int32), np.zeros(len(h), np.int32)
        missing = np.asarray(names.is_null())
        ids = pc.fill_null(names, 0).to_numpy()
        hot = np.isin(ids, self.ids) & ~missing
        chosen = [(i, np.flatnonzero(hot & (ids == i))) for i in np.unique(ids[hot]).tolist()]
        if None in self.pieces:
            chosen.append((None, np.flatnonzero(missing)))
        for i, where in chosen:
            cuts, parts = self.pieces[i]
            piece[where] = np.searchsorted(cuts, h[where], side="right")
            part[where] = turn[where] % parts[piece[where]]
        return piece, part


def write_tokens(df: DataFrame, tokenizer_path: str, folder: str, end_id: int, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """Encode ``df`` into shards under ``folder`` (new or empty) and store
    their table (shard, documents, ids, first) there too; returns that table.
    Runs jobs."""
    spark = df.sparkSession
    with open(tokenizer_path, "rb") as f:
        file = f.read()
    library = tokenizers.Tokenizer.from_str(file.decode())
    bits = bits_for(max(max(library.get_vocab().values()), end_id) + 1)
    tokenizer = spark.sparkContext.broadcast(file)
    small_batches(spark)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                     F.xxhash64(F.col(text)).alias("h"))
    shards = min(max(1, -(-rows.count() // SHARD_DOCS)), MOST_SHARDS)
    cuts = rows.stat.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.25 / shards) \
        if shards > 1 else []
    hot = HotIds(rows)
    bounds = np.unique(np.append(np.array([min(int(c), (1 << 63) - 1) for c in cuts], np.int64), hot.bounds()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer.value)
        turn = 0
        for batch in batches:
            lo = 0
            for ids, ends in encoder.encode(batch.column("text")):
                ids, ends = with_end(ids, ends, end_id)
                n = len(ends) - 1
                names = batch.column("doc_id").slice(lo, n)
                piece, part = hot.place(names, batch.column("h").slice(lo, n).to_numpy(), turn + np.arange(n))
                lo, turn = lo + n, turn + n
                shard = np.searchsorted(bounds, pc.fill_null(names, 0).to_numpy(), side="right") + 1
                shard[np.asarray(names.is_null())] = 0
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(shard.astype(np.int32)), pa.array(piece), pa.array(part),
                     pa.array(np.diff(ends).astype(np.int64)), packed_rows(ids, ends, bits)],
                    names=["doc_id", "shard", "piece", "part", "n", "packed"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, current, done = None, None, []
        for batch in batches:
            for name, *shard, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != current:
                    if writer:
                        done.append((*current, *writer.close()))
                    file_name = f"shard-{'-'.join(f'{x:06d}' for x in shard)}.ids"
                    writer, current = ShardWriter(folder, file_name, bits), shard
                writer.add(name, unpack(data, bits, n).astype(np.int32))
        if writer:
            done.append((*current, *writer.close()))
        columns = list(zip(*done, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [*[pa.int32()] * 3, pa.string(), *[pa.int64()] * 2], strict=True)],
            names=["number", "piece", "part", "shard", "documents", "ids"])

    key = ["shard", "piece", "part"]
    encoded = rows.mapInArrow(encode, "doc_id long, shard int, piece int, part int, n long, packed binary")
    dealt = encoded.repartition(*key).sortWithinPartitions(*key, F.col("doc_id").asc_nulls_first(), "packed")
    written = sorted(dealt.mapInArrow(
        write, "number int, piece int, part int, shard string, documents long, ids long").collect())
    first, table = 0, []
    for row in written:  # a row a shard
        table.append((row.shard, row.documents, row.ids, first))
        first += row.ids
    schema = "shard string, documents long, ids long, first long"
    spark.createDataFrame(table, schema).coalesce(1).write.parquet(f"{folder}/index")
    return spark.read.schema(schema).parquet(f"{folder}/index")


def packed_rows(ids: np.ndarray, ends: np.ndarray, bits: int) -> pa.Array:
    """Each document's ids, packed (a document begins at a byte)."""
    if bits % 8 == 0:
        data = pack(ids, bits)
        offsets = (ends * (bits // 8)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1,
                                     [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
    return pa.array([pack(ids[a:b], bits) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the shards under
    ``folder``: start is the number of ids before it; ids are little-endian
    unsigned 32-bit integers."""
    index = spark.read.schema("shard string, documents long, ids long, first long").parquet(f"{folder}/index")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("shard").to_pylist(), batch.column("first").to_pylist(), strict=True):
                shard = ShardReader(folder, name)
                lo = 0
                while lo < shard.documents:  # some documents at a time, some 4 million ids
                    hi = int(np.searchsorted(shard.ends, shard.ends[lo] + (1 << 22), side="right")) - 1
                    hi = min(max(hi, lo + 1), shard.documents)
                    ids = shard.read(int(shard.ends[lo]), int(shard.ends[hi]))
                    ends = shard.ends[lo : hi + 1] - shard.ends[lo]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[lo:hi], mask=~shard.has_id[lo:hi]),
                         pa.array(shard.ends[lo:hi] + base), pa.array(np.diff(ends)),
                         packed_rows(ids, ends, 32)],
                        names=["doc_id", "start", "n_tokens", "ids"])
                    lo = hi

    files = max(1, min(index.count(), spark.sparkContext.defaultParallelism * 4))
    return index.repartition(files, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())

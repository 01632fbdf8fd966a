"""Operator 6: byte-level BPE encoding and decoding by corpus-level merge replay.

The pre-tokens of a block of documents are reduced to distinct ones. An
inverted index leads from the rank of a token pair to the positions (in all
distinct pre-tokens of the block) where that pair stands. Merges are then
replayed over the whole block in rank order: all positions of the next rank
are merged at once, and only the pairs of their two neighbours are looked up
again and entered into the index. The result equals merging each pre-token by
itself, lowest rank first and leftmost first.

A block is a bounded number of bytes of text (``BLOCK_BYTES``), so memory does
not grow with the corpus, and a task that is lost is simply run again. The
vocabulary file is read once by the driver; its size is that of the file.

Defined results: a NULL or empty text gives no ids and decodes to empty
bytes; repeated rows are encoded each; other columns pass through, and an
existing column named like the output is replaced.
"""

from __future__ import annotations

import base64
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField

from tierlake.llm.frames import add_columns
from tierlake.llm.pretokens import Block, Words, byte_level_starts, text_block, text_slices, words

#: Text bytes of one replayed block.
BLOCK_BYTES = 4 << 20
NONE = np.int32(2**31 - 1)


class Merges:
    """Rank tables of a vocabulary of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"vocabulary lacks the single bytes {missing[:5]}")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        whole = sorted(ranks, key=ranks.get)
        self.whole = pa.array(whole, pa.binary())
        self.whole_ids = np.array([ranks[t] for t in whole], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        grid = np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)
        self.byte_pairs = self.pair_ranks(*grid).reshape(256, 256)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation, or NONE."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        want = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.values[at], NONE)

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of one pre-token, merged by itself (lowest rank, leftmost)."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, int(NONE)), i)
                           for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all distinct pre-tokens: flat ids, and n + 1 offsets."""
        n = len(distinct)
        known = pc.index_in(distinct, value_set=self.whole)
        rest = np.flatnonzero(np.asarray(known.is_null()))
        counts = np.ones(n, np.int64)
        ids, sizes = self._replay(distinct.take(pa.array(rest)))
        counts[rest] = sizes
        offsets = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(offsets[-1], np.int32)
        single = np.ones(n, bool)
        single[rest] = False
        flat[offsets[:-1][single]] = self.whole_ids[known.drop_null().to_numpy()]
        flat[expand(offsets[rest], sizes)] = ids
        return flat, offsets

    def _replay(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (flat) and their number for pre-tokens that need merging."""
        m = len(distinct)
        if not m:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        _, bounds, data = distinct.buffers()
        at = np.frombuffer(bounds, np.int32)[distinct.offset : distinct.offset + m + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        at = (at - at[0]).astype(np.int64)
        n = len(raw)
        token = self.byte_ids[raw]
        after = np.arange(1, n + 1, dtype=np.int32)  # next live position; n: none
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[at[1:] - 1] = n
        before[at[:-1]] = -1
        rank = np.full(n + 1, NONE, np.int32)  # of the pair that starts here
        inner = np.flatnonzero(after < n)
        rank[inner] = self.byte_pairs[raw[inner], raw[inner + 1]]
        alive = np.ones(n, bool)

        # The inverted index: rank -> positions.
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(where: np.ndarray) -> None:
            where = where[rank[where] != NONE]
            if not len(where):
                return
            found = rank[where]
            order = np.argsort(found, kind="stable")
            where, found = where[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(found)], strict=True):
                r = int(found[lo])
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(where[lo:hi])

        enter(inner)
        again: list[np.ndarray] = []
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r)
            at_pair = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at_pair = at_pair[rank[at_pair] == r]
            if not len(at_pair):
                continue
            # Pairs that overlap (a run of one token) merge from the left.
            linked = np.flatnonzero(at_pair[1:] == after[at_pair[:-1]]) + 1
            if len(linked):
                head = np.ones(len(at_pair), bool)
                head[linked] = False
                place = np.arange(len(at_pair))
                since = place - np.maximum.accumulate(np.where(head, place, 0))
                at_pair = at_pair[since % 2 == 0]
            gone = after[at_pair]
            beyond = after[gone]
            token[at_pair] = r
            rank[gone] = NONE
            alive[gone] = False
            after[at_pair] = beyond
            has = beyond < n
            before[beyond[has]] = at_pair[has]
            right = at_pair[has]
            rank[at_pair[~has]] = NONE
            left = before[at_pair]
            left = left[left >= 0]
            touched = np.concatenate([left, right])
            if len(touched):
                rank[touched] = self.pair_ranks(token[touched], token[after[touched]])
                low = touched[rank[touched] < r]
                if len(low):  # out of rank order: such a pre-token is merged by itself
                    again.append(np.searchsorted(at, low, side="right") - 1)
                enter(touched)
        ids = token[alive]
        sizes = np.add.reduceat(alive, at[:-1], dtype=np.int64) if m else np.zeros(0, np.int64)
        if again:
            pieces = np.split(ids, np.cumsum(sizes)[:-1])
            for w in np.unique(np.concatenate(again)).tolist():
                pieces[w] = np.array(self.merge_one(distinct[w].as_py()), np.int32)
            ids, sizes = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
        return ids, sizes


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    total = int(sizes.sum())
    out = np.ones(total, np.int64)
    keep = sizes > 0
    starts, sizes = starts[keep], sizes[keep]
    if not total:
        return out
    first = np.cumsum(sizes) - sizes
    out[first[0]] = starts[0]
    out[first[1:]] = starts[1:] - (starts[:-1] + sizes[:-1] - 1)
    return np.cumsum(out)


def spread(w: Words, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and n + 1 offsets of the texts."""
    sizes = np.diff(offsets)[w.index]
    ids = flat[expand(offsets[:-1][w.index], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return ids, ends[w.first]


def parse_ranks(file: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: per line a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}


@cache
def merges_of(file: bytes) -> Merges:
    """One set of tables per worker and vocabulary."""
    return Merges(parse_ranks(file))


def encode_column(column: pa.Array, merges: Merges) -> pa.Array:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    parts = []
    for lo, hi in text_slices(column, BLOCK_BYTES):
        block = text_block(column.slice(lo, hi - lo))
        w = words(block, byte_level_starts(block))
        ids, ends = spread(w, *merges.encode(w.distinct))
        parts.append(pa.Array.from_buffers(
            pa.large_binary(), hi - lo,
            [None, pa.py_buffer((ends * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]))
    return pa.chunked_array(parts, pa.large_binary()).combine_chunks().cast(pa.binary()) if parts \
        else pa.array([], pa.binary())


def decode_column(column: pa.Array, merges: Merges) -> pa.Array:
    """Bytes of each row of ids; NULL stays NULL."""
    token = merges.tokens.__getitem__
    return pa.array([None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist()))
                     for x in column.to_pylist()], pa.binary())


def _with_binary(df: DataFrame, source: str, target: str, file: bytes, convert) -> DataFrame:
    vocabulary = df.sparkSession.sparkContext.broadcast(file)

    def make():
        merges = merges_of(vocabulary.value)
        return lambda batch: [convert(batch.column(source), merges)]

    return add_columns(df, [StructField(target, BinaryType())], make)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of each text (binary, little-endian unsigned 32-bit).

    ``ranks_path`` is a file on the driver, sent to the tasks (bounded: one
    vocabulary). Special strings inside texts are ordinary text.
    """
    return _with_binary(df, text, ids, read_vocabulary(ranks_path), encode_column)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each row of ids stands for."""
    return _with_binary(df, ids, decoded, read_vocabulary(ranks_path), decode_column)


def round_trip(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids",
               decoded: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` without the texts, in one pass: a task has one
    Python worker with one set of tables instead of two. The bytes come from
    the encoded ids alone."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(ranks_path))

    def make():
        merges = merges_of(vocabulary.value)

        def both(batch: pa.RecordBatch) -> list[pa.Array]:
            found = encode_column(batch.column(text), merges)
            return [found, decode_column(found, merges)]

        return both

    return add_columns(df, [StructField(ids, BinaryType()), StructField(decoded, BinaryType())], make, drop=[text])

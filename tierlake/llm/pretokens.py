"""Split whole blocks of texts into pre-tokens with array operations.

A block is a set of texts stored back to back as UTF-8 (the layout of an Arrow
string column). Boundaries are found for all bytes of the block at once and
the pre-tokens become one Arrow binary array, whose distinct values Arrow
finds by hashing; encoders then work on distinct pre-tokens only.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4

# The characters with the Unicode property White_Space.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003,
    0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F,
    0x3000,
)


class Block(NamedTuple):
    """Texts back to back: bytes, and where each text starts (n + 1 offsets)."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Pre-tokens of a block: distinct values, the value of each pre-token,
    and the first pre-token of each text (n + 1 entries)."""

    distinct: pa.Array
    index: np.ndarray
    first: np.ndarray


@cache
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            table[run.start() : run.end()] = kind
    table[list(WHITE_SPACE)] = SPACE
    return table


def text_block(column: pa.Array) -> Block:
    """The block of an Arrow string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Block(raw[at[0] : at[-1]], at - at[0])


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = char_classes()
    cls = table[data]  # right for ASCII
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        cp = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            has = size > k
            cp[has] = (cp[has] << 6) | (data[lead[has] + k] & 0x3F)
        kind = table[cp]
        cls[lead] = kind
        for k in (1, 2, 3):
            has = size > k
            cls[lead[has] + k] = kind[has]
    return cls


def byte_level_starts(block: Block) -> np.ndarray:
    """Where the pre-tokens of the byte-level BPE pattern start:
    contractions, letters, numbers and other signs with one space before
    them, and white space that nothing takes."""
    data, offsets = block
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    cls = byte_classes(data)
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:n])
    start |= text_start

    # White space before another character of the same text: its last
    # character goes with what follows (a plain space) or stands alone.
    runs = np.flatnonzero(start)
    white = cls[runs[:-1]] == SPACE
    end = runs[1:][white]
    end = end[~text_start[end]]
    if len(end):
        last = end - 1
        tail = data[last] >= 0x80
        if tail.any():
            two = data[np.maximum(last - 1, 0)] >= 0xC0
            last = np.where(tail, np.where(two, last - 1, last - 2), last)
        start[last] = True
        start[end[data[last] == 0x20]] = False

    # Contractions: an apostrophe that starts a pre-token.
    quote = np.flatnonzero((data == 0x27) & start[:n])
    if len(quote):
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = pad[quote + 1], pad[quote + 2]
        own1 = ~text_start[np.minimum(quote + 1, n)]
        own2 = own1 & ~text_start[np.minimum(quote + 2, n)]
        size = np.where(own1 & np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
        for a, b in (b"re", b"ve", b"ll"):
            size[own2 & (one == a) & (two == b)] = 2
        hit = quote[size > 0]
        size = size[size > 0]
        start[hit + 1] = False
        start[hit + 1 + size] = True
    return np.flatnonzero(start[:n])


def space_starts(block: Block) -> np.ndarray:
    """Where pre-tokens start that begin with their spaces (U+0020 or
    U+2581): at each such run, and at each text."""
    data, offsets = block
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    space = data == 0x20
    mark = np.flatnonzero(data == 0xE2)
    mark = mark[mark + 2 < n]
    mark = mark[(data[mark + 1] == 0x96) & (data[mark + 2] == 0x81)]
    for k in range(3):
        space[mark + k] = True
    start = np.zeros(n + 1, bool)
    start[1:n] = space[1:] & ~space[:-1]
    start[offsets] = True
    return np.flatnonzero(start[:n])


def words(block: Block, starts: np.ndarray) -> Words:
    """Distinct pre-tokens of a block, and which one stands where."""
    bounds = np.append(starts, len(block.data)).astype(np.int32)
    values = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(block.data)])
    coded = values.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(), np.searchsorted(starts, block.offsets))


def plain_words(block: Block) -> Words:
    """Words (runs without ASCII white space) of a block, as ``words``."""
    data, offsets = block
    white = np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = white[1:] != white[:-1]
    start[offsets] = True
    starts = np.flatnonzero(start[: len(data)])
    runs = words(block, starts)  # words and the gaps between them
    is_word = ~white[starts]
    before = np.concatenate([[0], np.cumsum(is_word)])
    return Words(runs.distinct, runs.index[is_word], before[runs.first])


def text_slices(column: pa.Array, most_bytes: int):
    """Slices of a column whose texts have at most ``most_bytes`` bytes
    together (a longer text is a slice by itself)."""
    offsets = text_block(column).offsets
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to

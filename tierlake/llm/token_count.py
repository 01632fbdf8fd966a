"""Operator 1: token counts by the whole-token shortcut.

For a piece-merging tokenizer (sentencepiece BPE) a text falls into pre-tokens
that begin with their spaces. Offline, from the model alone, two facts are
proved before any text is read (``prove``):

* no piece holds a space mark behind another character, so no merge crosses
  the start of a pre-token, and the count of a text is the sum of the counts
  of its pre-tokens;
* which pieces of the vocabulary, taken as a whole pre-token, encode as one
  token.

Pre-tokens among the latter count one each without any merging. Only the
distinct others of a block of texts are merged by the library, once each.

Blocks are bounded in bytes and tables by the vocabulary, so memory does not
grow with the corpus; there is no shuffle.

Defined results: NULL and empty texts count 0 bytes and 0 tokens; repeated
rows are counted each; other columns pass through, and existing columns named
like the outputs are replaced.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from tierlake.llm.frames import add_columns
from tierlake.llm.pretokens import space_starts, text_block, text_slices, words

#: Text bytes of one block.
BLOCK_BYTES = 12 << 20
MARK = "▁"


class Counter:
    """A model, and the pre-tokens proved to be one token."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.single = pa.array(prove(self.library), pa.binary())

    def counts(self, distinct: pa.Array) -> np.ndarray:
        """Tokens of each distinct pre-token."""
        out = np.ones(len(distinct), np.int64)
        rest = np.flatnonzero(np.asarray(pc.index_in(distinct, value_set=self.single).is_null()))
        others = distinct.take(pa.array(rest)).to_pylist()
        out[rest] = self.merge([w.decode() for w in others])
        return out

    def merge(self, pretokens: list[str]) -> list[int]:
        """Counts by the library, which puts a mark before every text: of a
        pre-token's own first space it is that mark."""
        plain = [w[1:] if w[:1] in (" ", MARK) else w for w in pretokens]
        encoded = self.library.encode(plain, num_threads=1) if plain else []
        return [len(ids) if w else 1 for w, ids in zip(plain, encoded, strict=True)]


def prove(library: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Pre-tokens that are one token, from the vocabulary alone; fails if the
    model merges across the start of a pre-token or rewrites its input."""
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i)
               for i in range(len(pieces))]
    for piece, skip in zip(pieces, special, strict=True):
        if not skip and MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} crosses the start of a pre-token")
    for probe in ("a", "a ", " a", "a  b", "a\nb", "é 　x", "ﬁ" + MARK + "Å"):
        if library.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model rewrites its input")
    whole = [p for p, skip in zip(pieces, special, strict=True)
             if not skip and p.startswith(MARK) and p != MARK]
    encoded = library.encode([p[1:].replace(MARK, " ") for p in whole], num_threads=1)
    proved = [MARK, *(p for p, ids in zip(whole, encoded, strict=True) if len(ids) == 1)]
    as_text = [p.replace(MARK, " ") for p in proved]
    return [p.encode() for p in {*as_text, *proved}]


@cache
def counter_of(model: bytes) -> Counter:
    """One set of tables per worker and model."""
    return Counter(model)


def count_column(column: pa.Array, counter: Counter) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of each text."""
    sizes, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in text_slices(column, BLOCK_BYTES):
        block = text_block(column.slice(lo, hi - lo))
        starts = space_starts(block)
        w = words(block, starts)
        each = counter.counts(w.distinct)[w.index]
        # A text that itself begins with a space gets the mark besides it.
        length = np.diff(block.offsets)
        own = np.flatnonzero(length > 0)
        head = _spaced(block, block.offsets[own])
        each[w.first[own[head]]] = _marked(w, w.first[own[head]], counter)
        total = np.concatenate([[0], np.cumsum(each)])
        sizes.append(length)
        tokens.append(total[w.first[1:]] - total[w.first[:-1]])
    return np.concatenate(sizes), np.concatenate(tokens)


def _spaced(block, at: np.ndarray) -> np.ndarray:
    data = block.data
    space = data[at] == 0x20
    for p in np.flatnonzero(data[at] == 0xE2):
        space[p] = bytes(data[at[p] : at[p] + 3]) == MARK.encode()
    return space


def _marked(w, which: np.ndarray, counter: Counter) -> np.ndarray:
    """Counts of pre-tokens at the start of a text that have own spaces: the
    library's mark comes on top of them."""
    if not len(which):
        return np.zeros(0, np.int64)
    coded = pa.array(w.index[which])
    distinct = coded.unique()
    texts = [x.decode() for x in w.distinct.take(distinct).to_pylist()]
    counts = np.array([len(x) for x in counter.library.encode(texts, num_threads=1)], np.int64)
    return counts[pc.index_in(coded, value_set=distinct).to_numpy()]


def count_tokens(df: DataFrame, model_path: str, text: str = "text", n_bytes: str = "n_bytes",
                 n_tokens: str = "n_tokens") -> DataFrame:
    """``df`` with the bytes and tokens of each whole text.

    Counts are those of the library without begin or end tokens.
    ``model_path`` is a file on the driver, sent to the tasks.
    """
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        counter = counter_of(model.value)
        return lambda batch: [pa.array(c) for c in count_column(batch.column(text), counter)]

    return add_columns(df, [StructField(n_bytes, LongType()), StructField(n_tokens, LongType())], make)

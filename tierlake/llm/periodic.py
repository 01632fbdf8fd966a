"""Operator 13: periodic runs, found by online dyadic square catching.

The words of a text are appended one by one. Whenever the number of words so
far is a multiple of 2**k, a block of 2**k words is complete, and soon after
it becomes a catcher: while it lies between 2**(k+1) and 2**(k+2) words back,
each appended word is compared with the block's last word. If they agree, the
comparison goes on over the suffix of the text; if the whole block stands
there again, the distance is a period, and the catch is open: it is extended
to the left at once and to the right by one comparison with each word
appended later. A catch that ends after two periods or more holds a square,
and all its overlapping squares of that period are one run.

Any stretch of twice its period p (2**(k+1) <= p < 2**(k+2)) holds a whole
block of 2**k words that stands again p words later, so no run is missed.
Periods of one to three words have blocks of one word; their comparisons are
three counters. Each level has two catchers at a time, so the catchers of all
levels together are a logarithmic number, kept in a table by their last word:
a word asks only for the blocks that end like it. A distance that is a
multiple of an open catch's period within that catch isn't opened again: it
would break off at the same places.

A run's period is the smallest one: of two runs of the same stretch the one
with the shorter period stays.

Work is one pass over the texts without a shuffle; memory is that of one
text's words (a batch of texts at a time), and a lost task is run again.

Defined results: NULL, empty and blank texts have no words, no runs, and
collapse to the empty text; repeated rows get equal results; an empty table
gives an empty one; existing columns named like the outputs are replaced,
others (of any type) pass through.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tierlake.llm.frames import WORD, add_columns

#: Least words of a run.
LEAST = 12
RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])
ARROW_RUNS = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))

Run = tuple[int, int, int]


class Catchers:
    """Online state of one text: append words, then ``close``."""

    def __init__(self, least: int = LEAST):
        self.least = least
        self.words: list = []
        #: Catchers by their last word: (end, size) of each block.
        self.want: dict = {}
        #: Open catches of periods from four on: period -> start.
        self.open: dict[int, int] = {}
        #: Equal pairs in a row at the distances one to three.
        self.equal = [0, 0, 0]
        self.found: dict[tuple[int, int], int] = {}

    def extend(self, words: list) -> None:
        """Append words."""
        all_words, want, opened = self.words, self.want, self.open
        e1, e2, e3 = self.equal
        none: tuple = ()
        # Earlier words; None equals no word.
        past = [None, None, None, *all_words[-3:]]
        w1, w2, w3 = past[-1], past[-2], past[-3]
        n = len(all_words)
        for word in words:
            # Open catches advance by this word, or end before it.
            if word == w1:
                e1 += 1
            elif e1:
                self._report(n - e1 - 1, n, 1)
                e1 = 0
            if word == w2:
                e2 += 1
            elif e2:
                if e2 > 1:
                    self._report(n - e2 - 2, n, 2)
                e2 = 0
            if word == w3:
                e3 += 1
            elif e3:
                if e3 > 2:
                    self._report(n - e3 - 3, n, 3)
                e3 = 0
            if opened:
                for period in [p for p in opened if all_words[n - p] != word]:
                    self._report(opened.pop(period), n, period)
            all_words.append(word)
            n += 1
            w3, w2, w1 = w2, w1, word
            # Blocks whose distance has come into their level's range.
            if not n & 1:
                size = 2
                while not n & (size - 1):
                    end = n - 2 * size
                    if end < size:
                        break
                    want.setdefault(all_words[end - 1], []).append((end, size))
                    size *= 2
            hits = want.get(word, none)
            if hits:
                late = 0
                for end, size in hits:
                    period = n - end
                    if period >= 4 * size:
                        late += 1
                    elif w2 == all_words[end - 2] and period not in opened:
                        self._catch(end, size, period, (e1, e2, e3))
                if late:
                    hits[:] = [(end, size) for end, size in hits if n - end < 4 * size]
        self.equal = [e1, e2, e3]

    def _catch(self, end: int, size: int, period: int, equal: tuple) -> None:
        """The last words end like the block up to ``end``: open a catch if
        they are the whole block and no open catch explains them."""
        words = self.words
        n = len(words)
        first = end - size
        for p, run in enumerate(equal, 1):
            if run >= p and period % p == 0 and n - run - p <= first:
                return
        for p, start in self.open.items():
            if period % p == 0 and start <= first:
                return
        if words[first:end] != words[n - size :]:
            return
        start = first
        while start and words[start - 1] == words[start - 1 + period]:
            start -= 1
        self.open[period] = start

    def _report(self, start: int, end: int, period: int) -> None:
        length = end - start
        if length >= self.least and length >= 2 * period:
            known = self.found.get((start, end))
            if known is None or period < known:
                self.found[start, end] = period

    def close(self) -> list[Run]:
        """All runs (start, length, period), by start, then period."""
        n = len(self.words)
        for period, equal in enumerate(self.equal, 1):
            self._report(n - equal - period, n, period)
        for period, start in self.open.items():
            self._report(start, n, period)
        return sorted(((s, e - s, p) for (s, e), p in self.found.items()), key=lambda r: (r[0], r[2]))


def runs_of(words: list, least: int = LEAST) -> list[Run]:
    """Runs of a list of words."""
    if len(words) < max(least, 2):
        return []
    catchers = Catchers(least)
    catchers.extend(words)
    return catchers.close()


def collapse(words: list, runs: list[Run]) -> list:
    """The words without those that a run repeats: of each run its first
    period stays, unless another run repeats that."""
    if not runs:
        return words
    kept, at = [], 0
    for lo, hi in sorted((s + p, s + n) for s, n, p in runs):
        if hi > at:
            kept += words[at : max(lo, at)]
            at = hi
    return kept + words[at:]


def split_words(text: str | None) -> list[bytes]:
    """Words of a text, equal words as one object. (``bytes.split`` divides
    at the six ASCII white-space characters.)"""
    if not text:
        return []
    one: dict[bytes, bytes] = {}
    return [one.setdefault(w, w) for w in text.encode().split()]


def find_runs(df: DataFrame, text: str = "text", least: int = LEAST, runs: str = "runs",
              collapsed: str = "collapsed") -> DataFrame:
    """``df`` with the array of runs (start, length, period; word numbers
    from 0) of each whole text, and the text without repeated words, joined
    by one space."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        found, short = [], []
        for value in batch.column(text):
            words = split_words(value.as_py())
            here = runs_of(words, least)
            found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in here])
            short.append(b" ".join(collapse(words, here)))
        return [pa.array(found, ARROW_RUNS), pa.array(short, pa.binary()).cast(pa.string())]

    new = [StructField(runs, ArrayType(RUN, False), False), StructField(collapsed, StringType(), False)]
    return add_columns(df, new, lambda: compute)


def planted(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text, or for every tenth document by the hash of its id the text
    whose words from a point on repeat the words from there (a period that
    fits three to ten times), joined by one space."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(crc / 10).cast("long")
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD})"))
    made = F.transform(F.array(words), lambda w: _repeat(w, g))[0]
    return F.when((crc % 10 == 0) & F.col(text).isNotNull(), made).otherwise(F.col(text))


def _repeat(words: Column, g: Column) -> Column:
    n = F.size(words)
    a = F.coalesce(g % F.nullif(n, F.lit(0)), F.lit(0))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    after = F.transform(F.sequence(F.lit(0).cast("long"), n - 1 - a), lambda i: F.get(words, (a + i % p).cast("int")))
    return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), after), " ")).otherwise("")

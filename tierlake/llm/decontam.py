"""Operator 12: benchmark decontamination by Wu-Manber multi-pattern search.

The test strings are all windows of ten consecutive words of the benchmark's
items (an item of fewer words is one window). A text is searched for all of
them at once, with words as the alphabet and blocks of two words: the shift
table says for each block that test strings hold how far its last place is
from their ends; any other block can't lie in an occurrence, and the search
skips as many positions as a test string has words, less one. Where the shift
is 0, the block's bucket of the suffix table and in it the bucket of the first
block select test strings, which are compared with the words directly.

The strings of the full length and the shorter ones of short items have tables
of their own, so that a short item doesn't shorten the skips of the others
(shorter strings share tables by length: of one word, and of more).

The benchmark isn't bounded, so the tables aren't either: items are cut into
pieces of ``PIECE`` words (overlapping by a window less one word) and pieces
are dealt into blocks of about ``BLOCK_BYTES`` by hash. Each block is one pass
over the texts, which adds its hits to the columns of the passes before it and
is stored; only one block at a time passes the driver. A benchmark of one
block takes one pass that isn't stored.

Texts aren't shuffled, and a lost task is run again.

Defined results: NULL, empty and wordless texts have no words and no hits;
NULL and wordless items have no windows; a NULL item id counts as the empty
text; items of equal id count as one, equal windows of different items are
found for each of them; repeated rows get equal results; an empty benchmark
hits nothing and an empty table gives an empty one; existing columns named
like the outputs are replaced, others (of any type) pass through.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tierlake.llm.frames import add_columns
from tierlake.session import scratch_path

#: Words of a window.
WINDOW = 10
#: What divides words, after A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a word bytewise: digits, small letters and all beyond ASCII as
#: they are, capitals lower-cased, the rest a space.
PLAIN = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
              else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Words of a piece of an item, and text bytes of a block of pieces.
PIECE, BLOCK_BYTES = 10_000, 1 << 20

SPAN = StructType([StructField("start", LongType(), False), StructField("length", LongType(), False)])
ARROW_SPANS = pa.list_(pa.struct([pa.field("start", pa.int64(), False), pa.field("length", pa.int64(), False)]))


def plain_words(text: str | None) -> list[bytes]:
    """Words of a text: lower-cased letters, digits, all beyond ASCII."""
    return text.encode().translate(PLAIN).split() if text else []


class WuManber:
    """Tables of test strings (tuples of words) of ``least`` words or more."""

    def __init__(self, strings: dict[tuple, object]):
        self.least = m = min(map(len, strings))
        self.block = b = min(2, m)
        self.shift: dict[tuple, int] = {}
        buckets: dict[tuple, dict] = defaultdict(lambda: defaultdict(list))
        for string in strings:
            for end in range(b, m + 1):
                key = string[end - b : end]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            buckets[string[m - b : m]][string[:b]].append(string)
        self.buckets = {k: dict(v) for k, v in buckets.items()}
        self.skip = m - b + 1

    def find(self, words: list[bytes]) -> list[tuple[int, tuple]]:
        """(start, test string) of every occurrence, by start."""
        found = []
        m, b, skip, shift = self.least, self.block, self.skip, self.shift.get
        at, n = m, len(words)
        while at <= n:
            jump = shift(tuple(words[at - b : at]), skip)
            if jump:
                at += jump
                continue
            start = at - m
            for string in self.buckets[tuple(words[at - b : at])].get(tuple(words[start : start + b]), ()):
                if tuple(words[start : start + len(string)]) == string:
                    found.append((start, string))
            at += 1
        return found


class Searcher:
    """All windows of some items, and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.items: dict[tuple, set[str]] = defaultdict(set)
        for item, text in items:
            words = plain_words(text)
            for i in range(max(len(words) - window + 1, 1 if words else 0)):
                self.items[tuple(words[i : i + window])].add(item)
        sizes = defaultdict(dict)
        for string, ids in self.items.items():
            sizes[2 if len(string) == window else min(len(string), 2) - 1][string] = ids
        self.tables = [WuManber(strings) for strings in sizes.values()]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of hit words, not overlapping, and the items."""
        hits, items = [], set()
        for table in self.tables:
            for start, string in table.find(words):
                hits.append((start, start + len(string)))
                items |= self.items[string]
        return merged(hits), items


def merged(spans) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = out[-1][0], hi
        else:
            out.append((lo, hi))
    return out


def word_array(text: str) -> Column:
    """The words of a text column, in Spark."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, GAPS), lambda w: w != "")


def pieces(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(item, piece): the items' words, in overlapping pieces of bounded
    length that hold every window once or more."""
    words = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                             word_array(text).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)), F.lit(PIECE))
    cut = words.select("item", "words", F.explode(starts).alias("at"))
    return cut.select("item", F.array_join(F.slice("words", F.col("at"), PIECE + window - 1), " ").alias("piece"))


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", bench_text: str = "text",
         item_id: str = "item_id", window: int = WINDOW, n_words: str = "n_words", spans: str = "spans",
         items: str = "items") -> DataFrame:
    """``df`` with the number of words of each whole text, the spans (start,
    length; word numbers from 0) of words inside occurrences of benchmark
    windows, and the ids of the items whose windows occur, sorted. Runs
    jobs: the benchmark is measured, and read in blocks."""
    spark = df.sparkSession
    parts = pieces(benchmark, bench_text, item_id, window)
    size = parts.agg(F.sum(F.octet_length("piece") + F.octet_length("item"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    block = F.pmod(F.xxhash64("item", "piece"), F.lit(blocks))
    for number in range(blocks):
        # One block at a time: about BLOCK_BYTES of text.
        rows = [(r.item, r.piece) for r in parts.where(block == number).collect()]
        df = _search(df, rows, text, window, (n_words, spans, items), first=number == 0)
        if number + 1 < blocks:
            stored = scratch_path(spark, "decontam")
            df.write.parquet(stored)
            df = spark.read.parquet(stored)
    return df


def _search(df: DataFrame, rows: list, text: str, window: int, outputs: tuple[str, str, str],
            first: bool) -> DataFrame:
    """One pass over the texts with one block of the benchmark; passes after
    the first add to the output columns of those before."""
    n_words, spans, items = outputs

    def make():
        searcher = Searcher(rows, window)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index(text))
            old = [None] * len(texts)
            if not first:
                old = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (spans, items)),
                          strict=True)
            counts, hit, names = [], [], []
            for value, before in zip(texts, old, strict=True):
                words = plain_words(value.as_py())
                found, ids = searcher.search(words)
                if before is not None:
                    found = merged(found + [(s["start"], s["start"] + s["length"]) for s in before[0]])
                    ids |= set(before[1])
                counts.append(len(words))
                hit.append([{"start": a, "length": b - a} for a, b in found])
                names.append(sorted(ids, key=str.encode))
            return [pa.array(counts, pa.int64()), pa.array(hit, ARROW_SPANS), pa.array(names, pa.list_(pa.string()))]

        return compute

    new = [StructField(n_words, LongType(), False), StructField(spans, ArrayType(SPAN, False), False),
           StructField(items, ArrayType(StringType(), False), False)]
    return add_columns(df, new, make)

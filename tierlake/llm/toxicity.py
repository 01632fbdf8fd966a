"""Operator 2: toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts, one from toxic and
one from ordinary text. Both start with the most common ordinary words; then
follow, in the toxic one, the pieces of words that many toxic texts and hardly
any ordinary ones use, and in the other one the pieces for which it is the
other way round. Both have the same length.

A text is cut into windows of ``WINDOW`` words, all of it, and every window is
compressed with both dictionaries: the difference of the two lengths says how
much better the toxic one fits (negative: the ordinary one). For compression a
character is written as four bytes that stand for its word up to it, so that
words match where they begin alike and a match of a few characters outweighs
its fixed cost; a space is the same everywhere, so windows match across words.

How often differences of a text pass several thresholds, in either direction,
and its largest ones go into a logistic calibration, which is fitted on
labelled texts that had no part in the dictionaries; its value is the score.

Fitting uses a bounded sample of labelled texts (``TOXIC`` and ``ORDINARY`` of
them at most, by hash; of texts that share their least hash of three words in
a row, which copies and near copies do, one is taken). Texts that use a piece
are counted by a Spark aggregation; what the driver gets are the pieces that
fill the dictionaries (``SPECIAL_BYTES``, ``COMMON_BYTES``) and one row of
figures a calibration text. Scoring is one pass without a shuffle over blocks
of texts; memory grows with the longest text (about 80 bytes a character).

Defined results: NULL and empty texts have no words and get the score of a
text without any; labels other than 0 and 1, labels of unknown texts and
texts without labels are not learnt from; if a class has no labelled text,
every score is 0; repeated rows get equal scores; an empty table gives an
empty one; existing columns named like the outputs are replaced, others (of
any type) pass through.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from tierlake.llm.frames import add_columns, hash_sample, slices, small_batches
from tierlake.llm.pretokens import text_slices
from tierlake.session import cut_lineage

#: Most labelled texts that are learnt from.
TOXIC, ORDINARY = 2500, 10000
#: Share of them that goes into the dictionaries; the rest calibrates.
DICTIONARY_SHARE = 0.75
#: Most bytes of a dictionary for its own pieces, and for common words.
SPECIAL_BYTES, COMMON_BYTES = 32 << 10, 16 << 10
#: A piece belongs to a class that uses it in so many texts, that many
#: standard deviations above what the other class leads to expect, and that
#: many times as often.
LEAST_TEXTS, LEAST_DEVIATION, LEAST_RATIO = 3, 2.5, 12.0
#: Characters of a word that pieces are counted for.
LONGEST_PIECE = 24
WINDOW = 6
THRESHOLDS = (4, 6, 8, 10, 12, 16, 20, 26)
BLOCK_BYTES = 512 << 10

SYMBOL = 4  # bytes of a character
SPACE = 0x20
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


@dataclass(frozen=True)
class ToxicModel:
    """Contents of the dictionaries, and the calibration: the mean and spread
    of each figure, and the weights (the last one is the constant)."""

    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


def lowered(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def _powers(n: int) -> np.ndarray:
    """Powers of ``_BACK`` from 0 to n."""
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BACK, np.uint64))])


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts as symbols: a space, and each word with a space after
    it. Symbols of all texts, where the spaces are, and the first space of
    each text (n + 1 entries). A symbol is a hash of the word up to it."""
    gap = pa.scalar(" ", pa.large_string())
    none = pa.scalar("", pa.large_string())
    spaced = pc.binary_join_element_wise(none, column, none, gap)
    size = np.concatenate([[0], np.cumsum(pc.utf8_length(spaced).to_numpy())])
    text = "".join(spaced.to_pylist())
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    white = (code == SPACE) | ((code >= 9) & (code <= 13))
    kept = ~white
    kept[1:] |= ~white[:-1]
    kept[size[:-1]] = True  # each text's first space
    start = np.concatenate([[0], np.cumsum(kept)])[size]
    code, white = code[kept].astype(np.uint64), white[kept]
    spaces = np.flatnonzero(white)
    n = len(code)
    # Sums of code * BACK**place that start anew at each space.
    last = np.maximum.accumulate(np.where(white, np.arange(n), 0))
    place = np.arange(n) - last
    code += np.uint64(1)
    code *= _powers(int(place.max(initial=0)))[place]
    h = np.cumsum(code)
    h -= h[last]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    out = h.astype("<u4")
    out[white] = SPACE
    return out, spaces, np.searchsorted(spaces, start)


def windows(column: pa.Array, words: int = WINDOW) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Windows of lower-cased texts, as bytes: the windows of all texts, the
    first of each text (n + 1 entries), and the number of words of each."""
    symbol, spaces, first = symbols(column)
    raw = symbol.tobytes()
    n_words = np.diff(first) - 1
    count = -(-n_words // words)
    at = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n_words)), count)
    lo = first[text] + words * (np.arange(at[-1]) - at[text])
    hi = np.minimum(lo + words, first[text + 1] - 1)
    cut = [raw[a:b] for a, b in zip((spaces[lo] * SYMBOL).tolist(), ((spaces[hi] + 1) * SYMBOL).tolist(), strict=True)]
    return cut, at, n_words


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        compression_level=3, window_log=18, hash_log=14, chain_log=14, search_log=5, min_match=6,
        target_length=0, strategy=zstandard.STRATEGY_FAST, write_content_size=0,
        write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary)


class Distance:
    """Differences of window lengths under the two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def of(self, window: bytes) -> int:
        return len(self.ordinary.compress(window)) - len(self.toxic.compress(window))


@cache
def distance_of(toxic: bytes, ordinary: bytes) -> Distance:
    """One pair of dictionaries per worker."""
    return Distance(toxic, ordinary)


def figures_column(column: pa.Array, distance: Distance) -> np.ndarray:
    """One row of figures a text: how many windows pass each threshold (as a
    share and against the length), the largest differences, their sums."""
    column = lowered(column)
    rows = [np.zeros((0, 2 * len(THRESHOLDS) + 7))]
    for lo, hi in text_slices(column, BLOCK_BYTES):
        cut, at, n = windows(column.slice(lo, hi - lo))
        d = np.fromiter(map(distance.of, cut), np.int64, len(cut))

        def total(x: np.ndarray, at=at) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(x)])
            return sums[at[1:]] - sums[at[:-1]]

        columns = []
        for t in THRESHOLDS:
            k = total(d >= t)
            columns += [np.log((k + 0.1) / (n + 20)), k / np.sqrt(n + 5)]
        text = np.repeat(np.arange(len(n)), np.diff(at))
        order = np.lexsort((-d, text))
        place = np.arange(len(d)) - at[text]
        top = np.zeros((3, len(n)))
        for k in range(3):
            here = place == k
            top[k, text[here]] = d[order][here]
        columns += [total(d) / (n + 5), *(top / 10), np.log(n + 1), total(np.where(d > 4, d, 0)) / (n + 5),
                    total(d <= -6) / np.sqrt(n + 5)]
        rows.append(np.stack(columns, axis=1))
    return np.concatenate(rows)


def sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The bounded sample: (text, label, part), chosen by hash; part 0 goes
    into the dictionaries. Texts aren't shuffled: ids are chosen first."""
    known = labels.where(F.col("label").isin(0, 1)).select(F.col(doc_id).alias("id"), "label")
    body = F.coalesce(F.col(text), F.lit(""))
    # The words are bound once, not split again for each of them.
    words = F.array(F.split(F.lower(body), r"[\x20\x09-\x0D]+"))
    least = F.transform(words, lambda w: F.array_min(F.transform(
        w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))))[0]
    texts = docs.select(F.col(doc_id).alias("id"), body.alias("text"), least.alias("h"))
    kinds = cut_lineage(texts.select("id", "h").join(known, "id").groupBy("h").agg(
        F.max("label").alias("label"), F.min("id").alias("id")))
    chosen = hash_sample(kinds.where("label = 1"), TOXIC, "h").unionByName(
        hash_sample(kinds.where("label = 0"), ORDINARY, "h"))
    part = F.pmod(F.xxhash64(F.lit("part"), "h"), F.lit(1000)) >= int(1000 * DICTIONARY_SHARE)
    # The chosen are TOXIC + ORDINARY rows at most, so they may be broadcast.
    rows = texts.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["h"])
    return rows.select("text", "label", part.cast("int").alias("part"))


def piece_counts(texts: DataFrame) -> DataFrame:
    """(piece, toxic, ordinary): texts of either label that use each
    beginning of a word; a whole word is a piece that ends with a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            found: dict[int, Counter] = defaultdict(Counter)
            for label, body in zip(batch.column(1).to_pylist(), lowered(batch.column(0)).to_pylist(), strict=True):
                pieces = set()
                for raw in set(body.encode().split()):
                    word = raw.decode() + " "
                    pieces.update(word[:k] for k in range(1, min(len(word), LONGEST_PIECE) + 1))
                found[label].update(pieces)
            for label, pieces in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pieces.keys(), pa.string()), pa.array(np.full(len(pieces), label, np.int32)),
                     pa.array(list(pieces.values()), pa.int64())], names=["piece", "label", "n"])

    small_batches(texts.sparkSession)
    each = texts.select("text", F.col("label").cast("int")).mapInArrow(run, "piece string, label int, n long")
    return each.groupBy("piece").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
                                     F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("ordinary"))


def _spelt(piece: str, begin: int = 0) -> bytes:
    """Symbols of a piece from its character ``begin`` on; a space comes
    before its first."""
    symbol, _, _ = symbols(pa.array([piece], pa.large_string()))
    return symbol[begin : 1 + len(piece)].tobytes()


def _special(counted: DataFrame, own: str, other: str, share: float) -> bytes:
    """Pieces of one class for its dictionary, the most common ones last:
    chains of beginnings, from the first that belongs to the class."""
    expected = (F.col(other) + 1) * share
    belongs = (F.col(own) >= LEAST_TEXTS) & (F.col(own) >= LEAST_RATIO * expected) & (
        (F.col(own) - expected) / F.sqrt(expected + 1) >= LEAST_DEVIATION)
    rows = counted.where(belongs).orderBy(F.desc(own), "piece").limit(SPECIAL_BYTES // SYMBOL).collect()
    pieces = {r.piece: r[own] for r in rows}
    inner = {p[:-1] for p in pieces}
    out = b""
    for piece in pieces:  # most common first
        if piece in inner:
            continue
        begin = next(k for k in range(1, len(piece) + 1) if piece[:k] in pieces)
        chain = _spelt(piece, begin - 1)
        if chain not in out:
            out = chain + out
        if len(out) >= SPECIAL_BYTES:
            break
    return out[-SPECIAL_BYTES:]


def dictionaries(counted: DataFrame, n_toxic: int, n_ordinary: int) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary."""
    words = counted.where(F.col("piece").endswith(" ") & (F.col("ordinary") > 0)).orderBy(
        F.desc("ordinary"), "piece").limit(COMMON_BYTES // SYMBOL).collect()
    common = b""
    for r in words:
        if len(common) >= COMMON_BYTES:
            break
        common = _spelt(r.piece) + common
    toxic = _special(counted, "toxic", "ordinary", n_toxic / n_ordinary)
    ordinary = _special(counted, "ordinary", "toxic", n_ordinary / n_toxic)
    longest = max(len(toxic), len(ordinary), 8)
    return common + toxic.rjust(longest, b"\0"), common + ordinary.rjust(longest, b"\0")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> ToxicModel | None:
    """The model learnt from (a bounded sample of) the texts of ``docs`` that
    ``labels`` (doc_id, label) names; None if a class has no text. Runs
    jobs."""
    texts = cut_lineage(sample(docs, labels, text, doc_id))
    learnt = texts.where("part = 0")
    n = {r.label: r.n for r in learnt.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(n) != {0, 1}:
        return None
    counted = cut_lineage(piece_counts(learnt))
    model = ToxicModel(*dictionaries(counted, n[1], n[0]))
    rows = figures(texts.where("part = 1").select("text", "label"), model, "text").select(
        "label", "figures").collect()  # bounded: the calibration texts
    if {r.label for r in rows} != {0, 1}:
        rows = figures(texts.select("text", "label"), model, "text").select("label", "figures").collect()
    x = np.array([r.figures for r in rows])
    y = np.array([r.label for r in rows], float)
    return calibrate(model, x, y)


def calibrate(model: ToxicModel, x: np.ndarray, y: np.ndarray) -> ToxicModel:
    """Logistic regression (ridge, Newton steps) of the label on the figures."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / spread, np.ones(len(x))]
    ridge = np.r_[np.full(x.shape[1], 1e-4 * len(y) + 1e-3), 1e-6]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return replace(model, mean=tuple(mean.tolist()), spread=tuple(spread.tolist()), weights=tuple(w.tolist()))


def figures(df: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``df`` with the array ``figures`` of each text."""
    contents = model.toxic, model.ordinary

    def make():
        distance = distance_of(*contents)
        return lambda batch: [pa.array(figures_column(batch.column(text), distance).tolist(),
                                       pa.list_(pa.float64()))]

    return add_columns(df, [StructField("figures", ArrayType(DoubleType()))], make)


def score(df: DataFrame, model: ToxicModel | None, text: str = "text", score: str = "score",
          predicted: str = "predicted") -> DataFrame:
    """``df`` with the score (0 to 1) of each whole text, and 1 where it is
    0.5 at least."""
    if model is None:
        return df.withColumns({score: F.lit(0.0), predicted: F.lit(0)})
    contents = model.toxic, model.ordinary
    mean, spread, weights = (np.array(v) for v in (model.mean, model.spread, model.weights))

    def make():
        distance = distance_of(*contents)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            x = figures_column(batch.column(text), distance)
            z = ((x - mean) / spread) @ weights[:-1] + weights[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

        return compute

    return add_columns(df, [StructField(score, DoubleType()), StructField(predicted, IntegerType())], make)

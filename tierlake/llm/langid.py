"""Operator 9: language identification by multilingual mixture inference.

Each language has a distribution of hashed character n-grams (of lower-cased
letters, anything else counting as one space), learnt from labelled texts. A
document is taken as a mixture: every n-gram comes from one of its languages.
Expectation-maximisation estimates the proportions of the languages from the
n-gram likelihoods, first for all languages, then for the sets of the one,
two, ... most probable ones; the set with the best penalised likelihood
(log-likelihood less ``PENALTY`` * log(n-grams) / 2 a language) is selected.
The prediction is the largest proportion of that set, and its share of the
document is the score.

Every language of the labels is learnt, and a document can have any number of
them: its set grows until the penalised likelihood stops improving. Learning
uses at most ``PER_LANGUAGE`` distinct texts a language (by the hash of the
text), counted in Spark. The model holds only the n-grams that a language was seen
with (at most ``BUCKETS`` a language, 8 bytes each); all others have the
language's smoothing likelihood. Prediction is one pass without a shuffle.

Defined results: NULL texts and texts without a letter are ``und`` with score
0 and no languages; a NULL language is never learnt; without any learnt
language every text is ``und``; ties between languages go to the first by
name; repeated rows get equal results; existing columns named like the
outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField

from tierlake.llm.frames import add_columns, small_batches
from tierlake.session import cut_lineage

PER_LANGUAGE = 1000
#: Hash buckets of n-grams (of 3 characters).
BUCKETS = 1 << 14
SMOOTHING = 0.5
PENALTY = 4.0
ROUNDS, TOLERANCE = 12, 1e-3
#: Languages whose counts a task holds at a time.
HELD = 128
#: N-grams of a text that are hashed at a time.
CHUNK = 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    """Languages by name, and log-free likelihoods: an n-gram's likelihood in
    a language is the language's ``base`` and, if it was seen there, an
    ``excess``. Bucket b was seen in ``owner[starts[b] : starts[b + 1]]``."""

    languages: tuple[str, ...]
    base: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    excess: np.ndarray


@cache
def letters() -> np.ndarray:
    """1 for every code point that is a letter."""
    table = np.zeros(0x110000, bool)
    for run in regex.finditer(r"\p{L}+", "".join(map(chr, range(0x110000)))):
        table[run.start() : run.end()] = True
    return table


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, and how often each occurs; none if the
    text has no letter."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(BUCKETS, np.int64)
    lowered = text.lower()
    is_letter = letters()
    found = False
    for lo in range(0, len(lowered), CHUNK):
        part = lowered[max(lo - 2, 0) : lo + CHUNK]
        codes = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        kept = is_letter[codes]
        found = found or bool(kept.any())
        codes = np.where(kept, codes, 32)
        codes = codes[(codes != 32) | np.r_[True, codes[:-1] != 32]]  # one space in a row
        hashed = ((codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F)
                  + codes[2:]) * np.uint64(0x165667B19E3779F9)
        total += np.bincount((hashed >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = np.flatnonzero(total)
    return where, total[where]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """The model learnt from (a bounded sample of) ``labelled``; None without
    any language. Runs jobs."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    # Distinct texts by hash; a filter on the hash leaves about twice the rows
    # wanted of each language, and of those the first are taken.
    hashes = cut_lineage(known.select("lang", "h").distinct())
    sizes = hashes.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language
    share = F.least(F.lit(1.0), (2 * PER_LANGUAGE + 50) / F.col("n"))
    near = F.pmod(F.xxhash64("h"), F.lit(1 << 40)) < share * float(1 << 40)
    first = Window.partitionBy("lang").orderBy("h")
    chosen = hashes.join(F.broadcast(sizes), "lang").where(near).withColumn(
        "k", F.row_number().over(first)).where(F.col("k") <= PER_LANGUAGE)
    bounds = chosen.groupBy("lang", "n").agg(F.max("h").alias("last"))  # a row a language
    texts = known.join(F.broadcast(bounds), "lang").where(near & (F.col("h") <= F.col("last"))).dropDuplicates(
        ["lang", "h"])

    def counted(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, each in sums.items():
            where = np.flatnonzero(each)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(where), pa.string()), pa.array(where, pa.int32()), pa.array(each[where])],
                names=["lang", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                where, times = gram_counts(body)
                if name not in sums and len(sums) == HELD:
                    yield from counted(sums)
                    sums = {}
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))[where] += times
        yield from counted(sums)

    small_batches(labelled.sparkSession)
    rows = texts.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.collect_list(F.struct("bucket", "n")).alias("grams")).toArrow()  # a row a language
    if not rows.num_rows:
        return None
    rows = rows.sort_by("lang").combine_chunks()
    grams = rows["grams"].combine_chunks()
    owner = np.repeat(np.arange(rows.num_rows, dtype=np.int32), pc.list_value_length(grams).to_numpy())
    bucket = grams.flatten().field("bucket").to_numpy()
    n = grams.flatten().field("n").to_numpy().astype(np.float64)
    total = np.bincount(owner, weights=n) + SMOOTHING * BUCKETS
    order = np.lexsort((owner, bucket))
    return LanguageModel(
        tuple(rows["lang"].to_pylist()), SMOOTHING / total,
        np.searchsorted(bucket[order], np.arange(BUCKETS + 1)), owner[order],
        (n / total[owner])[order].astype(np.float32))


def proportions(mix: Callable, responsible: Callable, languages: int, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages by expectation-maximisation, and the
    log-likelihood they reach. ``mix`` gives the n-grams' likelihoods by
    proportions of languages, ``responsible`` sums weights of n-grams by
    likelihood for each language."""
    share = np.full(languages, 1.0 / languages)
    mixed = mix(share)
    # Of many languages each starts with little, so changes are smaller.
    tolerance = min(TOLERANCE, 0.01 / languages)
    for _ in range(ROUNDS if languages > 1 else 0):
        new = share * responsible(times / mixed) / times.sum()
        done = np.abs(new - share).max() < tolerance
        share = new
        mixed = mix(share)
        if done:
            break
    return share, float(np.log(mixed) @ times)


def infer(where: np.ndarray, times: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Languages of a document and their proportions, largest first."""
    times, base = times.astype(np.float64), model.base
    starts = model.starts[where]
    seen = model.starts[where + 1] - starts
    gram = np.repeat(np.arange(len(where)), seen)
    at = np.arange(len(gram)) + np.repeat(starts - np.cumsum(seen) + seen, seen)
    owner, excess = model.owner[at].astype(np.intp), model.excess[at].astype(np.float64)
    share, _ = proportions(
        lambda share: share @ base + np.bincount(gram, excess * share[owner], len(where)),
        lambda weight: weight.sum() * base + np.bincount(owner, excess * weight[gram], len(base)),
        len(base), times)
    order = np.argsort(-share, kind="stable")
    cost = PENALTY * np.log(max(times.sum(), 2)) / 2
    best, chosen = -np.inf, (order[:1], np.ones(1))
    here = np.zeros((len(where), 0))  # n-grams x languages of the set
    for k in range(1, len(order) + 1):
        own = owner == order[k - 1]
        column = np.full(len(where), base[order[k - 1]])
        column[gram[own]] += excess[own]
        here = np.column_stack([here, column])
        part, reached = proportions(here.__matmul__, here.__rmatmul__, k, times)
        if reached - cost * k <= best:
            break
        best, chosen = reached - cost * k, (order[:k], part)
    by_share = np.argsort(-chosen[1], kind="stable")
    return chosen[0][by_share], chosen[1][by_share]


def identify(df: DataFrame, model: LanguageModel | None, text: str = "text",
             prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the language of each whole text, its share, and all
    languages of the text with their shares."""
    names = model.languages if model else ()
    table = df.sparkSession.sparkContext.broadcast(model)
    fields = [StructField(prediction, StringType()), StructField(score, DoubleType()),
              StructField("languages", ArrayType(StringType())),
              StructField("shares", ArrayType(DoubleType()))]

    def make():
        learnt = table.value

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for body in batch.column(text).to_pylist():
                where, times = gram_counts(body)
                if not names or not len(where):
                    out.append(("und", 0.0, [], []))
                    continue
                which, share = infer(where, times, learnt)
                spoken = [names[i] for i in which.tolist()]
                out.append((spoken[0], min(1.0, float(share[0])), spoken, share.tolist()))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            types = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
            return [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]

        return compute

    return add_columns(df, fields, make)

"""Operator 3: quality rules as a short-circuit cascade (native).

Rules are boolean expressions over measures of a text. On a bounded sample of
documents each rule's cost (measured seconds a document) and selectivity
(share of the sample it rejects) are estimated, and the rules are ordered by
rejection per cost. The cascade is one CASE expression in that order: a
document that one rule rejects is not tested by any later rule, and costly
measures are computed only for documents that reach their rule. The order
changes the cost and the name of the first rejecting rule, never the verdict.

Everything is DataFrame functions on one row at a time: no shuffle, no
Python, and no state beyond one document. The sample is ``SAMPLE`` documents
at most, by a hash of the row.

Defined results: NULL and empty texts have no words and fail the rule on the
number of words; repeated rows are judged alike; an empty table has an empty
sample, and the rules keep the order they were given in; other columns pass
through, and existing columns named like an output are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.llm.frames import hash_sample
from tierlake.session import cut_lineage

#: Most documents that costs and selectivities are estimated on.
SAMPLE = 2000
#: Limits of the rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_SYMBOL_PERCENT = 30
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 20
MAX_DUP_LINES_PERCENT = 50
MAX_CAPITAL_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"


# --------------------------------------------------------------------------
# Measures of a text
# --------------------------------------------------------------------------

def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where filters
    are pushed down and projections merged."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_array(text: str = "text") -> Column:
    """Words: runs without ASCII white space."""
    spaced = F.regexp_replace(_text(text), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(spaced, " "), "")


def n_symbols(text: str = "text") -> Column:
    return F.regexp_count(_text(text), F.lit(SYMBOLS)).cast("long")


def n_capitals(text: str = "text") -> Column:
    return F.regexp_count(_text(text), F.lit(r"\p{Lu}")).cast("long")


def n_dup_lines(text: str = "text") -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(F.split(_text(text), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return _let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are compared by a 64-bit hash. If all differ, no word counts.
    Otherwise windows sorted by (hash, place) have their equals beside them;
    the places of those, in order, cover the words place to place + 2, and
    each word counts once."""
    n = F.size(words)

    def hashed(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def covered(places: Column) -> Column:
        each = F.transform(places, lambda p, k: F.coalesce(
            F.least(F.get(places, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(each, F.lit(0), lambda total, x: total + x).cast("long")

    def repeated(windows: Column) -> Column:
        found = F.filter(windows, lambda x, k: F.coalesce(
            (F.get(windows, k - 1)["h"] == x["h"]) | (F.get(windows, k + 1)["h"] == x["h"]),
            F.get(windows, k - 1)["h"] == x["h"], F.get(windows, k + 1)["h"] == x["h"], F.lit(False)))
        return _let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def count(hashes: Column) -> Column:
        windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")) \
                .otherwise(_let(windows, repeated))

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(
        _let(F.transform(F.sequence(F.lit(0), n - 3), hashed), count))


def word_measures(text: str = "text") -> Column:
    """Struct of n_words, word_chars and n_repeat_words; the words are found
    once."""
    return _let(word_array(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _word_chars(w).alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words")))


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    and n_capitals of each whole text (long)."""
    out = df.withColumn("_words", word_measures(text))
    return out.withColumns({
        "n_words": F.col("_words.n_words"), "word_chars": F.col("_words.word_chars"),
        "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": F.col("_words.n_repeat_words"), "n_capitals": n_capitals(text),
    }).drop("_words")


# --------------------------------------------------------------------------
# Rules
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """A rule rejects a document where ``rejects`` is true (NULL: keeps it)."""

    name: str
    rejects: Column

    def hit(self) -> Column:
        return F.coalesce(self.rejects, F.lit(False))


def default_rules(text: str = "text", measured: bool = False) -> list[Rule]:
    """The rules of this library. With ``measured`` they read the columns of
    ``with_measures``; otherwise each computes what it needs from the text."""
    def m(name: str, compute: Callable[[], Column]) -> Column:
        return F.col(name) if measured else compute()

    words = word_array(text)
    count = m("n_words", lambda: F.size(words).cast("long"))
    repeats = m("n_repeat_words", lambda: _let(words, _repeat_words))
    chars = m("word_chars", lambda: _let(words, _word_chars))
    symbols = m("n_symbols", lambda: n_symbols(text))
    lines = m("n_dup_lines", lambda: n_dup_lines(text))
    capitals = m("n_capitals", lambda: n_capitals(text))
    return [
        Rule("few_words", count < MIN_WORDS),
        Rule("repeated_words", 100 * repeats > MAX_REPEAT_PERCENT * count),
        Rule("symbols", 100 * symbols > MAX_SYMBOL_PERCENT * count),
        Rule("long_words", chars > MAX_MEAN_WORD * count),
        Rule("short_words", chars < MIN_MEAN_WORD * count),
        Rule("repeated_lines", 100 * lines > MAX_DUP_LINES_PERCENT * _line_count(text)),
        Rule("capitals", 100 * capitals > MAX_CAPITAL_PERCENT * chars),
    ]


def _line_count(text: str) -> Column:
    return F.regexp_count(_text(text), F.lit("\n")) + 1


@dataclass(frozen=True)
class Estimate:
    """What the sample says of a rule."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        """Rejection per cost."""
        return self.rejected / max(self.seconds, 1e-9)


def sample(df: DataFrame, text: str = "text", rows: int = SAMPLE) -> DataFrame:
    """At most ``rows`` documents, by a hash of the row (maps can't be
    hashed and have no part in it), stored."""
    key = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return cut_lineage(hash_sample(df.select(*key), rows, *key).select(text))


def estimate(picked: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """Cost and selectivity of each rule on a (stored) sample; one job a rule
    after one that warms up the scan."""
    def timed(rejects: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = picked.agg(F.avg(rejects.cast("double"))).first()[0]
        return time.perf_counter() - began, share or 0.0

    timed(F.lit(False))
    idle, _ = timed(F.lit(False))
    out = []
    for rule in rules:
        seconds, share = timed(rule.hit())
        out.append(Estimate(rule, max(seconds - idle, 1e-4), share))
    return out


def ordered(estimates: list[Estimate]) -> list[Rule]:
    """Most rejection per cost first; equals keep the order given."""
    return [e.rule for e in sorted(estimates, key=lambda e: -e.worth)]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or NULL: later rules of a rejected
    document aren't evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects, F.lit(rule.name)).otherwise(out)
    return out


def plan(df: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> list[Rule]:
    """The rules in the order that a sample of ``df`` suggests. Runs jobs."""
    rules = default_rules(text) if rules is None else rules
    return ordered(estimate(sample(df, text), rules))


def judge(df: DataFrame, rules: list[Rule] | None = None, text: str = "text",
          rejected_by: str = "rejected_by") -> DataFrame:
    """``df`` with the rule that rejects each document (NULL: kept), by the
    cascade in the planned order. Runs jobs on the sample."""
    return df.withColumn(rejected_by, cascade(plan(df, rules, text)))

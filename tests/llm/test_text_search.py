"""Operators 11 to 13 against plain versions, on small fixtures."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF001
from llm_fixtures import no_documents, odd_documents  # noqa: F401
from tierlake.llm import decontam, periodic, phrases, queries

# --------------------------------------------------------------------------
# Periodic runs
# --------------------------------------------------------------------------


def plain_runs(w, least=12):
    """All runs by trying every period."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


copies = st.tuples(st.integers(0, 80), st.integers(1, 40), st.integers(1, 90))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=120), st.lists(copies, max_size=4), st.sampled_from([1, 4, 12]))
def test_runs_equal_plain_runs(words, repeats, least):
    for at, period, size in repeats:
        for i in range(at + period, min(len(words), at + period + size)):
            words[i] = words[i - period]
    got = periodic.runs_of(words, least)
    assert got == plain_runs(words, least)
    assert periodic.collapse(words, got) == plain_collapse(words, got)


@pytest.mark.parametrize("cuts", [(1,), (7, 8, 50), tuple(range(1, 90))])
def test_catchers_are_online(cuts):
    words = ([0, 1, 2, 3, 4] * 8 + [9] * 20 + [0, 1] * 15)[:90]
    catchers, at = periodic.Catchers(), 0
    for to in (*cuts, len(words)):
        catchers.extend(words[at:to])
        at = max(at, to)
    assert catchers.close() == plain_runs(words)


def test_runs_of_long_periodic_words():
    assert periodic.runs_of(["a"] * 50_000) == [(0, 50_000, 1)]
    block = list(range(9_000))
    assert periodic.runs_of(block * 4 + block[:5]) == [(0, 36_005, 9_000)]


def plant(words, doc_id):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_op13_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF001).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        words = plant(re.findall(r"[^\x20\x09-\x0D]+", text or ""), doc_id)
        runs = plain_runs(words) if len(words) < 1500 else periodic.runs_of(words)
        planted += zlib.crc32(str(doc_id).encode()) % 10 == 0 and bool(runs)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        kept = " ".join(plain_collapse(words, runs))
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 5


def test_runs_of_odd_rows(spark, odd_documents, no_documents):
    rows = periodic.find_runs(odd_documents.withColumn("runs", odd_documents.doc_id)).collect()
    assert len(rows) == 10
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
        words = periodic.split_words(r.text)
        assert [tuple(x) for x in r.runs] == periodic.runs_of(words)
    assert by_id[1][0].runs == by_id[1][1].runs
    assert by_id[1][0].runs[0].period == 6 and by_id[1][0].collapsed == "The cat sat on the mat."
    for i in (3, 4, 7):
        assert by_id[i][0].runs == [] and by_id[i][0].collapsed == ""
    # The long text's period, the least common multiple of its cycles, doesn't fit in twice.
    assert by_id[5][0].runs == [] and by_id[5][0].collapsed == by_id[5][0].text and by_id[5][0].ids == "x"
    assert periodic.find_runs(no_documents).count() == 0


def test_planting_of_odd_rows(spark, odd_documents):
    rows = odd_documents.select("doc_id", "text", periodic.planted().alias("made")).collect()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert re.findall(r"[^\x20\x09-\x0D]+", r.made or "") == plant(words, r.doc_id)


# --------------------------------------------------------------------------
# Benchmark decontamination
# --------------------------------------------------------------------------

def plain_split(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+",
                      re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_hits(text, items, window):
    words, hit, names = plain_split(text), set(), set()
    for item, other in items:
        w = plain_split(other)
        for i in range(max(len(w) - window + 1, 1 if w else 0)):
            part = w[i : i + window]
            for at in range(len(words) - len(part) + 1):
                if words[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    names.add(item)
    return len(words), hit, sorted(names, key=str.encode)


sentence = st.lists(st.sampled_from("a b c d É ß-Q 日本 7 x'y".split()), max_size=18).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["1", "2", "é", ""]), sentence), max_size=5), sentence, st.integers(1, 6))
def test_search_equals_plain_search(items, text, window):
    spans, names = decontam.Searcher(items, window).search(decontam.plain_words(text))
    n, hit, want = plain_hits(text, items, window)
    assert len(decontam.plain_words(text)) == n
    assert {i for a, b in spans for i in range(a, b)} == hit and sorted(names, key=str.encode) == want


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    def words(n):
        return " ".join(f"w{i}" for i in rng.integers(0, 30, n))
    items = [(i % 7, words(int(rng.integers(0, 60)))) for i in range(20)] + [(None, "w1 w2"), (9, None), (9, "--")]
    texts = [(i, words(150)) for i in range(30)] + [(30, None), (31, " ".join(t for _, t in items[:20]))]
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    monkeypatch.setattr(decontam, "PIECE", 9)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 700)
    named = [("" if i is None else str(i), t) for i, t in items]
    for r in decontam.find(docs, bench, window=3).collect():
        n, hit, want = plain_hits(r.text, named, 3)
        assert (r.n_words, r["items"]) == (n, want)
        assert {i for s in r.spans for i in range(s.start, s.start + s.length)} == hit


def test_decontamination_of_odd_rows(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(1, "the cat sat on the mat the cat sat on"), (2, "日本語")],
                                  "item_id long, text string")
    docs = odd_documents.withColumn("spans", odd_documents.source)
    rows = decontam.find(docs, bench).collect()
    assert len(rows) == 10
    for r in rows:
        words = plain_split(r.text)
        assert r.n_words == len(words) and r.ids == "x"
        assert r["items"] == {1: ["1"], 8: ["2"]}.get(r.doc_id, [])
    assert {tuple(r.spans) for r in rows if r.doc_id == 1} == {((0, 10),)}
    assert decontam.find(no_documents, bench).count() == 0
    assert all(r["items"] == [] for r in decontam.find(odd_documents, bench.where("false")).collect())


# --------------------------------------------------------------------------
# Phrase collocations
# --------------------------------------------------------------------------

def plain_phrases(rows, least, most, percent=100):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    counts[lang or "und"][tuple(w[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        here = []
        frequent = [p for p in f if f[p] >= least and len(p) > 1]
        around = Counter()  # most occurrences of any longer candidate that holds the phrase
        for q in frequent:
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    around[q[i : i + size]] = max(around[q[i : i + size]], f[q])
        for p in frequent:
            if p in around and 100 * around[p] >= percent * f[p]:
                continue
            score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            here.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(here)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def some_documents():
    rng = np.random.default_rng(5)
    vocabulary = ["Ab", "ba", "ñu", "日", "x-y", "..", "to", "of", "q", "r", "s", "t"]
    passage = "one two three four five six, seven eight nine ten eleven twelve one two three four five six"
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(vocabulary, int(rng.integers(0, 60)), p=np.arange(12, 0, -1) / 78))
        if i % 3 == 0:
            text += "\n" + passage
        rows.append((["en", "de", None][i % 7 % 3], text))
    return rows + [rows[0]] * 40 + [("en", None), ("fr", ""), (None, " ,. \n")]


@pytest.mark.parametrize("period", [1, 3, 32])
def test_mining_equals_plain_mining(spark, monkeypatch, period):
    rows = some_documents()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    monkeypatch.setattr(phrases, "SLICE", 20)
    assert as_rows(phrases.mine(docs, least=15, most=40, period=period)) == plain_phrases(rows, 15, 40)
    assert as_rows(phrases.mine(docs, least=15, most=40, percent=60, period=period)) == plain_phrases(rows, 15, 40, 60)


def test_tables_that_hold_everything_change_nothing(spark, monkeypatch):
    rows = some_documents()
    monkeypatch.setattr(phrases, "TABLE_BITS", 1 << 6)
    monkeypatch.setattr(phrases, "BITS_EACH", 0)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert as_rows(phrases.mine(docs, least=15, most=40)) == plain_phrases(rows, 15, 40)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB é.\n\t,"), max_size=60)), max_size=8),
       st.sampled_from([1, 2, 7]))
def test_every_phrase_has_one_chunk(texts, period):
    s = phrases.stream(pa.array(texts, pa.string()))
    owner = phrases.owners(s.first)
    for size in range(1, 6):
        inside = np.zeros(len(s.ids), int)
        lo, hi, own, text = phrases.cut(s, period)
        for a, b, o, t in zip(lo, hi, own, text, strict=True):
            assert (owner[a:b] == t).all()
            inside[a : max(a, min(a + o, b - size + 1))] += 1
        for i in range(len(s.ids) - size + 1):
            assert inside[i] == (owner[i] == owner[i + size - 1])


def test_mining_of_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.lang, r.text) for r in odd_documents.collect()]
    assert as_rows(phrases.mine(odd_documents, least=2, most=30)) == plain_phrases(rows, 2, 30)
    assert phrases.mine(no_documents).count() == 0

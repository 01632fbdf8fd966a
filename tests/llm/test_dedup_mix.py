"""Operators 7 and 8: fingerprints, links and components by brute force, and
the mix against a plain queue."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF001, SF01
from llm_fixtures import no_documents, odd_documents  # noqa: F401
from tierlake.llm import components, mixing, quality, queries, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    """{doc row index: component} for (doc_id, fingerprint) rows."""
    distinct = sorted({fp for _, fp in rows})
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    first = {}
    for doc_id, fp in rows:
        if doc_id is not None:
            first[root(fp)] = min(first.get(root(fp), doc_id), doc_id)
    return [(doc_id, fp, first.get(root(fp))) for doc_id, fp in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "Word", "x\x1cy", "　"]), max_size=30), st.sampled_from([" ", "\n", "\t\r"]))
def test_fingerprint(words, gap):
    assert simhash.fingerprint(gap.join(words), 4, 42) == brute_fingerprint(gap.join(words))


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 57}" for i in range(500))
    monkeypatch.setattr(simhash, "CHUNK", 16)
    assert simhash.fingerprint(text, 4, 42) == brute_fingerprint(text)


def test_masks_cover_all_pairs_within_the_radius():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31 and all(30 <= m.bit_count() <= 36 for m in masks)
    for bits in itertools.combinations(range(64), 3):
        difference = sum(1 << b for b in bits)
        assert any(not difference & m for m in masks)
    rng = random.Random(1)
    for _ in range(20_000):
        difference = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not difference & m for m in masks)


def test_midpoints():
    flips = simhash.midpoint_flips(4)
    assert len(flips) == len(set(flips)) == 2081
    assert all(f.bit_count() <= 2 for f in flips)


def planted(seed, centres, copies):
    """Fingerprints in balls of a few bits, some of them chained."""
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        fp = rng.getrandbits(64)
        for _ in range(copies):
            out.append(fp)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                fp ^= 1 << b
            if rng.random() < 0.3:
                fp = out[-1] ^ 1 << rng.randrange(64)
    return out


def check_links(spark, fps):
    rows = [(i, fp) for i, fp in enumerate(fps)] + [(None, fps[0]), (len(fps) + 5, fps[0]), (0, fps[0])]
    frame = spark.createDataFrame([(i, simhash.signed(fp)) for i, fp in rows], "doc_id long, fp long")
    got = simhash.near_duplicates(frame, 4).select("doc_id", "fp", "component_id").collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == Counter(brute_components(rows))


def test_components_of_planted_copies(spark):
    check_links(spark, [0, 1, 0b11111, *planted(3, 40, 6)])


def test_large_buckets_meet_at_midpoints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 3)
    check_links(spark, [0, 1, 0b11111, *planted(4, 12, 25)])


def test_large_bucket_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 10)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check_links(spark, planted(5, 3, 60))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    odd = [(7000, 7000), (None, 3), (8000, 8001), (8001, 8000)]
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame(path + star + odd, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(301)}) == 1
    assert got[0] != got[1000] and got[8000] == got[8001] and 7000 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op7_query(spark):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    got = queries.op7_simhash(spark, SF01).collect()
    assert Counter(tuple(r) for r in got) == Counter(
        (d, f"{fp:016x}", c) for d, fp, c in brute_components(rows))


def test_deduplicate_odd_rows(spark, odd_documents, no_documents):
    kept = simhash.deduplicate(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]  # the row without an id stands alone
    assert sorted(ids, key=lambda i: -1 if i is None else i) == [None, 1, 2, 3, 5, 8]
    assert simhash.deduplicate(no_documents).count() == 0


def test_deduplicate_keeps_one_row_of_each_group(spark):
    """Repeated ids lie in several groups, and some groups have no id."""
    rng = random.Random(6)
    rows = []
    for group in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts = [" ".join([*words, f"end{k}"]) for k in range(3)]
        ids = [[None], [1], [1, 2, None], [3 + group, None, 1]][group % 4]
        rows += [(rng.choice(ids), rng.choice(texts)) for _ in range(6)]
    groups = {}
    distinct = sorted({brute_fingerprint(t) for _, t in rows})
    of = dict(zip(distinct, brute_components([(k, fp) for k, fp in enumerate(distinct)]), strict=True))
    for i, text in rows:
        order = i is None, i or 0, simhash.signed(xxhash.xxh64_intdigest(text.encode(), seed=42))
        groups.setdefault(of[brute_fingerprint(text)][2], []).append((order, i, text))
    assert len(groups) == 12 and len({t for _, t in rows}) > 24
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(min(g, key=lambda x: x[0])[1:] for g in groups.values())


# --------------------------------------------------------------------------
# Mixing
# --------------------------------------------------------------------------

def brute_targets(sizes, cycle=(3, 1, 2), ratio=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, left = {}, set(names)
    budget = ratio * sum(sizes.values())
    while left:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > epochs * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in left}
        for s in full:
            target[s] = epochs * sizes[s]
            budget -= target[s]
        left -= full
    return target


def brute_mix(rows, epochs=2):
    """Rows taken of (source, doc_id, size) entries, repeats counted."""
    entries = Counter(rows)
    total = {e: e[2] * n for e, n in entries.items()}
    sizes = Counter()
    for e, t in total.items():
        sizes[e[0]] += t
    target = brute_targets(dict(sizes))
    queue = []
    for source in sizes:
        run = 0
        own = [e for e in entries if e[0] == source and total[e]]
        own.sort(key=lambda e: (hashlib.md5(f"42:{'' if e[1] is None else e[1]}".encode()).hexdigest(), e[1] or 0, e[2]))
        for e in own:
            for _ in range(entries[e]):
                run += e[2]
                for k in range(epochs):
                    queue.append(((run + k * sizes[source]) / target[source], source is None, source or "", e))
    queue.sort(key=lambda x: (x[:3], hashlib.md5(f"42:{'' if x[3][1] is None else x[3][1]}".encode()).hexdigest()))
    taken, run = Counter(), 0
    for *_, e in queue:
        run += e[2]
        if run > int(1.5 * sum(sizes.values())):
            break
        taken[e] += 1
    return entries, sizes, target, taken


def check_mix(spark, rows):
    frame = spark.createDataFrame(rows, "source string, doc_id long, size long")
    got = mixing.decide(frame).collect()
    entries, sizes, target, taken = brute_mix(rows)
    assert Counter((r.source, r.doc_id, r.size) for r in got) == entries
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) <= 1e-6 * max(1, target[r.source])
        assert r.copies in (taken[(r.source, r.doc_id, r.size)] // entries[(r.source, r.doc_id, r.size)] + k for k in (0, 1))
    assert Counter(e for r in got for e in [(r.source, r.doc_id, r.size)] * r.copies) == taken


def test_mix_equals_a_plain_queue(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", "d", "zz", None]), i, rng.choice([0, 1, 5, 30, 400])) for i in range(600)]
    rows += [("hot", 10_000 + i, 50) for i in range(400)] + [("hot", 1, 3)] * 4 + [("none", 5, 0), (None, None, 8)]
    check_mix(spark, rows)
    monkeypatch.setattr(mixing, "SLICE", 16)
    check_mix(spark, rows)


def test_mix_of_one_source_and_of_nothing(spark):
    check_mix(spark, [("a", i, 10) for i in range(20)])
    assert mixing.decide(spark.createDataFrame([], "source string, doc_id long, size long")).count() == 0
    empty = mixing.decide(spark.createDataFrame([("a", 1, 0)], "source string, doc_id long, size long")).collect()
    assert [(r.target, r.copies) for r in empty] == [(0.0, 0)]


def test_mix_keeps_columns_and_repeats_rows(spark, odd_documents, no_documents):
    out = mixing.mix(odd_documents)
    assert out.columns == odd_documents.columns and mixing.mix(no_documents).count() == 0
    rows = [(r.source, r.doc_id, len((r.text or "").encode().split())) for r in odd_documents.collect()]
    entries, _, _, taken = brute_mix(rows)
    got = Counter((r.source, r.doc_id, len((r.text or "").encode().split())) for r in out.collect())
    assert got == taken


def test_mix_of_a_hot_null_id(spark, monkeypatch):
    """A third of the rows and more on one NULL id: sources still end near
    their targets, and texts that share it are taken row by row."""
    rows = [("a", None, f"w{i} " * 50) for i in range(3000)] + [("b", i, "x " * 50) for i in range(1000)]
    frame = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(7)
    sized = [(s, i, 50) for s, i, _ in rows]
    *_, target, taken = brute_mix(sized)
    for parts in (10_000, 7):
        monkeypatch.setattr(mixing, "PARTS", parts)
        out = mixing.mix(frame).groupBy("source", "doc_id", "text").count().collect()
        for s in "ab":
            n = 50 * sum(r["count"] for r in out if r.source == s)
            near = 3000 * 50 / 7 if parts == 7 else 100
            assert abs(n - target[s]) <= near
            assert parts == 7 or n == 50 * sum(k for e, k in taken.items() if e[0] == s)
        assert max(r["count"] for r in out if r.source == "a") <= 2
        assert sum(r["count"] for r in out) <= 6000


def test_op8_sql_with_repeated_ids(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, None, 1, 2, *range(3, 60)]), rng.choice(["s", "t", None]), "w " * rng.choice([0, 1, 3, 9]))
            for _ in range(2000)] + [(None, "t", "hot " * 4)] * 2500
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["op8_mixing"]).fetchall()
    got = queries.op8_mixing(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_mix_comes_near_its_targets(spark):
    rows = queries.op8_mixing(spark, SF001).groupBy("source_size", "target").agg(
        F.sum("taken").alias("taken"), F.max("size").alias("most"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    for r in rows.collect():
        assert abs(r.taken - r.target) <= 2 * r.most and r.over <= 0


def test_numpy_popcount_matches_python():
    x = np.array([0, 1, 2**64 - 1, 0xF0F0], np.uint64)
    assert np.bitwise_count(x).tolist() == [int(v).bit_count() for v in x.tolist()]


# --------------------------------------------------------------------------
# Columns named like helpers
# --------------------------------------------------------------------------

def test_columns_named_like_helpers_stay(spark, odd_documents):
    extra = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in
             ("_h", "_size", "_pass", "_copies", "_p_id", "_score", "_toxic", "_rejected_by", "__h")}
    docs = odd_documents.withColumns(extra).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    values = {c: {r[0] for r in docs.select(c).collect()} for c in extra}
    for out in (simhash.deduplicate(docs), mixing.mix(docs), quality.judge(docs)):
        assert out.columns[: len(docs.columns)] == docs.columns
        for r in out.collect():
            assert all(r[c] in values[c] for c in extra) and (r.m or {}).get("a") == r.doc_id
    prints = simhash.fingerprints(docs, shingle=4, seed=42)
    found = simhash.near_duplicates(prints)
    assert found.columns.count("component_id") == 1 and found.select("component_id").count() == 10

"""Operators 2 to 5 and 9: held-out accuracy, plain Python versions, and
exhaustive search; and the pipeline, stage by stage."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF001, SF01
from llm_fixtures import no_documents, odd_documents  # noqa: F401
from tierlake.llm import ann, langid, preference, quality, queries, toxicity

SF1 = "/root/testdata/sf0.1"


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# --------------------------------------------------------------------------
# Toxicity
# --------------------------------------------------------------------------

def test_op2_held_out_accuracy(spark):
    rows = queries.op2_toxicity(spark, SF1).join(
        spark.read.parquet(f"{SF1}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    toxic = [r for r in held if r.toxic]
    assert np.mean([r.predicted for r in toxic]) >= 0.9
    assert np.mean([r.toxic for r in held if r.predicted]) >= 0.9


def test_toxicity_of_odd_rows(spark, odd_documents, no_documents):
    nasty = spark.createDataFrame(
        [(100 + i, " ".join(f"w{(i * 7 + k) % 83} zorgle w{(i + k) % 61}" for k in range(30))) for i in range(40)]
        + [(200 + i, " ".join(f"w{(i * 5 + k) % 83} w{(i + 3 * k) % 61}" for k in range(45))) for i in range(80)],
        "doc_id long, text string")
    labels = nasty.select("doc_id", (F.col("doc_id") < 200).cast("int").alias("label"))
    model = toxicity.fit(nasty, labels)
    of = toxicity.distance_of(model.toxic, model.ordinary).of
    assert of(spelt("w1 zorgle w2")) > 4 and abs(of(spelt("w1 w2 w3"))) < 4
    scored = {r.doc_id: r.predicted for r in toxicity.score(nasty, model).collect()}
    assert all(scored[i] == int(i < 200) for i in scored)
    odd = toxicity.score(odd_documents, model).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if not (r.text or "").strip(" \t\n\x0b\x0c\r")}) == 1
    assert toxicity.score(no_documents, model).count() == 0
    assert toxicity.fit(nasty, labels.where("label = 0")) is None
    assert {r.score for r in toxicity.score(odd_documents, None).collect()} == {0.0}


def spelt(text, words=6):
    return toxicity.windows(pa.array([text], pa.large_string()), words)[0][0]


def plain_windows(text, words):
    """Windows of words, each character as a hash of its word up to it."""
    parts, out = text.encode().split(), []
    for i in range(0, len(parts), words):
        raw = toxicity._spelt(" ")[:4]
        for word in parts[i : i + words]:
            word = word.decode()
            raw += b"".join(toxicity._spelt(word[:k])[-4:] for k in range(1, len(word) + 1)) + toxicity._spelt(" ")[:4]
        out.append(raw)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé日 \n\t\x0b\x1c"), max_size=30), max_size=6), st.integers(1, 4))
def test_windows_cover_whole_texts(texts, words):
    cut, at, n = toxicity.windows(pa.array(texts, pa.large_string()), words)
    assert n.tolist() == [len(t.encode().split()) for t in texts]
    assert [cut[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [plain_windows(t, words) for t in texts]


def test_figures_equal_plain_compression(spark):
    """Every window of a text through both dictionaries, by zstandard itself."""
    docs = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(8).collect()] + ["", None]
    toxic, ordinary = spelt("trash moron " * 30, 60), spelt("of the and " * 20, 60)
    size = max(len(toxic), len(ordinary))
    distance = toxicity.Distance(toxic.rjust(size, b"\0"), ordinary.rjust(size, b"\0"))
    got = toxicity.figures_column(pa.array(docs, pa.string()), distance)
    for text, row in zip(docs, got, strict=True):
        text = (text or "").lower()
        n = len(text.encode().split())
        d = [len(distance.ordinary.compress(w)) - len(distance.toxic.compress(w))
             for w in plain_windows(text, toxicity.WINDOW)]
        top = (sorted(d, reverse=True) + [0, 0, 0])[:3]
        want = [x for t in toxicity.THRESHOLDS for k in (sum(v >= t for v in d),)
                for x in (np.log((k + 0.1) / (n + 20)), k / np.sqrt(n + 5))]
        want += [sum(d) / (n + 5), *(v / 10 for v in top), np.log(n + 1), sum(v for v in d if v > 4) / (n + 5),
                 sum(v <= -6 for v in d) / np.sqrt(n + 5)]
        assert np.allclose(row, want)


# --------------------------------------------------------------------------
# Quality
# --------------------------------------------------------------------------

def plain_measures(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(
    ["a", "b", "É", "#", "日", "😀", "\x1c", "　"]), max_size=25).map(" ".join), st.lists(st.sampled_from(
        ["a b", "", " ", "c|", "a b\t", "\x0b"]), max_size=8).map("\n".join)), min_size=1, max_size=12))
def test_measures(spark, rows):
    frame = quality.with_measures(spark.createDataFrame(list(enumerate(rows)), "i int, text string"))
    got = {r.i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in frame.collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(rows)}


def test_cascade_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    rules = quality.default_rules()
    forward = docs.withColumn("by", quality.cascade(rules)).where("by IS NULL").select("doc_id")
    back = docs.withColumn("by", quality.cascade(rules[::-1])).where("by IS NULL").select("doc_id")
    assert {r[0] for r in forward.collect()} == {r[0] for r in back.collect()}
    estimates = [quality.Estimate(r, s, x) for r, s, x in zip(rules, (3, 1, 1, 2, 5, 1, 1), (.3, .5, 0, .9, 0, .1, .1),
                                                             strict=True)]
    assert [r.name for r in quality.ordered(estimates)][:2] == ["repeated_words", "long_words"]
    plan = quality.judge(docs).where("rejected_by IS NULL")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_of_odd_rows(spark, odd_documents, no_documents):
    judged = {r.doc_id: r.rejected_by for r in quality.judge(odd_documents).collect()}
    # Three words in a row of the long text come again after 30287 words, so nearly all are repeated.
    assert judged[5] == "repeated_words" and all(judged[i] for i in (1, 3, 4, 7, None))
    assert quality.judge(no_documents).count() == 0


# --------------------------------------------------------------------------
# Vectors
# --------------------------------------------------------------------------

def exact(rows, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 100 == 0}):
        query = min(v for i, v in rows if i == q)
        away = np.sqrt(((x - np.array(query)) ** 2).sum(axis=1))
        near = [j for j in np.lexsort((ids, away)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(away[j])) for j in near]
    return out


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_op4_recall_and_scores(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF1}/embeddings.parquet").collect()]
    got, want = found(queries.op4_learned_partitions(spark, SF1)), exact(rows)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    scores = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - scores[q][i]) < 1e-12 for q in got for i, s in got[q] if i in scores[q])


def test_search_visits_partitions_with_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "PARTITION", 150)
    monkeypatch.setattr(ann, "BLOCK", 40)
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 5, (12, 8))
    x = np.concatenate([c + rng.normal(0, 1, (150, 8)) for c in centres])
    same = [1.0] * 8
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, same) for i in range(600)] + [(6000, same)] * 2
    got, want = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"),
                                 F.col("vec_id") % 100 == 0)), exact(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert got[5000] == [(5000 + i, 0.0) for i in range(1, 11)]  # ties go to smaller ids


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, [1.0]), (8, []), (100, [4.0, 6.0]), (None, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = found(ann.search(frame, F.col("vec_id") % 100 == 0))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1, 100], 100: [1, 0]}
    assert got[0][1][1] == 5.0
    assert ann.search(frame.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_balanced_partition():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (100, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5))])
    label = ann.balanced_partition(ann.neighbour_graph(x, 8), 4)
    assert max(np.bincount(label)) <= 110
    assert np.mean([np.bincount(label[i : i + 100]).max() for i in range(0, 400, 100)]) > 80


# --------------------------------------------------------------------------
# Preference pairs
# --------------------------------------------------------------------------

def plain_pair(chosen, rejected):
    def shown(turns):
        return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)

    def spans(turns):
        out, at = [], 0
        for r, t in turns:
            start = at + len(r) + 5
            if r == "assistant":
                out.append(f"{start}:{start + len(t) + 7}")
            at = start + len(t) + 8
        return ",".join(out)

    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    return n, shown(chosen[:n]), shown(chosen[n:]), spans(chosen[n:]), shown(rejected[n:]), spans(rejected[n:])


def test_preference_pairs(spark):
    a = [("system", "s"), ("user", "hi 😀"), ("assistant", "yo"), ("user", "q"), ("assistant", "long answer")]
    pairs = {1: (a, a[:3] + [("user", "q2"), ("assistant", "é")]), 2: (a, a), 3: (a[:2], a), 4: (a, []),
             5: ([("user", "")], [("assistant", "")]), 6: ([], a)}
    rows = [(k, side == 0, i, role, text, "x") for k, both in pairs.items() for side in (0, 1)
            for i, (role, text) in enumerate(both[side])]
    rows += [(7, True, None, None, None, "x"), (7, True, 0, "user", "b", "x"), (None, True, 0, "user", "b", "x")]
    frame = spark.createDataFrame(rows, "pair_id long, chosen boolean, turn int, role string, text string, prompt string")
    got = {r[0]: tuple(r[1:]) for r in preference.format_pairs(frame).collect()}
    want = {k: plain_pair(*both) for k, both in pairs.items()} | {7: plain_pair([("user", ""), ("user", "b")], [])}
    assert got == want
    body, spans = got[1][2], got[1][3].split(",")
    assert [body[int(s.split(":")[0]) : int(s.split(":")[1])] for s in spans] == ["long answer<|end|>"]
    assert preference.format_pairs(frame.where("false")).count() == 0


def test_op5_query(spark, tmp_path):
    """Every conversation against itself with the next one's last reply;
    NULLs, repeated turns, a missing neighbour, ids at both ends."""
    talks = {1: [("user", "a"), ("assistant", "b")], 2: [("user", "a"), ("assistant", "c"), ("assistant", "c")],
             3: [("assistant", "c")], 7: [("user", "q"), (None, None)], 8: [("user", "")],
             -2**63: [("user", "low")], 2**63 - 1: [("user", "high"), ("assistant", "top")]}
    rows = [(i, n, r, t) for i, turns in talks.items() for n, (r, t) in enumerate(turns)] + [(None, 0, "user", "none")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    full = {i: [(r or "user", t or "") for r, t in turns] for i, turns in talks.items()}
    following = {i: full.get(i + 1 if i < 2**63 - 1 else -2**63, []) for i in full}
    got = {r[0]: tuple(r[1:]) for r in queries.op5_preference(spark, str(tmp_path)).collect()}
    assert got == {i: plain_pair(t, t[:-1] + following[i][-1:]) for i, t in full.items()}
    assert got[2][0] == 3 and got[1][0] == 1


# --------------------------------------------------------------------------
# Languages
# --------------------------------------------------------------------------

def test_op9_held_out_accuracy(spark):
    rows = queries.op9_language(spark, SF01).join(
        spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.95


def many_languages(n):
    """(lang, text) of ``n`` languages with a few letters each; the last have
    the fewest texts."""
    def text(i, salt):
        letters = [chr(0x4E00 + 8 * i + k) for k in range(8)]
        return " ".join("".join(letters[(j * j + salt + k) % 8] for k in range(4)) for j in range(40))
    return [(f"l{i:03d}", text(i, salt)) for i in range(n) for salt in range(2 if i < n - 6 else 1)]


def test_every_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 7)
    rows = many_languages(206)
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == tuple(sorted({lang for lang, _ in rows}))
    docs = spark.createDataFrame(rows[::9] + rows[-6:], "lang string, text string")
    for r in langid.identify(docs, model).collect():
        assert r.lang_pred == r.lang and r.languages == [r.lang]


def test_copies_of_a_text_are_learnt_once(spark):
    rows = many_languages(3)
    once = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    often = langid.fit(spark.createDataFrame(rows + rows[:1] * 300, "lang string, text string"))
    assert once.languages == often.languages
    for name in ("base", "starts", "owner", "excess"):
        assert np.array_equal(getattr(once, name), getattr(often, name))


def test_mixture_of_seven_languages(spark):
    rows = many_languages(206)
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    for some in (rows[-7:], rows[:14:2]):
        whole = spark.createDataFrame([(" ".join(text for _, text in some),)], "text string")
        found = langid.identify(whole, model).first()
        assert sorted(found.languages) == sorted(lang for lang, _ in some)
        assert all(abs(s - 1 / 7) < 0.05 for s in found.shares) and found.score == found.shares[0]


def test_mixture_of_two_languages(spark, odd_documents, no_documents):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("length(text) > 1500")
    model = langid.fit(docs)
    one = {r.lang: r.text for r in docs.where("lang IN ('en', 'de')").select("lang", "text").collect()}
    both = spark.createDataFrame([(one["en"][:1500] + "\n" + one["de"][:1500],), (one["de"][:1500],)], "text string")
    mixed, single = langid.identify(both, model).collect()
    assert set(mixed.languages) == {"de", "en"} and all(0.3 < s < 0.7 for s in mixed.shares)
    assert single.languages == ["de"] and single.score == 1.0
    odd = {r.doc_id: r for r in langid.identify(odd_documents, model).collect()}
    assert odd[3].lang_pred == odd[4].lang_pred == odd[7].lang_pred == "und" and odd[3].score == 0
    assert odd[1].lang_pred in model.languages
    assert langid.identify(no_documents, model).count() == 0 and langid.fit(no_documents) is None
    assert {r.lang_pred for r in langid.identify(odd_documents, None).collect()} == {"und"}


# --------------------------------------------------------------------------
# Pipeline
# --------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        rows = out.collect()
        if name == "byte_bpe":
            assert len(rows) == docs.count() and {"ids_sha256", "decoded_sha256"} <= set(out.columns)
            break
        assert out.columns == columns
        kept = Counter(r.doc_id for r in rows)
        before = Counter(r.doc_id for r in docs.collect())
        assert set(kept) <= set(before)
        if name != "source_mix":
            assert max(kept.values()) == 1
        docs = spark.createDataFrame(rows, docs.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality_rules", "near_dedup", "source_mix", "byte_bpe"]


def test_pipeline_of_nothing(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF001}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

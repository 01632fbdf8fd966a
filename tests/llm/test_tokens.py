"""Operators 1, 6 and 10 against their libraries, text by text."""

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF001
from llm_fixtures import no_documents, odd_documents  # noqa: F401
from tierlake.llm import bpe, packing, pretokens, queries, token_count
from tierlake.session import scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")

parts = st.sampled_from([
    "'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "　", "\xa0", "\x85", "a", "B", "é", "1",
    "²", "!", "?", "日", "😀", "́", "_", "<|endoftext|>", "\x00", "LL", "the", " is", "▁", "<s>", "<0x0A>"])
texts = st.lists(st.one_of(st.none(), st.lists(parts, max_size=12).map("".join), st.text(
    st.characters(codec="utf-8", categories=("L", "N", "P", "S", "Z", "Cc")), max_size=20)), max_size=20)


def read(path):
    with open(path, "rb") as f:
        return f.read()


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, read(RANKS).splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TIKTOKEN = library()
MERGES = bpe.merges_of(read(RANKS))
COUNTER = token_count.counter_of(read(PIECES))
PIECE_LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOKENIZER = tokenizers.Tokenizer.from_file(JSON)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_bpe_equals_library(rows):
    column = pa.array(rows, pa.string())
    ids = bpe.encode_column(column, MERGES)
    want = [TIKTOKEN.encode_ordinary(t or "") for t in rows]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == want
    assert bpe.decode_column(ids, MERGES).to_pylist() == [(t or "").encode() for t in rows]


@settings(max_examples=150, deadline=None)
@given(texts)
def test_token_count_equals_library(rows):
    size, tokens = token_count.count_column(pa.array(rows, pa.string()), COUNTER)
    assert tokens.tolist() == [len(PIECE_LIBRARY.encode(t or "")) for t in rows]
    assert size.tolist() == [len((t or "").encode()) for t in rows]


@settings(max_examples=100, deadline=None)
@given(texts)
def test_json_tokenizer_equals_library(rows):
    encoder = packing.encoder_of(read(JSON))
    got = [ids[a:b].tolist() for ids, ends in encoder.encode(pa.array(rows, pa.string()))
           for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert got == [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in rows]


def test_merges_out_of_rank_order_are_redone():
    # "abc" ranks below "ab", so merging "ab" makes a pair of a lower rank.
    ranks = {bytes([b]): 300 + b for b in range(256)} | {b"ab": 20, b"abc": 10, b"xab": 5, b"abab": 15}
    merges = bpe.Merges(ranks)
    words = [b"abc", b"zabcab", b"ababab", b"xabcabc", b"aabbab", b"q"]
    flat, at = merges.encode(pa.array(words, pa.binary()))
    for k, word in enumerate(words):
        want = [ranks[word]] if word in ranks else merges.merge_one(word)
        assert flat[at[k] : at[k + 1]].tolist() == want


def test_blocks_do_not_change_results(monkeypatch):
    rows = [f"some words {i} and more" * (i % 5) for i in range(50)] + [None, ""]
    column = pa.array(rows)
    whole = bpe.encode_column(column, MERGES).to_pylist(), token_count.count_column(column, COUNTER)[1].tolist()
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 40)
    monkeypatch.setattr(token_count, "BLOCK_BYTES", 40)
    assert bpe.encode_column(column, MERGES).to_pylist() == whole[0]
    assert token_count.count_column(column, COUNTER)[1].tolist() == whole[1]


def test_proved_pieces_are_single_tokens():
    for piece in token_count.prove(PIECE_LIBRARY)[::500]:
        text = piece.decode()
        if text not in (" ", "▁"):
            assert len(PIECE_LIBRARY.encode(text[1:])) == 1


def test_plain_words():
    block = pretokens.text_block(pa.array(["a  b\n", "", None, " \t", "c a"]))
    w = pretokens.plain_words(block)
    values = w.distinct.take(pa.array(w.index)).to_pylist()
    assert values == [b"a", b"b", b"c", b"a"] and w.first.tolist() == [0, 2, 2, 2, 2, 4]


def test_odd_rows(spark, odd_documents, no_documents):
    rows = token_count.count_tokens(odd_documents, PIECES).collect()
    for r in rows:
        assert r.n_tokens == len(PIECE_LIBRARY.encode(r.text or ""))
        assert r.n_bytes == len((r.text or "").encode()) and r.score == 0.5
    both = bpe.decode(bpe.encode(odd_documents, RANKS), RANKS).collect()
    assert len(both) == 10
    for r in both:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert np.frombuffer(r.ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(r.text or "")
    assert token_count.count_tokens(no_documents, PIECES).count() == 0
    assert bpe.decode(bpe.encode(no_documents, RANKS), RANKS).count() == 0
    once = bpe.round_trip(odd_documents, RANKS)
    assert once.columns == [c for c in bpe.decode(bpe.encode(odd_documents, RANKS), RANKS).columns if c != "text"]
    assert sorted(map(str, once.collect())) == sorted(
        map(str, bpe.decode(bpe.encode(odd_documents, RANKS), RANKS).drop("text").collect()))
    assert bpe.round_trip(no_documents, RANKS).count() == 0


def test_op1_query(spark):
    got = {r.doc_id: r for r in queries.op1_token_count(spark, SF001).collect()}
    rows = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(PIECE_LIBRARY.encode(r.text))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (n, n > 4096)


def test_op6_query(spark):
    import hashlib

    got = {r.doc_id: r for r in queries.op6_byte_bpe(spark, SF001).collect()}
    for r in spark.read.parquet(f"{SF001}/documents.parquet").collect():
        ids = TIKTOKEN.encode_ordinary(r.text)
        mine = got[r.doc_id]
        assert mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_packing_round_trip(bits, values):
    ids = np.array([v % (1 << bits) for v in values], np.uint32)
    data = packing.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert packing.unpack(data, bits, len(ids)).tolist() == ids.tolist()


def test_shard_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_IDS", 64)
    rng = np.random.default_rng(0)
    for bits in (11, 16):
        docs = [rng.integers(0, 1 << bits, n) for n in (0, 1, 63, 64, 65, 500, 0, 7)]
        writer = packing.ShardWriter(str(tmp_path), f"s{bits}", bits)
        for k, ids in enumerate(docs):
            writer.add(None if k == 3 else k, ids.astype(np.int32))
        assert writer.close() == (f"s{bits}", 8, sum(map(len, docs)))
        shard = packing.ShardReader(str(tmp_path), f"s{bits}")
        for k in (5, 0, 7, 2, 3, 4, 1, 6):
            assert shard.document(k).tolist() == docs[k].tolist()
        assert shard.has_id.tolist() == [True] * 3 + [False] + [True] * 4
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s11", "s16"]


def expected_files(rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), packing.crc32(ids)))
        start += len(ids)
    return out


def test_op10_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = queries.op10_token_files(spark, SF001).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected_files(rows)


def test_token_files_of_odd_rows(spark, odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 3)
    folder = scratch_path(spark, "odd-files")
    table = packing.write_tokens(odd_documents, JSON, folder, 2)
    assert table.count() > 1
    got = packing.read_tokens(spark, folder).withColumn("c", F.crc32("ids")).orderBy("start").collect()
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert [(r.doc_id, r.start, r.n_tokens, r.c) for r in got] == expected_files(rows)
    folder = scratch_path(spark, "no-files")
    assert packing.write_tokens(no_documents, JSON, folder, 2).count() == 0
    assert packing.read_tokens(spark, folder).count() == 0


def test_token_files_of_hot_ids(spark, monkeypatch):
    """A third of all rows without an id, a third with one id (most of them of
    one text): every shard stays small, and ids ascend over the shards."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 5)
    big = (1 << 63) - 1
    rows = [(None, f"text {i % 40}") for i in range(90)]
    rows += [(7, "one text" if i % 3 else f"other {i}") for i in range(90)]
    rows += [(i, "own text") for i in range(-40, 40)] + [(big, f"last {i}") for i in range(30)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = scratch_path(spark, "hot-files")
    table = packing.write_tokens(docs, JSON, folder, 2).collect()
    assert max(r.documents for r in table) <= 30 and sum(r.documents for r in table) == len(rows)
    got = packing.read_tokens(spark, folder).withColumn("c", F.crc32("ids")).orderBy("start").collect()
    want = expected_files(rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.c) for r in got) == sorted(
        (i is not None, i or 0, n, c) for i, _, n, c in want)
    assert [r.doc_id for r in got] == [i for i, *_ in want]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    again = scratch_path(spark, "hot-files")
    packing.write_tokens(docs.repartition(5), JSON, again, 2)
    same = packing.read_tokens(spark, again).withColumn("c", F.crc32("ids")).orderBy("start").collect()
    assert [tuple(r) for r in same] == [tuple(r) for r in got]

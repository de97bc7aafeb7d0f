"""Operators 7 to 10: token counts, pieces, packing. Held to the libraries and to exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import SF, clashing, frame
from tokenizers import Tokenizer

from vitalis.llm.matrices import (
    PAD_ID, ROW, best_fit_decreasing, op10_token_matrices, pack_matrices, position_ids, positions as places, write_packed,
)
from vitalis.llm.packing import END_ID, WINDOW, Shard, op9_retrieval_packing, pack_by_retrieval, pack_shard
from vitalis.llm.pieces import MODEL, PieceEncoder, decode_pieces, encode_pieces, op7_sentencepiece
from vitalis.llm.tokenids import IdEncoder
from vitalis.llm.tokens import TokenCounter, count_tokens, op8_token_counts, run_transducer, vocabulary_path

EDGES = ["", "   ", "'s", "it's", "'re 're're", "they'RE 'r 'v 'll 'l 'lx 've", "''s", "!'s", "a'", "a'r", "'r", "'d've",
         "<|endoftext|>a<|startoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext", "123 4a5",
         "é é İstanbul ΑΣ Σ ß ẞ ǅ", " x  y　z\u0085", "日本語テスト 한국어 😀👍🏽", "x" * 700, "!" * 300,
         "²½Ⅷ ⅷ ⓐⒶ", "\x00\x01", "▁a ▁ b", "\n\n a\t b", "a  b   c    d", "don't'll" * 40]


def mixed(seed, alphabet, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


TEXTS = EDGES + mixed(1, "ab'srtvelmd ,.!19éß́\n<|endoftext|>Σ") + mixed(2, "abtheinr  ▁.\n9éß😀")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary_path())
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_and_ids_equal_the_library(library, documents):
    texts = TEXTS + list(documents.values())
    expected = library(texts)
    assert TokenCounter(vocabulary_path())(texts).tolist() == [len(e) for e in expected]
    ids, offs = IdEncoder(vocabulary_path())(texts)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == expected


def test_prefix_scan_equals_a_sequential_run():
    from vitalis.llm.tokens import BEFORE, CLASSES, GAP, HERE, word_transducer

    move, emit = word_transducer()
    classes = np.random.default_rng(0).integers(0, CLASSES, 5000).astype(np.uint8)
    classes[-1] = 0
    state, starts = GAP, np.zeros(len(classes), bool)
    for i, c in enumerate(classes):
        e = emit[state * CLASSES + c]
        starts[i] |= bool(e & HERE)
        if e & BEFORE:
            starts[i - 1] = True
        state = move[state * CLASSES + c]
    assert (run_transducer(classes) == starts).all()


def test_op8_query(spark, documents, library):
    expected = dict(zip(documents, library(list(documents.values())), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op8_token_counts(spark, SF).collect()} == {
        i: (len(documents[i].encode()), len(e), len(e) > 2048) for i, e in expected.items()}


def test_op8_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 30_000)]
    got = count_tokens(clashing(frame(spark, rows)))
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.key) for r in got.collect()), key=str) == sorted(
        [(1, 0, 0, False, "x"), (2, 0, 0, False, "x"), (2, 0, 0, False, "x"), (None, 3, 2, False, "x"),
         (3, 150_000, 30_000, True, "x")], key=str)
    assert count_tokens(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        count_tokens(frame(spark, []).withColumnRenamed("lang", "n_tokens"))


def test_pieces_equal_the_library_both_ways(documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    texts = TEXTS + list(documents.values())
    encoder = PieceEncoder(public_tokenizers.path(MODEL))
    ids, offs = encoder.encode(texts)
    expected = sp.encode(texts, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == expected
    assert [t.decode() for t in encoder.decode(ids.astype(np.int64), offs)] == [sp.decode(e) for e in expected]


def test_op7_query_and_edges(spark, documents):
    got = {r.doc_id: r for r in op7_sentencepiece(spark, SF).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    for i, t in documents.items():
        ids = np.array(sp.encode(t), "<u4")
        assert (got[i].n_pieces, got[i].ids_crc32, got[i].round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)
    rows = [(1, None), (2, ""), (None, " a"), (3, "a b"), (3, "a b")]
    there = encode_pieces(clashing(frame(spark, rows)))
    back = decode_pieces(there).select("doc_id", "text", "decoded", "key").collect()
    assert [(r.doc_id, r.decoded, r.key) for r in back] == [(i, t or "", "x") for i, t in rows]
    assert decode_pieces(encode_pieces(frame(spark, []))).collect() == []


def check_pieces(rows, expected):
    """Every id of every document in exactly one piece, sequences gapless; padding in ids."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(expected)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(expected[i]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(expected[i][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(expected[i])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= WINDOW
        padding += 0 if at & (at - 1) == 0 else WINDOW - at
    return padding


def test_op9_query(spark, documents, library):
    expected = {i: [*e, END_ID] for i, e in zip(documents, library(list(documents.values())), strict=True)}
    assert check_pieces(op9_retrieval_packing(spark, SF).collect(), expected) == 0


def test_op9_puts_lexical_neighbours_together():
    rng = np.random.default_rng(0)
    docs = [np.append(rng.integers(100 * (k % 4) + 10, 100 * (k % 4) + 60, 500), END_ID).astype(np.uint16)
            for k in range(40)]
    idf = np.ones(500)
    windows = {}
    for doc, _, _, sequence, _ in pack_shard(docs, idf):
        windows.setdefault(sequence, set()).add(doc % 4)
    assert np.mean([len(w) for w in windows.values()]) < 1.5


def test_op9_edges(spark):
    rows = [(1, None), (2, ""), (3, "the cat"), (4, "the cat " * 5000), (None, "a")]
    got = pack_by_retrieval(clashing(frame(spark, rows))).collect()
    assert check_pieces(got, {i: [*Tokenizer.from_file(vocabulary_path()).encode(t or "", add_special_tokens=False).ids,
                                  END_ID] for i, t in rows}) == 0
    assert sum(r.length for r in pack_by_retrieval(frame(spark, [(7, "a b")] * 3)).collect()) == 9
    assert pack_by_retrieval(frame(spark, [])).collect() == []


def test_op9_asks_for_all_terms_of_a_seed():
    """Against BM25 over every common term; the seed's heaviest terms are its own."""
    idf = np.ones(300)
    idf[:100] = 10.0
    docs = [np.append(np.arange(30), np.arange(100, 140)), np.arange(130, 200), np.arange(110, 150), np.arange(200, 260)]
    shard = Shard([d.astype(np.uint16) for d in docs], idf)
    shard.used[0] = True
    assert shard.neighbours(0).tolist() == [2, 1]


def test_op9_table_without_any_term(spark):
    got = pack_by_retrieval(frame(spark, [(1, None), (2, ""), (3, "")])).collect()
    assert check_pieces(got, {i: [END_ID] for i in (1, 2, 3)}) == 0


def test_best_fit_equals_the_naive_search():
    rng = random.Random(0)
    for _ in range(100):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 60))]
        rooms = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [x for x in rooms if x >= sizes[i]]
            room = min(fit) if fit else 50
            if fit:
                rooms.remove(room)
            rooms.append(room - sizes[i])
        rows = best_fit_decreasing(sizes, 50)
        assert sorted(50 - sum(sizes[i] for i in r) for r in rows) == sorted(rooms)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))


def check_matrices(rows, expected):
    seen = {i: np.zeros(len(e), int) for i, e in expected.items()}
    for r in rows:
        ids = np.frombuffer(r.ids, np.uint16)
        assert len(ids) == ROW and (ids[r.n_tokens:] == PAD_ID).all() and r.cu_seqlens[-1] == r.n_tokens <= ROW
        for i, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert ids[a:b].tolist() == expected[i][s:s + b - a]
            seen[i][s:s + b - a] += 1
        positions = position_ids(np.array(r.cu_seqlens))
        assert (places(r.resets, ROW) == positions).all()
        assert all((positions[a:b] == np.arange(b - a)).all() for a, b in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:],
                                                                               strict=True))
    assert all((s == 1).all() for s in seen.values())


def test_op10_files_and_query(spark, documents, library, tmp_path):
    expected = {i: [*e, END_ID] for i, e in zip(documents, library(list(documents.values())), strict=True)}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = write_packed(docs, str(tmp_path / "packed")).collect()
    check_matrices(rows, expected)
    got = {r.sequence_id: r for r in op10_token_matrices(spark, SF).collect()}
    for r in rows:
        q = got[r.sequence_id]
        assert (q.n_tokens, q.cu_seqlens, q.doc_ids, q.starts) == (r.n_tokens, r.cu_seqlens, r.doc_ids, r.starts)
        assert q.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, np.uint16)[:r.n_tokens].astype("<u4").tobytes())


def test_op10_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "the cat"), (4, "the cat " * 5000), (None, "a")]
    check_matrices(pack_matrices(clashing(frame(spark, rows))).collect(),
                   {i: [*e, END_ID] for (i, _), e in zip(rows, library([t or "" for _, t in rows]), strict=True)})
    assert sum(r.n_tokens for r in pack_matrices(frame(spark, [(7, "a b")] * 3)).collect()) == 9
    assert pack_matrices(frame(spark, [])).collect() == []

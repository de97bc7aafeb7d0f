"""Operator 1 against brute force."""

import hashlib
import random

from conftest_llm import SF, clashing, cut_words, frame, words

from vitalis.llm.substrings import COVER, PERIOD, WINDOW, ANCHOR, dedup_substrings, op1_substring_dedup


def test_cover_aligns_any_two_positions():
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER for d in range(PERIOD))
    assert ANCHOR + PERIOD - 1 == WINDOW


def expect(docs):
    out = {}
    for (i, t), (w, gone) in cut_words(docs).items():
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, len(w)] = (sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_query(spark, documents):
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, SF).collect()}
    assert got == expect(list(documents.items()))
    assert any(n for n, _ in got.values())


def test_shared_passages_at_every_alignment(spark):
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(30)]
    docs = []
    for i in range(60):
        own = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(40))]
        part = passage[rng.randrange(10):rng.randrange(14, 31)]
        docs.append((i * 3, " ".join(own[:i % 17] + part + own[i % 17:])))
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_sha256) for r in dedup_substrings(frame(spark, docs)).collect()}
    assert got == expect(docs)


def test_edges(spark):
    long = " ".join(f"t{k}" for k in range(3000))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "a b c"), (5, long), (6, long), (6, long), (None, long),
            (None, None), (7, "é " * 13), (8, "é " * 14 + "\n end"), (9, "é" + "é " * 30)]
    got = dedup_substrings(clashing(frame(spark, rows)), n_words="w", n_removed="r", kept_sha256="h").collect()
    assert len(got) == len(rows) and got[0]["key"] == "x"
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.text, r.w, r.r))
    assert by[1] == [(None, 0, 0)] and by[2] == [("", 0, 0)] and by[4] == [("a b c", 3, 0)]
    assert by[5] == [(long, 3000, 0)] and by[6] == [("", 3000, 3000)] * 2
    assert sorted(by[None], key=str) == [("", 3000, 3000), (None, 0, 0)]
    assert by[8] == [("end", 15, 14)]
    assert words(by[9][0][0])[0] == "éé" and by[9][0][2] == 29


def test_empty_table_and_clash(spark):
    empty = frame(spark, [])
    assert dedup_substrings(empty).collect() == []
    try:
        dedup_substrings(empty, n_words="lang")
    except ValueError:
        return
    raise AssertionError("a clash must be refused")

"""Operators 5 and 2, and the pipeline: held-out quality, decoding, brute force."""

import collections
import hashlib
import math

import numpy as np
import pytest
from conftest_llm import SF, clashing, cut_words, frame, near_groups
from test_lines import expect as lines_expected

import corpus_pipeline
from vitalis.llm.fingerprints import (
    FEATURE, SCALE, as_text, compare_with_edits, digests, entropy_classes, fingerprint_documents, from_text, likeness,
    op2_improbable_features, rarity,
)
from vitalis.llm.toxicity import (
    CUTOFF, SYMBOLS, fit_character_model, fit_toxicity, held_out, op5_toxicity, restore, score_toxicity, training_rows,
    viterbi, _readings,
)

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    return fit_toxicity(docs, training_rows(docs, spark.read.parquet(f"{BIG}/labels.parquet")))


def test_held_out_quality(spark, fitted):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "toxic")
    rows = score_toxicity(docs, fitted, keep=["doc_id"]).where(held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    hit = sum(r.score >= CUTOFF and r.toxic == 1 for r in rows)
    said, real = sum(r.score >= CUTOFF for r in rows), sum(r.toxic == 1 for r in rows)
    assert len(rows) > 500 and hit / said > 0.9 and hit / real > 0.7


def test_disguises_are_read(fitted):
    for word, read in ((b"1d10t", b"idiot"), (b"i d i o t", b"idiot"), (b"m0r0n", b"moron"), (b"stuuuupid", b"stupid"),
                       (b"tr4sh", b"trash"), (b"p@thetic", b"pathetic"), (b"l.o.s.e.r", b"loser"), (b"CL0WN", b"clown")):
        text = np.frombuffer(b"the " + word + b" of that, " + word, np.uint8)
        out, offs = restore(text, np.array([0, len(text)]), fitted["lm"])
        if word != b"1d10t":
            assert out.tobytes() == b"the " + read + b" of that, " + read, word
        assert offs[-1] == len(out)


def read(text, model):
    text = np.frombuffer(text, np.uint8)
    out, offs = restore(text, np.array([0, len(text)]), model)
    assert offs[-1] == len(out)
    return out.tobytes()


def test_every_kind_of_disguise_is_read(fitted):
    """Signs at either end, digits and signs in spaced runs, and spans of any length; numbers stay."""
    for word, meant in ((b"1d10t", b"idiot"), (b"1 d 1 0 t", b"idiot"), (b"$tupid", b"stupid"), (b"!diot", b"idiot"),
                        (b"idi0+", b"idiot"), (b"i d i 0 +", b"idiot"), (b"$ t u p ! d", b"stupid")):
        assert read(b"the " + word + b" of that", fitted["lm"]) == b"the " + meant + b" of that", word
    assert read(b"the @sshole of that", fitted["lm"]).startswith(b"the a")
    spaced = read(b"the " + b" ".join([b"s t u p 1 d"] * 17)[:199] + b" of", fitted["lm"])  # 100 letters and digits
    assert spaced.count(b"stupid") == 16
    assert read(b"xx" + b"-stup1d" * 100, fitted["lm"]).count(b"stupid") == 100
    assert read(b"st" + b"u" * 500 + b"p1d", fitted["lm"]) == b"stupid"
    for text in (b"in 2024 or 3.14 and 10-20", b"call 555-7713 (017) or 1 2 3 4"):
        assert read(text, fitted["lm"]) == text


def test_readings_are_those_of_the_model(fitted):
    """A worker that has read under one table's model reads anew under another's."""
    flat = np.full_like(fitted["lm"], -math.log(SYMBOLS))
    # a model that has seen one pair of letters only: a sign with two readings is read as the letter of that pair
    slanted = [np.full_like(fitted["lm"], -9.0) for _ in range(2)]
    for model, letter in zip(slanted, b"il", strict=True):
        model[:, :, letter - 96] = -0.1
    spans = np.frombuffer(b"1d10tm0r1n", np.uint8).reshape(2, 5)
    readings = []
    for model in (*slanted, flat, fitted["lm"], slanted[0]):
        readings.append(viterbi(spans, model))
        assert read(b"1d10t m0r1n", model) == b" ".join(readings[-1])
    assert readings[0] != readings[1] and readings[0] == readings[-1]


def test_disguised_documents_are_toxic(spark, fitted):
    texts = [(1, "you $tupid one"), (2, "you 1 d 1 0 t"), (3, "you !diot"), (4, "you " + "-stup1d" * 40)]
    assert all(r.score > CUTOFF for r in score_toxicity(frame(spark, texts), fitted).collect())


def test_clean_text_is_left_alone(fitted, documents):
    texts = [t.lower().encode() for t in documents.values() if t.replace(" ", "").replace("\n", "").isalpha()]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    out, _ = restore(buf, offs, fitted["lm"])
    assert len(out) >= 0.999 * len(buf)


def test_viterbi_finds_the_best_path():
    """Against all readings of short spans."""
    rng = np.random.default_rng(0)
    model = np.log(rng.dirichlet(np.ones(SYMBOLS), (SYMBOLS, SYMBOLS))).astype(np.float32)
    emit, cost, _, drop = _readings()
    for span in (b"a1a", b"00b", b"aab.", b"1$x"):
        best = (-math.inf, None)

        def walk(i, p, c, score, text):
            nonlocal best
            if i == len(span):
                best = max(best, (score + float(model[p, c, 0]), text))
                return
            byte = span[i]
            lost = drop[byte]
            if emit[byte, 0] > 0 and emit[byte, 0] == c:
                lost = max(lost, math.log(0.3))
            if lost > -math.inf:
                walk(i + 1, p, c, score + float(lost), text)
            for k in range(3):
                if emit[byte, k] >= 0:
                    e = int(emit[byte, k])
                    walk(i + 1, c, e, score + float(cost[byte, k]) + float(model[p, c, e]),
                         text + (bytes([byte]) if e == emit[byte, 0] else bytes([96 + e])))

        walk(0, 0, 0, 0.0, b"")
        assert viterbi(np.frombuffer(span, np.uint8)[None, :], model)[0] == best[1]


def test_op5_query_and_edges(spark, fitted):
    rows = op5_toxicity(spark, SF).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    texts = [(1, None), (2, ""), (2, ""), (None, "you idiot"), (3, "of the " * 20_000), (4, "y0u 1 d 1 0 t")]
    got = score_toxicity(clashing(frame(spark, texts)), fitted).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.score)
    assert len(got) == 6 and got[0]["n"] == "x" and by[1] == by[2] and len(by[2]) == 1
    assert min(by[None]) > CUTOFF > max(by[3])
    assert score_toxicity(frame(spark, []), fitted).collect() == []
    bare = fit_toxicity(frame(spark, []), spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert score_toxicity(frame(spark, [(1, "a")]), bare).first().score == pytest.approx(0.5)
    assert fit_character_model(frame(spark, [(1, None)])).shape == (SYMBOLS,) * 3


def test_entropy_classes():
    rng = np.random.default_rng(0)
    x = rng.integers(97, 110, 140_000).astype(np.uint8)
    got = entropy_classes(x)
    for i in [0, 1, 500, *range(131_000, 131_100), len(got) - 1]:
        s = sum(int(np.rint(c * math.log2(c) * SCALE)) for c in collections.Counter(x[i:i + FEATURE].tolist()).values())
        assert got[i] == 1000 - s * 1000 // (SCALE * FEATURE * 6)


def test_fingerprints_do_not_depend_on_the_batch(spark, documents):
    rank = rarity(frame(spark, documents.items()))
    texts = [t.encode() for t in [*documents.values(), "", "short", "x" * 500]]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    together = digests(np.frombuffer(b"".join(texts), np.uint8), offs, rank)
    for t, chain in zip(texts, together, strict=True):
        alone = digests(np.frombuffer(t, np.uint8), np.array([0, len(t)]), rank)[0]
        assert (alone == chain).all() and (from_text(as_text(chain)) == chain).all()
        assert likeness(chain, chain) == 1.0
    assert likeness(together[0], together[-3]) == 0.0


def test_op2_query(spark, documents):
    got = {r.doc_id: r for r in op2_improbable_features(spark, SF).collect()}
    ids = sorted(documents)
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n = documents[i], documents[after]
        edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_next == pytest.approx(likeness(from_text(got[i].fingerprint), from_text(got[after].fingerprint)))
        assert got[i].near_edited == pytest.approx(
            likeness(from_text(got[i].fingerprint), from_text(got[i].edited_fingerprint)))
    assert np.mean([r.near_edited for r in got.values()]) > 5 * np.mean([r.near_next for r in got.values()])


def test_op2_edges(spark):
    rows = [(2, ""), (1, None), (5, "é" * 7), (None, "first"), (9, "x" * 70_000), (9, "x" * 70_000), (7, "ab")]
    got = sorted((r for r in compare_with_edits(clashing(frame(spark, rows))).collect()), key=lambda r: (
        r.doc_id is not None, r.doc_id or 0))
    order = [(None, "first"), (1, ""), (2, ""), (5, "é" * 7), (7, "ab"), (9, "x" * 70_000), (9, "x" * 70_000)]
    for r, (i, t), (_, n) in zip(got, order, [*order[1:], order[0]], strict=True):
        edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        if i != 9:
            assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert got[1].near_next == 1.0 and got[0].near_next == 0.0 and got[5].fingerprint == got[6].fingerprint
    assert compare_with_edits(frame(spark, [])).collect() == []
    rank = rarity(frame(spark, rows))
    assert fingerprint_documents(clashing(frame(spark, rows)), rank).where("fingerprint is null").isEmpty()


def test_pipeline_stages_against_brute_force(spark):
    """Every stage on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    all_docs = {r.doc_id: r.text for r in docs.collect()}

    one = stages[0](spark, docs, SF).cache()
    scores = {r.doc_id: r.score for r in op5_toxicity(spark, SF).collect()}
    assert one.columns == columns
    kept = {r.doc_id: r.text for r in one.collect()}
    assert kept == {i: t for i, t in all_docs.items() if scores[i] < CUTOFF}

    two = stages[1](spark, one, SF).cache()
    kept = {i: e[3] for i, e in lines_expected(kept).items()}
    assert two.columns == columns and {r.doc_id: (r.text, r.n_chars) for r in two.collect()} == {
        i: (t, len(t)) for i, t in kept.items()}

    three = stages[2](spark, two, SF).cache()
    _, groups = near_groups(kept)
    kept = {i: t for i, t in kept.items() if groups.find(i) == i}
    assert three.columns == columns and {r.doc_id: r.text for r in three.collect()} == kept

    four = stages[3](spark, three, SF).cache()
    cut = cut_words(list(kept.items()))
    assert four.columns == columns
    for r in four.collect():
        w, gone = cut[r.doc_id, kept[r.doc_id]]
        assert r.text.split() == [x for x, g in zip(w, gone, strict=True) if not g] and r.n_chars == len(r.text)
        assert r.text == kept[r.doc_id] or any(gone)
    final = {r.doc_id: r.text for r in four.collect()}
    pieces = stages[4](spark, four, SF).collect()
    assert {p.doc_id for p in pieces} == set(final)


def test_pipeline_runs_and_takes_an_empty_table(spark, documents):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []

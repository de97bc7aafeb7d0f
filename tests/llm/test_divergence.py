"""Operator 12 against brute force in plain integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from conftest_llm import A_TO_Z, SF, clashing

from vitalis.llm import divergence
from vitalis.llm.divergence import audit_sources, op12_source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def expect(rows, min_docs=10, top=10):
    """rows: (text, lang, source) -> set of result rows."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(A_TO_Z) for t in TERM.findall(text or "")]
        groups[lang].add(source)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()

    def ranked(lang, source, part, pairs):
        for k, (item, value) in enumerate(sorted(pairs, key=lambda x: (-x[1], x[0].encode())), 1):
            if part == "pair" or k <= top:
                out.add((lang, source, part, item, value, k))

    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = sum((count[lang, s] for s in sources), Counter())

        def p(counter, kept=kept):
            n = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q = p(whole)
        by = {s: p(count[lang, s]) for s in sources}
        for s in sources:
            ranked(lang, s, "pair", [(o, sum((by[s][t] - by[o][t]) ** 2 // (by[s][t] + by[o][t]) for t in kept))
                                     for o in sources if o != s])
            ranked(lang, s, "term", [(t, (by[s][t] - q[t]) ** 2 // (by[s][t] + q[t])) for t in kept
                                     if count[lang, s][t] and by[s][t] > q[t]])
    return out


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def table(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)


def made_up(seed=4, n=240, sources=9):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gämma", "δέλτα", "ε", "zeta", "eta", "theta", "iota", "kappa", "la", "mu", "no"]
    rows = []
    for _ in range(n):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(sources)}"
        text = " ".join(rng.choice(words) + rng.choice(["", ",", "1", "-x", "\n"]) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(["en", "de", None]), source))
    return rows


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert result(op12_source_divergence(spark, SF)) == expect(rows)


def test_collisions_are_split(spark):
    """With digests of a few bits nearly all terms share one; the result is the same."""
    rows = made_up()
    for bits in (64, 5, 2, 1):
        assert result(audit_sources(table(spark, rows), bits=bits)) == expect(rows), bits
    assert result(audit_sources(table(spark, rows), min_docs=60, top=2, bits=3)) == expect(rows, 60, 2)


@pytest.mark.parametrize("name, size", [("SOURCES", 3), ("SLICE_ROWS", 7), ("TERMS", 2)])
def test_blocks_slices_and_matrices_of_any_size(spark, monkeypatch, name, size):
    rows = made_up(seed=9)
    monkeypatch.setattr(divergence, name, size)
    assert result(audit_sources(table(spark, rows))) == expect(rows)


def test_digests_alone_are_counted(spark):
    """No exchange of the counting carries a string beside the group's names."""
    docs = table(spark, made_up()).select("lang", "source", "text")
    counted = docs.mapInArrow(divergence._count(64), "lang string, source string, digest long, n long, docs long")
    assert [f.name for f in counted.schema if f.dataType.simpleString() == "string"] == ["lang", "source"]


def test_edges(spark):
    long = "word " * 200_000 + "tail"
    rows = [(None, None, None), ("", "en", "a"), ("", "en", "b"), (None, "en", None), ("1 2 3", "fr", "x"), (long, "de", "p"),
            *[("Word ONE two", "de", "p")] * 12, *[("word three", "de", "q")] * 3, ("word", None, "")]
    assert result(audit_sources(clashing(table(spark, rows)))) == expect(rows)
    assert result(audit_sources(table(spark, []))) == set()
    assert result(audit_sources(table(spark, [(None, None, None)]))) == set()
    assert result(audit_sources(table(spark, [("a", "en", "s")] * 3 + [("b c", "en", "t")] * 3), min_docs=1, top=1)) == \
        expect([("a", "en", "s")] * 3 + [("b c", "en", "t")] * 3, 1, 1)

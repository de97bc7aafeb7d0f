"""Operator 13 against brute force."""

import random
import re
import zlib

from conftest_llm import A_TO_Z, SF, clashing, frame

from vitalis.llm import spelling
from vitalis.llm.spelling import group_variants, op13_spelling_variants, spelling_variants, word_counts

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def count_words(docs, min_chars=7, min_count=2, slip=31):
    out = {}
    for i, t in docs:
        for run in RUN.findall(t or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_chars:
                out[run] = out.get(run, 0) + 1
    return {w: n for w, n in out.items() if n >= min_count}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def expect(counts, ratio=10):
    forms, out = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [forms[w], None, n, len(others), counts.get(forms[w])]
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def as_dict(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_query(spark, documents):
    counts = count_words(documents.items())
    got = as_dict(op13_spelling_variants(spark, SF))
    assert {w: v[2] for w, v in got.items()} == counts
    by = {}
    for w in counts:  # near words agree once a character is taken from one of them or from both
        for key in {w} | {w[:k] + w[k + 1:] for k in range(len(w))}:
            by.setdefault(key, []).append(w)
    found = {w: set() for w in counts}
    for group in by.values():
        for k, a in enumerate(group):
            for b in group[k + 1:]:
                if near(a, b):
                    found[a].add(b)
                    found[b].add(a)
    assert {w: v[3] for w, v in got.items()} == {w: len(x) for w, x in found.items()}
    for w, v in got.items():
        best = min(found[w], key=lambda x: (-counts[x], x), default=None)
        assert v[0] == (best if best and counts[best] >= 10 * counts[w] else None)


def word_table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_dense_words_and_long_prefixes(spark):
    """Runs of equal letters, every edit, chains of forms; the same when most prefixes go as digests."""
    rng = random.Random(3)
    counts = {}
    for _ in range(250):
        counts["".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))] = rng.choice([2, 2, 3, 20, 25, 400, 5000])
    table = word_table(spark, counts)
    assert as_dict(group_variants(table)) == expect(counts)
    for long in (0, 1, 3, 4):
        assert as_dict(group_variants(table, long=long)) == expect(counts)


def test_chain(spark):
    counts = {"letters": 2, "lettersx": 20, "lettersxy": 200, "lettersxyz": 2000, "lettersxyzz": 20_000, "alone": 9}
    got = as_dict(group_variants(word_table(spark, counts)))
    assert got == expect(counts) and got["letters"][:2] == ("lettersx", "lettersxyzz") and got["alone"][1] == "alone"


def test_large_group(spark):
    """A word with hundreds of variants; no range of rotations holds more than one word a letter."""
    base = "verylikelyspelled"
    variants = {base[:k] + c + base[k + d:] for k in range(len(base)) for c in "abcdefghij" for d in (0, 1)}
    counts = {w: 2 for w in variants} | {base: 900}
    got = as_dict(group_variants(word_table(spark, counts)))
    assert got == expect(counts) and all(v[0] == base for w, v in got.items() if w != base)
    table = spelling.rotations(word_table(spark, counts))
    assert max(r["count"] for r in table.groupBy("prefix").count().collect()) <= 92


def test_edges(spark):
    giant = "".join(random.Random(1).choice("abcdefgh") for _ in range(100_000))
    texts = [(1, None), (2, ""), (None, "Somewhat somewhat ÀÉÎõüÿß ÀÉÎõüÿß x×y"), (3, "some-what short words"),
             (4, giant), (4, giant), (5, giant[:500] + giant[501:]), (6, giant[:500] + giant[501:]),
             (7, "wording " * 3), (7, "wording " * 3)]
    got = as_dict(spelling_variants(clashing(frame(spark, texts)), slip=1 << 40))
    assert got == expect(count_words(texts, slip=1 << 40))
    assert got[giant][3] == 1 and got["wording"][2] == 6
    slips = [(k, "lengthyword otherword") for k in range(400)]
    assert {r.word: r.n for r in word_counts(frame(spark, slips)).collect()} == count_words(slips)
    assert as_dict(spelling_variants(frame(spark, []))) == {}
    assert as_dict(group_variants(spark.createDataFrame([(None, 3), ("word", 2)], "word string, n long"))) == {
        "word": (None, "word", 2, 0, None)}

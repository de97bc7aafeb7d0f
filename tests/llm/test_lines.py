"""Operator 3 against brute force, and its plan."""

import hashlib
import random
import re

from conftest_llm import SF, clashing, frame
from pyspark.sql import functions as F

from vitalis.llm import lines
from vitalis.llm.layout import written
from vitalis.llm.lines import MIN_CHARS, NEAR_CHARS, banded_distance, dedup_lines, op3_line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, times):
    out = list(line)
    for _ in range(times):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = rng.choice("abcdé ")
        elif kind < 0.7:
            del out[at]
        else:
            out.insert(at, rng.choice("abcdé "))
    return "".join(out)


def expect(docs, edits=2):
    """{doc_id: (lines, equal, near, kept text)} of {doc_id: text}."""
    first = {}
    for i, t in sorted(docs.items()):
        for k, line in enumerate((t or "").split("\n")):
            if len(line) >= MIN_CHARS and line not in first:
                first[line] = i, k
    long = [x for x in first if len(x) >= NEAR_CHARS]
    by, near = {}, set()
    for x in long:
        by.setdefault(len(x), []).append(x)
    letters = {x: [x.count(c) for c in "enitasrohdlu"] for x in long}
    for x in long:
        for size in range(len(x) - edits, len(x) + 1):
            for y in by.get(size, ()):
                if x is not y and sum(abs(p - q) for p, q in zip(letters[x], letters[y], strict=True)) <= 2 * edits \
                        and distance(x, y) <= edits:
                    near.add(max(x, y, key=first.get))
    out = {}
    for i, t in docs.items():
        kept, equal, close = [], 0, 0
        for k, line in enumerate((t or "").split("\n")):
            if line in first and first[line] != (i, k):
                equal += 1
            elif line in near:
                close += 1
            else:
                kept.append(line)
        out[i] = (len((t or "").split("\n")), equal, close, "\n".join(kept))
    return out


def test_banded_distance(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randint(12, 80)))
        b = edited(rng, a, rng.randint(0, 4))
        if abs(len(a) - len(b)) <= 2:
            rows.append((a, b, distance(a, b)))
    for r in spark.createDataFrame(rows, "a string, b string, d int").select(
            "d", banded_distance(F.col("a"), F.col("b"), 2).alias("e")).collect():
        assert r.e == r.d if r.d <= 2 else r.e > 2


def test_query(spark, documents):
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.n_chars, r.kept_sha256)
           for r in op3_line_dedup(spark, SF).collect()}
    assert got == {i: (n, e, c, len(k), hashlib.sha256(k.encode()).hexdigest())
                   for i, (n, e, c, k) in expect(documents).items()}


def test_near_lines_of_every_shape(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(55, 130))) for _ in range(25)]
    docs = {}
    for i in range(80):
        docs[i] = "\n".join(edited(rng, rng.choice(bases), rng.choice([0, 1, 1, 2, 2, 3])) for _ in range(4))
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.text) for r in dedup_lines(frame(spark, docs.items())).collect()}
    assert got == expect(docs)


def test_near_lines_as_short_as_equal_ones(spark):
    rng = random.Random(5)
    bases = ["Thwhesnd, esator whshing and hewh."] + ["".join(rng.choice("abcdé ") for _ in range(n)) for n in range(20, 60)]
    docs = {0: "\n".join(bases), 1: "Thwhesnd esator whshing and hewh.", 2: bases[1][:18] + "zz"}
    docs |= {3 + k: edited(rng, x, 1 + k % 3) for k, x in enumerate(bases)}
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.text) for r in dedup_lines(frame(spark, docs.items())).collect()}
    assert got[1] == got[2] == (1, 0, 1, "")
    assert got == expect(docs)


def test_crowded_keys(spark):
    """Keys under which many lines are indexed are searched in rounds: same result for any bound, linear on copies."""
    rng = random.Random(11)
    bases = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 60))) for _ in range(3)]
    docs = {i: "\n".join(edited(rng, rng.choice(bases), rng.choice([0, 1, 1, 2, 2, 3])) for _ in range(4)) for i in range(60)}
    for crowd in (0, 1, 5):
        got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.text)
               for r in dedup_lines(frame(spark, docs.items()), crowd=crowd).collect()}
        assert got == expect(docs), crowd


def test_a_large_group_of_near_copies(spark):
    base = "a passage that thousands of pages carry, each with a number of its own at the end: "
    docs = [(i, f"{base}{i % 10}{chr(97 + i % 7)}{chr(97 + i // 200)}xx") for i in range(5000)]
    got = {r.doc_id: (r.n_equal, r.n_near, r.text) for r in dedup_lines(frame(spark, docs)).collect()}
    seen, want = {}, {}
    for i, t in docs:  # lines differ in three single characters
        near = any(sum(x != y for x, y in zip(t, u, strict=True)) <= 2 for u in seen)
        want[i] = (1, 0, "") if t in seen else (0, 1, "") if near else (0, 0, t)
        seen.setdefault(t, i)
    assert got == want


def test_entries_are_exchanged_once(spark, monkeypatch):
    """Index and probes read one shuffle of the entries."""
    plans = []
    monkeypatch.setattr(lines, "written", lambda df, label: (plans.append((label, df)), written(df, label))[1])
    text = "a line that is long enough to be compared with others"
    dedup_lines(frame(spark, [(1, text), (2, text + "!"), (3, text[:-2])]))
    found = dict(plans)["line-pairs"]
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 200_000  # no bitmap is written out in it
    assert re.search(r"ReusedExchange \[key#\d+L, indexed#\d+, h#\d+L, c#\d+\], Exchange hashpartitioning\(key", plan)


def test_edges(spark):
    line = "a line that is long enough to be compared with others by edit distance"
    rows = [(1, None), (2, ""), (3, line), (4, line), (4, line), (None, line + "!"), (5, f"short\n\nshort\n{line}.\n"),
            (6, "x" * 100_000 + "\n" + line), (7, "x" * 99_999 + "y"), (None, None)]
    got = sorted(((r.doc_id, r.text, r.l, r.e, r.c, r["rid"]) for r in dedup_lines(
        clashing(frame(spark, rows)), n_lines="l", n_equal="e", n_near="c").collect()), key=str)
    assert got == sorted([(1, None, 0, 0, 0, "x"), (2, "", 1, 0, 0, "x"), (3, line, 1, 0, 0, "x"),
                          (4, "", 1, 1, 0, "x"), (4, "", 1, 1, 0, "x"), (None, "", 1, 0, 1, "x"),
                          (5, "short\n\nshort\n", 5, 0, 1, "x"), (6, "x" * 100_000, 2, 1, 0, "x"),
                          (7, "", 1, 0, 1, "x"), (None, None, 0, 0, 0, "x")], key=str)
    assert dedup_lines(frame(spark, [])).collect() == []


def test_plan_has_no_python(spark):
    plan = dedup_lines(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

import math
import re

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def frame(spark, texts, schema=DOCS):
    """A documents table of (id, text) pairs."""
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in texts], schema)


def clashing(df):
    """The same table with more columns, named like working columns of the operators."""
    from pyspark.sql import functions as F

    for name in ("id", "key", "chunk", "cid", "bucket", "rid", "line", "words", "n", "comp", "at", "label_", "vec"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, size=5):
    w = words((text or "").translate(A_TO_Z))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


class Groups:
    """Union-find with the smallest member as the name."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_groups(docs, threshold=75):
    """Brute-force components of {id: text}."""
    sets = {k: shingle_set(t) for k, t in docs.items()}
    groups, ids = Groups(docs), sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                groups.join(a, b)
    return sets, groups


def cut_words(docs, window=13):
    """Brute-force operator 1 on [(id, text)]: {(id, text): (words, removed flags)}."""
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (math.inf if i is None else i):
                gone[k:k + window] = [True] * window
        out[i, t] = w, gone
    return out


@pytest.fixture(scope="session")
def documents():
    """{doc_id: text} of the smallest tables."""
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))

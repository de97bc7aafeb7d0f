"""Operator 5 - toxicity with noisy-channel deobfuscation.

1. A character language model (trigrams over a-z, "other letter" and "break")
   is counted over all texts.
2. Words that look disguised - a digit or sign that imitates a letter anywhere, a
   filler inside, a letter three times in a row - and three or more single
   letters, digits or signs in a row become lattices: each byte may stand for
   itself, for a letter it imitates, for a repetition or for a filler. Viterbi
   decoding, batched over spans of equal length, picks the likeliest reading;
   spans beyond ``WHOLE_SPAN`` bytes are read in overlapping pieces. All other
   bytes have only one reading, and so have numbers (no letter, mostly digits).
3. A logistic model over hashed byte 4-, 5- and 6-grams and words of the
   restored text gives the score. Its features are chosen by chi-square and its
   weights fitted on a bounded, hash-ordered sample of labelled rows
   (``MOST_LABELLED``); scoring covers every byte of every text.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.functions.columns import col
from vitalis.llm.layout import fresh_names
from vitalis.llm.textkit import blocks, lower_ascii, prefix_hash, span_hash, text_buffer, word_spans, worker_cache

MOST_LABELLED = 20_000
CUTOFF = 0.3
HASH_BITS = 22
SLICES = 32
FEATURES = 400
LEAST_DOCS = 5
GRAMS = (4, 5, 6)
SYMBOLS = 28  # 0 break, 1-26 a-z, 27 any other letter
# The letters that digits and signs imitate.
IMITATED = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "", "-": "", "_": "", ".": "",
}
# Channel model, log probabilities of what a writer does with an intended letter.
LITERAL_LETTER = math.log(0.97)
IMITATE = math.log(0.05)
LITERAL_SIGN = math.log(0.002)
LITERAL_IMITATOR = math.log(0.0002)  # a digit or sign that could be a letter, inside a span with letters
REPEAT = math.log(0.3)
FILLER = math.log(0.05)
SPACING = math.log(0.3)
# Longer spans are read in pieces of SPAN_CORE bytes with SPAN_LAP bytes more on both sides, which are read but not kept.
WHOLE_SPAN = 200
SPAN_CORE = 128
SPAN_LAP = 32


def _symbol_of_byte() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[97:123] = np.arange(1, 27)
    t[65:91] = np.arange(1, 27)
    t[128:] = 27
    return t


def _trigram_counts(batches):
    """One row per non-zero trigram of the task's texts (a break before and after each)."""
    table, counts = _symbol_of_byte(), np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        buf, offs = text_buffer(batch.column(0))
        for a, b in blocks(offs):
            s = table[buf[offs[a]:offs[b]]]
            at = np.repeat(offs[a:b + 1] - offs[a], 2)  # two breaks between documents
            s = np.insert(s, at, 0)
            counts += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["trigram", "n"])


def fit_character_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(c | a, b) over the whole table, add-half smoothed; 28^3 cells whatever the input's size."""
    rows = (df.select(col(text_col)).mapInArrow(_trigram_counts, "trigram long, n long")
            .groupBy("trigram").agg(F.sum("n").alias("n")).collect())
    counts = np.full(SYMBOLS**3, 0.5)
    for r in rows:
        counts[r["trigram"]] += r["n"]
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32)


def _readings() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: symbol and cost of up to three emissions, the letter each writes, cost of dropping it as filler."""
    own = _symbol_of_byte()
    emit = np.full((256, 3), -1, np.int64)
    cost = np.full((256, 3), -np.inf, np.float32)
    emit[:, 0] = own
    cost[:, 0] = np.where(own > 0, LITERAL_LETTER, LITERAL_SIGN)
    for c in b" \t\n":
        cost[c, 0] = LITERAL_LETTER
    drop = np.full(256, -np.inf, np.float32)
    for sign, letters in IMITATED.items():
        if letters:
            cost[ord(sign), 0] = LITERAL_IMITATOR
        for k, letter in enumerate(letters):
            emit[ord(sign), 1 + k] = ord(letter) - 96
            cost[ord(sign), 1 + k] = IMITATE - math.log(len(letters))
        if not letters:  # what imitates a letter is no filler: 1d10t is not "dot"
            drop[ord(sign)] = FILLER
    drop[32] = SPACING
    return emit, cost, own, drop


def decoded(spans: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes written, is one written?) at each byte of the likeliest reading of each row (equal length, lower case).

    The state is the last two symbols written; all rows advance together, one
    byte at a time.
    """
    emit, cost, _, drop = _readings()
    n, length = spans.shape
    score = np.full((n, SYMBOLS, SYMBOLS), -np.inf, np.float32)
    score[:, 0, 0] = 0
    came = np.empty((length, n, SYMBOLS, SYMBOLS), np.int8)  # the symbol two before, or -1: nothing written
    rows = np.arange(n)
    for i in range(length):
        byte = spans[:, i]
        # dropped: a filler, or a repetition of the letter written last
        lost = np.repeat(drop[byte][:, None], SYMBOLS, axis=1)
        letter = emit[byte, 0]
        again = letter > 0
        lost[rows[again], letter[again]] = np.maximum(lost[rows[again], letter[again]], REPEAT)
        new = score + lost[:, None, :]
        back = np.full((n, SYMBOLS, SYMBOLS), -1, np.int8)
        for k in range(3):
            c = emit[byte, k]
            live = np.flatnonzero(c >= 0)
            if not len(live):
                continue
            c = c[live]
            steps = score[live] + model[:, :, c].transpose(2, 0, 1)
            best = steps.max(axis=1) + cost[byte[live], k][:, None]
            frm = steps.argmax(axis=1)
            better = best > new[live, :, c]
            r, p = np.nonzero(better)
            new[live[r], p, c[r]] = best[r, p]
            back[live[r], p, c[r]] = frm[r, p]
        score, came[i] = new, back
    p, c = np.divmod((score + model[:, :, 0]).reshape(n, -1).argmax(axis=1), SYMBOLS)
    text, kept = np.zeros((n, length), np.uint8), np.zeros((n, length), bool)
    for i in range(length - 1, -1, -1):
        before, byte = came[i, rows, p, c].astype(np.int64), spans[:, i]
        kept[:, i] = wrote = before >= 0
        text[:, i] = np.where(emit[byte, 0] == c, byte, 96 + c)
        p, c = np.where(wrote, before, p), np.where(wrote, p, c)
    return text, kept


def viterbi(spans: np.ndarray, model: np.ndarray) -> list[bytes]:
    """The likeliest reading of each row of ``spans`` (bytes of equal length, lower case)."""
    return [t[k].tobytes() for t, k in zip(*decoded(spans, model), strict=True)]


def read_spans(spans: list[bytes], model: np.ndarray) -> list[bytes]:
    """The likeliest reading of each span, whatever its length."""
    todo: dict[int, dict[bytes, list]] = {}
    out: list[list[bytes]] = []
    for k, span in enumerate(spans):
        core = len(span) if len(span) <= WHOLE_SPAN else SPAN_CORE
        out.append([b""] * -(-len(span) // core))
        for part in range(len(out[k])):
            begin, end = max(0, part * core - SPAN_LAP), min(len(span), (part + 1) * core + SPAN_LAP)
            piece = span[begin:end]
            todo.setdefault(len(piece), {}).setdefault(piece, []).append(
                (k, part, part * core - begin, min(len(span), (part + 1) * core) - begin))
    for length, group in todo.items():
        pieces = sorted(group)
        for at in range(0, len(pieces), 256):
            some = pieces[at:at + 256]
            read = decoded(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), length), model)
            for piece, text, kept in zip(some, *read, strict=True):
                for k, part, a, b in group[piece]:
                    out[k][part] = text[a:b][kept[a:b]].tobytes()
    return [b"".join(parts) for parts in out]


def disguised(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(start, end) of the spans of lower-cased texts that have more than one sensible reading."""
    start, end, wo = word_spans(buf, offs)
    if not len(start):
        return np.zeros((0, 2), np.int64)
    letter = _symbol_of_byte()[buf] > 0
    digit = (buf >= 48) & (buf <= 57)
    kinds = np.zeros((2, 256), bool)
    for sign, imitated in IMITATED.items():
        kinds[0 if imitated else 1, ord(sign)] = True
    alike, filler = kinds[0][buf], kinds[1][buf]
    letters, digits, alikes, fillers = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, digit, alike, filler))

    def may_be_words(a, b):
        """Without a letter only mostly signs ('@$$') may be a word; the others are numbers and amounts."""
        n = alikes[b] - alikes[a]
        return (letters[b] > letters[a]) | ((n >= 3) & (2 * (digits[b] - digits[a]) <= n))

    size = end - start
    # fillers count between the first and last byte of a word that is or imitates a letter
    at = np.append(np.flatnonzero(letter | alike), len(buf))
    i, j = np.searchsorted(at, start), np.searchsorted(at, end) - 1
    first = np.minimum(at[i], end)
    inside = np.where(i <= j, fillers[np.maximum(at[j], first)] - fillers[first], 0)
    flag = may_be_words(start, end) & ((alikes[end] > alikes[start]) | (inside > 0))
    triple = np.zeros(len(buf) + 1, np.int64)
    if len(buf) > 2:
        triple[1:len(buf) - 1] = letter[:-2] & (buf[:-2] == buf[1:-1]) & (buf[1:-1] == buf[2:]) & (buf[:-2] < 128)
        triple = np.cumsum(triple)
    flag |= (size >= 4) & (triple[np.maximum(end - 2, start)] > triple[start])
    # runs of three or more single letters, digits or signs with one blank between
    single = (size == 1) & (letter | alike | filler)[start]
    follows = np.zeros(len(start), bool)
    follows[1:] = single[1:] & single[:-1] & (start[1:] == end[:-1] + 1)
    follows[wo[:-1][wo[:-1] < len(start)]] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], follows, [False]]).astype(np.int8)))
    a, b = edge[::2] - 1, edge[1::2] - 1
    long = (b - a >= 2) & may_be_words(start[a], end[b])
    spans = np.concatenate([np.stack([start[flag], end[flag]], axis=1),
                            np.stack([start[a[long]], end[b[long]]], axis=1)])
    return spans[np.argsort(spans[:, 0], kind="stable")]


def restore(buf: np.ndarray, offs: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased, deobfuscated texts. Readings under this model are remembered from block to block."""
    buf = lower_ascii(buf)
    spans = disguised(buf, offs)
    if not len(spans):
        return buf, offs
    key = hashlib.blake2b(model.tobytes(), digest_size=16).digest()
    known, memo = worker_cache().get("readings", (None, {}))
    if known != key:
        memo = {}
        worker_cache()["readings"] = key, memo
    if len(memo) > 200_000:
        memo.clear()
    raw = buf.tobytes()
    pieces = [raw[a:b] for a, b in spans]
    todo = sorted({piece for piece in pieces if piece not in memo})
    memo.update(zip(todo, read_spans(todo, model), strict=True))
    out, shift, last = [], np.zeros(len(spans), np.int64), 0
    for k, ((a, b), piece) in enumerate(zip(spans, pieces, strict=True)):
        read = memo[piece]
        out += [raw[last:a], read]
        last, shift[k] = b, len(read) - (b - a)
    out.append(raw[last:])
    moved = np.concatenate([[0], np.cumsum(shift)])[np.searchsorted(spans[:, 0], offs, side="left")]
    return np.frombuffer(b"".join(out), np.uint8), offs + moved


def features(buf: np.ndarray, offs: np.ndarray):
    """Yields (document, feature) arrays: words and byte n-grams inside words, hashed to HASH_BITS bits."""
    start, end, wo = word_spans(buf, offs)
    if not len(start):
        return
    shift = np.uint64(64 - HASH_BITS)
    prefix = prefix_hash(buf)
    doc_of_word = np.repeat(np.arange(len(offs) - 1), np.diff(wo))
    yield doc_of_word, (span_hash(prefix, start, end) >> shift).astype(np.int64)
    size = end - start
    for g in GRAMS:
        room = np.zeros(len(buf) + 1, np.int32)
        long = size >= g
        room[start[long]] += 1
        np.add.at(room, end[long] - g + 1, -1)
        at = np.flatnonzero(np.cumsum(room[:-1]) > 0)
        if len(at):
            yield (np.searchsorted(offs, at, side="right") - 1,
                   (span_hash(prefix, at, at + g) >> shift).astype(np.int64))


def _document_counts(model):
    """Per slice of the feature space: in how many toxic and clean documents of the task each feature occurs."""
    def run(batches):
        counts = np.zeros((2, 1 << HASH_BITS), np.int32)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            buf, offs = text_buffer(batch.column(0))
            for a, b in blocks(offs):
                text, to = restore(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a], model)
                for doc, f in features(text, to):
                    key = np.unique((doc << HASH_BITS) | f)
                    doc, f = key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)
                    for label in (0, 1):
                        np.add.at(counts[label], f[toxic[a:b][doc] == label], 1)
        width = (1 << HASH_BITS) // SLICES
        for s in range(SLICES):
            part = counts[:, s * width:(s + 1) * width]
            at = np.flatnonzero(part.any(axis=0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s]), pa.array([(at + s * width).tobytes()], pa.binary()),
                 pa.array([part[0, at].tobytes()], pa.binary()), pa.array([part[1, at].tobytes()], pa.binary())],
                ["slice", "feature", "clean", "toxic"])
    return run


def _best_features(n_clean: int, n_toxic: int):
    """Of a slice: the features whose document counts tell the classes apart best."""
    def run(table: pa.Table) -> pa.Table:
        parts = []
        for r in table.to_pylist():
            parts.append((np.frombuffer(r["feature"], np.int64), np.frombuffer(r["clean"], np.int32),
                          np.frombuffer(r["toxic"], np.int32)))
        f, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        clean = np.bincount(where, np.concatenate([p[1] for p in parts]), minlength=len(f))
        toxic = np.bincount(where, np.concatenate([p[2] for p in parts]), minlength=len(f))
        n = n_clean + n_toxic
        both = clean + toxic
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = n * (toxic * (n_clean - clean) - clean * (n_toxic - toxic)) ** 2 / (
                both * (n - both) * float(n_clean) * n_toxic)
        # only what speaks for toxicity: a text is not cleared by what else it says
        chi = np.where((both >= LEAST_DOCS) & (both < n) & (toxic * n > both * n_toxic), chi, 0.0)
        top = np.lexsort((f, -chi))[:FEATURES]
        top = top[chi[top] > 0]
        return pa.Table.from_arrays([pa.array(f[top]), pa.array(chi[top])], ["feature", "chi"])
    return run


def _places(chosen: np.ndarray) -> np.ndarray:
    """The column of each feature, -1 for those not chosen."""
    table = np.full(1 << HASH_BITS, -1, np.int16)
    table[chosen] = np.arange(len(chosen))
    return table


def _present(buf, offs, table: np.ndarray, width: int) -> np.ndarray:
    """Does each document have each chosen feature?"""
    out = np.zeros((len(offs) - 1, width), bool)
    for doc, f in features(buf, offs):
        k = table[f]
        hit = k >= 0
        out[doc[hit], k[hit]] = True
    return out


def _rows_for_fit(model, chosen):
    def run(batches):
        places = _places(chosen)
        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            bits = []
            for a, b in blocks(offs):
                text, to = restore(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a], model)
                bits += [row.tobytes() for row in np.packbits(_present(text, to, places, len(chosen)), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bits, pa.binary())], ["toxic", "bits"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.2) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by Newton steps (intercept free)."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labelled: DataFrame, text_col: str = "text", label_col: str = "toxic",
                 id_col: str = "doc_id", most: int = MOST_LABELLED) -> dict:
    """Character model (over all ``docs``), features and weights (over at most ``most`` rows of ``labelled``).

    ``labelled`` has id, text and a 0/1 label; rows with a null label are left out.
    The sample is the share of rows, by a hash of the id, that makes about ``most``.
    With one class or none the score is the base rate (0.5 without any label).
    """
    model = fit_character_model(docs, text_col)
    labelled = labelled.where(col(label_col).isNotNull())
    share = min(1.0, most / max(1, labelled.count()))
    sample = (labelled.where(F.pmod(F.xxhash64(col(id_col)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
              .select(col(text_col).alias("text"), col(label_col).cast("long").alias("toxic"))
              .repartition(8, F.xxhash64("text")))
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = seen.get(0, 0), seen.get(1, 0)
    base = (n_toxic + 0.5) / (n_clean + n_toxic + 1)
    out = {"lm": model, "chosen": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": math.log(base / (1 - base))}
    if not n_clean or not n_toxic:
        return out
    best = (sample.mapInArrow(_document_counts(model), "slice long, feature binary, clean binary, toxic binary")
            .groupBy("slice").applyInArrow(_best_features(n_clean, n_toxic), "feature long, chi double")
            .orderBy(F.desc("chi"), "feature").limit(FEATURES).collect())
    if not best:
        return out
    chosen = np.array(sorted(r["feature"] for r in best), np.int64)
    rows = sample.mapInArrow(_rows_for_fit(model, chosen), "toxic long, bits binary").collect()
    rows.sort(key=lambda r: (r["toxic"], bytes(r["bits"])))
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1),
                      axis=1, count=len(chosen))
    out["chosen"] = chosen
    out["weights"], out["bias"] = _logistic(x, np.array([r["toxic"] for r in rows], np.float64))
    return out


def _score(fitted, text_name, keep):
    def run(batches):
        places = _places(fitted["chosen"])
        for batch in batches:
            buf, offs = text_buffer(batch.column(batch.schema.get_field_index(text_name)))
            z = np.full(batch.num_rows, fitted["bias"])
            if len(fitted["chosen"]):
                for a, b in blocks(offs):
                    text, to = restore(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a], fitted["lm"])
                    z[a:b] += _present(text, to, places, len(fitted["chosen"])) @ fitted["weights"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(k)) for k in keep),
                 pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*keep, "score"])
    return run


def score_toxicity(df: DataFrame, fitted: dict, text_col: str = "text", keep: list[str] | None = None,
                   score: str = "score") -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) and a score from 0 to 1 of every whole text.

    Null and empty texts get the model's score of no feature. Repeated rows get
    equal scores. ``score`` must not be one of the kept columns (ValueError).
    """
    keep = df.columns if keep is None else keep
    if score in keep:
        raise ValueError(f"the table already has a column named {score!r}")
    inner = [f"c{k}" for k in range(len(keep))]
    (text,) = fresh_names(df, "text_to_score")
    fields = [T.StructField(n, df.schema[c].dataType) for n, c in zip(inner, keep, strict=True)]
    scored = (df.select(*(col(c).alias(n) for n, c in zip(inner, keep, strict=True)), col(text_col).alias(text))
              .mapInArrow(_score(fitted, text, inner), T.StructType([*fields, T.StructField("score", T.DoubleType())])))
    return scored.select(*(F.col(n).alias(c) for n, c in zip(inner, keep, strict=True)), F.col("score").alias(score))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents that are not held out."""
    seen = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    return docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text").join(seen, "doc_id")


def held_out(doc_id):
    """crc32 of the id as text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted = fit_toxicity(docs, training_rows(docs, labels))
    return (score_toxicity(docs, fitted, keep=["doc_id"])
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= CUTOFF).cast("int").alias("predicted")))

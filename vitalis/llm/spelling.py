"""Operator 13 - spelling variants by permuterm rotations.

A word is marked with a terminator and rotated: for every split of the word into
a + c + b the rotation that starts behind the character c reads ``b $ a c``. Words
that differ in c alone therefore share the prefix ``b $ a``, and so does the word
``a b``, whose own rotation is that prefix: a replacement and an indel are both the
range of rotations with one prefix, the edited character being the one behind it.
Rotations are dealt by that prefix and sorted; a scan of each range gives every
member what it needs of its neighbours, how many there are and the best one before
and behind it, so no pairs are made. A range holds one word for each character at
most (92 with the alphabet of the query).

Two words can meet in several ranges only when one is the other with a character
more inside a run of that character; the indel counts in the range of the run's first
place alone. Prefixes of more than ``LONG`` characters are not written out: they are
digests from prefix sums (a word of a million letters costs a million small rows, not a
million rotations), and the pairs that meet there are confirmed on the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalis.functions.columns import col
from vitalis.llm.layout import written
from vitalis.llm.textkit import mix, prefix_hash, span_hash, text_buffer

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10
SLIP = 31  # one run in so many loses a character, by a checksum of document and run
LONG = 255
MARK = "$"  # no letter


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): the words of ``min_chars`` code points or more that occur ``min_count`` times or more.

    A run of letters, A-Z lower-cased, is a word; a run whose crc32 of ``id:run`` is a
    multiple of ``slip`` first loses the code point at that checksum modulo its length.
    Shorter runs can only give shorter words, so they are not taken from the text at all.
    """
    runs = (df.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"),
                      F.explode(F.regexp_extract_all(col(text_col), F.lit(f"([{LETTERS}]{{{min_chars},}})"), F.lit(1)))
                      .alias("run"))
            .select("id", F.translate("run", UPPER, LOWER).alias("run"))
            .select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"), F.char_length("run").alias("size")))
    at = (F.col("h") % F.col("size")).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.col("run").substr(F.lit(1), at),
                                                   F.col("run").substr(at + 2, F.col("size")))).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.char_length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def rotations(words: DataFrame, long: int = LONG) -> DataFrame:
    """(prefix, c, first, word, n) of ``words`` (word, n), for prefixes of up to ``long`` characters.

    c is the character behind the prefix, '' for the word that the prefix is a rotation
    of. ``first``: c does not repeat the character before it in the word.
    """
    word, size = F.col("word"), F.char_length("word")

    def edited(i):
        c = word.substr(i + 1, F.lit(1))
        return F.struct(F.concat(word.substr(i + 2, size), F.lit(MARK), word.substr(F.lit(1), i)).alias("prefix"),
                        c.alias("c"), ((i == 0) | (word.substr(i, F.lit(1)) != c)).alias("first"))

    def whole(i):
        return F.struct(F.concat(word.substr(i + 1, size), F.lit(MARK), word.substr(F.lit(1), i)).alias("prefix"),
                        F.lit("").alias("c"), F.lit(True).alias("first"))

    none = F.array().cast("array<struct<prefix:string,c:string,first:boolean>>")
    rows = F.concat(
        F.when((size <= long + 1) & (size > 0), F.transform(F.sequence(F.lit(0), size - 1), edited)).otherwise(none),
        F.when(size <= long, F.transform(F.sequence(F.lit(0), size), whole)).otherwise(none))
    return words.where(size <= long + 1).select("word", "n", F.explode(rows).alias("r")).select("r.*", "word", "n")


def scanned(entries: DataFrame) -> DataFrame:
    """(word, near, best): what each range of rotations tells its members; best is (-n, word) of the best other."""
    ordered = Window.partitionBy("prefix").orderBy("c")
    everyone = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("less"), F.col("word").alias("w"))
    whole = F.col("c") == ""
    return (entries.select(
        "word", whole.alias("whole"), "first",
        F.least(F.min(me).over(ordered.rowsBetween(Window.unboundedPreceding, -1)),
                F.min(me).over(ordered.rowsBetween(1, Window.unboundedFollowing))).alias("best"),
        F.count_if(whole).over(everyone).alias("wholes"), F.count_if(~whole).over(everyone).alias("longer"),
        F.count_if(~whole & F.col("first")).over(everyone).alias("firsts"))
        .where(F.col("best").isNotNull())
        .select("word", "best", F.when(F.col("whole"), F.col("firsts"))
                .otherwise(F.col("longer") - 1 + F.when(F.col("first"), F.col("wholes")).otherwise(0)).alias("near")))


def _digests(long: int):
    """(prefix digest, word id) of every prefix longer than ``long``, from prefix sums over the word's bytes."""
    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                x = buf[offs[k]:offs[k + 1]]
                sums = prefix_hash(x)
                at = np.append(np.flatnonzero((x & 0xC0) != 0x80), len(x))  # where the characters begin
                size = len(at) - 1
                nought, end = np.zeros(size + 1, np.int64), np.full(size + 1, len(x))
                before = span_hash(sums, nought, at) * np.uint64(0x9E3779B97F4A7C15)
                behind = span_hash(sums, at, end)
                keys = [mix(before + behind)] if size > long else []
                if size > long + 1:
                    keys.append(mix(before[:-1] + behind[1:]))
                for key in keys:
                    for a in range(0, len(key), 1 << 16):
                        part = key[a:a + (1 << 16)].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), ids[k]))],
                                                         ["prefix", "wid"])
    return run


def long_pairs(words: DataFrame, long: int = LONG) -> DataFrame:
    """(a, na, b, nb), both ways round: words one edit apart that share a prefix of more than ``long`` characters."""
    big = words.where(F.char_length("word") > long).select(F.xxhash64("word").alias("wid"), "word", "n")
    entries = big.select("wid", "word").mapInArrow(_digests(long), "prefix long, wid long")
    pairs = (entries.withColumnRenamed("wid", "ida").join(entries.withColumnRenamed("wid", "idb"), "prefix")
             .where("ida < idb").select("ida", "idb").distinct())
    a, b = (big.select(F.col("wid").alias(f"id{s}"), F.col("word").alias(s), F.col("n").alias(f"n{s}")) for s in "ab")
    near = (pairs.join(a, "ida").join(b, "idb").where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb"))
    return near.union(near.select("b", "nb", "a", "na"))


def group_variants(words: DataFrame, ratio: int = RATIO, long: int = LONG) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n), each word once.

    Near words differ by exactly one inserted, deleted or replaced code point. A
    word's form is its near word of largest n (then the smallest), if that has
    ``ratio`` times its n or more; root follows forms to the last. Words must not
    hold ``$``; the empty word and null are nobody's neighbour (null rows go). An empty table gives no rows.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")).where(F.col("word").isNotNull()), "words")
    told = scanned(rotations(words, long))
    if not words.where(F.char_length("word") > long).isEmpty():
        told = told.unionByName(long_pairs(words, long).select(
            F.col("a").alias("word"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("w")).alias("best"),
            F.lit(1).cast("long").alias("near")))
    told = told.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    found = written(words.join(told, "word", "left").select(
        "word", F.when(fits, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n")), "forms")

    # a form has ratio times the word's count, so a chain is short; each round doubles what is followed
    up = written(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = up.select(F.col("word").alias("via"), F.col("root").alias("next"))
        up = written(up.join(step, F.col("root") == F.col("via"), "left")
                     .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                     "roots")
        moved = not up.where("moved").isEmpty()
        up = up.select("word", "root")
        if not moved:
            break
    return found.join(up, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                      min_count: int = MIN_COUNT, slip: int = SLIP, ratio: int = RATIO, long: int = LONG) -> DataFrame:
    """The words of ``df`` with their most likely intended form; see ``word_counts`` and ``group_variants``.

    * null or empty text: no words; null id: checksums as for an empty id
    * very long texts and words: read whole
    * ties: the smallest word in code-point order; repeated rows: every occurrence counts
    * an empty table gives no rows; other columns are not read
    """
    return group_variants(word_counts(df, id_col, text_col, min_chars, min_count, slip), ratio, long)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``documents``."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

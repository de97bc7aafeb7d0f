"""Operator 3 - line deduplication by a segment-partition edit join (DataFrame functions only).

A line is dropped if an earlier line - smaller (id, position) - is equal or
within ``max_edits`` edits. Equal lines meet by hash. For the others, a line of
``near_chars`` characters or more is cut into max_edits + 1 segments: by
pigeonhole one segment survives any max_edits edits unchanged. Each distinct
line is indexed under (its length, segment number, segment), and probes the
indexes of all lengths up to max_edits below its own with the substrings that
can still be that segment (their start may be off by as many places as there
are edits left and right of it). Pairs that meet must agree in counts of ten
letters (an edit changes the counts by two at most; checked inside the join) and are
verified by a banded bit-parallel edit distance: the 2 * max_edits + 1 diagonals
around the main one are the bits of one integer, moved along both lines by an
``aggregate`` over positions.

A key under which more than ``CROWD`` lines are indexed is not joined: its members are
gathered, and in rounds each of them meets the earliest members only (64, then the next
128, ...). A line that has met its earlier near line needs no other and leaves as
receiver, not as donor, so a group of near copies costs about its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalis.functions.columns import col
from vitalis.llm.layout import fresh_names, measured, shuffle_partitions, written

MAX_EDITS = 2
MIN_CHARS = 20
NEAR_CHARS = MIN_CHARS  # three segments still have six characters
# Letters of the count filter, three bits each; a count is kept modulo 8.
LETTERS = "enitasrohd"
# More letters, looked at before a pair is verified.
MORE_LETTERS = "lucmgwbpfv", "zkjqxyäüéó"
CROWD = 512
FIRST_ROUND = 64
LAST = 2**63 - 1


def line_entries(lines: DataFrame, max_edits: int) -> DataFrame:
    """(key, indexed, h, c) of ``lines`` (h, line): a key for each segment and each place where it may be found.

    The segments of the line itself, unshifted, are index entries and probes at once
    (``indexed``); the others are probes of shorter lines or of shifted segments.
    Built one segment a row, so that the generated code stays small enough to be compiled.
    """
    segments = max_edits + 1
    per_segment = (lines.select("h", "line", letter_counts(F.col("line")).alias("c"),
                                F.char_length("line").alias("size"))
                   .select("h", "line", "c", "size", F.explode(F.array(*map(F.lit, range(segments)))).alias("k")))
    size, k, keys = F.col("size"), F.col("k"), []
    for shorter in range(segments):
        length = size - shorter
        start = F.floor(length * k / segments).cast("int")
        width = F.floor(length * (k + 1) / segments).cast("int") - start
        for shift in sorted(range(-max_edits, max_edits + 1), key=abs):
            # k edits may lie before segment k, max_edits - k behind it
            fits = [j for j in range(segments) if max(-j, shorter - (max_edits - j)) <= shift
                    <= min(j, shorter + (max_edits - j))]
            if fits:
                key = F.xxhash64(length, k, F.col("line").substr(start + (1 + shift), width))
                keys.append(key if len(fits) == segments else F.when(k.isin(fits), key))
    return (per_segment.select("h", "c", F.posexplode(F.array(*keys)).alias("at", "key"))
            .where(F.col("key").isNotNull()).select("key", (F.col("at") == 0).alias("indexed"), "h", "c"))


def letter_counts(line: Column, letters: str = LETTERS) -> Column:
    """Counts of the letters, 3 bits each."""
    parts = [F.shiftleft(((F.char_length(line) - F.char_length(F.replace(line, F.lit(letter), F.lit("")))) % 8)
                         .cast("int"), 3 * k) for k, letter in enumerate(letters)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def counts_apart(a: Column, b: Column, letters: str = LETTERS) -> Column:
    """Sum of the differences of two letter counts, each taken the short way round modulo 8."""
    out = F.lit(0)
    for k in range(len(letters)):
        d = (F.shiftright(a, 3 * k).bitwiseAND(F.lit(7)) - F.shiftright(b, 3 * k).bitwiseAND(F.lit(7))).bitwiseAND(F.lit(7))
        out = out + F.least(d, F.lit(8) - d)
    return out


def banded_distance(a: Column, b: Column, max_edits: int) -> Column:
    """Edit distance of two lines whose lengths differ by ``max_edits`` at most; right up to max_edits, larger beyond.

    Bit r of the band at column j is row j - max_edits + r. ``vp`` and ``vn`` mark
    rows one above, one below the row before. The score runs down the band's lower
    edge while that lies inside the matrix, then along its last row.
    """
    k = max_edits
    width = 2 * k + 1
    full, rows = F.lit((1 << width) - 1), F.char_length(a)

    def bit(value, r):
        return F.shiftright(value, r).bitwiseAND(F.lit(1))

    def matches(lines):
        """For each column, the rows of its band that hold its character."""
        return F.transform(F.sequence(F.lit(1), F.char_length(b)), lambda j: reduce(lambda p, q: p.bitwiseOR(q), [
            F.when((j - k + r >= 1) & (F.get(lines["x"], j - k + r - 1) == F.get(lines["y"], j - 1)), F.lit(1 << r))
            .otherwise(F.lit(0)) for r in range(width)]))

    def step(state, match):
        j, vp, vn, score = state["j"], state["vp"], state["vn"], state["score"]
        d0 = (match.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(full)
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(full))
        hn = d0.bitwiseAND(vp)
        down = F.lit(1) - bit(d0, 2 * k)
        at = F.greatest(rows - j + k, F.lit(0))
        along = (F.call_function("shiftright", hp, at).bitwiseAND(F.lit(1))
                 - F.call_function("shiftright", hn, at).bitwiseAND(F.lit(1)))
        moved = F.shiftright(d0, 1)
        return F.struct(
            (j + 1).alias("j"),
            hn.bitwiseOR(F.bitwise_not(moved.bitwiseOR(hp)).bitwiseAND(full)).cast("int").alias("vp"),
            moved.bitwiseAND(hp).cast("int").alias("vn"),
            (score + F.when(j + k <= rows, down).otherwise(along)).cast("int").alias("score"))

    start = F.struct(F.lit(1).alias("j"), F.lit(((1 << (k + 1)) - 1) << k).cast("int").alias("vp"),
                     F.lit(0).alias("vn"), F.lit(k).alias("score"))
    # an array of one, mapped, so that the lines are taken apart once and not at every step
    both = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    return F.aggregate(F.get(F.transform(both, matches), 0), start, step, lambda s: s["score"])


def _split_lines(docs: DataFrame) -> DataFrame:
    return docs.select("rid", "id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


SIEVE_BITS = 23  # 1 MB; beyond, more hashes pass that nobody asked for, and the joins drop them


def sieve(hashes: DataFrame, h: str) -> Column:
    """A bitmap of 2**SIEVE_BITS bits that holds the high bits of every hash: an array of 64-bit words, made once as a
    subquery, so that it is no part of the plan's text."""
    word = F.shiftrightunsigned(F.col(h), 64 - SIEVE_BITS)
    marks = (hashes.select(F.shiftright(word, 6).cast("int").alias("word"),
                           F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(F.lit(63)).cast("int"))
                           .alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("mark")))
    every = hashes.sparkSession.range(1 << (SIEVE_BITS - 6)).select(F.col("id").cast("int").alias("word"),
                                                                    F.lit(0).cast("long").alias("mark"))
    filled = marks.union(every).groupBy("word").agg(F.bit_or("mark").alias("mark"))
    return (filled.agg(F.sort_array(F.collect_list(F.struct("word", "mark"))).alias("all"))
            .select(F.col("all.mark")).scalar())


def _passes(table: Column, h: str) -> Column:
    """May the hash be one of those in the bitmap?"""
    bits = F.shiftrightunsigned(F.col(h), 64 - SIEVE_BITS)
    word = F.get(table, F.shiftright(bits, 6).cast("int"))
    return F.call_function("shiftright", word, bits.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _verified(pairs: DataFrame, max_edits: int) -> DataFrame:
    """The rows whose lines la and lb are within ``max_edits``."""
    return (pairs.where(F.abs(F.char_length("la") - F.char_length("lb")) <= max_edits)
            .where(sum(counts_apart(letter_counts(F.col("la"), some), letter_counts(F.col("lb"), some), some)
                       for some in (LETTERS, *MORE_LETTERS)) <= 2 * max_edits)
            .where(banded_distance(F.col("la"), F.col("lb"), max_edits) <= max_edits))


def crowd_drops(members: DataFrame, known: DataFrame, max_edits: int, first_round: int = FIRST_ROUND) -> DataFrame:
    """(at) of the members (key, h) that lie near an earlier member of one of their keys.

    ``known``: (h, line, at, c). Each round offers every key's next earliest members as
    donors, twice as many as the round before, to the members that are still receivers.
    """
    places = written(members.join(known.select("h", "at", "c"), "h"), "members")
    receivers, last, done, size = places, None, [], first_round
    while True:
        left = places if last is None else places.join(last, "key").where(F.col("at") > F.col("last"))
        order = Window.partitionBy("key").orderBy("at")
        donors = written(left.withColumn("n", F.row_number().over(order)).where(F.col("n") <= size)
                         .select("key", F.col("at").alias("before"), F.col("c").alias("cb")), "donors")
        if donors.isEmpty():
            break
        met = (receivers.join(donors, "key").where((F.col("before") < F.col("at"))
                                                   & (counts_apart(F.col("c"), F.col("cb")) <= 2 * max_edits))
               .select("at", "before").distinct())
        one = known.select("at", F.col("line").alias("la"))
        two = known.select(F.col("at").alias("before"), F.col("line").alias("lb"))
        found = written(_verified(met.join(one, "at").join(two, "before"), max_edits).select("at").distinct(), "found")
        done.append(found)
        last = written(donors.groupBy("key").agg(F.max("before").alias("last")), "last")
        # no longer receivers: those that have met their near line, and those without donors left under a key
        receivers = written(receivers.join(found, "at", "left_anti").join(last, "key")
                            .where(F.col("at") > F.col("last")).drop("last"), "receivers")
        if receivers.isEmpty():
            break
        size *= 2
    return reduce(DataFrame.union, done).distinct()


def repeated_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS,
                   near_chars: int = NEAR_CHARS, crowd: int = CROWD) -> DataFrame:
    """(rid, id, pos, near) of the lines to drop of ``docs`` (rid, id, text); see ``dedup_lines``."""
    place = F.struct(F.coalesce("id", F.lit(LAST)).alias("o"), F.col("pos").alias("p"), F.col("rid").alias("r"))
    lines = written(_split_lines(docs).where(F.char_length("line") >= min_chars)
                    .select("rid", "id", "pos", F.xxhash64("line").alias("h"),
                            F.xxhash64(F.lit(1), "line").alias("g"), F.char_length("line").alias("size")), "lines")
    first = written(lines.groupBy("h", "g").agg(F.min(place).alias("at"), F.max("size").alias("size"),
                                                F.count(F.lit(1)).alias("copies")), "first-lines")
    equal = (lines.join(first.where("copies > 1").select("h", "g", "at"), ["h", "g"]).where(place != F.col("at"))
             .select("rid", "id", "pos", F.lit(False).alias("near")))
    long = first.where(F.col("size") >= near_chars)

    # The texts of distinct lines are taken where they lie. A line that occurs once needs no look at others; those
    # that may occur twice (by the sieve) are merged by hash first, map-side too.
    texts = (docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.char_length("line") >= near_chars)
             .select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "line"))
    twice = sieve(long.where("copies > 1"), "h")
    distinct = texts.where(~_passes(twice, "h")).union(
        texts.where(_passes(twice, "h")).groupBy("h", "g").agg(F.min("line").alias("line")).select("h", "g", "line"))

    # One shuffle of the entries serves both sides: the index is picked behind it, and both sides read all its columns.
    # A crowded key has one row without a line in the index, which only marks its probes.
    entries = line_entries(distinct, max_edits).repartition(shuffle_partitions(docs.sparkSession), "key")
    here = F.spark_partition_id() >= 0  # keeps the filter above the shuffle
    by_key = Window.partitionBy("key")
    index = (entries.where(F.when(here, F.col("indexed")))
             .select("key", F.col("h").alias("ha"), F.col("c").alias("ca"), F.count(F.lit(1)).over(by_key).alias("n"),
                     F.row_number().over(by_key.orderBy("h")).alias("nth"))
             .where((F.col("n") <= crowd) | (F.col("nth") == 1))
             .select("key", F.when(F.col("n") <= crowd, F.col("ha")).alias("ha"), "ca"))
    probes = entries.select(F.col("key").alias("probe"), "indexed", "h", "c")
    meets = ((F.col("ha") != F.col("h")) & (~F.col("indexed") | (F.col("ha") < F.col("h")))
             & (counts_apart(F.col("ca"), F.col("c")) <= 2 * max_edits))
    met = written(index.join(probes, (F.col("key") == F.col("probe")) & (F.col("ha").isNull() | meets))
                  .select(F.when(F.col("ha").isNull(), F.col("key")).alias("key"),
                          F.least("ha", "h").alias("a"), F.when(F.col("ha").isNotNull(), F.greatest("ha", "h")).alias("b"))
                  .distinct(), "line-pairs")
    pairs = met.where("key is null").select("a", "b")
    members = met.where("key is not null").select("key", F.col("a").alias("h"))
    ends = written(met.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct(), "ends")
    known = written(texts.where(_passes(sieve(ends, "h"), "h")).join(ends, "h").groupBy("h", "g")
                    .agg(F.min("line").alias("line")).join(long.select("h", "g", "at"), ["h", "g"])
                    .select("h", "line", "at", letter_counts(F.col("line")).alias("c")), "pair-lines")
    one = known.select(F.col("h").alias("a"), F.col("line").alias("la"), F.col("at").alias("ata"))
    two = known.select(F.col("h").alias("b"), F.col("line").alias("lb"), F.col("at").alias("atb"))
    near = _verified(pairs.join(one, "a").join(two, "b"), max_edits).select(F.greatest("ata", "atb").alias("at"))
    if not members.isEmpty():
        near = near.union(crowd_drops(members, known, max_edits))
    return equal.union(near.distinct().select(F.col("at.r").alias("rid"), F.nullif(F.col("at.o"), F.lit(LAST)).alias("id"),
                                              F.col("at.p").alias("pos"), F.lit(True).alias("near")))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS,
                min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, n_lines: str = "n_lines",
                n_equal: str = "n_equal", n_near: str = "n_near", crowd: int = CROWD) -> DataFrame:
    """``df`` with the repeated lines cut from ``text_col``, and how many lines it had, lost as equal, lost as near.

    A line of ``min_chars`` characters or more goes if an earlier line is equal, one
    of ``near_chars`` or more also if an earlier such line is within ``max_edits``
    edits (of characters). Lines are separated by line feeds; shorter and blank
    lines always stay, and a text that loses nothing is unchanged.

    * null text: no lines, stays null; empty text: one empty line, which stays
    * null id: after all other ids
    * repeated rows (equal id and text) are one document: neither loses lines to the other
    * rows of one id with different texts: ordered by position, then by a hash of the text
    * the result columns' names must be free in ``df`` (ValueError); other columns pass through
    """
    if near_chars < min_chars or near_chars < 4 * (max_edits + 1):
        raise ValueError("near_chars must be min_chars or more, and leave segments of four characters")
    clash = {n_lines, n_equal, n_near} & set(df.columns)
    if clash:
        raise ValueError(f"the table already has columns named {sorted(clash)}")
    rid, own = fresh_names(df, "rid", "id_as_long")
    keyed = df.withColumn(own, col(id_col).cast("long")).withColumn(rid, F.xxhash64(col(own), col(text_col)))
    docs = keyed.select(col(rid).alias("rid"), col(own).alias("id"), col(text_col).alias("text"))
    _, total = measured(df, text_col)
    parts = max(shuffle_partitions(df.sparkSession), -(-total // (32 << 20)))
    key, gone, near = fresh_names(df, "gone_rid", "gone", "gone_near")
    drops = written(repeated_lines(docs, max_edits, min_chars, near_chars, crowd)
                    .groupBy("rid").agg(F.collect_set("pos").alias(gone), F.count_if("near").alias(near))
                    .withColumnRenamed("rid", key), "dropped-lines")
    lines = F.split(col(text_col), "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    # an array of one, mapped, so that the text is taken apart once and not for every line
    kept = F.get(F.transform(F.array(lines), lambda every: F.array_join(
        F.transform(places, lambda i: F.get(every, i)), "\n")), 0)
    counts = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines)]
    # a text that loses nothing stays where it is; only those in the bitmap are shuffled to their dropped lines
    table, none = sieve(drops, key), F.lit(0).cast("long")
    rest = keyed.where(~_passes(table, rid)).select(*map(col, df.columns), *counts, none.alias(n_equal), none.alias(n_near))
    merged = keyed.where(_passes(table, rid)).repartition(parts, col(rid)).join(drops, col(rid) == F.col(key), "left")
    return rest.union(merged.select(
        *(F.when(F.col(gone).isNull(), col(c)).otherwise(kept).alias(c) if c == text_col else col(c)
          for c in df.columns), *counts,
        F.coalesce(F.size(gone) - F.col(near), F.lit(0)).cast("long").alias(n_equal),
        F.coalesce(near, F.lit(0)).cast("long").alias(n_near)))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_equal, n_near, n_chars and the SHA-256 of the kept text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_equal", "n_near",
                                    F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                                    F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

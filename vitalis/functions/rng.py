"""Deterministic per-row randomness.

A uniform number in [0, 1) is taken from the md5 of the row key, a seed and a
salt, so draws depend only on row identity — never on partitioning, task
order or retries (a lost executor recomputes exactly the same sample). The same
expression is written in SQL for the oracles:

    CAST(('0x' || substr(md5(key || '|' || seed || '|' || salt), 1, 13)) AS BIGINT)
        / 4503599627370496.0
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = float(2 ** 52)


def unit_hash(key: Column, seed: int = 42, salt: str | Column = "") -> Column:
    salt_col = salt if isinstance(salt, Column) else F.lit(salt)
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), salt_col.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(TWO_POW_52)


def row_key(*cols: Column) -> Column:
    """A string identity for composite keys (used as the RNG key)."""
    return F.concat_ws("|", *[c.cast("string") for c in cols])


# --- a permutation of ranks without a sort ------------------------------------------------
PRIME = 2147483647  # 2**31 - 1
ROUNDS = 4
MOST_STEPS = 128


def round_keys(seed: int, name: str) -> list[tuple[int, int]]:
    """Multiplier and offset of each Feistel round, from md5 of (seed, name, round)."""
    out = []
    for k in range(ROUNDS):
        h = int(hashlib.md5(f"{seed}|{name}|{k}".encode()).hexdigest(), 16)
        out.append((h % (PRIME - 1) % 65_000 + 1, (h >> 64) % PRIME))
    return out


def halves(n: int) -> tuple[int, int]:
    """(a, b), about equal, with a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted_rank(rank: Column, n: int, seed: int, name: str) -> Column:
    """A keyed bijection of 0 ... n-1: a Feistel walk over the ranks, plain arithmetic for each row.

    A rank is a pair (l, r) below (a, b); a round adds a keyed hash of one half to the
    other. A result of n or more is walked on until it falls below n: there are fewer
    than a such places. A walk of ``MOST_STEPS`` steps that has not ended (all but impossible) is an error.
    """
    a, b = halves(n)
    keys = round_keys(seed, name)

    def hashed(v: Column, k: int) -> Column:
        t = (v * F.lit(keys[k][0]).cast("long") + F.lit(keys[k][1]).cast("long")) % F.lit(PRIME).cast("long")
        return (t * t) % F.lit(PRIME).cast("long")

    def mixed(k: int):
        if k % 2:
            return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + hashed(s["l"], k)) % F.lit(b)).alias("r"))
        return lambda s: F.struct(((s["l"] + hashed(s["r"], k)) % F.lit(a)).alias("l"), s["r"].alias("r"))

    def once(x: Column) -> Column:
        state = F.array(F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).cast("long").alias("r")))
        for k in range(ROUNDS):  # mapped over an array of one: each round's halves are worked out once
            state = F.transform(state, mixed(k))
        return F.get(F.transform(state, lambda s: s["l"] * F.lit(b).cast("long") + s["r"]), 0)

    steps = F.sequence(F.lit(1), F.lit(min(a, MOST_STEPS)))
    stuck = F.raise_error(F.lit("a walk over the ranks did not end")).cast("long")

    def ended(x: Column) -> Column:
        """One place in b is too large at first; only such a row walks on."""
        walked = F.aggregate(steps, x, lambda y, _: F.when(y < n, y).otherwise(once(y)))
        return F.when(x < n, x).otherwise(F.get(F.transform(F.array(walked), lambda y: F.when(y < n, y).otherwise(stuck)), 0))

    return F.get(F.transform(F.array(once(rank.cast("long"))), ended), 0)


def permuted_ranks(n: int, seed: int, name: str) -> list[int]:
    """The same permutation in plain Python, for small n."""
    a, b = halves(n)
    keys = round_keys(seed, name)

    def once(x):
        left, right = divmod(x, b)
        for k, (m, c) in enumerate(keys):
            if k % 2:
                right = (right + ((left * m + c) % PRIME) ** 2 % PRIME) % b
            else:
                left = (left + ((right * m + c) % PRIME) ** 2 % PRIME) % a
        return left * b + right

    out = []
    for x in range(n):
        x = once(x)
        while x >= n:
            x = once(x)
        out.append(x)
    return out

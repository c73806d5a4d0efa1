"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: A key set is broadcast whole up to so many keys and so many bytes of keys.
MOST_KEYS = 1_000_000
MOST_KEY_BYTES = 32 << 20
#: Most 64-bit words of the filter that stands in for a larger set.
FILTER_WORDS = 1 << 19


def join_null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner equi-join on ``cols`` where NULL matches NULL (group and model keys may be NULL)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond).drop(*[f"_r_{c}" for c in cols])


class KeySet:
    """The distinct keys of a frame, written once, with their checked size.

    Nulls are left out, as they match nothing. ``small`` tells whether the set
    may be broadcast; a larger one filters by ``might_hold`` first, so only
    possible hits meet it in a shuffle.
    """

    def __init__(self, keys: DataFrame, on: str | Sequence[str], most_keys: int = MOST_KEYS, most_bytes: int = MOST_KEY_BYTES):
        self.on = [on] if isinstance(on, str) else list(on)
        self.keys = materialize(keys.select(*self.on).dropna().distinct())
        size = sum((F.octet_length(F.col(c).cast("string")) for c in self.on), F.lit(0))
        self.count, n_bytes = self.keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        self.small = self.count <= most_keys and n_bytes <= most_bytes

    def _place(self, n_words: int) -> tuple[Column, Column]:
        """Word of the filter and its bits for a key."""
        h = F.xxhash64(*self.on)
        mask = F.lit(0).cast("long")
        for i in range(4):
            at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
        return F.pmod(F.shiftrightunsigned(h, 24), F.lit(n_words)), mask

    def might_hold(self, big: DataFrame, n_words: int | None = None) -> DataFrame:
        """``big`` without most of the rows whose key is not in the set: a
        blocked Bloom filter (a word per row, 4 bits per key, ``FILTER_WORDS``
        rows at most) is broadcast, whatever the size of the set."""
        n_words = n_words or min(FILTER_WORDS, 1 << max(4, (self.count // 4).bit_length()))
        word, mask = self._place(n_words)
        words = self.keys.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_mask"))
        hit = (word == F.col("_word")) & (F.col("_mask").bitwiseAND(mask) == mask)
        return big.join(F.broadcast(words), hit, "left_semi")

    def semi_join(self, big: DataFrame) -> DataFrame:
        """Rows of ``big`` whose key is in the set."""
        if self.small:
            return big.join(F.broadcast(self.keys), self.on, "left_semi")
        return self.might_hold(big).join(self.keys, self.on, "left_semi")


def semi_join_keys(big: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """``big`` rows whose key is in ``keys``, without moving the other rows of
    ``big``: the distinct keys are written and counted (jobs), then broadcast
    if they are few; else a filter of bounded size comes before the join."""
    return KeySet(keys, on).semi_join(big)

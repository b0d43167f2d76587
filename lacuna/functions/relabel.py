"""Display labels: a seeded bijection of dense labels, as a column expression."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 24


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """A number for each round, whatever n is."""
    rng = random.Random(seed)
    return [rng.getrandbits(60) for _ in range(rounds)]


def shuffled(place: Column, n: int, seed: int = 0, rounds: int = ROUNDS) -> Column:
    """A permutation of 0..n-1 that the seed picks; null for null and for what lies outside.

    Each round pairs x with (key - x) mod n and swaps the two or not, by a hash bit of the larger one. That is a
    bijection for every n, so nothing is walked, sorted or joined.
    """
    keys = F.array(*[F.lit(k % max(1, n)).cast("long") for k in round_keys(seed, rounds)])

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.get(keys, r) - x, F.lit(n))
        bit = F.ascii(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), r.cast("string"), F.greatest(x, other).cast("string")).cast("binary")), 1, 1)) % 2
        return F.when(bit == 1, other).otherwise(x)

    inside = F.when((place >= 0) & (place < n), place.cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), inside, swap)


def display_labels(label: Column, n: int, seed: int = 0) -> Column:
    """Dense labels 0..n-1 as 1..n in a shuffled order, so that neighbours differ in colour; 0, the background, stays 0, and null (or -1) is null."""
    return F.when(label == 0, F.lit(0).cast("long")).otherwise(shuffled(label, n, seed) + 1)

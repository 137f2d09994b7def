"""Keyed permutations of 0 .. n-1 as columns, without a sort or a shuffle.

The numbers lie on a grid of two factors whose product is at least n. Four rounds add a keyed
hash of one coordinate to the other, modulo its factor, which permutes the grid; a number that
falls on one of the few places beyond n goes through the rounds again. Places beyond n are all
different on the way, so the walk ends after at most as many further steps as there are such places.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME, FACTOR, ROUNDS, TRIED = 2_147_483_647, 48_271, 4, 4096


def grid(n: int) -> tuple[int, int]:
    """Two factors about the root of n whose product is at least n, with the fewest places beyond n."""
    root = math.isqrt(max(n, 1) - 1) + 1
    tried = range(max((root + 1) // 2, root - TRIED + 1), root + 1)
    return min(((a, -(-n // a)) for a in tried), key=lambda f: (f[0] * f[1] - n, -f[0]))


def round_keys(seed: int, name: str) -> list[int]:
    """The keys of one permutation; another name gives an independent one."""
    draw = random.Random(f"{seed}:{name}")
    return [draw.randrange(1, PRIME) for _ in range(ROUNDS)]


def permuted(number: Column, n: int, keys: list[Column]) -> Column:
    """The place of ``number``, a long from 0 to n-1, under the permutation of these round keys.

    Whole Arrow batches go through the rounds: as column expressions the four rounds repeat each other
    and make a method of generated code that is too long for the JVM to compile.
    """
    a, b = grid(n)

    def mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
        square = (x + key) % PRIME
        return (square * square % PRIME * FACTOR + key) % PRIME

    def step(x: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
        left, right = x // b, x % b
        for i, key in enumerate(rounds):
            if i % 2 == 0:
                left = (left + mixed(right, key)) % a
            else:
                right = (right + mixed(left, key)) % b
        return left * b + right

    @F.arrow_udf("long")
    def places(number: pa.Array, *keys: pa.Array) -> pa.Array:
        known = number.is_valid().to_numpy(zero_copy_only=False)
        x = number.fill_null(0).to_numpy(zero_copy_only=False)
        rounds = [k.to_numpy(zero_copy_only=False) for k in keys]
        place = step(x, rounds)
        beyond = np.flatnonzero(known & (place >= n))
        while len(beyond):
            place[beyond] = step(place[beyond], [k[beyond] for k in rounds])
            beyond = beyond[place[beyond] >= n]
        return pa.array(place, pa.int64(), mask=~known)

    return places(number, *[k.cast("long") for k in keys])

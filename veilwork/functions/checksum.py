"""The decimal check digit of 12-digit ids: products in the dihedral group of the pentagon, over digits that are
permuted by their place from the right."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the place permutation takes the digits 0 to 9.
TURN = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _product(a: int, b: int) -> int:
    """0-4 are turns of the pentagon, 5-9 are flips."""
    turn = (a + b) % 5 if a < 5 else (a - b) % 5
    return turn + 5 * ((a >= 5) != (b >= 5))


PRODUCT = np.array([[_product(a, b) for b in range(10)] for a in range(10)], np.int8)
PLACE = [list(range(10))]
while len(PLACE) < 8:
    PLACE.append([TURN[d] for d in PLACE[-1]])
PLACE = np.array(PLACE, np.int8)
#: For each c the digit d with product 0.
INVERSE = PRODUCT.argmin(axis=1).astype(np.int8)


def fold(texts: list[str | None], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The fold of each text from the right, places counted from `shift` on, and whether it is all ASCII digits."""
    digits = np.array([t is not None and t.isascii() and t.isdigit() for t in texts], bool)
    length = np.array([len(t) if ok else 0 for t, ok in zip(texts, digits, strict=True)], np.int64)
    c = np.zeros(len(texts), np.int8)
    if digits.any():
        longest = int(length.max())
        flat = np.frombuffer("".join(t[::-1].ljust(longest, "x") if ok else "x" * longest for t, ok in zip(texts, digits, strict=True)).encode(), np.uint8).reshape(-1, longest)
        for i in range(longest):
            on = length > i
            c[on] = PRODUCT[c[on], PLACE[(i + shift) % 8][flat[on, i] - 48]]
    return c, digits


def change_counts(texts: list[str]) -> tuple[tuple[int, int], tuple[int, int]]:
    """Of all changes of one digit, and of all swaps of two different neighbours, in texts of ASCII digits: how many there are, how many no longer fold to 0.

    Products are associative, so a changed text's fold is (places before) x (changed places) x (places behind), counted from the right.
    """
    tried = np.zeros((2, 2), np.int64)
    by_length: dict[int, list[str]] = {}
    for t in texts:
        by_length.setdefault(len(t), []).append(t)
    for n, same in by_length.items():
        digits = np.frombuffer("".join(t[::-1] for t in same).encode(), np.uint8).reshape(-1, n).T - 48
        at = np.stack([PLACE[i % 8][digits[i]] for i in range(n)])
        before, behind = np.zeros((n + 1, len(same)), np.int8), np.zeros((n + 1, len(same)), np.int8)
        for i in range(n):
            before[i + 1] = PRODUCT[before[i], at[i]]
            behind[n - 1 - i] = PRODUCT[at[n - 1 - i], behind[n - i]]
        for i in range(n):
            for d in range(10):
                other = digits[i] != d
                found = PRODUCT[PRODUCT[before[i], PLACE[i % 8][d]], behind[i + 1]] != 0
                tried[0] += other.sum(), (other & found).sum()
            if i + 1 < n:
                other = digits[i] != digits[i + 1]
                pair = PRODUCT[PLACE[i % 8][digits[i + 1]], PLACE[(i + 1) % 8][digits[i]]]
                found = PRODUCT[PRODUCT[before[i], pair], behind[i + 2]] != 0
                tried[1] += other.sum(), (other & found).sum()
    return tuple(tuple(int(x) for x in row) for row in tried)


@F.arrow_udf(T.BooleanType())
def verhoeff_valid(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Whether a text of ASCII digits, of any length but 0, folds to 0; false for any other text and null."""
    for batch in batches:
        c, digits = fold(batch.to_pylist(), 0)
        yield pa.array(digits & (c == 0))


@F.arrow_udf(T.StringType())
def verhoeff_check_digit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The digit that makes a text valid when put behind it; null for texts that are not ASCII digits."""
    for batch in batches:
        texts = batch.to_pylist()
        c, digits = fold(texts, 1)
        digits |= np.array([t == "" for t in texts], bool)
        yield pa.array([str(INVERSE[x]) if ok else None for x, ok in zip(c, digits, strict=True)], pa.string())


def verhoeff_fold_sql(text: str, n: int, shift: int = 0) -> str:
    """SQL, for Spark as for DuckDB, of the fold of a text of n digits: for short plans without Python workers."""
    product = "".join(str(x) for x in PRODUCT.reshape(-1))
    c = "0"
    for i in range(n):
        place = "".join(str(x) for x in PLACE[(i + shift) % 8])
        digit = f"CAST(substr('{place}', CAST(substr({text}, {n - i}, 1) AS INT) + 1, 1) AS INT)"
        c = f"CAST(substr('{product}', {c} * 10 + {digit} + 1, 1) AS INT)"
    return c


def check_digit_sql(text: str, n: int) -> str:
    """SQL of the check digit, as text, of a text of n digits."""
    return f"substr('{''.join(str(x) for x in INVERSE)}', {verhoeff_fold_sql(text, n, 1)} + 1, 1)"


def verhoeff_valid_native(text: Column) -> Column:
    """verhoeff_valid by a higher-order fold inside the JVM: slower in bulk, but no Python worker."""
    product = F.lit("".join(str(x) for x in PRODUCT.reshape(-1)))
    place = F.lit("".join(str(x) for x in PLACE.reshape(-1)))
    pick = lambda table, at: F.substring(table, at + 1, F.lit(1)).cast("int")
    n = F.length(text)
    fold_ = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0),
        lambda c, i: pick(product, c * 10 + pick(place, (i % 8) * 10 + F.substring(text, n - i, F.lit(1)).cast("int"))),
    )
    return F.coalesce(F.when(text.rlike(r"^[0-9]+\z"), fold_ == 0), F.lit(False))


#: The products of two digits, by the place of the second from the right: every 12-digit text is six of them.
_PAIRS = [[int(PRODUCT[PLACE[i][n % 10], PLACE[i + 1][n // 10]]) for n in range(100)] for i in range(0, 8, 2)]


def verhoeff_valid12(digits: Column) -> Column:
    """verhoeff_valid for texts of 12 ASCII digits, which others must not get here, by tables that the plan holds: no Python worker, so rows stay dealt as they are. Null stays null."""
    table = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
    product, c = table(PRODUCT.reshape(-1)), None
    for j in range(6):
        pair = F.get(table(_PAIRS[j % 4]), F.substring(digits, 11 - 2 * j, 2).cast("int"))
        c = pair if c is None else F.get(product, c * 10 + pair)
    return c == 0


def register_functions(spark: SparkSession) -> None:
    """Make verhoeff_valid and verhoeff_check_digit callable from SQL in this session."""
    spark.udf.register("verhoeff_valid", verhoeff_valid)
    spark.udf.register("verhoeff_check_digit", verhoeff_check_digit)

"""String similarity as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity of two texts by code points; 0 where either is empty, null where either is null."""
    empty = F.array().cast("array<int>")

    def both(z: Column) -> Column:
        # z binds the letters once; inside a lambda they would be split again for every letter.
        x, y = z["x"], z["y"]
        window = z["w"]

        def step(acc: Column, c: Column) -> Column:
            lo, hi = F.greatest(acc["i"] - window, F.lit(1)), F.least(acc["i"] + window, F.size(y))
            free = F.when(lo <= hi, F.filter(F.sequence(lo, F.greatest(lo, hi)), lambda j: (F.element_at(y, j) == c) & ~F.array_contains(acc["used"], j))).otherwise(empty)
            return F.transform(
                F.array(F.try_element_at(free, F.lit(1))),
                lambda hit: F.named_struct(
                    F.lit("used"), F.when(hit.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], hit)),
                    F.lit("mine"), F.when(hit.isNull(), acc["mine"]).otherwise(F.array_append(acc["mine"], c)),
                    F.lit("i"), acc["i"] + 1,
                ),
            )[0]

        def finish(acc: Column) -> Column:
            theirs = F.transform(F.array_sort(acc["used"]), lambda j: F.element_at(y, j))
            m = F.size(acc["mine"]).cast("double")
            t = F.floor(F.size(F.filter(F.zip_with(acc["mine"], theirs, lambda p, q: p != q), lambda d: d)) / 2)
            return F.when(m == 0, F.lit(0.0)).otherwise((m / F.size(x) + m / F.size(y) + (m - t) / m) / 3)

        start = F.named_struct(F.lit("used"), empty, F.lit("mine"), F.array().cast("array<string>"), F.lit("i"), F.lit(1))
        return F.aggregate(x, start, step, finish)

    window = F.greatest(F.floor(F.greatest(F.length(a), F.length(b)) / 2).cast("int") - 1, F.lit(0))
    bound = F.array(F.named_struct(F.lit("x"), _chars(a), F.lit("y"), _chars(b), F.lit("w"), window))
    none = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(a.isNull() | b.isNull(), None).when(none, F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.transform(bound, both)[0])


def boost(j: Column, a: Column, b: Column) -> Column:
    """Winkler's addition for a common prefix of up to four characters, from a Jaro similarity of 0.7."""
    same = [F.substring(a, 1, k) == F.substring(b, 1, k) for k in range(1, 5)]
    long = [(F.length(a) >= k) & (F.length(b) >= k) for k in range(1, 5)]
    prefix = F.lit(0)
    for k in range(4, 0, -1):
        prefix = F.when(prefix > 0, prefix).otherwise(F.when(same[k - 1] & long[k - 1], k).otherwise(0))
    return F.when(j >= 0.7, j + prefix * 0.1 * (1 - j)).otherwise(j)


def jaro_winkler(a: Column, b: Column) -> Column:
    return F.transform(F.array(jaro(a, b)), lambda j: boost(j, a, b))[0]


def one_typo(a: Column, b: Column) -> Column:
    """At most one letter added, left out or replaced, or two neighbours exchanged."""
    d = F.levenshtein(a, b, 2)
    letters = lambda s: F.array_sort(F.split(s, ""))
    return (d >= 0) & ((d <= 1) | ((d == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b))))

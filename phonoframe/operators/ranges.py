"""An order cut into parts by bounds that are fixed once, so that every plan which names a row's part names the same one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Rows that a part holds at least, about; rows drawn for each part's bound.
LEAST_ROWS, DRAWN = 10_000, 60


def bounds(df: DataFrame, *order: str, parts: int, least_rows: int = LEAST_ROWS) -> list[Row]:
    """At most parts - 1 rows of the columns `order`, ascending, nulls first. From about DRAWN rows a part, however large df is.

    A key that holds more than a part's share of the rows is the bound of several parts.
    """
    n = df.count()
    parts = min(parts, n // least_rows)
    if parts < 2:
        return []
    drawn = df.select(*order).sample(fraction=min(1.0, parts * DRAWN / n), seed=17).orderBy(*order).collect()
    return [drawn[len(drawn) * k // parts] for k in range(1, parts)] if len(drawn) >= parts else []


def part(df: DataFrame, cuts: list[Row], *order: str) -> Column:
    """The number of a row's part, from 0 to len(cuts): parts ascend with `order`. Rows of a key that is the bound of several parts are dealt to those by a hash of all their columns."""
    if not cuts:
        return F.lit(0)
    kinds = [df.schema[c].dataType for c in order]
    at = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(row, kinds, order, strict=True)]) for row in cuts])
    key = F.struct(*order)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def count(below) -> Column:  # how many cuts are below the key, by halving
        step = lambda found, s: F.when((found + s <= len(cuts)) & below(F.get(at, found + s - 1)), found + s).otherwise(found)
        return F.aggregate(steps, F.lit(0), step)

    first = count(lambda cut: cut < key)
    if len({tuple(map(str, row)) for row in cuts}) == len(cuts):
        return first
    hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    return first + F.pmod(F.xxhash64(*hashed), count(lambda cut: cut <= key) - first + 1).cast("int")

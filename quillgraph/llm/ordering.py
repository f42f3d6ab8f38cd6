"""Order statistics of whole tables: the exact k-th key by digits, and numbers in order without a window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import written

#: Bits of a digit: the driver sees 2 ** DIGIT counts a pass at most.
DIGIT = 12
_SIGN, _ALL = -(1 << 63), (1 << 64) - 1


def kth(rows: DataFrame, keys: list[str], k: int) -> list[tuple[str, int]]:
    """Bounds of the k smallest of rows by its keys (longs without nulls, in this order): see ``within``.

    Radix selection: each pass counts one digit of the rows that agree in all
    digits before, and goes on with the digit that the k-th row has. Digits
    that all rows share are skipped, and passes end when all rows that are left
    belong to the k. The keys together must tell rows apart.
    """
    ends = rows.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(keys) for n, f in (("min", F.min), ("max", F.max)))).first()
    bounds, same = [], F.lit(True)
    for i, key in enumerate(keys):
        biased = F.col(key).bitwiseXOR(F.lit(_SIGN))
        low, high = ((ends[f"{n}{i}"] ^ _SIGN) & _ALL for n in ("min", "max"))
        bits = (low ^ high).bit_length()
        prefix = low >> bits
        while bits:
            bits -= min(DIGIT, bits)
            digit = F.shiftrightunsigned(biased, bits) if bits else biased
            counts = sorted((r["d"] & _ALL, r["n"]) for r in rows.filter(same).groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect())
            for prefix, n in counts:
                if k <= n:
                    break
                k -= n
            same = same & (digit == F.lit(prefix - (1 << 64) if prefix >> 63 else prefix))
            if n == k:
                return [*bounds, (key, _signed((prefix + 1 << bits) - 1))]
        bounds.append((key, _signed(prefix)))
        same = same & (F.col(key) == bounds[-1][1])
    return bounds


def _signed(biased: int) -> int:
    value = biased ^ (1 << 63)
    return value - (1 << 64) if value >> 63 else value


def within(bounds: list[tuple[str, int]]) -> Column:
    """Whether a row is not behind the bounds of ``kth``."""
    last, value = bounds[-1]
    return reduce(lambda rest, b: (F.col(b[0]) < b[1]) | ((F.col(b[0]) == b[1]) & rest), reversed(bounds[:-1]), F.col(last) <= value)


def numbered(rows: DataFrame, order: list, out: str, name: str, by: str | None = None) -> DataFrame:
    """rows in this order (by first, where it is given) with out = 0, 1, ..., anew for each value of by.

    One range sort, written; a row's number is its place in its part of the
    sort plus the rows of the parts before, of which there is one count a part
    (and value of by), so no window sees more than parts.
    """
    keys = [by] if by else []
    line = written(rows.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = line.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    # a row for each part of the sort, and one more a value of by: bounded by spark.sql.shuffle.partitions
    both = line.withColumn("_part", part).join(F.broadcast(starts), [*keys, "_part"])
    return both.withColumn(out, (F.col("_at") + F.col("_start")).cast("long")).drop("_at", "_part", "_start")

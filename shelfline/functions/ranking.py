"""Order statistics without a single-task sort.

A plain ``Window.orderBy`` without a partition, and ``percentile`` over a continuous column, pull
every row into one task. These helpers first collapse equal values to counts, cut the value range
at a small number of fixed bounds, and rank inside the buckets; only the per-bucket totals (as many
rows as there are bounds) meet in one place. Bounds only steer balance: results are exact for any
bounds, so a recomputed task can never change a rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SAMPLE_SIZE = 4096
SKETCH_ACCURACY = 10000


def range_bounds(df: DataFrame, column: str, buckets: int = 64) -> list:
    """At most ``buckets - 1`` cut values from a fixed-size hash sample of the column.

    Tables far above the sample size are thinned by hash first, so that tasks do not each offer a
    full sample.
    """
    known = df.select(column).where(F.col(column).isNotNull())
    share = min(1.0, 16 * SAMPLE_SIZE / max(known.count(), 1))
    if share < 1.0:
        known = known.where(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = (
        known
        .orderBy(F.xxhash64(column), column)
        .limit(SAMPLE_SIZE)
        .collect()
    )
    values = sorted({r[0] for r in rows})
    if len(values) < 2 * buckets:
        return values[::2][:buckets]
    step = len(values) / buckets
    return [values[int(i * step)] for i in range(1, buckets)]


def bucket_of(column: Column, bounds: Sequence) -> Column:
    """Number of bounds below the value; monotone in the value."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b) for b in bounds])
    return F.size(F.filter(cuts, lambda b: b < column))


def _offsets(bucketed: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Rows before each (key, bucket); at most one row per bound and key enters the window."""
    totals = bucketed.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_total"))
    span = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *keys, "_bucket", F.coalesce(F.sum("_total").over(span), F.lit(0)).alias("_offset")
    )


def cumulative_counts(
    df: DataFrame, column: str, keys: Sequence[str] = (), buckets: int = 64
) -> DataFrame:
    """One row per (keys, value): ``n`` rows hold it, ``before`` rows are smaller."""
    keys = list(keys)
    counts = cut_lineage(
        df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n")),
        "counts",
    )
    bounds = range_bounds(counts, column, buckets)
    bucketed = counts.withColumn("_bucket", bucket_of(F.col(column), bounds))
    inner = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(column)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        bucketed.withColumn("_inner", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        .join(_offsets(bucketed, keys, F.col("n")), [*keys, "_bucket"])
        .select(*keys, column, "n", (F.col("_inner") + F.col("_offset")).alias("before"))
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], column: str, name: str = "position", buckets: int = 64
) -> DataFrame:
    """``row_number`` by ``column`` (unique within keys) where a key may hold most of the rows."""
    keys = list(keys)
    df = cut_lineage(df, "numbered")
    bounds = range_bounds(df, column, buckets)
    bucketed = df.withColumn("_bucket", bucket_of(F.col(column), bounds))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(column)
    return (
        bucketed.withColumn("_inner", F.row_number().over(inner))
        .join(_offsets(bucketed, keys, F.lit(1)), [*keys, "_bucket"])
        .withColumn(name, (F.col("_inner") + F.col("_offset")).cast("long"))
        .drop("_bucket", "_inner", "_offset")
    )


def fractional_ranks(df: DataFrame, columns: dict[str, str], buckets: int = 64) -> DataFrame:
    """Share-of-rows rank with ties averaged, one new column per entry ``{source: target}``.

    Nulls get a null rank. The join back is on the value, from a table of distinct values.
    """
    total = df.select(*[F.count(c).alias(c) for c in columns]).first()
    out = df
    for source, target in columns.items():
        n_rows = max(total[source], 1)
        ranks = cumulative_counts(df, source, buckets=buckets).select(
            F.col(source), ((F.col("before") + (F.col("n") + 1) / 2) / n_rows).alias(target)
        )
        out = out.join(ranks, source, "left")
    return out


def quantiles(
    df: DataFrame, wanted: dict[str, float], small_bracket: int = 200_000
) -> dict[str, float | None]:
    """Exact quantiles with linear interpolation between neighbours, as plain numbers.

    First a mergeable sketch brackets each quantile; only the rows inside the bracket are then
    grouped by value. A narrow bracket is read off directly, a wide one is ranked by bucket.
    """
    edge = 2.0 / SKETCH_ACCURACY
    aggregates = []
    for name, p in wanted.items():
        value = F.col(name)
        aggregates += [
            F.count(value).alias(f"{name}__n"),
            F.percentile_approx(
                value, [max(p - edge, 0.0), min(p + edge, 1.0)], SKETCH_ACCURACY
            ).alias(f"{name}__bracket"),
            F.min(value).alias(f"{name}__min"),
            F.max(value).alias(f"{name}__max"),
        ]
    sketch = df.agg(*aggregates).first()

    ranks, brackets = {}, {}
    for name, p in wanted.items():
        if sketch[f"{name}__n"]:
            position = p * (sketch[f"{name}__n"] - 1)
            ranks[name] = (math.floor(position), position - math.floor(position))
            brackets[name] = tuple(sketch[f"{name}__bracket"])
    found = _pick(df, brackets, {n: r[0] for n, r in ranks.items()}, small_bracket)
    missed = {n: (sketch[f"{n}__min"], sketch[f"{n}__max"]) for n in brackets if n not in found}
    if missed:
        found |= _pick(df, missed, {n: ranks[n][0] for n in missed}, small_bracket)

    out: dict[str, float | None] = dict.fromkeys(wanted)
    for name, (first, second) in found.items():
        share = ranks[name][1]
        out[name] = float(first if second is None else first + (second - first) * share)
    return out


def _pick(
    df: DataFrame, brackets: dict[str, tuple], lefts: dict[str, int], small_bracket: int
) -> dict[str, tuple]:
    """Values at positions ``left`` and ``left + 1`` per column, for brackets that contain them."""
    if not brackets:
        return {}
    facts = []
    for name, (low, high) in brackets.items():
        value = F.col(name)
        facts += [
            F.count(F.when(value < low, 1)).alias(f"{name}__below"),
            F.count(F.when(value.between(low, high), 1)).alias(f"{name}__inside"),
            F.min(F.when(value > high, value)).alias(f"{name}__above"),
        ]
    stats = df.agg(*facts).first()
    out = {}
    for name, (low, high) in brackets.items():
        below, count = stats[f"{name}__below"], stats[f"{name}__inside"]
        first = lefts[name] - below
        if not 0 <= first < count:
            continue
        above = stats[f"{name}__above"]
        if low == high:
            out[name] = (low, low if first + 1 < count else above)
            continue
        inside = df.select(name).where(F.col(name).between(low, high))
        if count <= small_bracket:
            counts = inside.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(name).collect()
            ends, seen = [], 0
            for row in counts:
                ends.append((seen, seen + row["n"], row[0]))
                seen += row["n"]
        else:
            holds = lambda r: (F.col("before") <= r) & (F.col("before") + F.col("n") > r)
            rows = cumulative_counts(inside, name).where(holds(first) | holds(first + 1)).collect()
            ends = [(r["before"], r["before"] + r["n"], r[name]) for r in rows]
        at = {r: v for r in (first, first + 1) for low_, high_, v in ends if low_ <= r < high_}
        out[name] = (at[first], at.get(first + 1, above))
    return out

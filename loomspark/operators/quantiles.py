"""Exact order statistics by histogram refinement: no buffer grows with the rows.

Each round counts the rows of every wanted interval in BINS equal bins and keeps the bin that holds the
wanted rank, with its own least and largest value as the next interval, until that is one value. A
round is one aggregation with partial counts in every task, and brings at most BINS rows for each wanted
value to the driver. Nulls and NaN have no rank; without values a statistic is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 512


@dataclass
class _Sought:
    """The rank-th (from 0) of the values of column from lo to hi."""

    column: str
    rank: int
    lo: float
    hi: float


def ranks(kind: str, n: int) -> list[int]:
    """The ranks, from 0, whose mean is the median, or the one of the 95th percentile: index int(0.95 n)."""
    return {"median": [(n - 1) // 2, n // 2], "p95": [min(int(0.95 * n), n - 1)]}[kind]


def exact_quantiles(rows: DataFrame, wanted: dict[str, tuple[str, str]]) -> dict[str, float | None]:
    """wanted: name -> (numeric column, median or p95); the value of each name. rows are read once a round."""
    columns = sorted({c for c, _ in wanted.values()})
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    found = rows.agg(*[f(value[c]).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    stats = {c: (found[f"n_{i}"], found[f"lo_{i}"], found[f"hi_{i}"]) for i, c in enumerate(columns)}
    sought = {(c, r): _Sought(c, r, *stats[c][1:]) for c, kind in wanted.values() if stats[c][0] for r in ranks(kind, stats[c][0])}
    while open_ := {k: s for k, s in sought.items() if s.lo < s.hi}:
        keys = list(open_)
        each = F.array(*[F.struct(F.lit(i).alias("t"), value[s.column].alias("v"), F.lit(s.lo).alias("lo"), F.lit(s.hi).alias("hi")) for i, s in enumerate(open_.values())])
        part = rows.select(F.explode(each).alias("x")).select("x.*").filter("v between lo and hi")
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: a difference does not overflow
        bins = part.groupBy("t", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(bins, key=lambda r: (r.t, r.bin)):
            s = open_.get(keys[r.t])
            if s is None:
                continue
            if s.rank < r.n:
                s.lo, s.hi = r.lo, r.hi
                del open_[keys[r.t]]
            else:
                s.rank -= r.n
    out = {}
    for name, (c, kind) in wanted.items():
        values = [sought[c, r].lo for r in ranks(kind, stats[c][0])] if stats[c][0] else []
        out[name] = values[0] / 2 + values[-1] / 2 if len(values) > 1 and values[0] != values[-1] else values[0] if values else None
    return out

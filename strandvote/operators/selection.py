"""Exact order statistics of many columns and groups by repeated bracketing.

The first pass counts the values of each group and column and takes a mergeable sketch of them, whose rank
error is bounded; two of its thousand quantiles bracket each wanted rank. Each further pass counts, for all
wanted ranks at once, the values up to the lower and below the upper end, and sketches what lies strictly
between; a rank that falls on an end is found, any other is bracketed closer. What lies between shrinks to
a three-hundredth a pass, whatever the values are, as the ends themselves, ties included, are only counted.
When no bracket holds over HELD values, those are counted one by one and summed in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

#: Quantiles and accuracy of a sketch; values that one window holds at most.
GRID, ACCURACY, HELD = 1000, 10_000, 500_000
INF = float("inf")


def _beside(rows: DataFrame, state: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of their group; null keys meet null keys, and without keys there is one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(state))
    state = state.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return rows.join(state, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], how).drop(*[f"_k_{k}" for k in keys])


def _sketch(value: Column) -> Column:
    return F.percentile_approx(value, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), F.lit(ACCURACY))


def _narrowed(t: str, grid: Column, rank: Column, n: Column) -> list[Column]:
    """The ends around a rank among n values, by a grid of their quantiles; one grid step to either side covers the sketch's error."""
    at = F.floor(rank * GRID / n).cast("int")
    lo = F.when(at >= 1, F.try_element_at(grid, at)).otherwise(F.col(f"lo_{t}"))
    hi = F.when(at + 3 <= GRID + 1, F.try_element_at(grid, at + 3)).otherwise(F.col(f"hi_{t}"))
    return [lo.alias(f"lo_{t}"), hi.alias(f"hi_{t}")]


def brackets(rows: DataFrame, targets: dict[str, tuple[str, float, int]], keys: list[str], held: int = HELD) -> DataFrame:
    """By group of keys and for each target t (column, quantile, 0 or 1): lo_t, hi_t, rank_t, n_t (its values), le_t (those up to lo_t), in_t (those between) and value_t, where it is found.

    rank_t is floor(quantile * (n - 1)) plus the target's number, from 0, and no more than n - 1.
    """
    columns = sorted({c for c, _, _ in targets.values()})
    first = rows.groupBy(*keys).agg(*[x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.count_if(F.col(c) == -INF).alias(f"least_{c}"), _sketch(F.when(F.col(c) > -INF, F.col(c))).alias(f"g_{c}"))])
    begin = []
    for t, (c, p, more) in targets.items():
        n, le = F.col(f"n_{c}"), F.col(f"least_{c}")
        rank = F.least(F.floor(F.lit(p) * (n - 1)).cast("long") + more, n - 1)
        begin += [F.lit(-INF).alias(f"lo_{t}"), F.lit(float("nan")).alias(f"hi_{t}"), rank.alias(f"rank_{t}"), n.alias(f"n_{t}"), le.alias(f"le_{t}"), (n - le).alias(f"in_{t}")]
        begin.append(F.when((rank >= 0) & (rank < le), F.lit(-INF)).alias(f"value_{t}"))
    state = first.select(*keys, *begin, *[F.col(f"g_{c}").alias(f"g_{t}") for t, (c, _, _) in targets.items()])
    state = stored(state, "brackets")
    open_ = lambda t: F.col(f"value_{t}").isNull() & (F.col(f"in_{t}") > held)
    while state.agg(F.max(F.greatest(F.lit(0), *[open_(t).cast("int") for t in targets]))).first()[0]:
        ends = []
        for t in targets:
            lo, hi = _narrowed(t, F.col(f"g_{t}"), F.col(f"rank_{t}") - F.col(f"le_{t}"), F.col(f"in_{t}"))
            ends += [F.when(open_(t), lo).otherwise(F.col(f"lo_{t}")).alias(f"lo_{t}"), F.when(open_(t), hi).otherwise(F.col(f"hi_{t}")).alias(f"hi_{t}"), F.col(f"rank_{t}"), F.col(f"n_{t}"), F.col(f"value_{t}")]
        ends = state.select(*keys, *ends)
        sums = []
        for t, (c, _, _) in targets.items():
            v, lo, hi = F.col(c), F.col(f"lo_{t}"), F.col(f"hi_{t}")
            sums += [F.count_if(v <= lo).alias(f"le_{t}"), F.count_if(v < hi).alias(f"lt_{t}"), _sketch(F.when((v > lo) & (v < hi), v)).alias(f"g_{t}")]
            sums += [F.first(c).alias(c) for c in (f"lo_{t}", f"hi_{t}", f"rank_{t}", f"n_{t}", f"value_{t}")]
        counted = _beside(rows, ends, keys).groupBy(*keys).agg(*sums)
        after = []
        for t in targets:
            rank, le, lt = F.col(f"rank_{t}"), F.col(f"le_{t}"), F.col(f"lt_{t}")
            value = F.coalesce(f"value_{t}", F.when((rank >= 0) & (rank < le), F.col(f"lo_{t}")).when(rank >= lt, F.col(f"hi_{t}")))
            after += [*[F.col(f"{c}_{t}") for c in ("lo", "hi", "rank", "n", "le", "g")], (lt - le).alias(f"in_{t}"), value.alias(f"value_{t}")]
        state = stored(counted.select(*keys, *after), "brackets")
    return state


def _between(rows: DataFrame, state: DataFrame, targets: dict[str, tuple[str, float, int]], keys: list[str]) -> DataFrame:
    """keys, _t (target), _k (rank inside), _v and _c, the count of each value inside the bracket of a rank that isn't found."""
    entry = lambda t, c: F.when(F.col(f"value_{t}").isNull() & (F.col(c) > F.col(f"lo_{t}")) & (F.col(c) < F.col(f"hi_{t}")), F.struct(F.lit(t).alias("_t"), F.col(c).alias("_v"), (F.col(f"rank_{t}") - F.col(f"le_{t}")).alias("_k")))
    inside = F.array_compact(F.array(*[entry(t, c) for t, (c, _, _) in targets.items()]))
    near = _beside(rows, state, keys).select(*keys, F.explode(inside).alias("_e")).select(*keys, "_e.*")
    return near.groupBy(*keys, "_t", "_k", "_v").agg(F.count("*").alias("_c"))


def quantiles(df: DataFrame, asks: dict[str, tuple[str, float]], keys: list[str] | None = None, held: int = HELD) -> DataFrame:
    """keys and a column for each of asks (name: column, quantile), by linear interpolation; without keys one row.

    Null and NaN don't count; a column without values gives null. It runs a pass over df for each round, and
    one more; in all of them all groups and asks go together.
    """
    keys = keys or []
    columns = {c: f"_c{i}" for i, c in enumerate(sorted({c for c, _ in asks.values()}))}
    rows = df.select(*keys, *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(v) for c, v in columns.items()])
    targets = {f"{i}{s}": (columns[c], p, more) for i, (c, p) in enumerate(asks.values()) for s, more in (("a", 0), ("b", 1))}
    state = brackets(rows, targets, keys, held)
    upto = F.sum("_c").over(W.partitionBy(*keys, "_t").orderBy("_v"))  # the values of one bracket
    found = _between(rows, state, targets, keys).withColumn("_upto", upto).where("_upto > _k").groupBy(*keys, "_t").agg(F.min("_v").alias("_v"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_t") == t, F.col("_v"))).alias(f"near_{t}") for t in targets])
    out, values = _beside(state, wide, keys, "left"), []
    for i, (name, (_, p)) in enumerate(asks.items()):
        at = F.lit(p) * (F.col(f"n_{i}a") - 1)
        place = F.floor(at)
        a, b = (F.coalesce(f"value_{i}{s}", f"near_{i}{s}") for s in "ab")
        values.append(F.when(at == place, a).otherwise((place + 1 - at) * a + (at - place) * b).alias(name))
    return out.select(*keys, *values)

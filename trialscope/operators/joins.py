"""Joins and grids.

Equi-joins only; no cartesian products of data-sized tables.  Tables that grow with
the data (per-worker flags, estimates) get no broadcast hint: AQE measures the real
shuffle size at run time and switches to a broadcast join only under
``spark.sql.adaptive.autoBroadcastJoinThreshold``.  Grids are built with
``explode(sequence)`` / ``explode(array)`` from bounded design factors.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.operators.aggregates import apply_exclusions  # noqa: F401  (C1 lives with D10)
from trialscope.session import cut_lineage


# C2 ------------------------------------------------------------------------
def join_draw_stats(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two per-draw tables (slopes x intercepts) on keys + draw."""
    return a.join(b, list(keys), "full")


# C3 ------------------------------------------------------------------------
def rate_table(a: DataFrame, b: DataFrame, keys: Sequence[str], fill: dict | None = None) -> DataFrame:
    out = a.join(b, list(keys), "full")
    return out.fillna(fill) if fill else out


# C4 ------------------------------------------------------------------------
def scaled_key(c, digits: int = 3) -> Column:
    """A double made into an exact integer key (x * 10^digits, half to even)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.bround(col * (10 ** digits), 0).cast("long")


def drop_combinations(df: DataFrame, remove: DataFrame, keys: Sequence[str], digits: int = 3) -> DataFrame:
    """Anti join on double keys, compared as scaled integers."""
    l = df.withColumns({f"_k{i}": scaled_key(k, digits) for i, k in enumerate(keys)})
    r = remove.select(*[scaled_key(k, digits).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    return l.join(r, [f"_k{i}" for i in range(len(keys))], "left_anti").drop(*[f"_k{i}" for i in range(len(keys))])


# C5 / D14 ------------------------------------------------------------------
def duplicate_counts(trials: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many responses match each grid row: count per key, right-joined to the grid.

    Same numbers as the reference's many-to-many right join then count, without
    materialising the matched pairs.
    """
    per = trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matches"))
    return per.join(grid, list(keys), "right").fillna(0, ["n_matches"])


# C6 ------------------------------------------------------------------------
def join_rounded(a: DataFrame, b: DataFrame, col_a: str, col_b: str, digits: int = 3, how: str = "full",
                 extra: Sequence[str] = ()) -> DataFrame:
    """Join on a double rounded to ``digits`` (as an exact integer key)."""
    la = a.withColumn("_rk", scaled_key(col_a, digits))
    rb = b.withColumn("_rk", scaled_key(col_b, digits))
    return la.join(rb, ["_rk", *extra], how).drop("_rk")


# C7 ------------------------------------------------------------------------
def join_estimates(df: DataFrame, est: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(est, list(keys), "left")


# C8 ------------------------------------------------------------------------
def join_checked(a: DataFrame, b: DataFrame, keys: Sequence[str], check: Sequence[tuple[str, str]]) -> DataFrame:
    """Keyed join with a per-row equality check of columns that must agree.

    Returns the joined rows plus ``_mismatch``; ``mismatches(df)`` counts them (the
    reference binds by position and prints a warning; position has no meaning here).
    """
    j = a.alias("l").join(b.alias("r"), list(keys), "inner")
    bad = F.lit(False)
    for ca, cb in check:
        bad = bad | ~F.col(f"l.{ca}").eqNullSafe(F.col(f"r.{cb}"))
    return j.withColumn("_mismatch", bad)


# C9 ------------------------------------------------------------------------
def keep_workers(df: DataFrame, workers: DataFrame, worker: str = "worker_id") -> DataFrame:
    return df.join(workers.select(worker).distinct(), worker, "left_semi")


# C10 -----------------------------------------------------------------------
def replicate_rows(df: DataFrame, k, out: str = "copy") -> DataFrame:
    """Every row ``k`` times (``k`` an int or a column): ``explode(sequence)``, no cross join."""
    kk = F.lit(k) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k)
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), kk)))


def expand_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Every row once per listed value (``crossing`` with a literal vector)."""
    return df.withColumn(col, F.explode(F.array(*[F.lit(v) for v in values])))


# C11 -----------------------------------------------------------------------
def full_grid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All combinations of the distinct values of ``cols`` (ungrouped ``data_grid``), NULL left out.

    The grid is a range of cell numbers, whose digits are joined to each column's dictionary: only the numbers of values
    reach the driver, and neither a column's values nor the grid ever stand in one row or one task.
    """
    from trialscope.operators.clean import dictionary
    seen = cut_lineage(df.select(*cols).distinct())
    books = {c: cut_lineage(dictionary(seen, c, f"_at_{c}")) for c in cols}
    sizes = {c: book.count() for c, book in books.items()}
    grid, below = df.sparkSession.range(math.prod(sizes.values())), 1
    for c in cols:
        grid = grid.withColumn(f"_at_{c}", F.expr(f"(id div {below}) % {max(1, sizes[c])}"))
        below *= max(1, sizes[c])
    for c, book in books.items():
        grid = grid.join(book, f"_at_{c}")
    return grid.select(*cols)


# C14 -----------------------------------------------------------------------
def level_pairs(df: DataFrame, by: str, levels: Sequence, keys: Sequence[str], value: str) -> DataFrame:
    """Every two levels of ``by`` in their order within each (keys): left, right and right's value less left's.

    An equi-join on the keys (draw among them), whose rows are one a level, with the index inequality as its condition.
    """
    at = F.array_position(F.array(*map(F.lit, levels)), F.col(by))
    side = df.where(at > 0).select(*keys, F.col(by).alias("_by"), at.alias("_i"), F.col(value).alias("_v"))
    left, right = (side.withColumnsRenamed({c: f"{n}{c}" for c in ("_by", "_i", "_v")}) for n in ("l", "r"))
    pairs = left.join(right, list(keys)).where("l_i < r_i")
    return pairs.select(*keys, F.col("l_by").alias("left"), F.col("r_by").alias("right"), (F.col("r_v") - F.col("l_v")).alias(value))


# C12 -----------------------------------------------------------------------
def group_grid(df: DataFrame, keys: Sequence[str], values: dict[str, Sequence]) -> DataFrame:
    """Observed key combinations x given values (grouped ``data_grid``)."""
    out = df.select(*keys).distinct()
    for c, vs in values.items():
        out = expand_values(out, c, vs)
    return out


# C13 -----------------------------------------------------------------------
def range_grid(df: DataFrame, keys: Sequence[str], col: str, n: int) -> DataFrame:
    """``n`` equally spaced values over each group's observed range of ``col``."""
    rng = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / (n - 1)
    return (rng.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn(col, F.when(F.col("_i") == n - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("_i") * step))
            .drop("_lo", "_hi", "_i"))

"""Windows, sorts, set operations and reshaping.

Windows are always partitioned by a data key (worker, group) so no window pulls a
whole table into one task; an explicit order is always given, since Spark rows have
none.  Pivots take their value list explicitly (no extra distinct job, bounded width).
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.operators import ranks


# E1 ------------------------------------------------------------------------
def lag_by(df: DataFrame, part: Sequence[str], order: Sequence, col: str, default=None, out: str | None = None,
           offset: int = 1) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    v = F.lag(col, offset).over(w)
    if default is not None:
        v = F.coalesce(v, F.lit(default))
    return df.withColumn(out or f"prev_{col}", v)


# E2 ------------------------------------------------------------------------
def top_n_per_group(df: DataFrame, keys: Sequence[str], col: str, n: int) -> DataFrame:
    """dplyr ``top_n``: rows whose value ranks in the top ``n`` (ties kept)."""
    w = Window.partitionBy(*keys).orderBy(F.col(col).desc())
    return df.withColumn("_r", F.rank().over(w)).filter(F.col("_r") <= n).drop("_r")


# E3 ------------------------------------------------------------------------
def ranked(df: DataFrame, part: Sequence[str], order: Sequence, method: str = "rank", out: str = "rank") -> DataFrame:
    """Rank of each row in its group. ``rank`` of column names counts rows before a value by ranges, so no task reads a group."""
    if method == "rank" and all(isinstance(c, str) for c in order):
        values = df.groupBy(*part, *order).agg(F.count(F.lit(1)).alias("_c"))
        at = ranks.running(values, part, order, F.col("_c")).select(
            *(F.col(c).alias(f"_of_{c}") for c in (*part, *order)), (F.col("_before") + 1).cast("int").alias(out))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*part, *order)))
        return df.join(at, same).select(*df.columns, out)
    w = Window.partitionBy(*part).orderBy(*order)
    fn = {"rank": F.rank, "row_number": F.row_number, "dense_rank": F.dense_rank}[method]
    return df.withColumn(out, fn().over(w).cast("int"))


# E4 ------------------------------------------------------------------------
def arrange(df: DataFrame, *order) -> DataFrame:
    """Total sort (range-partitioned by Spark); use only for final output."""
    return df.orderBy(*order)


# E5 ------------------------------------------------------------------------
def union_rows(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# E6 ------------------------------------------------------------------------
def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*cols) if cols else df).distinct()


# E7 ------------------------------------------------------------------------
def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, key: str = "key",
            value: str = "value") -> DataFrame:
    """``gather``: every non-id column (or the listed ones) to (key, value) rows."""
    values = list(values) if values else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), values, key, value)


# E8 ------------------------------------------------------------------------
def to_wide(df: DataFrame, keys: Sequence[str], key: str, value: str, levels: Sequence) -> DataFrame:
    """``spread`` with a listed level set: one conditional aggregate per level, one pass."""
    return df.groupBy(*keys).pivot(key, list(levels)).agg(F.first(value))


# E9 ------------------------------------------------------------------------
def unite(df: DataFrame, out: str, cols: Sequence[str], sep: str = "_", drop: bool = True) -> DataFrame:
    res = df.withColumn(out, F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]))
    return res.drop(*cols) if drop else res


# E10 -----------------------------------------------------------------------
def unnest(df: DataFrame, cols: Sequence[str], pos: str | None = None) -> DataFrame:
    """Unnest one or several equal-length array columns together (row-aligned)."""
    keep = [c for c in df.columns if c not in cols]
    z = F.arrays_zip(*[F.col(c) for c in cols])
    if pos:
        ex = df.select(*keep, F.posexplode(z).alias(pos, "_z"))
        return ex.select(*keep, (F.col(pos) + 1).cast("int").alias(pos), *[F.col("_z")[c].alias(c) for c in cols])
    ex = df.select(*keep, F.explode(z).alias("_z"))
    return ex.select(*keep, *[F.col("_z")[c].alias(c) for c in cols])


# E11 -----------------------------------------------------------------------
def spread_draws(df: DataFrame, keys: Sequence[str], col: str, index: str, value: str) -> DataFrame:
    """A vector parameter per draw to long rows with its (1-based) index."""
    ex = df.select(*keys, F.posexplode(col).alias("_i", value))
    return ex.select(*keys, (F.col("_i") + 1).cast("int").alias(index), value)


# E12 -----------------------------------------------------------------------
def for_each_level(df: DataFrame, key: str, summary) -> DataFrame:
    """One result per level in a single grouped job (never a driver loop over levels):
    ``summary`` is a function of the grouping keys returning aggregate Columns."""
    return df.groupBy(key).agg(*summary())


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c

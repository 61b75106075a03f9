"""Positions, running sums, lags and quantiles in an order, without a task that reads a whole group.

Rows are dealt to ranges of the order (a range exchange, materialised once).  What a row needs from its group's earlier
rows comes from a small table of one row a (group, range): sums, or the last value; only the rest is a window, and that
over one group's share of one range.  A group of a third of all rows lies in a third of the ranges.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.session import cut_lineage

#: bits of a row's number within its range, as ``monotonically_increasing_id`` lays them out
ROW_BITS = 33


def _names(by: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in by]


def ordered(df: DataFrame, by: list[Column | str], name: str = "_at", ranges: int | None = None) -> DataFrame:
    """``df`` with its 0-based position in the order ``by`` as ``name`` (long), materialised once.

    Rows that tie in every column of ``by`` lie in one range: give an id as the last one, or aggregate equal rows first.
    """
    by = _names(by)
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    dealt = cut_lineage(dealt.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, ROW_BITS)
    counts = dealt.groupBy(part.alias("_range")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = counts.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    at = F.col(name).bitwiseAND((1 << ROW_BITS) - 1) + F.col("_before")
    joined = dealt.join(F.broadcast(before), part == F.col("_range"))
    return joined.select(*(F.col(c) for c in df.columns), at.alias(name))


def ranged(df: DataFrame, by: list[Column | str], ranges: int | None = None) -> DataFrame:
    """``df`` dealt to ranges of the order ``by``, with each row's range as ``_range`` (int), materialised once."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(ranges, *_names(by)).withColumn("_range", F.spark_partition_id()))


def _on_range(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns that ``side`` has for its (keys, ``_range``); NULL keys meet NULL keys."""
    side = side.withColumnsRenamed({k: f"_of_{k}" for k in keys} | {"_range": "_of_range"})
    same = [F.col("_range") == F.col("_of_range"), *(F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys)]
    return df.join(side, reduce(lambda a, b: a & b, same), how).drop("_of_range", *(f"_of_{k}" for k in keys))


def _part_sums(dealt: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """keys, ``_range``, ``_own`` (the weight there), ``_before`` (in earlier ranges) and ``_total``: a row a (group, range)."""
    own = dealt.groupBy(*keys, "_range").agg(F.sum(weight).alias("_own"))
    group = Window.partitionBy(*keys)  # as many rows as ranges at most
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumns({"_before": F.coalesce(F.sum("_own").over(earlier), F.lit(0)), "_total": F.sum("_own").over(group)})


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weight: Column | None = None,
            ranges: int | None = None) -> DataFrame:
    """``df`` with ``_before``: the weight (default: rows) of its group's rows before it in ``order``, and ``_total`` of the group.

    Give an id as the last column of ``order`` where many rows tie, else ties lie in one range (as in ``ordered``).
    """
    weight = F.lit(1) if weight is None else weight
    keys, order = list(keys), _names(list(order))
    dealt = ranged(df, [*keys, *order], ranges)
    out = _on_range(dealt, _part_sums(dealt, keys, weight).drop("_own"), keys)
    here = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("_before", F.col("_before") + F.coalesce(F.sum(weight).over(here), F.lit(0))).drop("_range")


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], cols: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``prev_<col>``: each column's value in the group's row before, NULL in its first row.

    The first row of a range takes the last row of the group's range before: a row a (group, range).
    """
    keys, order = list(keys), _names(list(order))
    dealt = ranged(df, [*keys, *order], ranges)
    value = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(cols)))
    last = dealt.groupBy(*keys, "_range").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    last = last.withColumn("_last", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")))
    out = _on_range(dealt, last, keys)
    here = Window.partitionBy(*keys, "_range").orderBy(*order)
    first = F.row_number().over(here) == 1
    return out.withColumns({f"prev_{c}": F.when(first, F.col(f"_last.c{i}")).otherwise(F.lag(c).over(here)) for i, c in enumerate(cols)}
                           ).drop("_range", "_last")


def quantiles(df: DataFrame, col: str, ps: Sequence[float], keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Exact type-7 quantiles (R default) per group by distributed selection, long form ``(keys, p, q)``.

    The distinct values with their counts are dealt to ranges; the ranges' counts tell in which one each wanted rank lies,
    and only these are sorted.  NULLs are left out.
    """
    keys = list(keys)
    freq = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = ranged(freq, [*keys, "_v"], ranges)
    place = [(F.col("_total") - 1) * F.lit(float(p)) for p in ps]
    targets = F.array(*(F.struct(F.lit(float(p)).alias("p"), end.alias("upper"), edge(h).cast("long").alias("at"), (h - F.floor(h)).alias("part"))
                        for p, h in zip(ps, place) for end, edge in ((F.lit(False), F.floor), (F.lit(True), F.ceil))))
    wanted = _part_sums(dealt, keys, F.col("_c")).select(
        *keys, "_range", "_before", F.filter(targets, lambda t: (t["at"] >= F.col("_before")) & (t["at"] < F.col("_before") + F.col("_own"))).alias("_t"))
    near = _on_range(dealt, wanted.where(F.size("_t") > 0), keys)
    here = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("_upto", F.col("_before") + F.sum("_c").over(here))
    hit = near.select(*keys, "_v", F.explode(F.filter("_t", lambda t: (t["at"] < F.col("_upto")) & (t["at"] >= F.col("_upto") - F.col("_c")))).alias("_t"))
    two = hit.groupBy(*keys, F.col("_t.p").alias("p")).agg(
        F.max(F.when(~F.col("_t.upper"), F.col("_v"))).alias("_a"), F.max(F.when(F.col("_t.upper"), F.col("_v"))).alias("_b"), F.first("_t.part").alias("_f"))
    return two.select(*keys, "p", (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("q"))

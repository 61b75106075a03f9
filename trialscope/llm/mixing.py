"""Mixing sources to target weights by hierarchical budgets. DataFrame functions only.

The token budget runs down a tree of levels (domain, language, source): at each node the children share it by
their weights, and a child whose subtree cannot take its share (tokens times ``max_epochs``) is filled and its
shortage shared among its siblings, before any of it reaches the next ancestor's children. A leaf spends its
budget on whole epochs and on a token-prefix of one more, in an order seeded by epoch and id. All sums are
integers, so that every engine and retry agrees.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut, whole_row

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
#: a leaf's epoch order is cut into 16 ** HEX ranges, so that no leaf is summed in one task
HEX = 3


def domain_of(source: Column) -> Column:
    """Domain of a source name of the documents table: by the number in it, modulo 4; ``other`` without one."""
    digits = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(digits == "", "other").otherwise(F.concat(F.lit("d"), (F.substring(digits, -9, 9).cast("int") % 4).cast("string")))


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    """Whole weight of a node among its siblings, by its name; 1 where ``weights`` says nothing."""
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map([F.lit(x) for name, w in weights.items() for x in (name, int(w))])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1)).cast("long")


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: Mapping[str, Mapping[str, int]], total: Column,
            max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with ``budget``: each leaf's share of ``total`` tokens.

    The plan of a level reads the one above several times, so each level (a row a node) is written out.
    """
    names = list(levels)
    caps = leaves.withColumns({f"w_{name}": _weight(name, weights.get(name, {})) for name in names})
    # a node without weight takes nothing, and none of its parent's room
    caps = cut(caps.withColumn("cap", F.when(F.least(*[F.col(f"w_{n}") for n in names], F.lit(1)) > 0, F.col("tokens") * max_epochs)
                               .otherwise(F.lit(0).cast("long"))))
    above = cut(caps.agg(F.least(F.sum("cap"), total).alias("budget")))
    for depth in range(1, len(names) + 1):
        path, parent = names[:depth], names[:depth - 1]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"w_{path[-1]}").alias("w"))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(above)
        by = Window.partitionBy(*parent, "budget")
        fill = by.orderBy((F.col("cap") / F.when(F.col("w") > 0, F.col("w"))).asc_nulls_last(), names[depth - 1])
        before = fill.rowsBetween(Window.unboundedPreceding, -1)
        nodes = (nodes.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
                 .withColumn("w_left", F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0)))
                 .withColumn("full", (F.col("w") > 0) & (F.col("cap") * F.col("w_left") <= (F.col("budget") - F.col("cap_before")) * F.col("w")))
                 .withColumn("spent", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by))
                 .withColumn("w_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(by)))
        share = F.when(F.col("full"), F.col("cap")).when(F.col("w") > 0, F.expr("w * (budget - spent) div w_open")).otherwise(F.lit(0))
        above = cut(nodes.select(*path, F.least(share, "cap").cast("long").alias("budget")))
    return caps.select(*names, "tokens").join(above, names)


def plan(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int = 1,
         seed: int = 0, id_col: str = "doc_id", text_col: str = "text", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(id, t, levels, n_tokens, rows, copies): how often each document (id and text hash t) is taken.

    The budget is ``share`` (numerator, denominator) of all tokens; a token is a word. ``weights`` gives, by level
    and name, whole weights relative to siblings (1 where absent, 0 takes nothing). Null levels are named
    ``none``; null texts have no tokens. Rows equal in id, text and levels are ``rows`` copies of one document
    and are taken together. Documents without tokens are taken wherever the order reaches them. Ties in the seeded
    order (equal ids) are broken by the text hash. An empty table gives an empty plan.
    """
    names = list(levels)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in names],
                       F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    items = cut(rows.groupBy("id", "t", *names).agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("rows")))
    items = items.withColumn("cost", F.col("n_tokens") * F.col("rows"))
    leaves = items.groupBy(*names).agg(F.sum("cost").alias("tokens"))
    total = F.expr(f"(sum(tokens) * {int(share[0])}) div {int(share[1])}")
    leaves = budgets(leaves, levels, weights, total, max_epochs)
    # a leaf without tokens has no epochs to count
    leaves = leaves.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("long")))
    leaves = cut(leaves.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")))
    taken = items.join(leaves.select(*names, "epochs", "rest"), names)
    spot = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("none"))).cast("binary"))
    taken = taken.withColumn("spot", spot).withColumn("range", F.substring("spot", 1, HEX))
    sums = taken.groupBy(*names, "range").agg(F.sum("cost").alias("sum"))
    earlier = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy(*names, "range").orderBy("spot", "t").rowsBetween(Window.unboundedPreceding, 0)
    taken = taken.join(sums, [*names, "range"]).withColumn("upto", F.col("before") + F.sum("cost").over(within))
    copies = F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("upto") <= F.col("rest")), 1).otherwise(0)
    return taken.select("id", "t", *names, "n_tokens", "rows", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int = 1, seed: int = 0,
        id_col: str = "doc_id", text_col: str = "text", levels: Mapping[str, Column] | None = None) -> DataFrame:
    """The rows of ``docs`` as often as ``plan`` takes them, all columns; ``levels`` names and computes the levels."""
    levels = levels or {c: F.col(c) for c in LEVELS}
    # the input's columns travel in one struct, whatever their names; the levels are l0, l1, ... beside it
    hidden = {f"l{i}": F.coalesce(column.cast("string"), F.lit("none")) for i, column in enumerate(levels.values())}
    number = {name: f"l{i}" for i, name in enumerate(levels)}
    leveled = docs.select(whole_row(docs), F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("words"),
                          *[column.alias(name) for name, column in hidden.items()])
    chosen = plan(leveled.drop("row"), {number[k]: v for k, v in weights.items() if k in number}, share, max_epochs, seed, "key", "words", tuple(hidden))
    chosen = chosen.where("copies > 0")
    keyed = leveled.withColumn("hash", F.xxhash64("words")).drop("words")
    joined = keyed.alias("d").join(chosen.alias("p"), F.col("d.key").eqNullSafe(F.col("p.id")) & (F.col("d.hash") == F.col("p.t"))
                                   & F.expr(" AND ".join(f"d.{c} = p.{c}" for c in hidden)))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")

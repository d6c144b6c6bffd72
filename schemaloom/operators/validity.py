"""Which remapped dependencies hold on target rows: one relation for all targets and dependencies.

Rows meet the dependencies that are asked about on their case, and each pair gives hashed keys (two of an
IND, one of the others), which combine before the one shuffle. Nothing but the verdicts, a row a
dependency, leaves it. Two 64-bit hashes stand for a side, as in ``validate``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stored

#: What is asked: columns of the target of a case. Only CFDs have a pattern, in which ``_`` is any value.
ASK = "case_id string, kind string, lhs array<int>, rhs array<int>, pattern array<struct<attr:int,value:string>>"


def row_maps(target: DataFrame, key: list[str]) -> DataFrame:
    """key, m (attribute to value) from key, t_attr, raw; a null is a value of its own."""
    return target.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("t_attr", F.coalesce(F.concat(F.lit("="), "raw"), F.lit("-"))))).alias("m"))


def _hash(side: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.transform(side, lambda a: F.coalesce(F.try_element_at("m", a), F.lit("-"))))


def _keyed(asks: DataFrame, target: DataFrame) -> DataFrame:
    """case_id, ask, kind, row_id, k0, k1, h0, h1, left: what each row has to say on each dependency."""
    each = row_maps(target, ["case_id", "row_id"]).join(asks, "case_id")
    met = F.forall("pattern", lambda e: (e["value"] == "_") | F.coalesce(F.try_element_at("m", e["attr"]) == F.concat(F.lit("="), e["value"]), F.lit(False)))
    entry = lambda key, other, left: F.struct(_hash(key, 1).alias("k0"), _hash(key, 2).alias("k1"), other(3).alias("h0"), other(4).alias("h1"), F.lit(left).alias("left"))
    none = lambda _: F.lit(0).cast("long")
    sides = F.when(F.col("kind") == "ind", F.array(entry("lhs", none, True), entry("rhs", none, False))).otherwise(F.array(entry("lhs", lambda s: _hash("rhs", s), True)))
    return each.where(met).select("case_id", "ask", "kind", "row_id", F.inline(sides))


_GROUP = ["case_id", "ask", "kind", "k0", "k1"]


def _groups(keyed: DataFrame) -> DataFrame:
    """n and ok of each left side."""
    same = [f(h).alias(f"{n}_{h}") for h in ("h0", "h1") for n, f in (("lo", F.min), ("hi", F.max))]
    groups = keyed.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.bool_or("left").alias("l"), F.bool_or(~F.col("left")).alias("r"), *same)
    ok = F.when(F.col("kind") == "ind", ~F.col("l") | F.col("r")).otherwise(F.expr("lo_h0 = hi_h0 AND lo_h1 = hi_h1"))
    return groups.select("case_id", "ask", "n", ok.alias("ok"))


def relation(asks: DataFrame, target: DataFrame, first_rows: tuple[int, ...] = (0,)) -> DataFrame:
    """The columns of ASK with first_rows, holds and support.

    ``target``: case_id, row_id, t_attr, raw. With first_rows > 0 only so many rows of a group, by
    row_id, are compared. ``support`` is the size of the largest group of an FD or CFD, 0 without any; it
    is null for INDs. A CFD that no row is about doesn't hold; other dependencies hold on no rows.
    """
    # A table of its own, whose size the optimiser knows when it chooses how rows meet it.
    asks = stored(asks.distinct().withColumn("ask", F.md5(F.to_json(F.struct("kind", "lhs", "rhs", "pattern")).cast("binary"))), "asks")
    keyed = _keyed(asks, target)
    whole = _groups(keyed).groupBy("case_id", "ask").agg(F.bool_and("ok").alias("ok"), F.max("n").alias("n"))
    parts = []
    for most in first_rows:
        verdict = whole
        if most:
            # The rank is cut in the tasks that make the rows, so a large group is small when it meets.
            first = keyed.where("kind != 'ind'").withColumn("place", F.row_number().over(W.partitionBy(*_GROUP).orderBy("row_id"))).where(F.col("place") <= most)
            some = _groups(first).groupBy("case_id", "ask").agg(F.bool_and("ok").alias("first_ok"))
            verdict = whole.join(some, ["case_id", "ask"], "left").select("case_id", "ask", F.coalesce("first_ok", "ok").alias("ok"), "n")
        out = asks.join(verdict, ["case_id", "ask"], "left")
        support = F.when(F.col("kind") != "ind", F.coalesce("n", F.lit(0)))
        parts.append(out.select("case_id", "kind", "lhs", "rhs", "pattern", F.lit(most).alias("first_rows"), F.coalesce("ok", F.size("pattern") == 0).alias("holds"), support.cast("long").alias("support")))
    return reduce(DataFrame.union, parts)

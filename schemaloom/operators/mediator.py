"""CFD rules to (attribute, row) edges, and nested subsets of rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def offsets(tables: DataFrame) -> DataFrame:
    """tbl, ord, n_rows to tbl, offset: rows of the tables before it."""
    return tables.withColumn("offset", F.coalesce(F.sum("n_rows").over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def row_ids(df: DataFrame, name: str = "row_gid", offset: int = 0) -> DataFrame:
    """A file scan's rows numbered from ``offset`` on, in the order of files and of rows in them.

    Rows are counted by scan partition, a row each, and the counts are summed up; no row is moved. The two scans
    must have the same partitions, so a plan that moves, joins or drops rows is an error.
    """
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if moved := re.search(r"^[\s+:*()\d-]*((?:Exchange|Join|HashAggregate|Sort|Window|Generate|Limit|Sample|Union|Coalesce|MapIn|FlatMap)\w*|\w+Join|\w+Aggregate|\w*Limit\b)", plan, re.M):
        raise ValueError(f"rows of a plain scan can be numbered, not those of {moved[1]}")
    at = F.monotonically_increasing_id()
    placed = df.withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col("__at") + offset).alias(name))  # a row a partition


def owners(rules: DataFrame, tables: DataFrame, headers: DataFrame) -> DataFrame:
    """rule_id, tbl: the table whose range of attributes (tables: tbl, ord, lo, hi) holds a rule's first one, the
    first such in order; else the first one that has it in its header (headers: tbl, attr_id)."""
    first = rules.select("rule_id", F.get("lhs", F.lit(0)).alias("attr_id"))
    ranged = first.join(F.broadcast(tables), F.col("attr_id").between(F.col("lo"), F.col("hi"))).groupBy("rule_id").agg(F.min_by("tbl", "ord").alias("a"))
    headed = first.join(headers, "attr_id").join(F.broadcast(tables.select("tbl", "ord")), "tbl").groupBy("rule_id").agg(F.min_by("tbl", "ord").alias("b"))
    return first.join(ranged, "rule_id", "left").join(headed, "rule_id", "left").select("rule_id", F.coalesce("a", "b").alias("tbl"))


def expand(rules: DataFrame, cell: DataFrame) -> DataFrame:
    """rule_id, lhs, rhs, pattern against attr_id, row_gid, raw: an edge of every attribute of a rule
    and every row that has all its constants (raw values, not trimmed)."""
    # Rules are as many as a schema has, not as the rows.
    need = rules.select("rule_id", F.explode("pattern").alias("attr_id", "raw"), F.size("pattern").alias("want"))
    rows = cell.join(F.broadcast(need), ["attr_id", "raw"]).groupBy("rule_id", "row_gid", "want").agg(F.count(F.lit(1)).alias("got")).where("got = want")
    both = rows.join(F.broadcast(rules.select("rule_id", F.array_union("lhs", "rhs").alias("attrs"))), "rule_id")
    return both.select(F.explode("attrs").alias("attr_id"), "row_gid").distinct()


def nested(items: DataFrame, key: str, fractions: list[float], seed: int = 42) -> DataFrame:
    """fraction, item: prefixes of one seeded order, so smaller fractions are subsets of larger ones.

    The order is that of an md5, whose first digits deal the items to 4096 parts of about one size; an
    item's rank is that in its part and the sizes of the parts before it.
    """
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    each = items.select(key).distinct().withColumn("m", mark).withColumn("part", F.substring("m", 1, 3))
    sizes = each.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("part", F.coalesce(F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    n = sizes.agg(F.sum("c").alias("n"))
    ranked = each.join(F.broadcast(before), "part").withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy("m", key)) + F.col("before"))
    take = items.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double")
    return ranked.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(take)).where(F.col("rank") <= F.floor(F.col("fraction") * F.col("n") + 1e-9)).select("fraction", key)


def not_nested(subsets: DataFrame, key: str) -> DataFrame:
    """Items of a fraction that the next larger one lacks; nothing if the subsets are nested."""
    steps = subsets.select("fraction").distinct().withColumn("next", F.lead("fraction").over(W.orderBy("fraction"))).where("next is not null")
    want = subsets.join(F.broadcast(steps), "fraction").select(F.col("next").alias("fraction"), key)
    return want.join(subsets, ["fraction", key], "left_anti")

"""Source dependencies carried over to target columns through candidate assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import validity
from .signals import top_k
from .validate import minimise


def candidates(scores: DataFrame, k: int = 3) -> DataFrame:
    """s_attr, t_attr: each source column's k best targets."""
    return top_k(scores, k, by="s_attr").select("s_attr", "t_attr")


def assignments(deps: DataFrame, cand: DataFrame) -> DataFrame:
    """dep_id, lhs, rhs, assign for every choice of a candidate per attribute; none if an attribute has none.

    Choices are counted through: the digits of a choice's number, in the mixed radix of the attributes' candidate
    counts, say which candidate each attribute gets. One join and one grouping, however long dependencies are.
    """
    options = cand.groupBy("s_attr").agg(F.sort_array(F.collect_list("t_attr")).alias("own"))
    each = deps.select("dep_id", "lhs", "rhs", F.posexplode(F.array_distinct(F.concat("lhs", "rhs"))).alias("at", "s_attr"))
    bound = each.join(options, "s_attr", "left").groupBy("dep_id", "lhs", "rhs").agg(F.sort_array(F.collect_list(F.struct("at", "s_attr", "own"))).alias("attrs"))
    total = F.aggregate("attrs", F.lit(1).cast("long"), lambda n, a: n * F.size(a["own"]))
    bound = bound.where(F.forall("attrs", lambda a: a["own"].isNotNull())).withColumn("choice", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)))
    start = F.struct(F.col("choice").alias("left"), F.array().cast("array<struct<s:int,t:int>>").alias("picked"))
    pick = lambda state, a: F.struct(
        F.floor(state["left"] / F.size(a["own"])).cast("long").alias("left"),
        F.concat(state["picked"], F.array(F.struct(a["s_attr"].cast("int").alias("s"), F.get(a["own"], (state["left"] % F.size(a["own"])).cast("int")).cast("int").alias("t")))).alias("picked"),
    )
    return bound.select("dep_id", "lhs", "rhs", F.map_from_entries(F.aggregate("attrs", start, pick)["picked"]).alias("assign"))


def _mapped(c: str):
    return F.transform(c, lambda a: F.element_at("assign", a))


def mapped_fds(deps: DataFrame, cand: DataFrame) -> DataFrame:
    """Remapped FDs whose left side has no repeats and doesn't meet the right side."""
    out = assignments(deps, cand).select("dep_id", _mapped("lhs").alias("lhs"), _mapped("rhs").alias("rhs"))
    return out.where((F.size("lhs") == F.size(F.array_distinct("lhs"))) & ~F.arrays_overlap("lhs", "rhs")).select("lhs", "rhs").distinct()


def mapped_inds(deps: DataFrame, cand: DataFrame) -> DataFrame:
    """Both sides are assigned independently; sides that meet are dropped."""
    left = assignments(deps.select("dep_id", "lhs", F.array().cast("array<int>").alias("rhs")), cand).select("dep_id", _mapped("lhs").alias("lhs"))
    right = assignments(deps.select("dep_id", F.col("rhs").alias("lhs"), F.array().cast("array<int>").alias("rhs")), cand).select("dep_id", _mapped("lhs").alias("rhs"))
    return left.join(right, "dep_id").where(~F.arrays_overlap("lhs", "rhs")).select("lhs", "rhs").distinct()


def _holding(deps: DataFrame, target: DataFrame, kind: str, pattern=None) -> DataFrame:
    """The verdicts of ``validity`` on dependencies of one kind and one target (row_id, t_attr, raw)."""
    none = F.array().cast("array<struct<attr:int,value:string>>")
    asks = deps.select(F.lit("").alias("case_id"), F.lit(kind).alias("kind"), "lhs", "rhs", (none if pattern is None else pattern).alias("pattern"))
    return validity.relation(asks, target.withColumn("case_id", F.lit(""))).where("holds")


def holding_fds(deps: DataFrame, target: DataFrame, min_group: int = 1) -> DataFrame:
    """The FDs (lhs, rhs) that hold on the target rows; with min_group > 1 only those with a group so large."""
    return _holding(deps, target, "fd").where(F.col("support") >= min_group).select("lhs", "rhs")


def holding_inds(deps: DataFrame, target: DataFrame) -> DataFrame:
    return _holding(deps, target, "ind").select("lhs", "rhs")


def mapped_cfds(deps: DataFrame, cand: DataFrame) -> DataFrame:
    """Remapped CFDs (dep_id, lhs, rhs, pattern), patterns too; filtered as FDs are."""
    entry = lambda e: F.struct(F.element_at("assign", e["key"]), e["value"])
    out = assignments(deps.select("dep_id", "lhs", "rhs"), cand).join(deps.select("dep_id", "pattern"), "dep_id")
    out = out.select(_mapped("lhs").alias("lhs"), _mapped("rhs").alias("rhs"), F.transform(F.map_entries("pattern"), entry).alias("p"))
    out = out.where((F.size("lhs") == F.size(F.array_distinct("lhs"))) & ~F.arrays_overlap("lhs", "rhs"))
    return out.select("lhs", "rhs", F.sort_array("p").alias("p")).distinct().select("lhs", "rhs", F.map_from_entries("p").alias("pattern"))


def holding_cfds(deps: DataFrame, target: DataFrame) -> DataFrame:
    """The CFDs (lhs, rhs, pattern) that hold on target rows, of which at least one has the pattern's constants."""
    entries = F.transform(F.sort_array(F.map_entries("pattern")), lambda e: F.struct(e["key"].cast("int").alias("attr"), e["value"].alias("value")))
    held = _holding(deps, target, "cfd", entries)
    return held.select("lhs", "rhs", F.map_from_entries("pattern").alias("pattern"))


def target_dependencies(fds: DataFrame, inds: DataFrame, scores: DataFrame, target: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    cand = candidates(scores, k)
    return minimise(holding_fds(mapped_fds(fds, cand), target)), holding_inds(mapped_inds(inds, cand), target)

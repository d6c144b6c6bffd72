"""Functional, conditional and inclusion dependencies, in one scan a table however many there are.

Keys are typed values, null-safe. A group holds an FD if the least and the greatest hash of its right
sides are equal; two 64-bit hashes stand for a side, so no wide value passes through a shuffle. Batches sum
chunks of rows before the shuffle, in memory that doesn't grow with what a task reads. A violation is missed only where both pairs of
hashes of all its right sides coincide, which has a probability below 2^-120 for any table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stored
from .combine import chunks, dealt


@dataclass(frozen=True)
class Dependency:
    lhs: tuple
    rhs: tuple
    pattern: tuple = field(default=())  # (attribute, constant) pairs; "_" is any value

    def __str__(self) -> str:
        return f"{','.join(map(str, self.lhs))} -> {','.join(map(str, self.rhs))}"


def named(lhs, rhs) -> str:
    return f"{','.join(lhs)}->{','.join(rhs)}"


def _cols(columns) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def _text(columns) -> Column:
    return F.array(*(c.cast("string") for c in _cols(columns)))


def _hashes(columns: list[Column]) -> list[Column]:
    """Two independent hashes; null is a value of its own at each place."""
    each = [x for c in columns for x in (c, c.isNull())]
    return [F.xxhash64(F.lit(seed), *each) for seed in (1, 2)]


def _same(hashes: list[Column]) -> list[Column]:
    return [f(h).alias(f"{n}{i}") for i, h in enumerate(hashes) for n, f in (("lo", F.min), ("hi", F.max))]


_OK = "lo0 = hi0 AND lo1 = hi1"


def fd_groups(df: DataFrame, lhs: list[str], rhs: list[str], first_rows: int | None = None, order: str | None = None) -> DataFrame:
    """The left side's columns as k0, k1 .., n, ok for each group. ``first_rows`` looks at so many rows of a
    group only, in ``order``."""
    keys = [f"k{i}" for i in range(len(lhs))]
    each = df.select(*(c.alias(k) for c, k in zip(_cols(lhs), keys)), *(h.alias(f"h{i}") for i, h in enumerate(_hashes(_cols(rhs)))), *([F.col(f"`{order}`").alias("o")] if order else []))
    if first_rows:
        each = each.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("o"))).where(F.col("place") <= first_rows)
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_same([F.col("h0"), F.col("h1")])).select(*keys, "n", F.expr(_OK).alias("ok"))


def _verdict(groups: DataFrame, name: str) -> DataFrame:
    n = groups.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(~F.col("ok")).alias("n_violating"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_relevant"))
    return n.select(F.lit(name).alias("dep"), (F.col("n_violating") == 0).alias("satisfied"), "n_groups", "n_violating", "n_relevant")


def fd(df: DataFrame, lhs: list[str], rhs: list[str], name: str | None = None) -> DataFrame:
    return _verdict(fd_groups(df, lhs, rhs), name or named(lhs, rhs))


def _sides(rows: pa.Table) -> pa.Table:
    """The groups of a chunk: rows, one right side, and whether all rows have it and what they must have."""
    g = rows.group_by(["i", "k0", "k1"], use_threads=False).aggregate([([], "count_all"), ("h0", "min"), ("h0", "max"), ("h1", "min"), ("h1", "max"), ("must", "all")])
    ok = pc.and_(pc.and_(pc.equal(g["h0_min"], g["h0_max"]), pc.equal(g["h1_min"], g["h1_max"])), g["must_all"])
    return pa.table([g["i"], g["k0"], g["k1"], g["count_all"], g["h0_min"], g["h1_min"], ok], ["i", "k0", "k1", "n", "h0", "h1", "ok"])


def _met(rows: pa.Table) -> pa.Table:
    """The keys of a chunk, once each side."""
    return rows.group_by(["i", "k0", "k1", "l"], use_threads=False).aggregate([])


def _batch(df: DataFrame, deps: list[tuple[str, Column, list[str], list[str], Column | None]]) -> DataFrame:
    """dep, satisfied, n_groups, n_violating, n_relevant of (name, rows it is about, lhs, rhs, what rows must
    have); also for dependencies that no row is about."""
    row = lambda i, a, b, must: F.struct(F.lit(i).alias("i"), *(h.alias(f"k{j}") for j, h in enumerate(_hashes(_cols(a)))), *(h.alias(f"h{j}") for j, h in enumerate(_hashes(_cols(b)))), (F.lit(True) if must is None else must).alias("must"))
    sides = F.array_compact(F.array(*(F.when(about, row(i, a, b, must)) for i, (_, about, a, b, must) in enumerate(deps))))
    part = df.select(F.inline(sides)).mapInArrow(chunks(_sides), "i int, k0 long, k1 long, n long, h0 long, h1 long, ok boolean")
    groups = dealt(part, df.count() * len(deps), "i", "k0", "k1").groupBy("i", "k0", "k1").agg(F.sum("n").alias("n"), *_same([F.col("h0"), F.col("h1")]), F.bool_and("ok").alias("ok"))
    groups = groups.select("i", "n", (F.expr(_OK) & F.col("ok")).alias("ok"))
    sums = groups.groupBy("i").agg(F.count(F.lit(1)).alias("g"), F.count_if(~F.col("ok")).alias("v"), F.sum("n").alias("r"))
    names = df.sparkSession.createDataFrame([(i, d[0]) for i, d in enumerate(deps)], "i int, dep string")
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return names.join(F.broadcast(sums), "i", "left").select("dep", (F.coalesce("v", F.lit(0)) == 0).alias("satisfied"), zero("g", "n_groups"), zero("v", "n_violating"), zero("r", "n_relevant"))


def fd_batch(df: DataFrame, deps: list[tuple[list[str], list[str]]]) -> DataFrame:
    """Many FDs over one table with one scan and one shuffle; all hold on an empty table."""
    return _batch(df, [(named(a, b), F.lit(True), a, b, None) for a, b in deps])


def cfd_batch(df: DataFrame, deps: list[tuple[list[str], list[str], dict[str, str]]], rhs_mode: str = "filter") -> DataFrame:
    """Many CFDs over one table with one scan and one shuffle, with their vacuity."""
    return _batch(df, [(named(a, b), *_pattern(df, a, b, p, rhs_mode)) for a, b, p in deps]).withColumn("vacuous", F.col("n_relevant") == 0)


def fd_violations(df: DataFrame, lhs: list[str], rhs: list[str]) -> DataFrame:
    """Violating groups with two right sides as evidence; only their rows meet again."""
    rows, bad = _of_violating(df, lhs, rhs)
    return rows.groupBy(*bad).agg(F.count(F.lit(1)).alias("n"), F.min("val").alias("one"), F.max("val").alias("other")).select(F.array(*(F.col(k).cast("string") for k in bad)).alias("key"), "n", "one", "other")


def _of_violating(df: DataFrame, lhs: list[str], rhs: list[str], order: list[str] = ()) -> tuple[DataFrame, list[str]]:
    keys = [f"k{i}" for i in range(len(lhs))]
    rows = df.select(*(c.alias(k) for c, k in zip(_cols(lhs), keys)), _text(rhs).alias("val"), *_cols(order)).alias("r")
    bad = fd_groups(df, lhs, rhs).where("not ok").select(*keys).alias("b")
    return rows.join(bad, reduce(lambda x, y: x & y, (F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)), "left_semi"), keys


def fd_violation_pairs(df: DataFrame, lhs: list[str], rhs: list[str], order: list[str], most: int = 3) -> DataFrame:
    """key, one, other: the first row of each violating group beside each of the ``most`` next that differ from
    it, in an order that the caller names. At most that many rows of a group are looked at."""
    rows, keys = _of_violating(df, lhs, rhs, order)
    first = W.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most + 1).withColumn("one", F.first("val").over(first))
    return rows.where("place > 1 and one != val").select(F.array(*(F.col(k).cast("string") for k in keys)).alias("key"), "one", F.col("val").alias("other"), F.col("place").cast("long").alias("place"))


def matches(pattern: dict[str, str]) -> Column:
    """All constants equal; ``_`` matches anything; unknown columns match nothing."""
    out = F.lit(True)
    for c, v in pattern.items():
        if v != "_":
            out = out & F.coalesce(F.col(f"`{c}`").cast("string") == v, F.lit(False))
    return out


def _pattern(df: DataFrame, lhs, rhs, pattern: dict[str, str], rhs_mode: str) -> tuple[Column, list[str], list[str], Column | None]:
    """The rows that a CFD is about, its sides, and what these rows must have."""
    if any(c not in df.columns for c in pattern):
        return F.lit(False), lhs, rhs, None
    right = {c: v for c, v in pattern.items() if c in rhs and v != "_"}
    if rhs_mode == "filter" or not right:
        return matches(pattern), lhs, rhs, None
    return matches({c: v for c, v in pattern.items() if c not in rhs}), lhs, rhs, matches(right)


def cfd(df: DataFrame, lhs: list[str], rhs: list[str], pattern: dict[str, str], rhs_mode: str = "filter", name: str | None = None) -> DataFrame:
    """``filter``: constants of the right side choose rows too. ``check``: rows must have them. No rows: vacuous."""
    about, _, _, must = _pattern(df, lhs, rhs, pattern, rhs_mode)
    return _batch(df, [(name or named(lhs, rhs), about, lhs, rhs, must)]).withColumn("vacuous", F.col("n_relevant") == 0)


def _common(*types: str) -> str:
    """A type in which values of these types are equal as SQL has them equal."""
    whole = {"tinyint", "smallint", "int", "bigint"}
    if set(types) <= whole:
        return "bigint"
    if len(set(types)) == 1:
        return types[0]
    return "double" if all(t in whole | {"double", "float"} or t.startswith("decimal") for t in types) else "string"


def _pair_types(r: DataFrame, x, s: DataFrame, y) -> list[str]:
    return [_common(r.schema[a].dataType.simpleString(), s.schema[b].dataType.simpleString()) for a, b in zip(x, y)]


def ind_missing(r: DataFrame, x: list[str], s: DataFrame, y: list[str]) -> DataFrame:
    """Distinct left values without a partner, as texts; nulls equal nulls."""
    keys, types = [f"k{i}" for i in range(len(x))], _pair_types(r, x, s, y)
    own = lambda df, c: df.select(*(a.cast(t).alias(k) for a, t, k in zip(_cols(c), types, keys))).distinct()
    left, right = own(r, x).alias("l"), own(s, y).alias("r")
    met = reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    return left.join(right, met, "left_anti").select(_text(keys).alias("key"))


def ind_batch(relations: dict[str, DataFrame], inds: list[tuple[str, list[str], str, list[str]]], names: list[str] | None = None) -> DataFrame:
    """dep, satisfied, n_missing of (left relation, columns, right relation, columns): one scan a relation and
    one shuffle. Hashes stand for the keys, as in FDs."""
    names = names or [f"{r}.{','.join(x)}[={s}.{','.join(y)}" for r, x, s, y in inds]
    sides: dict[str, list[Column]] = {}
    for i, (r, x, s, y) in enumerate(inds):
        types = _pair_types(relations[r], x, relations[s], y)
        for rel, columns, left in ((r, x, True), (s, y, False)):
            h = _hashes([c.cast(t) for c, t in zip(_cols(columns), types)])
            sides.setdefault(rel, []).append(F.struct(F.lit(i).alias("i"), h[0].alias("k0"), h[1].alias("k1"), F.lit(left).alias("l")))
    # What a relation has of a key is summed before tables are put together, so hot keys are small.
    parts = [relations[r].select(F.inline(F.array(*own))).mapInArrow(chunks(_met), "i int, k0 long, k1 long, l boolean") for r, own in sides.items()]
    rows = sum(relations[r].count() * len(own) for r, own in sides.items())
    keys = dealt(reduce(DataFrame.union, parts), rows, "i", "k0", "k1").groupBy("i", "k0", "k1").agg(F.bool_or("l").alias("l"), F.bool_or(~F.col("l")).alias("r"))
    missing = keys.groupBy("i").agg(F.count_if(F.col("l") & ~F.col("r")).alias("n"))
    spark = next(iter(relations.values())).sparkSession
    every = spark.createDataFrame(list(enumerate(names)), "i int, dep string")
    n = F.coalesce("n", F.lit(0))
    return every.join(F.broadcast(missing), "i", "left").select("dep", (n == 0).alias("satisfied"), n.alias("n_missing"))


def ind(r: DataFrame, x: list[str], s: DataFrame, y: list[str], name: str) -> DataFrame:
    return ind_batch({"r": r, "s": s}, [("r", x, "s", y)], [name])


def closure(attrs, fds: list[Dependency]) -> frozenset:
    """What a set of attributes determines, for a few dependencies in hand; ``closures`` is for tables of them."""
    out, more = set(attrs), True
    while more:
        new = {b for d in fds if set(d.lhs) <= out for b in d.rhs} - out
        more = bool(new)
        out |= new
    return frozenset(out)


def closures(starts: DataFrame, fds: DataFrame) -> DataFrame:
    """start, closure (both sorted) of every start set at once, from start (array) and lhs, rhs.

    A recursion in the plan: a step adds the right sides of all FDs whose left side is there, and a set that
    doesn't grow isn't carried on. The dependencies are one array beside the sets, as large as a schema's.
    Spark's limit of steps (spark.sql.cteRecursionLevelLimit) is the longest chain of dependencies.
    """
    own = starts.select(F.array_sort(F.array_distinct("start")).alias("start")).distinct()
    listed = fds.where("size(rhs) > 0").agg(F.collect_set(F.struct("lhs", "rhs")).alias("fds"))
    query = """
        WITH RECURSIVE reached(start, attrs, more) AS (
          SELECT start, start, true FROM {own}
          UNION ALL
          SELECT start, new, size(new) > size(attrs) FROM (
            SELECT start, attrs, array_sort(array_distinct(concat(attrs, flatten(transform(filter(fds, d -> size(array_except(d.lhs, attrs)) = 0), d -> d.rhs))))) AS new
            FROM reached, {listed} WHERE more))
        SELECT start, max_by(attrs, size(attrs)) AS closure FROM reached GROUP BY start"""
    return starts.sparkSession.sql(query, own=own, listed=listed)


def keys(attrs: DataFrame, fds: DataFrame, most: int = 3) -> DataFrame:
    """start, closure, superkey, minimal for all sets of at most ``most`` attributes (attr): a minimal key is a
    superkey that is none any more without one of its attributes."""
    every = attrs.select("attr").distinct()
    sets = every.select(F.array("attr").alias("start"))
    out = sets
    for _ in range(most - 1):
        sets = sets.crossJoin(F.broadcast(every)).where(F.col("attr") > F.element_at("start", -1)).select(F.concat("start", F.array("attr")).alias("start"))  # attributes of one schema
        out = out.union(sets)
    n = every.agg(F.count(F.lit(1)).alias("n"))
    got = closures(out, fds).crossJoin(F.broadcast(n)).select("start", "closure", (F.size("closure") >= F.col("n")).alias("superkey"))
    less = got.where("superkey").select("start", F.explode("start").alias("a")).select("start", F.array_remove("start", F.col("a")).alias("part"))
    beaten = less.join(got.where("superkey").select(F.col("start").alias("part")), "part", "left_semi").select("start").distinct().withColumn("beaten", F.lit(True))
    return got.join(beaten, "start", "left").select("start", "closure", "superkey", (F.col("superkey") & F.col("beaten").isNull()).alias("minimal"))


def is_superkey(attrs, everything, fds: list[Dependency]) -> bool:
    return set(everything) <= closure(attrs, fds)


def minimise(deps: DataFrame) -> DataFrame:
    """lhs, rhs arrays: drops those that another with a smaller left side and a covering right side implies.

    The lattice below a left side is listed: each of its subsets, beside one attribute of the right side,
    looks by equality for a dependency with that left side and that attribute. So a dependency meets those that may
    imply it, never all others.
    """
    own = stored(deps.select("lhs", "rhs").distinct(), "dependencies").withColumn("key", F.array_sort(F.array_distinct("lhs")))
    subsets = F.aggregate("key", F.array(F.array().cast(deps.schema["lhs"].dataType)), lambda got, a: F.concat(got, F.transform(got, lambda s: F.concat(s, F.array(a)))))
    kind = deps.schema["rhs"].dataType.elementType
    asked = own.select("lhs", "rhs", F.explode(subsets).alias("part"), F.array_min("rhs").cast(kind).alias("b"))
    # An empty right side is covered by any.
    named = own.select(F.col("key").alias("part"), F.col("lhs").alias("o_lhs"), F.col("rhs").alias("o_rhs"), F.explode(F.concat(F.array_distinct("rhs"), F.array(F.lit(None).cast(kind)))).alias("o_b"))
    met = (asked["part"] == named["part"]) & asked["b"].eqNullSafe(named["o_b"]) & (F.size("o_lhs") < F.size("lhs")) & (F.size(F.array_except("rhs", "o_rhs")) == 0)
    implied = asked.join(named, met).select("lhs", "rhs").distinct()
    return own.select("lhs", "rhs").join(implied, ["lhs", "rhs"], "left_anti")


def validate_all(spark: SparkSession, relations: dict[str, DataFrame], fds=(), cfds=(), inds=()) -> DataFrame:
    """kind, dep, satisfied for lists of (relation, lhs, rhs), (relation, lhs, rhs, pattern), (relation, lhs, relation, rhs).

    FDs and CFDs of a relation share a scan and a shuffle, and so do all INDs.
    """
    out = [spark.createDataFrame([], "kind string, dep string, satisfied boolean")]
    for r, df in relations.items():
        own = [(f"fd|{r}.{named(a, b)}", F.lit(True), a, b, None) for q, a, b in fds if q == r]
        own += [(f"cfd|{r}.{named(a, b)}", *_pattern(df, a, b, p, "filter")) for q, a, b, p in cfds if q == r]
        if own:
            kind = F.split("dep", r"\|", 2)
            out.append(_batch(df, own).select(kind[0].alias("kind"), kind[1].alias("dep"), "satisfied"))
    if inds:
        out.append(ind_batch(relations, list(inds)).select(F.lit("ind").alias("kind"), "dep", "satisfied"))
    return reduce(DataFrame.union, out)

"""Approximate profiles from mergeable states: a row a column leaves each task, whatever the table holds.

A state has counts, extremes, an HLL sketch of the distinct values, a KLL sketch of the numbers, and the
values that come first by md5, one more than a profile lists, so that a column with no more of them is known
exactly. States of parts of a table, or of batches of a stream, merge into that of the whole.

Samples weighted by rows are drawn by keys that a row's identity gives, so any part of a table can
draw its own and the smallest keys of all parts are the sample of the whole.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BOOL_TOKENS, INT, NUMBER, canonical, is_null_token, number
from .profile import EXACT_UNIQUE, QUANTILES, SAMPLE_VALUES, kind_of

#: Registers of the HLL sketches (2^12: a standard error of 1.6 %); size of the KLL sketches (a rank error of about 0.2 %).
LG_K, KLL_K = 12, 2000

_FITS = ("int", "float", "bool", "alpha", "digit", "alnum")
_STATE = "tbl string, col string, kind string, n long, n_null long, hll binary, kll binary, lo double, hi double, chars long, fits struct<" + ",".join(f"`{f}`:boolean" for f in _FITS) + ">"


def _value(name: str, kind: str) -> Column:
    """A cell's canonical text, null for null tokens."""
    text = canonical(F.col(f"`{name}`"), kind)
    return F.when(~is_null_token(text), F.trim(text))


def _fits(v: Column) -> Column:
    """What all values allow; null where there are none."""
    like = lambda pattern, drop=None: F.bool_and((v if drop is None else F.regexp_replace(v, drop, "")).rlike(pattern))
    tests = (like(INT), like(NUMBER), F.bool_and(F.lower(v).isin(BOOL_TOKENS)), like(r"^\p{L}+$", "[ -]"), like(r"^\p{Nd}+$"), like(r"^[\p{L}\p{Nd}]+$", " "))
    return F.struct(*(t.alias(f) for t, f in zip(tests, _FITS)))


def _first(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """col, k, v: the ``most`` distinct values of each column that come first by md5, of one task."""
    own: dict[str, dict[int, str]] = {}
    heaps: dict[str, list[int]] = {}
    for batch in batches:
        for name in batch.schema.names:
            kept, heap = own.setdefault(name, {}), heaps.setdefault(name, [])
            for v in pc.unique(batch.column(name)).to_pylist():
                if v is not None:
                    k = int.from_bytes(hashlib.md5(v.encode()).digest(), "big")
                    if k not in kept and (len(heap) < most or k < -heap[0]):
                        kept[k] = v
                        if len(heap) < most:
                            heapq.heappush(heap, -k)
                        else:
                            del kept[-heapq.heapreplace(heap, -k)]
    rows = [(name, f"{k:032x}", v) for name, kept in own.items() for k, v in kept.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["col", "k", "v"])


def _kept(values: DataFrame, most: int) -> DataFrame:
    """tbl, col, own from tbl, col, k, v: the first ``most`` values again, of all tasks or parts."""
    first = W.partitionBy("tbl", "col").orderBy("k")
    each = values.groupBy("tbl", "col", "k", "v").agg(F.count(F.lit(1)).alias("parts")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    return each.groupBy("tbl", "col").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("own"))


def states(df: DataFrame, table: str, exact: int = EXACT_UNIQUE) -> DataFrame:
    """A row a column: its state, with at most ``exact`` + 1 values."""
    own = [(n, t) for n, t in df.dtypes if kind_of(t)]
    if not own:
        return df.sparkSession.createDataFrame([], _STATE + ", own array<struct<k:string,v:string>>")
    texts = df.select(*(F.col(f"`{n}`") for n, _ in own), *(_value(n, t).alias(f"__{i}") for i, (n, t) in enumerate(own)))

    def state(i: int, name: str, kind: str) -> Column:
        v = F.col(f"__{i}")
        x = number(v) if kind_of(kind) == "text" else F.when(v.isNotNull(), F.col(f"`{name}`").cast("double"))
        return F.struct(
            F.lit(table).alias("tbl"), F.lit(name).alias("col"), F.lit(kind_of(kind)).alias("kind"), F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("n_null"),
            F.hll_sketch_agg(v, F.lit(LG_K)).alias("hll"), F.kll_sketch_agg_double(x, KLL_K).alias("kll"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(F.length(v).cast("long")).alias("chars"), _fits(v).alias("fits"),
        )

    rows = texts.agg(F.array(*(state(i, n, t) for i, (n, t) in enumerate(own))).alias("all")).select(F.inline("all"))
    values = df.select(*(_value(n, t).alias(n) for n, t in own)).mapInArrow(partial(_first, most=exact + 1), "col string, k string, v string")
    return rows.join(_kept(values.withColumn("tbl", F.lit(table)), exact + 1), ["tbl", "col"], "left")


def merged(parts: DataFrame, exact: int = EXACT_UNIQUE) -> DataFrame:
    """The states of columns from those of parts of their tables."""
    fits = F.struct(*(F.bool_and(F.col("fits")[f]).alias(f) for f in _FITS))
    out = parts.groupBy("tbl", "col", "kind").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll", KLL_K).alias("kll"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("chars").alias("chars"), fits.alias("fits"),
    )
    return out.join(_kept(parts.select("tbl", "col", F.inline("own")), exact + 1), ["tbl", "col"], "left")


def finished(state: DataFrame, exact: int = EXACT_UNIQUE, sample: int = SAMPLE_VALUES, drawn: DataFrame | None = None) -> DataFrame:
    """Profiles from states. Beyond ``exact`` values, distinct counts are estimated and values are a sample: that of
    ``drawn`` (tbl, col, vals), or the ``sample`` first by md5."""
    some, few = F.col("n") > F.col("n_null"), F.coalesce(F.size("own"), F.lit(0)) <= exact
    votes = F.when(F.col("fits.int"), "int").when(F.col("fits.float"), "float").when(F.col("fits.bool"), "bool").otherwise("str")
    dtype = F.when(~some, "str").when(F.col("kind") == "whole", "int").when(F.col("kind") == "double", "float").otherwise(votes)
    kind = F.when(~some | (F.col("kind") == "double"), "mixed").when(F.col("fits.alpha"), "alpha").when(F.col("fits.digit"), "digit").when(F.col("fits.alnum"), "alnum").otherwise("mixed")
    numeric = F.col("dtype").isin("int", "float")
    quantile = lambda q: F.when(numeric, F.kll_sketch_get_quantile_double("kll", F.lit(q)))
    listed = F.coalesce(F.sort_array(F.transform(F.slice("own", 1, exact) if drawn is None else F.col("own"), lambda s: s["v"])), F.array().cast("array<string>"))
    first = F.sort_array(F.transform(F.slice("own", 1, sample), lambda s: s["v"]))
    out = state.withColumn("dtype", dtype)
    if drawn is not None:
        out = out.join(drawn.withColumnRenamed("vals", "__vals"), ["tbl", "col"], "left")
        first = F.coalesce("__vals", first)
    return out.select(
        "tbl", "col", "dtype", F.col("n").alias("n_rows"),
        F.when(few, F.coalesce(F.size("own"), F.lit(0))).otherwise(F.hll_sketch_estimate("hll")).cast("long").alias("n_unique"),
        (F.col("n_null") / F.greatest("n", F.lit(1))).alias("null_rate"),
        F.when(numeric, F.col("lo")).alias("num_min"), F.when(numeric, F.col("hi")).alias("num_max"),
        *(quantile(q).alias(f"num_p{int(100 * q)}") for q in QUANTILES),
        (F.col("chars") / (F.col("n") - F.col("n_null"))).alias("str_avg_len"), kind.alias("str_char_class"),
        few.alias("exact_unique"), F.when(few, listed).otherwise(first).alias("unique_vals"),
    )


def profile_sketched(tables: dict[str, DataFrame], exact: int = EXACT_UNIQUE, sample: int = SAMPLE_VALUES, identity: dict[str, list[str]] | None = None) -> DataFrame:
    """Profiles with estimated distinct counts and quantiles. ``identity`` names the columns that tell a table's rows
    apart; values beyond ``exact`` are then a sample weighted by rows."""
    state = reduce(DataFrame.unionByName, [states(df, t, exact) for t, df in tables.items()])
    drawn = None
    if identity:
        each = [row_sample(tables[t], [n for n, k in tables[t].dtypes if kind_of(k)], own, sample).withColumn("tbl", F.lit(t)) for t, own in identity.items()]
        drawn = reduce(DataFrame.unionByName, each).groupBy("tbl", "col").agg(F.sort_array(F.collect_set("v")).alias("vals"))
    return finished(state, exact, sample, drawn)


def row_sample(df: DataFrame, columns: list[str], identity: list[str], k: int = SAMPLE_VALUES, weight: str | None = None, seed: int = 42, order: list[str] | None = None) -> DataFrame:
    """col, v, place: of each column, the values of k rows, drawn without replacement in proportion to ``weight`` (each
    row alike without one; rows of no weight are never drawn).

    A row's key is an exponential variate by its weight, made from an md5 of its identity and the column;
    the k least win. Each task passes on its own k at most, so the cells never meet. Rows that share an identity and
    a weight share a key, and stand by the columns of ``order``, then by their values, the greater first.
    """
    kinds = dict(df.dtypes)
    own = F.concat_ws("|", *(F.col(f"`{c}`").cast("string") for c in identity))
    heavy = F.lit(1.0) if weight is None else F.col(f"`{weight}`").cast("double")
    places = {f"__place{i}": F.col(f"`{c}`") for i, c in enumerate(order or [])}
    wide = df.select(own.alias("__own"), heavy.alias("__weight"), *(c.alias(n) for n, c in places.items()), *(_value(c, kinds[c]).alias(c) for c in columns)).where("__weight > 0")
    cell = wide.unpivot(["__own", "__weight", *places], columns, "col", "v").where("v is not null")
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), "col", "__own").cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 1) / F.lit(float(1 << 52))
    each = cell.withColumn("key", F.round(-F.log(u) / F.col("__weight"), 12))
    ranked = each.withColumn("place", F.row_number().over(W.partitionBy("col").orderBy("key", "__own", *places, F.desc("v"))))
    return ranked.where(F.col("place") <= k).select("col", "v", "place")

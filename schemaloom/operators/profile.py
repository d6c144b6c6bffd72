"""Column profiles from the value domain: each column's distinct values with their counts.

The domain is built from typed values (whole numbers, doubles, texts), whose chunks are summed before the
shuffle, so that hot values stay small, and only distinct values of numbers are ever turned into text. Quantiles
are exact without a sort of a whole column: a first pass brackets them by mergeable sketches, and only
the values inside a bracket are ranked, from the number of cells below it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import canonical, char_class, dtype_vote, is_null_token, number
from ..sources.shared import stored
from .combine import chunks, dealt

#: Distinct values up to which a column counts as exact, and the size of the sample beyond.
EXACT_UNIQUE, SAMPLE_VALUES = 500, 200
QUANTILES = (0.25, 0.5, 0.75)
#: Accuracy of the sketches (rank error 1 / ACCURACY) and half the width of a bracket, ten times that error.
ACCURACY, BRACKET = 2_000, 5e-3


def kind_of(type_name: str) -> str | None:
    """whole, double or text; None for columns that aren't profiled."""
    if type_name.startswith(("array", "map", "struct", "binary", "variant")):
        return None
    if type_name in ("tinyint", "smallint", "int", "bigint"):
        return "whole"
    return "double" if type_name in ("double", "float") else "text"


def cells(df: DataFrame, table: str) -> DataFrame:
    """tbl, col, raw: a row per cell, as text."""
    named = df.select(*(canonical(F.col(f"`{n}`"), t).alias(n) for n, t in df.dtypes if kind_of(t)))
    return named.unpivot([], named.columns, "col", "raw").select(F.lit(table).alias("tbl"), "col", "raw")


def value_domain(cell: DataFrame) -> DataFrame:
    return cell.groupBy("tbl", "col", "raw").agg(F.count(F.lit(1)).alias("cnt"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _counted(rows: pa.Table) -> pa.Table:
    """The values of a chunk with their counts."""
    g = rows.group_by(["i", "raw"], use_threads=False).aggregate([([], "count_all")])
    return pa.table([g["i"], g["raw"], g["count_all"]], ["i", "raw", "cnt"])


def _counted_doubles(rows: pa.Table) -> pa.Table:
    """The same for doubles, by their bits; nulls are NaNs, and there is one zero."""
    x = rows["raw"].to_numpy() + 0.0
    x[np.isnan(x)] = np.nan
    g = _counted(pa.table([rows["i"], pa.array(x.view(np.int64))], ["i", "raw"]))
    return g.append_column("x", pa.array(g["raw"].to_numpy().view(np.float64)))


def _domain(df: DataFrame, table: str) -> DataFrame:
    """tbl, col, kind, v (text, null for null tokens), x (number), cnt. A task holds a chunk of cells before the
    shuffle, and a bounded share of the values after it."""
    parts, rows = [], df.count()
    token = lambda text: F.when(~is_null_token(text), F.trim(text))
    for kind, cast in (("whole", "bigint"), ("double", "double"), ("text", "string")):
        own = [(n, t) for n, t in df.dtypes if kind_of(t) == kind]
        if own:
            value = lambda n, t: canonical(F.col(f"`{n}`"), t) if kind == "text" else F.col(f"`{n}`").cast(cast)  # noqa: E731, B023
            each = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), value(n, t).alias("raw")) for i, (n, t) in enumerate(own)))))
            count = F.sum("cnt").alias("cnt")
            if kind == "text":
                each = each.mapInArrow(chunks(_counted), "i int, raw string, cnt long").select("i", token(F.col("raw")).alias("v"), "cnt")
                each = dealt(each, rows * len(own), "i", "v").groupBy("i", "v").agg(count).withColumn("x", number(F.col("v")))
            else:
                shape = "i int, raw long, cnt long" + (", x double" if kind == "double" else "")
                each = dealt(each.mapInArrow(chunks(_counted_doubles if kind == "double" else _counted), shape), rows * len(own), "i", "raw").groupBy("i", "raw")
                each = each.agg(F.max("x").alias("own"), count).select("i", F.col("own").alias("raw"), "cnt") if kind == "double" else each.agg(count)
                each = each.withColumn("v", token(canonical(F.col("raw"), cast))).withColumn("x", F.when(F.col("v").isNotNull(), F.col("raw").cast("double")))
            name = F.element_at(F.array(*(F.lit(n) for n, _ in own)), F.col("i") + 1)
            parts.append(each.select(name.alias("col"), F.lit(kind).alias("kind"), "v", "x", "cnt"))
    return _union(parts).withColumn("tbl", F.lit(table))


def _edges(x: Column) -> Column:
    """Bounds below and above each quantile."""
    probabilities = [min(1.0, max(0.0, q + d)) for q in QUANTILES for d in (-BRACKET, BRACKET)]
    return F.percentile_approx(x, probabilities, ACCURACY)


def _brackets(df: DataFrame, table: str) -> DataFrame:
    """tbl, col, edges of a table's columns, in one pass that moves sketches only."""
    # Dates, times and booleans are texts that are never numbers.
    own = [(n, kind_of(t)) for n, t in df.dtypes if kind_of(t) in ("whole", "double") or t == "string"]
    if not own:
        return df.sparkSession.createDataFrame([], "tbl string, col string, edges array<double>")
    x = lambda n, k: number(F.trim(F.col(f"`{n}`").cast("string"))) if k == "text" else F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None))
    one = df.agg(F.array(*(F.struct(F.lit(n).alias("col"), _edges(x(n, k)).alias("edges")) for n, k in own)).alias("all"))
    return one.select(F.lit(table).alias("tbl"), F.inline("all"))


def _quantiles(domain: DataFrame, edges: DataFrame) -> DataFrame:
    """tbl, col, q: the quantiles, interpolated between the two values around each."""
    key, values = ["tbl", "col"], domain.where("x is not null").select("tbl", "col", "x", "cnt")
    bounds = edges.select(*key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(QUANTILES) - 1)), lambda i: F.struct(F.get("edges", 2 * i).alias("lo"), F.get("edges", 2 * i + 1).alias("hi")))).alias("i", "b")).select(*key, "i", "b.lo", "b.hi")
    # A row a column and quantile, so the bounds are as small as the schema. Outside a bracket the number of
    # cells below it counts, and the values next to it, which the last interpolation may need.
    each = values.join(F.broadcast(bounds), key)
    inside = each.where("x between lo and hi").groupBy(*key, "i", "x").agg(F.sum("cnt").alias("cnt"))
    less, more = F.when(F.col("x") < F.col("lo"), F.col("x")), F.when(F.col("x") > F.col("hi"), F.col("x"))
    rest = each.where("x not between lo and hi").groupBy(*key, "i").agg(F.sum(F.when(less.isNotNull(), F.col("cnt"))).alias("below"), F.max(less).alias("prev"), F.min(more).alias("next"))
    row = lambda x, cnt: F.struct(x.alias("x"), cnt.cast("long").alias("cnt"))
    rows = F.array(F.when(F.col("below") > 1, row(F.lit(None).cast("double"), F.col("below") - 1)), F.when(F.col("below") > 0, row(F.col("prev"), F.lit(1))), F.when(F.col("next").isNotNull(), row(F.col("next"), F.lit(1))))
    near = inside.union(rest.select(*key, "i", F.inline(F.array_compact(rows))))
    n = values.groupBy(*key).agg(F.sum("cnt").alias("n"))
    order = W.partitionBy(*key, "i").orderBy(F.asc_nulls_first("x"))
    ranked = near.withColumn("upto", F.sum("cnt").over(order)).where("x is not null").join(F.broadcast(n), key)
    want = F.element_at(F.array(*map(F.lit, QUANTILES)), F.col("i") + 1) * (F.col("n") - 1)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("x")))
    row = lambda df: df.groupBy(*key, "i").agg(at(F.floor(want)).alias("a"), at(F.ceil(want)).alias("b"), F.first(want - F.floor(want)).alias("f"), ((F.min(F.col("upto") - F.col("cnt")) <= F.floor(F.first(want))) & (F.max("upto") > F.ceil(F.first(want)))).alias("there"))
    got = row(ranked)
    # A sketch errs beyond its bracket with some small probability; then the whole column is ranked. The values of
    # all others stay where they are, as what was missed is at most a row a column and quantile.
    missed = each.select(*key, "i", "x", "cnt").join(F.broadcast(got.where("NOT there").select(*key, "i")), [*key, "i"], "left_semi")
    missed = missed.withColumn("upto", F.sum("cnt").over(W.partitionBy(*key, "i").orderBy("x"))).join(F.broadcast(n), key)
    got = got.where("there").unionByName(row(missed))
    got = got.select(*key, "i", (F.col("a") + F.col("f") * (F.col("b") - F.col("a"))).alias("v"))
    return got.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("q"))


def quantiles_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, lo, hi, q: extremes and exact quantiles of a number in each group. Only values inside a bracket are
    ranked, so a group with most of the rows isn't gathered."""
    own = df.select(F.col(group).alias("col"), F.col(value).cast("double").alias("x")).withColumn("tbl", F.lit(""))
    domain = stored(own.groupBy("tbl", "col", "x").agg(F.count(F.lit(1)).alias("cnt")), "domain")
    ends = domain.groupBy("tbl", "col").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    edges = own.groupBy("tbl", "col").agg(_edges(F.col("x")).alias("edges"))
    return ends.join(_quantiles(domain, edges), ["tbl", "col"], "left").select(F.col("col").alias(group), "lo", "hi", "q")


def _kept(domain: DataFrame, exact: int) -> DataFrame:
    """tbl, col, own: each column's first ``exact`` values in the order of their md5, with their places."""
    own = domain.where("v is not null").select("tbl", "col", "v", F.md5(F.col("v").cast("binary")).alias("m")).withColumn("head", F.substring("m", 1, 3))
    # Values are counted by the heads of their md5, so that only those up to the head in which the last one stands are sorted.
    heads = own.groupBy("tbl", "col", "head").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy("tbl", "col").orderBy("head")))
    last = heads.groupBy("tbl", "col").agg(F.min(F.when(F.col("upto") >= exact, F.col("head"))).alias("last"))
    own = own.join(F.broadcast(last), ["tbl", "col"]).where("last is null or head <= last")
    kept = own.select("tbl", "col", "v", F.row_number().over(W.partitionBy("tbl", "col").orderBy("m", "v")).alias("k")).where(F.col("k") <= exact)
    return kept.groupBy("tbl", "col").agg(F.collect_list(F.struct("k", "v")).alias("own"))


def _values(exact: int, sample: int) -> Column:
    """All values of a column that has up to ``exact``, else the first ``sample``."""
    own = F.filter("own", lambda s: (F.col("n_unique") <= exact) | (s["k"] <= sample))
    return F.coalesce(F.sort_array(F.transform(own, lambda s: s["v"])), F.array().cast("array<string>"))


def value_lists(tables: dict[str, DataFrame], exact: int = EXACT_UNIQUE, sample: int = SAMPLE_VALUES) -> DataFrame:
    """tbl, col, n_rows, n_unique, exact_unique, unique_vals of a profile, without the rest of it."""
    domain = _union([_domain(df, t) for t, df in tables.items()])
    base = domain.groupBy("tbl", "col").agg(F.sum("cnt").alias("n_rows"), F.count("v").alias("n_unique"))
    return base.join(_kept(domain, exact), ["tbl", "col"], "left").select("tbl", "col", "n_rows", "n_unique", (F.col("n_unique") <= exact).alias("exact_unique"), _values(exact, sample).alias("unique_vals"))


def _from_domain(domain: DataFrame, edges: DataFrame, exact: int, sample: int) -> DataFrame:
    text = F.when(F.col("kind") == "text", F.col("v"))
    # A column is of one kind. Extremes of texts would sort all values.
    of = lambda kind: F.bool_or(F.col("kind") == kind)
    base = domain.groupBy("tbl", "col").agg(
        F.sum("cnt").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("cnt"))), F.lit(0)).alias("n_null"),
        F.count("v").alias("n_unique"),
        F.when(F.count("v") == 0, "str").when(of("whole"), "int").when(of("double"), "float").otherwise(dtype_vote(text)).alias("dtype"),
        F.when(of("double"), "mixed").otherwise(char_class(F.when(F.col("kind") != "double", F.col("v")))).alias("char_class"),
        (F.sum(F.length("v") * F.col("cnt")) / F.sum(F.when(F.col("v").isNotNull(), F.col("cnt")))).alias("avg_len"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
    )
    numeric = F.col("dtype").isin("int", "float")
    stat = lambda c, name: F.when(numeric, c).alias(name)
    # A row a column; the values kept may be long, so the optimiser says how they are joined.
    both = base.join(_kept(domain, exact), ["tbl", "col"], "left").join(F.broadcast(_quantiles(domain, edges)), ["tbl", "col"], "left")
    return both.select(
        "tbl", "col", "dtype", "n_rows", "n_unique",
        (F.col("n_null") / F.greatest("n_rows", F.lit(1))).alias("null_rate"),
        stat(F.col("lo"), "num_min"), stat(F.col("hi"), "num_max"),
        stat(F.col("q")[0], "num_p25"), stat(F.col("q")[1], "num_p50"), stat(F.col("q")[2], "num_p75"),
        F.col("avg_len").alias("str_avg_len"), F.col("char_class").alias("str_char_class"),
        (F.col("n_unique") <= exact).alias("exact_unique"), _values(exact, sample).alias("unique_vals"),
    )


def profile_tables(tables: dict[str, DataFrame], exact: int = EXACT_UNIQUE, sample: int = SAMPLE_VALUES) -> DataFrame:
    """One row per column of typed or raw-string tables: counts, type, quantiles, string statistics, values.

    Distinct counts are exact, so that approximate mode only limits the values kept: all of them up to
    ``exact``, else the ``sample`` first by md5. Declared types decide; only texts are voted on.
    """
    some = {t: df for t, df in tables.items() if any(kind_of(k) for _, k in df.dtypes)}
    domain = stored(_union([_domain(df, t) for t, df in some.items()]), "domain")  # read by the counts, the lists and the quantiles
    return _from_domain(domain, _union([_brackets(df, t) for t, df in some.items()]), exact, sample)


def profile(cell: DataFrame, exact: int = EXACT_UNIQUE, sample: int = SAMPLE_VALUES) -> DataFrame:
    """The same from cells (tbl, col, raw)."""
    v = F.when(~is_null_token(F.col("raw")), F.trim("raw"))
    domain = cell.select("tbl", "col", v.alias("v")).groupBy("tbl", "col", "v").agg(F.count(F.lit(1)).alias("cnt"))
    edges = cell.groupBy("tbl", "col").agg(_edges(number(F.trim("raw"))).alias("edges"))
    return _from_domain(domain.select("tbl", "col", F.lit("text").alias("kind"), "v", number(F.col("v")).alias("x"), "cnt"), edges, exact, sample)


def sketches(cell: DataFrame, lg_k: int = 12) -> DataFrame:
    """Mergeable distinct-count sketches per column, for profiles that are kept up incrementally."""
    return cell.where(~is_null_token(F.col("raw"))).groupBy("tbl", "col").agg(F.hll_sketch_agg("raw", F.lit(lg_k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def fingerprint(df: DataFrame) -> str | None:
    """Names, sizes and times of a file-backed table's files as one hash."""
    files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("m")).distinct()
    each = F.concat_ws("|", "f", "s", F.col("m").cast("string"))
    return files.agg(F.md5(F.array_join(F.sort_array(F.collect_list(each)), ",").cast("binary"))).first()[0]


def cached_profile(df: DataFrame, table: str, path: str, rebuild: bool = False) -> DataFrame:
    """The profile of a file-backed table, kept at ``path`` as long as the input files don't change."""
    spark, stamp = df.sparkSession, fingerprint(df)
    try:
        old = spark.read.parquet(f"{path}/{table}")
        if not rebuild and old.select("fingerprint").first() == (stamp,):
            return old.drop("fingerprint")
    except Exception as e:  # only a missing cache is rebuilt
        if "PATH_NOT_FOUND" not in str(e):
            raise
    profile_tables({table: df}).withColumn("fingerprint", F.lit(stamp)).write.mode("overwrite").parquet(f"{path}/{table}")
    return spark.read.parquet(f"{path}/{table}").drop("fingerprint")

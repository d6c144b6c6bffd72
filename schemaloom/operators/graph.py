"""The attribute graph, its transition matrix, and row features grouped by signature."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def edges(fds: DataFrame | None = None, inds: DataFrame | None = None, bridge: DataFrame | None = None, positional: bool = True) -> DataFrame:
    """src, dst, kind, weight: FDs point from left to right, INDs and bridges both ways; repeats add up.
    Without inputs there are no edges.

    ``positional`` pairs the sides of a composite IND by place; otherwise all with all.
    """
    parts = [SparkSession.active().createDataFrame([], "src int, dst int, kind string")]
    every = lambda d: d.select(F.explode("lhs").alias("src"), "rhs").select("src", F.explode("rhs").alias("dst"))
    if fds is not None:
        parts.append(every(fds).withColumn("kind", F.lit("fd")))
    if inds is not None:
        one = inds.select(F.inline(F.arrays_zip("lhs", "rhs"))).toDF("src", "dst") if positional else every(inds)
        parts.append(one.union(one.select("dst", "src")).withColumn("kind", F.lit("ind")))
    if bridge is not None:
        both = bridge.select(F.col("t_attr").alias("src"), F.col("s_attr").alias("dst"))
        parts.append(both.union(both.select("dst", "src")).withColumn("kind", F.lit("bridge")))
    return reduce(DataFrame.union, parts).groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def transition(edge: DataFrame) -> DataFrame:
    """src, dst, p: weights over the sum of the row."""
    w = edge.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    return w.select("src", "dst", (F.col("w") / F.sum("w").over(W.partitionBy("src"))).alias("p"))


def propagate(p: DataFrame, start: DataFrame, hops: int, alpha: float = 0.5) -> DataFrame:
    """attr_id, col, value: alpha * sum over l of (1 - alpha)^l P^l applied to start (attr_id, col, value)."""
    term, out = start, start.withColumn("value", F.lit(alpha) * F.col("value"))
    for step in range(1, hops + 1):
        term = F.broadcast(p).join(term, F.col("dst") == F.col("attr_id")).groupBy(F.col("src").alias("attr_id"), "col").agg(F.sum(F.col("p") * F.col("value")).alias("value"))
        out = out.union(term.withColumn("value", F.lit(alpha * (1 - alpha) ** step) * F.col("value")))
    return out.groupBy("attr_id", "col").agg(F.sum("value").alias("value"))


def signatures(feature: DataFrame) -> DataFrame:
    """sig, mult: rows with the same attributes are one column with a multiplicity; nothing is lost."""
    return feature.distinct().groupBy("row_gid").agg(F.sort_array(F.collect_list("attr_id")).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("mult"))


def reversed_start(columns: DataFrame) -> DataFrame:
    """attr_id, col, mult, value from sig, col and mult: features normalised by row and then by column."""
    each = columns.select("col", "mult", F.explode("sig").alias("attr_id"))
    row = each.groupBy("attr_id").agg(F.sum("mult").alias("w"))
    each = each.join(row, "attr_id").withColumn("r", 1 / F.col("w"))
    return each.select("attr_id", "col", "mult", (F.col("r") / F.sum("r").over(W.partitionBy("col"))).alias("value"))


def backward(p: DataFrame, columns: DataFrame, hops: int, alpha: float = 0.5) -> DataFrame:
    """attr_id, col, value: walks along reversed edges to the columns (sig, col, mult) of the features."""
    start = reversed_start(columns)
    return propagate(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p"), start.select("attr_id", "col", "value"), hops, alpha)


def log_affinity_backward(value: DataFrame, columns: DataFrame) -> DataFrame:
    """attr_id, col, value: log2(d * y + 1) of values normalised by node over all d columns, with their multiplicities.

    A node's sum is taken before it meets the node's cells again, so no node's columns are gathered.
    """
    each = value.join(columns.select("col", "mult"), "col")
    share = each.groupBy("attr_id").agg(F.sum(F.col("mult") * F.abs("value")).alias("share"))
    d = columns.agg(F.sum("mult").alias("d"))
    y = F.when(F.col("share") == 0, 0.0).otherwise(F.col("value") / F.col("share"))
    return each.join(share, "attr_id").crossJoin(d).select("attr_id", "col", F.log2(F.col("d") * y + 1).alias("value"))  # one number


#: Nodes from which on affinities aren't normalised.
MANY_NODES = 1_000_000


def log_affinity(forward: DataFrame, n: int, many: int = MANY_NODES) -> DataFrame:
    """log2(n * z + 1), of column-normalised values, or of the values themselves from ``many`` on."""
    total = F.sum("value").over(W.partitionBy("col"))
    z = F.when(total == 0, 0.0).otherwise(F.col("value") / total) if n < many else F.col("value")
    return forward.select("attr_id", "col", F.log2(n * z + 1).alias("value"))


def gram(z: DataFrame) -> DataFrame:
    """i, j, g: sums over columns of mult * z_i * z_j, i <= j; columns carry mult."""
    a, b = z.alias("a"), z.alias("b")
    return a.join(b, (F.col("a.col") == F.col("b.col")) & (F.col("a.attr_id") <= F.col("b.attr_id"))).groupBy(F.col("a.attr_id").alias("i"), F.col("b.attr_id").alias("j")).agg(F.sum(F.col("a.mult") * F.col("a.value") * F.col("b.value")).alias("g"))


#: Rows of a shard and queries of a block: a task holds one of each. Shards, at least.
SHARD, BLOCK, SHARDS = 1 << 16, 1 << 14, 16


def _top(left: pd.DataFrame, right: pd.DataFrame, k: int, digits: int) -> pd.DataFrame:
    """The k rows of left nearest to each row of right; equal rounded cosines go by id."""
    none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "cosine": np.empty(0)})
    if left.empty or right.empty:
        return none
    left, unit, out = left.sort_values("id"), 10**digits, [none]

    def scaled(v):
        x = np.stack(v.to_list()).astype(np.float64)
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    x, y, a = scaled(left["v"]), scaled(right["v"]), left["id"].to_numpy()
    for at in range(0, len(y), 512):
        best = np.empty((len(y[at : at + 512]), 0), np.int64)
        for i in range(0, len(x), 8192):
            c = y[at : at + 512] @ x[i : i + 8192].T * unit
            c = (np.sign(c) * np.floor(np.abs(c) + 0.5)).astype(np.int64)
            best = np.concatenate([best, (c << 32) - np.arange(i, i + c.shape[1])], axis=1)  # a cosine, then a place
            if best.shape[1] > k:
                best = -np.partition(-best, k - 1, axis=1)[:, :k]
        c = -(-best >> 32)  # places count down, so the cosine is rounded up
        out.append(pd.DataFrame({"a": a[((c << 32) - best).ravel()], "b": np.repeat(right["id"].to_numpy()[at : at + 512], best.shape[1]), "cosine": c.ravel() / unit}))
    return pd.concat(out[1:] or out)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, digits: int = 4, vector: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """a, b, cosine, rank: the k rows a nearest to each query b, by the rounded cosine and then by a.

    rows, queries: id and a vector, all of one length. Every block of queries meets every shard of
    rows in a task that gives out its best k, so neither side is broadcast. A zero vector gives 0;
    rows without an id or a vector have no part.
    """
    pick = lambda df: df.where(F.col("id").isNotNull() & F.col(vector).isNotNull()).select(F.col("id").cast("long").alias("id"), F.col(vector).alias("v"))
    left, right = pick(rows), pick(queries)
    n, m = max(SHARDS, -(-left.count() // shard)), -(-right.count() // block) or 1
    own = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left, right = left.select("*", own(n).alias("s"), each(m).alias("t")), right.select("*", each(n).alias("s"), own(m).alias("t"))
    best = left.groupBy("s", "t").cogroup(right.groupBy("s", "t")).applyInPandas(lambda x, y: _top(x, y, k, digits), "a long, b long, cosine double")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("b").orderBy(F.desc("cosine"), "a")).cast("long")).where(F.col("rank") <= k)

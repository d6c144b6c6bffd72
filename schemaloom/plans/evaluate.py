"""Evaluation plans: target samples, signal-only rankings, controls, sweeps and ablations.

Everything is long: sim (run_id, t_attr, s_attr, score) and truth (run_id, t_attr, s_attr) in, metric rows
(run_id, name, value) out, so that any number of runs is one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import metrics, refine, signals

SIGNALS = ("subset", "type", "dist", "semantic", "total")
KS = (1, 3, 5)


def sample_rows(target: DataFrame, n: int, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """n rows of a target by a seeded hash of their ids; all of them if there are no more."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(row_id).cast("string")).cast("binary"))
    ids = target.select(row_id).distinct().withColumn("k", order).orderBy("k", row_id).limit(n).select(row_id)
    return target.join(F.broadcast(ids), row_id, "left_semi")  # n rows


def signal_rankings(scores: DataFrame, run: str = "") -> DataFrame:
    """sim of each signal by itself and of their fusion: runs named after them."""
    long = scores.unpivot(["t_attr", "s_attr"], list(SIGNALS), "signal", "score")
    return long.select(F.concat(F.lit(run), "signal").alias("run_id"), "t_attr", "s_attr", "score")


def scores_of(sim: DataFrame, truth: DataFrame, ks=KS) -> DataFrame:
    """run_id, name, value: hit rates, MRR and recall with ties by the lower id."""
    hits = metrics.hit_at_k(sim, truth, ks).select("run_id", F.concat(F.lit("p"), F.col("k").cast("string")).alias("name"), F.col("hit").alias("value"))
    rank = metrics.mrr(sim, truth).select("run_id", F.lit("mrr").alias("name"), F.col("mrr").alias("value"))
    recall = metrics.recall_at_gt(sim, truth).select("run_id", F.lit("recall").alias("name"), F.col("recall").alias("value"))
    return reduce(DataFrame.union, (hits, rank, recall))


def expected_of(sim: DataFrame, truth: DataFrame, ks=KS) -> DataFrame:
    """The same, as expected under random ties; this is the default for reports."""
    names = [*(f"p{k}" for k in ks), "mrr", "recall"]
    return metrics.expected(sim, truth, ks).unpivot("run_id", names, "name", "value")


def random_bridges(scores: DataFrame, k: int = 3, seeds=range(42, 52)) -> DataFrame:
    """t_attr, s_attr, rank, seed: one random bridge for each seed."""
    return reduce(DataFrame.union, (signals.random_bridge(scores, k, s).withColumn("seed", F.lit(s)) for s in seeds))


def bridge_hits(bridges: DataFrame, truth: DataFrame) -> DataFrame:
    """seed, hit: the share of target columns with a truth among their partners."""
    each = bridges.join(truth.select("t_attr", "s_attr").distinct().withColumn("ok", F.lit(1)), ["t_attr", "s_attr"], "left")
    known = each.join(truth.select("t_attr").distinct(), "t_attr", "left_semi")
    return known.groupBy("seed", "t_attr").agg(F.max(F.coalesce("ok", F.lit(0))).alias("ok")).groupBy("seed").agg(F.avg("ok").alias("hit"))


def reward_sweep(rewards=(0.01, 0.02, 0.05), top=(1, 3)) -> dict[str, refine.Config]:
    """Single rounds with fixed rewards."""
    return {f"r{r}_k{k}": refine.Config(fixed=dict.fromkeys(refine.KINDS, r), k_max=k) for r in rewards for k in top}


#: Variants of the ablation: stage, use of INDs in the graph, random bridges, kinds of rewards.
VARIANTS = {"V0": ("ref", True, False, "all"), "V1": ("emb", True, False, None), "V2": ("emb", False, False, None), "V3": ("ref", True, True, "all"), "V4": ("ref", True, False, "fd"), "V5": ("ref", True, False, "ind")}
#: What a variant equals where there are no INDs.
FALLBACK = {"V2": "V1", "V5": "V1"}


def hits_and_errors(sim: DataFrame, truth: DataFrame, ks=KS) -> DataFrame:
    """The detail of metrics for each k."""
    return reduce(DataFrame.union, (metrics.detail(sim, truth, k).withColumn("k", F.lit(k)) for k in ks))


def embedding_sim(vectors: DataFrame, n_source: int, run: str = "emb") -> DataFrame:
    """sim by cosine from vectors (attr_id, fwd, bwd): targets are the attributes from ``n_source`` on."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    v = vectors.select("attr_id", F.concat("fwd", "bwd").alias("v")).withColumn("n", F.sqrt(dot("v", "v")))
    t, s = v.where(F.col("attr_id") >= n_source).alias("t"), v.where(F.col("attr_id") < n_source).alias("s")
    scale = F.col("t.n") * F.col("s.n")
    each = t.crossJoin(F.broadcast(s))  # attributes of one schema
    return each.select(F.lit(run).alias("run_id"), (F.col("t.attr_id") - n_source).alias("t_attr"), F.col("s.attr_id").alias("s_attr"), F.when(scale == 0, 0.0).otherwise(dot("t.v", "s.v") / scale).alias("score"))


def best_first(metric: DataFrame) -> DataFrame:
    """Runs ranked by each metric."""
    return metric.withColumn("place", F.rank().over(W.partitionBy("name").orderBy(F.desc("value"))))

"""Ranking metrics, random bounds, transitions and reports over sim (run_id, t_attr, s_attr, score)
and truth (run_id, t_attr, s_attr).

Deterministic metrics break ties by the lower source id. ``expected`` gives what random tie-breaking
gives on average, in closed form. Truths are joined as they come: they are small in a match, but their
size isn't this module's to promise, so the optimiser chooses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["run_id", "t_attr", "s_attr"]


def _marked(sim: DataFrame, truth: DataFrame) -> DataFrame:
    """All cells, with hit."""
    return sim.join(truth.select(*KEY).distinct().withColumn("hit", F.lit(True)), KEY, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def ranked(sim: DataFrame, truth: DataFrame) -> DataFrame:
    """Cells of the target columns that have a truth, with rank and hit."""
    order = W.partitionBy("run_id", "t_attr").orderBy(F.desc("score"), "s_attr")
    known = truth.select("run_id", "t_attr").distinct()
    return _marked(sim.join(known, ["run_id", "t_attr"], "left_semi"), truth).withColumn("rank", F.row_number().over(order))


def firsts(sim: DataFrame, truth: DataFrame) -> DataFrame:
    """For each target column with a truth, the rank of its first hit; null if it has none, or no cells."""
    first = ranked(sim, truth).groupBy("run_id", "t_attr").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return truth.select("run_id", "t_attr").distinct().join(first, ["run_id", "t_attr"], "left")


def hit_at_k(sim: DataFrame, truth: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    each = firsts(sim, truth).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return each.groupBy("run_id", "k").agg(F.avg(F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).cast("double")).alias("hit"))


def mrr(sim: DataFrame, truth: DataFrame) -> DataFrame:
    return firsts(sim, truth).groupBy("run_id").agg(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def recall_at_gt(sim: DataFrame, truth: DataFrame) -> DataFrame:
    size = truth.select(*KEY).distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("g"))
    top = sim.withColumn("rank", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("score"), "t_attr", "s_attr"))).join(size, "run_id").where("rank <= g")
    got = top.join(truth.select(*KEY).distinct(), KEY, "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return size.join(got, "run_id", "left").select("run_id", (F.coalesce("n", F.lit(0)) / F.col("g")).alias("recall"))


def _miss(n: Column, g: Column, j: Column) -> Column:
    """Probability that none of g good ones is among the first j of n in random order."""
    some = F.when(j >= 1, F.sequence(F.lit(0), F.least(j, n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(some, F.lit(1.0), lambda a, i: a * F.greatest(F.lit(0.0), (n - g - i) / (n - i)))


def expected(sim: DataFrame, truth: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """run_id, p<k>, mrr, recall: the expected values when equal scores are ranked at random."""
    level = _marked(sim, truth).groupBy("run_id", "t_attr", "score").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("g"))
    above = W.partitionBy("run_id", "t_attr").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    first = level.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))).where("g > 0").groupBy("run_id", "t_attr").agg(F.max_by(F.struct("n", "g", "before"), "score").alias("x"))
    first = truth.select("run_id", "t_attr").distinct().join(first, ["run_id", "t_attr"], "left")  # a truth that isn't a cell is never hit
    n, g, before = (F.col(f"x.{c}") for c in ("n", "g", "before"))
    hits = [F.avg(F.coalesce(1 - _miss(n, g, k - before), F.lit(0.0))).alias(f"p{k}") for k in ks]
    state = F.struct(F.lit(1.0).alias("left"), F.lit(0.0).alias("sum"))
    chance = lambda r: F.least(F.lit(1.0), g / (n - r + 1))
    walk = F.aggregate(F.sequence(F.lit(1), F.when(n.isNull(), 1).otherwise((n - g + 1).cast("int"))), state, lambda a, r: F.struct((a["left"] * (1 - chance(r))).alias("left"), (a["sum"] + a["left"] * chance(r) / (before + r)).alias("sum")))["sum"]
    tops = first.groupBy("run_id").agg(*hits, F.avg(F.coalesce(walk, F.lit(0.0))).alias("mrr"))
    size = truth.select(*KEY).distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("all"))
    whole = level.groupBy("run_id", "score").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("run_id").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    slots = F.greatest(F.lit(0), F.least("n", F.col("all") - F.col("before")))
    recall = whole.join(size, "run_id").groupBy("run_id").agg((F.sum(F.col("g") * slots / F.col("n")) / F.first("all")).alias("recall"))
    return tops.join(recall, "run_id", "left").withColumn("recall", F.coalesce("recall", F.lit(0.0)))


def threshold_hits(sim: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    each = ranked(sim, truth).groupBy("run_id", "t_attr").agg(F.bool_or(F.col("hit") & (F.col("score") > threshold)).alias("ok"))
    return each.groupBy("run_id").agg(F.avg(F.col("ok").cast("double")).alias("hit"))


def first_truths(truth: DataFrame) -> DataFrame:
    """The first truth of each target column."""
    return truth.groupBy("run_id", "t_attr").agg(F.min("s_attr").alias("s_attr"))


def _f1(right: Column, said: Column, want: Column) -> list[Column]:
    p, r = F.coalesce(F.try_divide(right, said), F.lit(0.0)), F.coalesce(F.try_divide(right, want), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def top1_f1(sim: DataFrame, truth: DataFrame) -> DataFrame:
    """The best cell of every target column is its prediction, whatever its score; its first truth is right."""
    order = W.partitionBy("run_id", "t_attr").orderBy(F.desc("score"), "s_attr")
    said = sim.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    n = _marked(said, first_truths(truth)).groupBy("run_id").agg(F.count(F.lit(1)).alias("said"), F.count_if("hit").alias("right"))
    want = first_truths(truth).groupBy("run_id").agg(F.count(F.lit(1)).alias("want"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return n.join(want, "run_id", "full").select("run_id", *_f1(zero("right"), zero("said"), zero("want")))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment by shortest augmenting paths; every row gets a column if there are enough."""
    if cost.shape[0] > cost.shape[1]:
        return [(i, j) for j, i in assign(cost.T)]
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, base, last = i, 0.0, -1
        while True:
            d = base + cost[row] - u[row] - v
            better = ~done & (d < dist)
            dist[better], via[better] = d[better], last
            j = int(np.where(done, np.inf, dist).argmin())
            base, last = dist[j], j
            if owner[j] < 0:
                break
            done[j] = True
            row = owner[j]
        u[i] += base
        for j in np.flatnonzero(done):
            u[owner[j]] += base - dist[j]
            v[j] += dist[j] - base
        while last >= 0:
            back = via[last]
            owner[last] = i if back < 0 else owner[back]
            last = back
    return [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]


def assignment_f1(sim: DataFrame, truth: DataFrame) -> DataFrame:
    """Optimal one-to-one assignment per run, best F1 over thresholds 0, 0.01 .. 1.10 that scores must
    reach; the first truth of a target column is right. The lowest of equally good thresholds counts."""

    def one(left, right):
        run = (left.column("run_id") if left.num_rows else right.column("of"))[0].as_py()
        best = (0.0, 0.0)
        if left.num_rows:
            t, s, x = (left.column(c).to_numpy() for c in ("t_attr", "s_attr", "score"))
            ts, ss = sorted(set(t)), sorted(set(s))
            m = np.zeros((len(ts), len(ss)))
            m[np.searchsorted(ts, t), np.searchsorted(ss, s)] = x
            pairs = [(ts[i], ss[j], m[i, j]) for i, j in assign(-m)]
            want = set(zip(right.column("t").to_pylist(), right.column("s").to_pylist()))
            for k in range(111):
                said = [(a, b) for a, b, v in pairs if v >= k / 100]
                hits = sum(p in want for p in said)
                if hits:
                    p, r = hits / len(said), hits / len(want)
                    best = max(best, (2 * p * r / (p + r), -k / 100))
        return pa.table({"run_id": pa.array([run], pa.string()), "threshold": [abs(best[1])], "f1": [best[0]]})

    right = first_truths(truth).select(F.col("run_id").alias("of"), F.col("t_attr").alias("t"), F.col("s_attr").alias("s"))  # names of its own
    return sim.groupBy("run_id").cogroup(right.groupBy("of")).applyInArrow(lambda a, b: one(a, b), "run_id string, threshold double, f1 double")


def analytic_random(truth: DataFrame, n_source: int, ks=(1, 3, 5)) -> DataFrame:
    """Expected metrics of a random ranking over n_source columns."""
    g = truth.groupBy("run_id", "t_attr").agg(F.count_distinct("s_attr").alias("g"))
    miss = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * F.greatest(F.lit(0.0), (n_source - F.col("g") - i) / (n_source - i)))
    # P(first hit at r) = P(no hit before) * g / (N - r + 1)
    ranks = F.sequence(F.lit(1), F.lit(n_source))
    state = F.struct(F.lit(1.0).alias("left"), F.lit(0.0).alias("sum"))
    walk = F.aggregate(ranks, state, lambda a, r: F.struct((a["left"] * F.greatest(F.lit(0.0), 1 - F.col("g") / (n_source - r + 1))).alias("left"), (a["sum"] + a["left"] * F.least(F.lit(1.0), F.col("g") / (n_source - r + 1)) / r).alias("sum")))["sum"]
    cells = F.sum("g") / (F.count(F.lit(1)) * n_source)
    return g.groupBy("run_id").agg(*(F.avg(1 - miss(k)).alias(f"p{k}") for k in ks), F.avg(walk).alias("mrr"), cells.alias("recall"))


def transitions(before: DataFrame, after: DataFrame, truth: DataFrame, k: int = 1) -> DataFrame:
    """Per target column: kept, improved, dropped or missed between two matrices."""
    hit = lambda sim, name: firsts(sim, truth).select("run_id", "t_attr", F.coalesce(F.col("first") <= k, F.lit(False)).alias(name))
    both = hit(before, "was").join(hit(after, "now"), ["run_id", "t_attr"], "full")
    return both.select("run_id", "t_attr", F.when(F.col("was") & F.col("now"), "kept").when(F.col("now"), "improved").when(F.col("was"), "dropped").otherwise("missed").alias("change"))


def detail(sim: DataFrame, truth: DataFrame, k: int = 1) -> DataFrame:
    """For each target column with a truth: its k best, best first, its truths, the matched ones, hit."""
    each = ranked(sim, truth)
    listed = lambda c, keep: F.transform(F.sort_array(F.collect_list(F.when(keep, c))), lambda s: s["s_attr"])
    own, top = F.struct("rank", "s_attr"), F.col("rank") <= k
    said = each.groupBy("run_id", "t_attr").agg(listed(own, top).alias("predicted"), listed(F.struct(F.col("s_attr").alias("o"), "s_attr"), top & F.col("hit")).alias("matched"))
    want = truth.groupBy("run_id", "t_attr").agg(F.sort_array(F.collect_set("s_attr")).alias("truth"))
    return said.join(want, ["run_id", "t_attr"]).withColumn("hit", F.size("matched") > 0)


def summary(metric: DataFrame) -> DataFrame:
    """stage, dataset, n_inst, name, value rolled up to averages of each metric, and over data sets."""
    return metric.rollup("stage", "name", "dataset", "n_inst").agg(F.avg("value").alias("value")).where("stage is not null and name is not null")


def pivoted(metric: DataFrame, names: list[str]) -> DataFrame:
    """A row for each stage, dataset and n_inst, with a column for each metric."""
    return metric.groupBy("stage", "dataset", "n_inst").pivot("name", names).agg(F.avg("value"))


def dose_response(metric: DataFrame, base: float = 1.0) -> DataFrame:
    """Averages by dataset, fraction, stage and metric, and how far they are from those of the whole dose."""
    key = ["dataset", "stage", "name"]
    each = metric.groupBy(*key, "fraction").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("targets"))
    whole = each.where(F.col("fraction") == base).select(*key, F.col("value").alias("whole"))
    return each.join(whole, key, "left").select(*key, "fraction", "targets", "value", (F.col("value") - F.col("whole")).alias("change"))


def with_fallback(sim: DataFrame, wanted: DataFrame, fallback: dict[str, str]) -> DataFrame:
    """wanted: dataset, target, variant, no_ind. The matrix of each wanted variant; where it is missing in a
    data set without INDs, that of the variant it must equal there. ``used`` names the one that was taken."""
    have = sim.select("dataset", "target", "variant").distinct()
    other = F.coalesce(*(F.when(F.col("variant") == v, F.lit(w)) for v, w in fallback.items()), F.col("variant"))
    ask = wanted.join(have.withColumn("there", F.lit(True)), ["dataset", "target", "variant"], "left")
    ask = ask.select("dataset", "target", F.col("variant").alias("asked"), F.when(F.col("there"), F.col("variant")).when(F.col("no_ind"), other).alias("used")).where("used is not null")
    return sim.withColumnRenamed("variant", "used").join(ask, ["dataset", "target", "used"]).withColumnRenamed("asked", "variant")


def multi_run(metric: DataFrame) -> DataFrame:
    return metric.groupBy("stage", "name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def same(a: DataFrame, b: DataFrame, tol: float = 1e-9) -> DataFrame:
    """The largest difference of two matrices per run, and whether it is within the tolerance."""
    off = a.select(*KEY, F.col("score").alias("x")).join(b.select(*KEY, F.col("score").alias("y")), KEY, "full")
    return off.groupBy("run_id").agg(F.max(F.coalesce(F.abs(F.col("x") - F.col("y")), F.lit(float("inf")))).alias("off")).withColumn("same", F.col("off") <= tol)

"""Operator 11, filter interaction audit: what each filter removes after any others, from one SQL CUBE.

Rows carry a boolean failure flag a filter and fall into parts. They are counted once, by part and flags.
A CUBE over the part and the flags then holds a grouping set for each subset of the filters, and its
row in which all selected flags are false counts the rows that this subset lets through. A filter that
is applied after a set of others goes from the survivors of that set to those of the set with it, so
each step of each order is a pair of subsets, joined by part; what a filter removes in any order, and
its share over all orders, follows from n * 2^(n-1) pairs, however many rows there were.

Whether a text repeats that of a smaller doc_id is found without sending the copies of a text to one
task: rows are counted by digest, part and labels first, and only those counts meet in a digest.

Defined results: null texts count as empty, null parts as the empty string. A null doc_id is smaller
than none and larger than none, so its row repeats nothing and is repeated by nothing. Rows repeated with
doc_id and text each count, and none repeats the other. Of several labels of a document each counts.
Labels of no document are ignored, and null labels say nothing. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, stored

SPACE = r"[\x20\x09-\x0D]+"
FILTERS = list("ABCDE")
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3
#: All orders of more filters than these are too many rows to be read.
MAX_FILTERS = 7


def failures(docs: DataFrame, labels: DataFrame, tmp: Scratch) -> DataFrame:
    """part, A to E, n, good, toxic: counts of the documents that fail so, and of those that labels call good and toxic."""
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    text = text.withColumn("words", F.array_remove(F.split("t", SPACE), ""))
    each = text.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("t", 256)).alias("copy"),
        (F.size("words") < MIN_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * F.size("words")).alias("B"),
        (100 * F.regexp_count("t", F.lit("[A-Z]")).cast("long") > MAX_UPPER_PERCENT * F.length("t").cast("long")).alias("C"),
        F.col("t").rlike("[#$%&*|]").alias("D"),
    )
    each = each.groupBy("copy", "doc_id", "part", *"ABCD").agg(F.count(F.lit(1)).alias("n"))
    # A table of its own beside a doc_id that many rows may have, so that adaptive execution can split these.
    marks = labels.groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    each = each.join(tmp.stored(marks.where("doc_id IS NOT NULL AND (good OR toxic)"), "marks"), "doc_id", "left").na.fill(False, ["good", "toxic"])

    alike = each.groupBy("copy", "part", *"ABCD", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    first = F.col("least.doc_id") == F.min("least.doc_id").over(W.partitionBy("copy"))
    alike = alike.withColumn("new", F.col("nameless") + F.when(first, F.col("least.n")).otherwise(0))
    both = F.array(F.struct(F.lit(False).alias("E"), F.col("new").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("new")).alias("n")))
    split = alike.select("part", *"ABCD", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def survivors(cells: DataFrame, flags: list[str], sums: list[str]) -> DataFrame:
    """part, subset, sums: for each part and subset of ``flags`` (a mask, the first flag its highest bit), the sums
    over the cells that fail none of the subset; 0 where all fail."""
    every = (1 << len(flags)) - 1
    cube = cells.cube("part", *flags).agg(*(F.sum(c).alias(c) for c in sums), F.grouping_id().alias("rolled"))
    cube = cube.where(F.col("rolled") <= every)  # by part
    for flag in flags:
        cube = cube.where(~F.coalesce(flag, F.lit(False)))  # rolled up, or false
    cube = cube.select("part", (F.lit(every) - F.col("rolled")).cast("int").alias("subset"), *sums)
    whole = cells.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(every))).alias("subset"))
    return whole.join(cube, ["part", "subset"], "left").na.fill(0, sums)


def audit(cells: DataFrame, flags: list[str]) -> DataFrame:
    """A row per part, order of ``flags`` and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``cells`` holds part, the flags and the additive n, good and toxic; it is read several times.
    """
    if len(flags) > MAX_FILTERS:
        raise ValueError(f"at most {MAX_FILTERS} filters, not {len(flags)}")
    spark, size = cells.sparkSession, len(flags)
    bit, every = {f: 1 << (size - 1 - i) for i, f in enumerate(flags)}, (1 << size) - 1
    pairs, steps = [], []
    for f in flags:
        others = [x for x in flags if x != f]
        for k in range(size):
            orders = math.factorial(k) * math.factorial(size - 1 - k)
            pairs += [(f, sum(bit[x] for x in before), sum(bit[x] for x in before) | bit[f], orders) for before in combinations(others, k)]
    for order in permutations(flags):
        steps += [("".join(order), k + 1, f, sum(bit[x] for x in order[:k])) for k, f in enumerate(order)]
    # Both tables are as large as the number of filters makes them, whatever the input.
    pairs = spark.createDataFrame(pairs, "filter string, before int, after int, orders long")
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int")

    let = survivors(cells, flags, ["n", "good", "toxic"])
    names = lambda s: [F.col("subset").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("n", "good", "toxic"))]
    gone = let.select("part", *names("before")).join(F.broadcast(pairs), "before").join(let.select("part", *names("after")), ["part", "after"])
    gone = gone.select("part", "filter", "before", "after", "orders", F.col("after_n").alias("kept"), *((F.col(f"before_{c}") - F.col(f"after_{c}")).alias(out) for c, out in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))))
    whole = gone.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("after") == every, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    out = gone.join(whole, ["part", "filter"]).join(F.broadcast(steps), ["filter", "before"])
    return out.select("part", "filter_order", "step", "filter", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    with Scratch(spark) as tmp:
        cells = stored(failures(docs, labels, tmp), "cells")
    return audit(cells, FILTERS).drop("filter")


#: No subsets: each order's steps are applied to the documents' failures, letter by letter.
OP11_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM w),
lab AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN lab USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, filter_order[:step - 1] AS earlier, filter_order[step] AS own FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
s AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS hit, translate(fails, earlier, '') = fails AS here, fails = own AS only_this FROM cells, steps),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (here AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (here AND hit), 0) AS removed,
         coalesce(sum(n) FILTER (hit AND NOT here), 0) AS redundant, coalesce(sum(n) FILTER (only_this), 0) AS unique_fails,
         coalesce(sum(good) FILTER (here AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND hit), 0) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""

"""Four similarity signals of target and source columns, their fusion and the bridge.

``target``: t_attr, raw (a row per target cell). ``source``: profiles with s_attr. Only column
summaries and bounded value lists (at most EXACT_UNIQUE a column) are crossed, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import char_class, dtype_vote, is_null_token, number
from ..sources.shared import stored

WEIGHTS = {"subset": 0.4, "type": 0.2, "dist": 0.2, "semantic": 0.2}


def target_summary(target: DataFrame) -> DataFrame:
    v = F.when(~is_null_token(F.col("raw")), F.trim("raw"))
    x = number(F.trim("raw"))
    # The middle number by counts of equal ones, which combine before a column's numbers are put in order.
    counts = target.select("t_attr", x.alias("x")).where("x is not null").groupBy("t_attr", "x").agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy("t_attr")
    middle = counts.withColumns({"upto": F.sum("c").over(order.orderBy("x")), "half": F.floor(F.sum("c").over(order) / 2)}).where("upto > half").groupBy("t_attr").agg(F.min("x").alias("t_med"))
    summary = target.groupBy("t_attr").agg(
        dtype_vote(v).alias("t_type"), F.count_distinct("raw").alias("t_card"), F.avg(F.length(v)).alias("t_len"), char_class(v).alias("t_class"),
        F.min(x).alias("t_min"), F.max(x).alias("t_max"), F.count(x).alias("t_nums"), F.count(v).alias("t_vals"),
    )
    return summary.join(middle, "t_attr", "left")


def pairs(target: DataFrame, source: DataFrame) -> DataFrame:
    return target_summary(target).crossJoin(F.broadcast(source))


def subset_signal(target: DataFrame, source: DataFrame) -> DataFrame:
    """Share of distinct target values among the source's; beyond the exact size, values outside the
    sample count by the source's share of distinct rows."""
    own = target.where("raw is not null").select("t_attr", "raw").distinct()
    size = own.groupBy("t_attr").agg(F.count(F.lit(1)).alias("n"))
    values = source.select("s_attr", F.explode("unique_vals").alias("raw"))
    hit = own.join(values, "raw").groupBy("t_attr", "s_attr").agg(F.count(F.lit(1)).alias("m"))
    both = target.select("t_attr").distinct().join(size, "t_attr", "left").crossJoin(F.broadcast(source.select("s_attr", "exact_unique", "n_unique", "n_rows"))).join(hit, ["t_attr", "s_attr"], "left")
    m, n = F.coalesce("m", F.lit(0)), F.coalesce("n", F.lit(0))
    rest = F.when(F.col("exact_unique"), 0.0).otherwise((n - m) / n * F.least(F.lit(1.0), F.col("n_unique") / F.greatest("n_rows", F.lit(1))))
    return both.select("t_attr", "s_attr", F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), m / n + rest)).alias("subset"))


def type_signal(pair: DataFrame) -> DataFrame:
    t, s, num = F.col("t_type"), F.col("dtype"), ["int", "float"]
    base = F.when(t == s, 1.0).when(t.isin(num) & s.isin(num), 0.8).when((t == "bool") & s.isin(num), 0.5).when((t == "mixed") | (s == "mixed"), 0.2).when((t == "str") | (s == "str"), 0.3).otherwise(0.0)
    bonus = F.when((F.col("n_unique") > 0) & (F.col("t_card") / F.col("n_unique")).between(0.05, 5.0), 0.1).otherwise(0.0)
    return pair.select("t_attr", "s_attr", F.least(F.lit(1.0), base + bonus).alias("type"))


def distribution_signal(pair: DataFrame) -> DataFrame:
    overlap = F.greatest(F.lit(0.0), F.least("t_max", "num_max") - F.greatest("t_min", "num_min"))
    reach = F.least(F.lit(1.0), overlap / F.greatest(F.col("t_max") - F.col("t_min"), F.lit(1e-9)))
    iqr = F.col("num_p75") - F.col("num_p25")
    off = F.greatest(F.lit(0.0), F.least(F.abs(F.col("t_med") - F.col("num_p25")), F.abs(F.col("t_med") - F.col("num_p75"))) - iqr)
    near = F.greatest(F.lit(0.0), 1 - off / (iqr + 1e-9))
    apart = (F.col("t_max") < F.col("num_min")) | (F.col("t_min") > F.col("num_max"))
    numeric = F.when(F.col("t_nums") == 0, 0.1).when(F.col("num_min").isNull(), 0.0).when(apart, 0.0).otherwise(0.6 * reach + 0.4 * near)
    a, b = F.col("t_class"), F.col("str_char_class")
    kind = F.when(a == b, 1.0).when(a.isin("alpha", "alnum") & b.isin("alpha", "alnum"), 0.5).otherwise(0.2)
    size = 1 - F.abs(F.col("t_len") - F.col("str_avg_len")) / F.greatest("t_len", "str_avg_len", F.lit(1e-9))
    text = F.when((F.col("t_vals") == 0) | F.col("str_avg_len").isNull(), 0.0).otherwise(0.5 * size + 0.5 * kind)
    return pair.select("t_attr", "s_attr", F.when(F.col("dtype").isin("int", "float"), numeric).otherwise(text).alias("dist"))


#: Lengths in a band; rounds of best_similarity look at their own band and 1, 6, 24 .. more to either side.
BAND = 4


def _letters(c: Column) -> Column:
    """64 bits, one for each letter by its code: a letter of one text whose bit another lacks costs an edit."""
    codes = F.transform(F.array_distinct(F.split(c, "")), lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(x) % 64))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _closest(values: Column, start: Column) -> Column:
    """The best similarity of a text (a, n, letters) to values (b, m, letters), or ``start`` if that is better.

    The best so far is the bound to beat: a value that lacks too many letters isn't compared, and edits are counted
    only as far as they would be few enough.
    """

    def step(best: Column, v: Column) -> Column:
        longest = F.greatest(F.col("n"), v["m"], F.lit(1))
        allowed = F.floor((1 - best) * longest + 1e-9).cast("int")
        lacking = F.greatest(F.bit_count(F.col("letters").bitwiseAND(F.bitwise_not(v["letters"]))), F.bit_count(v["letters"].bitwiseAND(F.bitwise_not(F.col("letters")))))
        edits = F.pmod(F.call_function("levenshtein", F.col("a"), v["b"], allowed), F.lit(1 << 30))  # -1 (too many) is very many
        return F.when(lacking > allowed, best).otherwise(F.greatest(best, 1 - edits / longest))

    return F.aggregate(values, start, step)


def best_similarity(own: DataFrame, values: DataFrame) -> DataFrame:
    """a, s_attr, best: the greatest edit similarity of each a to a value b of each column (s_attr, b).

    Equal values meet by equality. Others meet by bands of their length, the nearest bands first; a text
    whose best similarity to every column is no less than what a longer difference in length allows is settled, and
    the others look at bands further off, with what they have found as the bound to beat. The maximum is exact.
    """
    own, values = own.select("a").distinct(), values.select("s_attr", "b").where("b is not null").distinct()
    lists = stored(values.withColumn("band", F.floor(F.length("b") / BAND).cast("int")).groupBy("s_attr", "band").agg(F.collect_list(F.struct("b", F.length("b").alias("m"), _letters(F.col("b")).alias("letters"))).alias("own")), "bands")
    # Both are a few numbers.
    columns, last = lists.agg(F.count_distinct("s_attr"), F.max("band")).first()
    if not columns:
        return own.select("a", F.lit(0).alias("s_attr"), F.lit(0.0).alias("best")).limit(0)
    best = stored(own.join(values.select(F.col("b").alias("a"), "s_attr"), "a").select("a", "s_attr", F.lit(1.0).cast("double").alias("best")), "best")
    # Comparing is what takes time, so texts stay spread however few bytes they are.
    wide = max(own.sparkSession.sparkContext.defaultParallelism, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = stored(own.select("a", F.length("a").alias("n"), _letters(F.col("a")).alias("letters")).repartition(wide, "a"), "texts")
    longest = texts.agg(F.max("n")).first()[0] or 0
    from_, to = 0, 1
    while True:
        # Bands whose distance from the text's own is from_ to to.
        home = F.floor(F.col("n") / BAND).cast("int")
        away = F.array_distinct(F.concat(F.sequence(home + from_, home + to), F.sequence(home - from_, home - to)))
        near = texts.withColumn("band", F.explode(away)).where(F.col("band").between(0, last))
        met = near.join(lists, "band").join(best, ["a", "s_attr"], "left")
        found = met.select("a", "s_attr", _closest(F.col("own"), F.coalesce("best", F.lit(0.0))).alias("best"))
        best = stored(best.unionByName(found).groupBy("a", "s_attr").agg(F.max("best").alias("best")), "best")
        if to >= max(last, longest // BAND):
            return best
        # Values in bands beyond differ by so many letters at least.
        off = F.lit(to * BAND + 1)
        bound = F.greatest(1 - off / F.greatest("n", F.lit(1)), 1 - off / (F.col("n") + off))
        done = texts.join(best, "a").where(F.col("best") >= bound).groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == columns)
        texts = stored(texts.join(done, "a", "left_anti").repartition(wide, "a"), "texts")
        if texts.isEmpty():
            return best
        from_, to = to + 1, 4 * to + 3


def semantic_signal(target: DataFrame, source: DataFrame) -> DataFrame:
    """Mean over distinct target values of the best edit similarity to a stored source value."""
    own = target.where(~is_null_token(F.col("raw"))).select("t_attr", F.lower(F.trim("raw")).alias("a")).distinct()
    values = source.select("s_attr", F.explode("unique_vals").alias("b")).select("s_attr", F.lower("b").alias("b"))
    return own.join(best_similarity(own, values), "a").groupBy("t_attr", "s_attr").agg(F.avg("best").alias("semantic"))


SOURCE_COLUMNS = ["s_attr", "dtype", "n_rows", "n_unique", "num_min", "num_max", "num_p25", "num_p75", "str_avg_len", "str_char_class", "exact_unique", "unique_vals"]


def signal(name: str, target: DataFrame, source: DataFrame) -> DataFrame:
    """t_attr, s_attr and one signal of every pair of columns, without the others."""
    if name == "subset":
        return subset_signal(target, source)
    pair = pairs(target, source)
    if name != "semantic":
        return {"type": type_signal, "dist": distribution_signal}[name](pair)
    best = semantic_signal(target, source)
    return pair.select("t_attr", "s_attr").join(best, ["t_attr", "s_attr"], "left").select("t_attr", "s_attr", F.coalesce("semantic", F.lit(0.0)).alias("semantic"))


def score(target: DataFrame, source: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """t_attr, s_attr, the four signals and their weighted total.

    Each signal reads the profile and the target, which are stored once instead of being worked out for each.
    """
    source, target = stored(source.select(*SOURCE_COLUMNS), "profiles"), stored(target.select("t_attr", "raw"), "target")
    weights, pair = weights or WEIGHTS, pairs(target, source)
    out = subset_signal(target, source).join(type_signal(pair), ["t_attr", "s_attr"]).join(distribution_signal(pair), ["t_attr", "s_attr"]).join(semantic_signal(target, source), ["t_attr", "s_attr"], "left")
    out = out.withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    return out.withColumn("total", sum((F.lit(w) * F.col(k) for k, w in weights.items()), F.lit(0.0)))


def top_k(scores: DataFrame, k: int = 3, by: str = "t_attr") -> DataFrame:
    """The k best partners of each column; ties go to the lower id."""
    other = "s_attr" if by == "t_attr" else "t_attr"
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("total"), other))).where(F.col("rank") <= k)


def random_bridge(scores: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """k partners for each target column by a seeded hash."""
    order = F.md5(F.concat_ws("|", F.lit(seed), "t_attr", "s_attr").cast("binary"))
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("t_attr").orderBy(order))).where(F.col("rank") <= k)

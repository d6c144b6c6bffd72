"""The whole match: profiles, signals, bridge, target dependencies, embedding, refinement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embed, graph, mediator, profile, refine, remap, signals
from ..sources.shared import stored
from . import evaluate


def features(spark: SparkSession, source: dict[str, DataFrame], rules: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """attr_id, row_gid: rules expanded over the rows of all tables, numbered on from table to table. Only columns
    that a rule has a constant for are unpivoted."""
    wanted = {r[0] for r in rules.select(F.explode(F.map_keys("pattern"))).distinct().collect()}  # attributes
    parts, at = [], 0
    for t, df in source.items():
        own = {names.index((t, c)): c for c in df.columns}
        have = [str(i) for i in own if i in wanted]
        if have:
            numbered = mediator.row_ids(df.select(*(F.col(f"`{own[int(i)]}`").alias(i) for i in have)), offset=at)
            parts.append(numbered.unpivot("row_gid", have, "attr_id", "raw").select(F.col("attr_id").cast("int").alias("attr_id"), "row_gid", "raw"))
        at += df.count()
    empty = spark.createDataFrame([], "attr_id int, row_gid long, raw string")
    return mediator.expand(rules, reduce(DataFrame.union, parts, empty))


def match(spark: SparkSession, source: dict[str, DataFrame], target: DataFrame, fds: DataFrame, inds: DataFrame, rules: DataFrame | None = None, k: int = 3, hops: int = 5, config: refine.Config = refine.Config(), use_inds: bool = True, random_seed: int | None = None, cfds: list[tuple] = ()) -> dict[str, DataFrame]:
    """``source``: raw-string tables in order, whose columns are numbered on; ``target``: raw strings, any number of rows.

    Gives score, bridge, sim, refined, and the vectors (attr_id, fwd, bwd). ``use_inds`` leaves INDs out of
    the graph, ``random_seed`` draws random bridges, ``cfds`` take part in rewards with ``dep_mode="every"``.
    The driver holds what a schema holds: edges of the graph, and vectors of its nodes.
    """
    names = [(t, c) for t, df in source.items() for c in df.columns]
    n, m = len(names), len(target.columns)
    attr = spark.createDataFrame([(t, c, i) for i, (t, c) in enumerate(names)], "tbl string, col string, s_attr int")
    profiles = profile.profile_tables(source).join(F.broadcast(attr), ["tbl", "col"])  # a row a column
    wide = target.toDF(*map(str, range(m))).withColumn("row_id", F.monotonically_increasing_id())
    cells = wide.unpivot("row_id", [str(j) for j in range(m)], "t_attr", "raw").select("row_id", F.col("t_attr").cast("int").alias("t_attr"), "raw")
    own = stored(cells, "target")  # numbered once
    score = stored(signals.score(own, profiles), "score")
    bridge = signals.top_k(score, k) if random_seed is None else signals.random_bridge(score, k, random_seed)
    with_id = lambda d: d.withColumn("dep_id", F.md5(F.to_json(F.struct("lhs", "rhs")).cast("binary")))
    t_fds, t_inds = remap.target_dependencies(with_id(fds), with_id(inds), score, own, k)
    up = lambda d: d.select(F.transform("lhs", lambda a: a + n).alias("lhs"), F.transform("rhs", lambda a: a + n).alias("rhs"))
    all_fds = fds.select("lhs", "rhs").union(up(t_fds))
    all_inds = inds.select("lhs", "rhs").union(up(t_inds)) if use_inds else None
    p = graph.transition(graph.edges(all_fds, all_inds, bridge.select((F.col("t_attr") + n).alias("t_attr"), "s_attr")))
    feature = features(spark, source, rules, names) if rules is not None else spark.createDataFrame([(i, i) for i in range(n)], "attr_id int, row_gid long")
    vectors = embed.vectors(spark, *embed.embed_graph(p, feature, n + m, hops=hops))
    sim = stored(evaluate.embedding_sim(vectors, n, "run"), "sim")
    none = F.array().cast("array<struct<attr:int,value:string>>").alias("pattern")
    listed = lambda d, kind: d.select(F.lit("run").alias("case_id"), F.lit(kind).alias("kind"), F.monotonically_increasing_id().alias("place"), "lhs", "rhs", none)
    by_hand = spark.createDataFrame([("run", "cfd", i, list(a), list(b), list(e)) for i, (a, b, e) in enumerate(cfds)], "case_id string, kind string, place long, lhs array<int>, rhs array<int>, pattern array<struct<attr:int,value:string>>")
    deps = listed(fds, "fd").union(listed(inds, "ind")).union(by_hand)
    runs = refine.runs(sim.withColumnRenamed("run_id", "case_id"), deps, {"": config})
    refined = refine.refine_runs(runs, own.withColumn("case_id", F.lit("run")))
    return {"score": score, "bridge": bridge, "sim": sim, "refined": refined, "vectors": vectors}

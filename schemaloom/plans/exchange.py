"""Queries that write given tables in the formats of ``sources`` and read them again, and profiles that are kept up.

Each writes into the folder that the executors share and returns what its reader gives, so that the SQL compares
what went out with what came back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical
from ..operators import mediator, profile
from ..sources import files
from ..sources.shared import shared_dir
from ..streaming import incremental
from .catalogue import _HELD, _HELD_INDS, _NATION_CELLS, _PAIRS, _PART_RULES, _held_fds, _held_inds, _matches, _nation_pairs, _part_feature, _profile_sql, _text, query, rounded, table


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def texts(df: DataFrame) -> DataFrame:
    """All columns as canonical text."""
    return df.select(*(canonical(F.col(n), t).alias(n) for n, t in df.dtypes))


@query("csv_documents", "SELECT doc_id::VARCHAR AS doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') AS lang FROM documents")
def _(spark, sf_dir):
    """Texts with quotes, commas and line ends, as CSV and back; nulls come back empty."""
    path = folder(spark, "csv")
    files.write_csv(texts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), path)
    back = files.csv_table(spark, path)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang")


@query("csv_folder", " UNION ALL ".join(f"SELECT '{t}' AS tbl, {i} AS ord, '{c}' AS col, {c}::VARCHAR AS raw FROM {t}" for i, t in enumerate(("customer", "nation", "supplier")) for c in {"customer": ["c_custkey", "c_name"], "nation": ["n_name"], "supplier": ["s_suppkey", "s_name"]}[t]))
def _(spark, sf_dir):
    """A folder of tables, a CSV folder each, found by listing it; the columns of each are numbered on."""
    path = folder(spark, "tables")
    for t, columns in (("customer", ["c_custkey", "c_name"]), ("nation", ["n_name"]), ("supplier", ["s_suppkey", "s_name"])):
        files.write_csv(texts(table(spark, sf_dir, t).select(*columns)), f"{path}/{t}.csv")
    found = files.csv_tables(spark, path)
    cells = [profile.cells(df, t).withColumn("ord", F.lit(i)) for i, (t, df) in enumerate(found.items())]
    return cells[0].unionByName(cells[1]).unionByName(cells[2]).select("tbl", "ord", "col", "raw")


@query(
    "dependency_files",
    f"""
WITH {_HELD}, {_HELD_INDS}
SELECT 'fd' AS kind, array_to_string(lhs, ',') AS lhs, array_to_string(rhs, ',') AS rhs, '' AS pattern FROM held
UNION ALL SELECT 'ind', src::VARCHAR, dst::VARCHAR, '' FROM held_inds
UNION ALL SELECT DISTINCT 'cfd', '2,4', '3', '2=' || p_brand || ';3=' || p_type FROM part WHERE p_size < 10
""",
)
def _(spark, sf_dir):
    """FDs and INDs that hold, and a rule for each brand and type of small parts, as text files and back."""
    path = folder(spark, "dependencies")
    files.write_deps(_held_fds(spark, sf_dir), f"{path}/fds")
    files.write_deps(_held_inds(spark, sf_dir), f"{path}/inds", "[=")
    small = table(spark, sf_dir, "part").where("p_size < 10").select("p_brand", "p_type").distinct()
    rules = small.select(F.array(F.lit(2), F.lit(4)).alias("lhs"), F.array(F.lit(3)).alias("rhs"), F.create_map(F.lit(2), "p_brand", F.lit(3), "p_type").alias("pattern"))
    files.write_cfds(rules, f"{path}/cfds")
    kinds = [_text(files.fds(spark, f"{path}/fds")).withColumn("kind", F.lit("fd")), _text(files.inds(spark, f"{path}/inds")).withColumn("kind", F.lit("ind"))]
    back = files.cfds(spark, f"{path}/cfds")
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("pattern")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ";")
    cfds = back.select(*(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("lhs", "rhs")), F.lit("cfd").alias("kind"), entries.alias("pattern"))
    return kinds[0].unionByName(kinds[1]).withColumn("pattern", F.lit("")).unionByName(cfds).select("kind", "lhs", "rhs", "pattern")


@query("edges_file", " UNION ALL ".join(f"SELECT {i} AS attr_id, p_partkey::BIGINT AS row_gid FROM part WHERE {c}" for i, c in enumerate(_PART_RULES)))
def _(spark, sf_dir):
    path = folder(spark, "edges")
    files.write_edges(_part_feature(spark, sf_dir), path)
    return files.edges(spark, path)


@query("bridge_file", f"SELECT t + 25 AS t_attr, string_agg(s::VARCHAR, ',' ORDER BY rank) AS s_attrs FROM (SELECT t, s, row_number() OVER (PARTITION BY t ORDER BY md5('42|' || t || '|' || s)) AS rank FROM {_PAIRS} QUALIFY rank <= 3) GROUP BY t")
def _(spark, sf_dir):
    """Bridges as JSON, targets numbered after the sources, best partner first."""
    from ..operators import signals

    path = folder(spark, "bridge")
    files.write_bridge(signals.random_bridge(_nation_pairs(spark, sf_dir), 3), path, 25)
    back = spark.read.schema("t_attr int, s_attrs array<int>").json(path)
    return back.select("t_attr", F.array_join(F.transform("s_attrs", lambda x: x.cast("string")), ",").alias("s_attrs"))


@query("matrix_files", f"WITH {_NATION_CELLS} SELECT 'long' AS form, run_id, t_attr, s_attr, score FROM m UNION ALL SELECT 'json', 'j', (dense_rank() OVER (ORDER BY t_attr) - 1)::INTEGER, (row_number() OVER (PARTITION BY t_attr ORDER BY s_attr) - 1)::INTEGER, score FROM (SELECT t_attr, s_attr, round(sum(score), 4) AS score FROM m WHERE t_attr < 3 GROUP BY ALL)")
def _(spark, sf_dir):
    """Matrices in long form, split by run, and one as JSON, whose cells are numbered by their places."""
    sim, _, _ = _matches(spark, sf_dir)
    path = folder(spark, "matrix")
    files.write_matrix(sim, f"{path}/long", decay=0.4)
    back = spark.read.option("basePath", f"{path}/long").parquet(f"{path}/long").where("decay = 0.4").select(F.lit("long").alias("form"), F.col("run_id").cast("string").alias("run_id"), "t_attr", "s_attr", "score")
    one = sim.where("t_attr < 3").groupBy("t_attr", "s_attr").agg(F.round(F.sum("score"), 4).alias("score"))  # three rows of five cells
    listed = lambda at, value: F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda x: x[value])
    rows = one.groupBy("t_attr").agg(listed("s_attr", "score").alias("row")).agg(listed("t_attr", "row").alias("m"))
    rows.select(F.to_json("m")).write.text(f"{path}/json")
    json = files.matrix(spark, f"{path}/json/*.txt", "j").select(F.lit("json").alias("form"), "run_id", "t_attr", "s_attr", "score")
    return back.union(json)


@query("truth_file", f"WITH {_NATION_CELLS} SELECT DISTINCT dense_rank() OVER (ORDER BY t_attr) - 1 AS t_attr, 'nation' || lpad(t_attr::VARCHAR, 2, '0') AS name, s_attr FROM tt")
def _(spark, sf_dir):
    """Truths as a JSON object of names and source ids, in order."""
    _, _, truth = _matches(spark, sf_dir)
    path = folder(spark, "truth")
    own = truth.select("t_attr", "s_attr").distinct().groupBy("t_attr").agg(F.sort_array(F.collect_set("s_attr")).alias("s"))
    entry = F.struct(F.concat(F.lit("nation"), F.lpad(F.col("t_attr").cast("string"), 2, "0")).alias("key"), F.col("s").alias("value"))
    own.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry))))).write.text(path)  # 25 at most
    return files.truth(spark, f"{path}/*.txt").select(F.col("t_attr").cast("long").alias("t_attr"), "name", "s_attr")


@query("overview_files", f"WITH {_NATION_CELLS} SELECT f AS form, run_id, t_attr::VARCHAR AS name, round(max(score), 6) AS value FROM m, (SELECT unnest(['csv', 'json']) AS f) GROUP BY ALL")
def _(spark, sf_dir):
    """Metric rows as CSV and as JSON."""
    sim, _, _ = _matches(spark, sf_dir)
    path, shape = folder(spark, "overview"), "run_id string, name string, value double"
    files.write_overview(rounded(sim.groupBy("run_id", F.col("t_attr").cast("string").alias("name")).agg(F.max("score").alias("value"))), path)
    both = [spark.read.schema(shape).option("header", True).csv(f"{path}/csv"), spark.read.schema(shape).json(f"{path}/json")]
    return both[0].select(F.lit("csv").alias("form"), "*").union(both[1].select(F.lit("json").alias("form"), "*"))


@query("subset_files", "WITH r AS (SELECT p_type AS rule, row_number() OVER (ORDER BY md5('42|' || p_type), p_type) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_type FROM part)) SELECT f AS fraction, rule FROM r, (SELECT unnest([0.25, 0.5])::DOUBLE AS f) WHERE k <= floor(f * n + 1e-9)")
def _(spark, sf_dir):
    path = folder(spark, "subsets")
    files.write_subsets(mediator.nested(table(spark, sf_dir, "part").select(F.col("p_type").alias("rule")), "rule", [0.25, 0.5]), path)
    return spark.read.parquet(path).select(F.col("fraction").cast("double").alias("fraction"), "rule")


@query("profile_cached", f"SELECT tbl, col, dtype, n_rows, n_unique, null_rate, exact_unique FROM ({_profile_sql('customer')})")
def _(spark, sf_dir):
    """The second time, the kept profile: its file is as old as before."""
    path, customer = folder(spark, "profiles"), table(spark, sf_dir, "customer")
    profile.cached_profile(customer, "customer", path)
    return rounded(profile.cached_profile(customer, "customer", path).select("tbl", "col", "dtype", "n_rows", "n_unique", "null_rate", "exact_unique"))


_STREAMED = {"event_type": "event_type", "user_id": "user_id::VARCHAR"}


@query("stream_profile_events", " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) AS n_rows, count(DISTINCT {v}) AS exact, true AS within FROM events" for c, v in _STREAMED.items()))
def _(spark, sf_dir):
    """A stream's batches leave mergeable states; their profile, and whether distinct counts are within 5 %."""
    path, events = folder(spark, "stream"), table(spark, sf_dir, "events").select(*_STREAMED)
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may name a file, too
    incremental.start(stream, "events", f"{path}/states", f"{path}/checkpoint").awaitTermination()
    exact = events.agg(*(F.count_distinct(c).alias(c) for c in _STREAMED)).unpivot([], list(_STREAMED), "col", "exact")
    return incremental.profile(spark, f"{path}/states").join(exact, "col").select("col", "n_rows", "exact", (F.abs(F.col("n_unique") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within"))

"""Readers and writers of tables, dependencies, matrices and truths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import Dependency


def csv_table(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """All cells as raw strings; "" and the text null stay apart; short rows are filled with ""."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False, nullValue="\0", emptyValue="", escape='"', multiLine=True, mode="PERMISSIVE")
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def csv_folder(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """Every *.csv of a folder by its stem, in order of name, through Spark's own file listing."""
    names = sorted(r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").collect())
    return {n.rpartition("/")[2][:-4]: csv_table(spark, n, **options) for n in names}


def csv_tables(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """Every *.csv under ``path``, a file or a folder of parts, by its stem, in order of name."""
    return {n.rpartition("/")[2][:-4]: csv_table(spark, n, **options) for n in sorted(_paths(spark, f"{path}/*.csv"))}


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, by Spark's own file system, so any store works."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [str(f.getPath()) for f in found] if found else []


def targets(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path`` that hold a target.csv, in natural order."""
    return natural_order(p.split("/")[-2] for p in _paths(spark, f"{path}/*/target.csv"))


def datasets(spark: SparkSession, path: str, preferred: list[str] = ()) -> dict[str, list[str]]:
    """Data sets (folders with a source and a target folder) and their targets: preferred ones first, then by name."""
    have = sorted({p.split("/")[-2] for p in _paths(spark, f"{path}/*/source")} & {p.split("/")[-2] for p in _paths(spark, f"{path}/*/target")})
    order = [n for n in preferred if n in have] + [n for n in have if n not in preferred]
    return {n: own for n in order if (own := targets(spark, f"{path}/{n}/target"))}


def column_count(tables: dict[str, DataFrame]) -> int:
    """Source columns over all tables, from their headers alone."""
    return sum(len(df.columns) for df in tables.values())


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """tbl, ord, n_rows of parsed rows, so a quoted line end doesn't count as a row."""
    one = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("tbl"), F.lit(i).alias("ord"), "n_rows") for i, (t, df) in enumerate(tables.items())]
    return reduce(DataFrame.union, one)


def natural_order(names) -> list[str]:
    return sorted(names, key=lambda n: (len(n), n))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line != '' and not startswith(line, '#')")


def _ids(c) -> F.Column:
    return F.transform(F.split(c, ","), lambda x: F.trim(x).cast("int"))


def fds(spark: SparkSession, path: str) -> DataFrame:
    """``0,1 -> 2``: lhs, rhs."""
    side = F.split("line", r"\s*->\s*")
    return _lines(spark, path).where("contains(line, '->')").select(_ids(side[0]).alias("lhs"), _ids(side[1]).alias("rhs"))


def inds(spark: SparkSession, path: str) -> DataFrame:
    """``0,1[=2,3``, by position."""
    side = F.split("line", r"\[=")
    return _lines(spark, path).where("contains(line, '[=')").select(_ids(side[0]).alias("lhs"), _ids(side[1]).alias("rhs"))


def cfds(spark: SparkSession, path: str) -> DataFrame:
    """``(0, 1=1996) => 2``: lhs, rhs, pattern. Rules need a constant."""
    rule = _lines(spark, path).where(r"line rlike '^\\(.*\\)\\s*=>.*' and length(line) - length(replace(line, '=', '')) >= 2")
    part = lambda text: F.transform(F.split(text, ","), lambda x: F.trim(x))
    rule = rule.select(part(F.regexp_extract("line", r"^\((.*)\)\s*=>", 1)).alias("l"), part(F.regexp_extract("line", r"=>\s*(.*)$", 1)).alias("r"))
    ids = lambda c: F.transform(c, lambda x: F.trim(F.substring_index(x, "=", 1)).cast("int"))
    fixed = F.filter(F.concat("l", "r"), lambda x: F.contains(x, F.lit("=")))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).cast("int"), F.trim(F.regexp_replace(x, "^[^=]*=", "")))
    return rule.select(ids("l").alias("lhs"), ids("r").alias("rhs"), F.map_from_entries(F.transform(fixed, entry)).alias("pattern"))


def as_list(deps: DataFrame) -> list[Dependency]:
    """Schema-sized: the dependencies of one data set, in file order."""
    return [Dependency(tuple(r["lhs"]), tuple(r["rhs"]), tuple(sorted((r["pattern"] or {}).items())) if "pattern" in r.asDict() else ()) for r in deps.collect()]


def truth(spark: SparkSession, path: str, run_id: str = "") -> DataFrame:
    """``{name: [source ids]}`` to run_id, t_attr (its place), name, s_attr."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<int>>").alias("m"))
    return doc.select(F.posexplode(F.map_entries("m")).alias("t_attr", "e")).select(F.lit(run_id).alias("run_id"), "t_attr", F.col("e.key").alias("name"), F.explode("e.value").alias("s_attr"))


def matrix(spark: SparkSession, path: str, run_id: str = "") -> DataFrame:
    """A JSON matrix to run_id, t_attr, s_attr, score."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<double>>").alias("m"))
    rows = doc.select(F.posexplode("m").alias("t_attr", "row"))
    return rows.select(F.lit(run_id).alias("run_id"), "t_attr", F.posexplode("row").alias("s_attr", "score"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="attr_id int, row_gid long")


def write_csv(table: DataFrame, path: str, sep: str = ",") -> None:
    """Cells as they are, for ``csv_table``: quoted where they must be, nulls empty."""
    table.write.mode("overwrite").csv(path, header=True, sep=sep, escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")


def write_deps(deps: DataFrame, path: str, arrow: str = " -> ") -> None:
    """FDs with `` -> ``, INDs with ``[=``; always written, also when empty."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    deps.select(F.concat(text("lhs"), F.lit(arrow), text("rhs")).alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def write_edges(edge: DataFrame, path: str) -> None:
    edge.select("attr_id", "row_gid").distinct().orderBy("attr_id", "row_gid").write.mode("overwrite").csv(path, sep=" ")


def write_cfds(deps: DataFrame, path: str) -> None:
    """``(0, 1=1996) => 2=x``: the constants stand by their attributes."""
    one = lambda a: F.concat(a.cast("string"), F.coalesce(F.concat(F.lit("="), F.element_at("pattern", a)), F.lit("")))
    side = lambda c: F.array_join(F.transform(c, one), ", ")
    deps.select(F.concat(F.lit("("), side("lhs"), F.lit(") => "), side("rhs")).alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def write_subsets(subsets: DataFrame, path: str) -> None:
    """Edges or rules of nested subsets, a folder a fraction."""
    subsets.write.mode("overwrite").partitionBy("fraction").parquet(path)


def write_bridge(bridge: DataFrame, path: str, n_source: int = 0) -> None:
    """A JSON row for each target attribute: t_attr, numbered after the sources, and its source ids, best first."""
    own = bridge.groupBy((F.col("t_attr") + n_source).alias("t_attr")).agg(F.sort_array(F.collect_list(F.struct("rank", "s_attr"))).alias("x"))
    own.select("t_attr", F.transform("x", lambda s: s["s_attr"]).alias("s_attrs")).write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """attr_id, fwd, bwd: an embedding's vectors, a row a node."""
    vectors.select("attr_id", "fwd", "bwd").write.mode("overwrite").parquet(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("attr_id int, fwd array<double>, bwd array<double>").parquet(path)


def write_overview(metric: DataFrame, path: str) -> None:
    """Metric rows as CSV with a header, and as JSON, in one order."""
    own = metric.orderBy(*metric.columns).coalesce(1)  # a report
    own.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    own.write.mode("overwrite").json(f"{path}/json")


def write_matrix(sim: DataFrame, path: str, **parameters) -> None:
    """Long form with the parameters as columns, split by run."""
    sim.withColumns({k: F.lit(v) for k, v in parameters.items()}).write.mode("overwrite").partitionBy("run_id").parquet(path)

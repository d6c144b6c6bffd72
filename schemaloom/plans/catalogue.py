"""The queries of the schema-matching operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_class, dtype_vote, is_null_token
from ..operators import embed, graph, mediator, metrics, profile, refine, remap, signals, sketch, validate, validity
from ..sources.shared import stored
from . import evaluate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def values(spark: SparkSession, schema: str, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# --- profiles -------------------------------------------------------------------------------------

NULLS = "('', 'null', 'none', 'na', 'nan', 'n/a')"
KINDS = {
    "customer": {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "d", "c_mktsegment": "s"},
    "part": {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "d"},
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "d", "o_orderdate": "t", "o_orderpriority": "s"},
    "lineitem": {"l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "d", "l_extendedprice": "d", "l_discount": "d", "l_tax": "d", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t"},
}


def _profile_sql(name: str) -> str:
    text = {"i": "{0}::VARCHAR", "s": "{0}", "d": "{0}::DECIMAL(18,6)::VARCHAR", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')"}
    cells = " UNION ALL ".join(f"SELECT '{c}' AS col, {text[k].format(c)} AS raw FROM {name}" for c, k in KINDS[name].items())
    return f"""
WITH c AS ({cells}), v AS (SELECT col, CASE WHEN raw IS NULL OR lower(trim(raw)) IN {NULLS} THEN NULL ELSE trim(raw) END AS v FROM c),
x AS (SELECT col, v, CASE WHEN regexp_matches(v, '^-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$') THEN v::DOUBLE END AS x FROM v),
k AS (SELECT col, CASE WHEN coalesce(bool_and(regexp_matches(v, '^-?[0-9]+$')), false) THEN 'int' WHEN coalesce(bool_and(x IS NOT NULL) FILTER (v IS NOT NULL), false) THEN 'float'
  WHEN coalesce(bool_and(lower(v) IN ('true','false','yes','no','0','1','t','f','y','n')), false) THEN 'bool' ELSE 'str' END AS dtype,
  count(*) AS n_rows, count(DISTINCT v) AS n_unique, (count(*) - count(v)) / count(*) AS null_rate, min(x) AS lo, max(x) AS hi, quantile_cont(x, [0.25, 0.5, 0.75]) AS q, avg(length(v)) AS str_avg_len,
  CASE WHEN count(v) = 0 THEN 'mixed' WHEN bool_and(regexp_matches(regexp_replace(v, '[ -]', '', 'g'), '^\\p{{L}}+$')) THEN 'alpha' WHEN bool_and(regexp_matches(v, '^\\p{{Nd}}+$')) THEN 'digit'
  WHEN bool_and(regexp_matches(replace(v, ' ', ''), '^[\\p{{L}}\\p{{Nd}}]+$')) THEN 'alnum' ELSE 'mixed' END AS str_char_class FROM x GROUP BY col),
d AS (SELECT DISTINCT col, v FROM v WHERE v IS NOT NULL), r AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY md5(v), v) AS i, count(*) OVER (PARTITION BY col) AS n FROM d),
u AS (SELECT col, md5(string_agg(v, '|' ORDER BY v)) AS vals FROM r WHERE n <= 500 OR i <= 200 GROUP BY col)
SELECT '{name}' AS tbl, col, dtype, n_rows, n_unique, round(null_rate, 6) AS null_rate,
  round(CASE WHEN dtype IN ('int','float') THEN lo END, 6) AS num_min, round(CASE WHEN dtype IN ('int','float') THEN hi END, 6) AS num_max,
  round(CASE WHEN dtype IN ('int','float') THEN q[1] END, 4) AS num_p25, round(CASE WHEN dtype IN ('int','float') THEN q[2] END, 4) AS num_p50, round(CASE WHEN dtype IN ('int','float') THEN q[3] END, 4) AS num_p75,
  round(str_avg_len, 6) AS str_avg_len, str_char_class, n_unique <= 500 AS exact_unique, vals AS unique_vals_md5 FROM k LEFT JOIN u USING (col)"""


def _profile(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = profile.profile_tables({name: table(spark, sf_dir, name)})
        out = rounded(out).withColumns({c: F.round(c, 4) for c in ("num_p25", "num_p50", "num_p75")})
        return out.withColumn("unique_vals_md5", F.when(F.size("unique_vals") > 0, F.md5(F.array_join("unique_vals", "|").cast("binary")))).drop("unique_vals")

    return run


for _name in KINDS:
    query(f"profile_{_name}", _profile_sql(_name))(_profile(_name))


@query(
    "profile_sketched_orders",
    f"SELECT tbl, col, dtype, n_rows, null_rate, num_min, num_max, str_avg_len, str_char_class, exact_unique, unique_vals_md5, true AS n_unique_within, CASE WHEN num_min IS NOT NULL THEN true END AS quantiles_within FROM ({_profile_sql('orders')})",
)
def _(spark, sf_dir):
    """The approximate profile: what it gives exactly, and whether its estimates are within 5 % of the distinct count
    and 1 % of the ranks."""
    orders = table(spark, sf_dir, "orders")
    own = stored(sketch.profile_sketched({"orders": orders}), "sketched")
    true = profile.value_lists({"orders": orders}).select("col", F.col("n_unique").alias("true_unique"))
    # How many numbers are at most an estimate, or less than it: a row a column and quantile.
    estimates = own.select("col", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"num_p{int(100 * q)}").alias("x")) for q in profile.QUANTILES))).alias("e")).where("e.x is not null").select("col", "e.q", "e.x")
    numbers = [n for n, t in orders.dtypes if profile.kind_of(t) in ("whole", "double")]
    cells = orders.select(*(F.col(n).cast("double").alias(n) for n in numbers)).unpivot([], numbers, "col", "v")
    rank = cells.join(F.broadcast(estimates), "col").groupBy("col", "q").agg(F.avg((F.col("v") < F.col("x")).cast("double")).alias("less"), F.avg((F.col("v") <= F.col("x")).cast("double")).alias("upto"))
    within = rank.groupBy("col").agg(F.bool_and((F.col("less") <= F.col("q") + 0.01) & (F.col("upto") >= F.col("q") - 0.01)).alias("quantiles_within"))
    out = rounded(own).join(true, "col").join(within, "col", "left")
    md5 = F.when(F.size("unique_vals") > 0, F.md5(F.array_join("unique_vals", "|").cast("binary"))).alias("unique_vals_md5")
    exact = ("tbl", "col", "dtype", "n_rows", "null_rate", "num_min", "num_max", "str_avg_len", "str_char_class", "exact_unique")
    return out.select(*exact, md5, (F.abs(F.col("n_unique") - F.col("true_unique")) <= 0.05 * F.col("true_unique")).alias("n_unique_within"), "quantiles_within")


_DRAWN = "round(-ln((('0x' || substr(md5('42|{c}|' || {i}), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / {w}, 12)"
_SAMPLED = {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "o_totalprice": "o_totalprice::DECIMAL(18,6)::VARCHAR"}


@query("row_weighted_sample", " UNION ALL ".join(f"(SELECT '{c}' AS col, {v} AS v, row_number() OVER (ORDER BY {_DRAWN.format(c=c, i='o_orderkey', w='1.0')}, o_orderkey::VARCHAR) AS place FROM orders QUALIFY place <= 200)" for c, v in _SAMPLED.items()))
def _(spark, sf_dir):
    """200 rows of each column, every row alike: frequent values come often."""
    out = sketch.row_sample(table(spark, sf_dir, "orders"), list(_SAMPLED), ["o_orderkey"])
    return out.withColumn("place", F.col("place").cast("long"))


@query("row_weighted_sample_by_quantity", f"SELECT 'l_shipdate' AS col, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS v, row_number() OVER (ORDER BY {_DRAWN.format(c='l_shipdate', i='concat_ws(chr(124), l_orderkey, l_linenumber)', w='l_quantity')}, concat_ws('|', l_orderkey, l_linenumber)) AS place FROM lineitem WHERE l_quantity > 0 QUALIFY place <= 200")
def _(spark, sf_dir):
    """200 rows in proportion to their quantities. Rows that share their identity and quantity stand as in the table."""
    rows = table(spark, sf_dir, "lineitem").withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    out = sketch.row_sample(rows, ["l_shipdate"], ["l_orderkey", "l_linenumber"], weight="l_quantity", order=["__file", "__row"])
    return out.withColumn("place", F.col("place").cast("long"))


@query("value_domain_lineitem_flags", "SELECT 'l_' || k AS col, v AS raw, count(*) AS cnt FROM (SELECT 'returnflag' AS k, l_returnflag AS v FROM lineitem UNION ALL SELECT 'linestatus', l_linestatus FROM lineitem) GROUP BY ALL")
def _(spark, sf_dir):
    return profile.value_domain(profile.cells(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), "lineitem")).drop("tbl")


@query("null_token_rate_documents", f"SELECT source, sum(CASE WHEN lang IS NULL OR lower(trim(lang)) IN {NULLS} THEN 1 ELSE 0 END)::BIGINT AS n_null, count(*) AS n FROM documents GROUP BY source")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(is_null_token(F.col("lang"))).alias("n_null"), F.count(F.lit(1)).alias("n"))


@query("dtype_vote_events", "SELECT event_type, CASE WHEN bool_and(regexp_matches(trim(props), '^-?[0-9]+$')) THEN 'int' WHEN bool_and(regexp_matches(trim(props), '^-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$')) THEN 'float' ELSE 'str' END AS props_type, CASE WHEN bool_and(regexp_matches(user_id::VARCHAR, '^-?[0-9]+$')) THEN 'int' ELSE 'str' END AS user_type FROM events GROUP BY event_type")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(dtype_vote(F.col("props")).alias("props_type"), dtype_vote(F.col("user_id").cast("string")).alias("user_type"))


@query("char_class_customer", "SELECT c_mktsegment, CASE WHEN bool_and(regexp_matches(regexp_replace(c_mktsegment, '[ -]', '', 'g'), '^\\p{L}+$')) THEN 'alpha' ELSE 'mixed' END AS segment_class, CASE WHEN bool_and(regexp_matches(c_custkey::VARCHAR, '^\\p{Nd}+$')) THEN 'digit' ELSE 'mixed' END AS key_class FROM customer GROUP BY c_mktsegment")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(char_class(F.col("c_mktsegment")).alias("segment_class"), char_class(F.col("c_custkey").cast("string")).alias("key_class"))


@query("quantiles_lineitem_price", "SELECT l_returnflag, round(min(l_extendedprice), 4) AS lo, round(max(l_extendedprice), 4) AS hi, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75 FROM lineitem GROUP BY l_returnflag")
def _(spark, sf_dir):
    q = profile.quantiles_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return rounded(q.select("l_returnflag", "lo", "hi", *(F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75")))), 4)


@query("distinct_sample_md5", "SELECT v, row_number() OVER (ORDER BY md5(v), v) AS k FROM (SELECT DISTINCT c_name AS v FROM customer) QUALIFY k <= 200")
def _(spark, sf_dir):
    from pyspark.sql import Window

    v = table(spark, sf_dir, "customer").select(F.col("c_name").alias("v")).distinct()
    return v.withColumn("k", F.row_number().over(Window.orderBy(F.md5(F.col("v").cast("binary")), "v")).cast("long")).where("k <= 200")


# --- dependencies ---------------------------------------------------------------------------------


def _fd_sql(name: str, t: str, lhs: list[str], rhs: list[str], where: str = "") -> str:
    val = "struct_pack(" + ", ".join(f"{c} := {c}" for c in rhs) + ")"
    return f"SELECT '{name}' AS dep, count(*) FILTER (d > 1) = 0 AS satisfied, count(*) AS n_groups, count(*) FILTER (d > 1) AS n_violating, coalesce(sum(n), 0)::BIGINT AS n_relevant FROM (SELECT count(*) AS n, count(DISTINCT {val}) AS d FROM {t} {where} GROUP BY {', '.join(lhs)})"


@query("fd_orders_key", _fd_sql("o_orderkey->o_custkey", "orders", ["o_orderkey"], ["o_custkey"]))
def _(spark, sf_dir):
    return validate.fd(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_custkey"])


@query("fd_lineitem_composite", _fd_sql("l_orderkey,l_linenumber->l_partkey", "lineitem", ["l_orderkey", "l_linenumber"], ["l_partkey"]))
def _(spark, sf_dir):
    return validate.fd(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey"])


BATCH = {"lineitem": [(["l_orderkey"], ["l_shipdate"]), (["l_returnflag"], ["l_linestatus"]), (["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])], "part": [(["p_brand"], ["p_type"]), (["p_partkey"], ["p_name", "p_brand"])], "customer": [(["c_name"], ["c_custkey"])], "nation": [(["n_name"], ["n_nationkey"])], "conversations": [(["conv_id", "turn"], ["role"])]}


@query("fd_batch_all", " UNION ALL ".join(_fd_sql(f"{','.join(a)}->{','.join(b)}", t, a, b) for t, deps in BATCH.items() for a, b in deps))
def _(spark, sf_dir):
    out = None
    for t, deps in BATCH.items():
        one = validate.fd_batch(table(spark, sf_dir, t), deps)
        out = one if out is None else out.union(one)
    return out


@query("fd_violations_part", "SELECT p_type AS key, count(*) AS n, min(p_size::VARCHAR) AS one, max(p_size::VARCHAR) AS other FROM part GROUP BY p_type HAVING min(p_size) <> max(p_size)")
def _(spark, sf_dir):
    return validate.fd_violations(table(spark, sf_dir, "part"), ["p_type"], ["p_size"]).select(F.col("key")[0].alias("key"), "n", F.col("one")[0].alias("one"), F.col("other")[0].alias("other"))


def _cfd_sql(name, lhs, rhs, where):
    return f"SELECT *, n_relevant = 0 AS vacuous FROM ({_fd_sql(name, 'lineitem', lhs, rhs, where)})"


@query("cfd_lineitem_returnflag", _cfd_sql("l_linenumber->l_linestatus", ["l_linenumber"], ["l_linestatus"], "WHERE l_returnflag = 'R'"))
def _(spark, sf_dir):
    return validate.cfd(table(spark, sf_dir, "lineitem"), ["l_linenumber"], ["l_linestatus"], {"l_returnflag": "R", "l_linenumber": "_"})


@query("cfd_vacuous", _cfd_sql("l_orderkey->l_partkey", ["l_orderkey"], ["l_partkey"], "WHERE l_returnflag = 'none'"))
def _(spark, sf_dir):
    return validate.cfd(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_partkey"], {"l_returnflag": "none"})


_CHECKED = """
SELECT 'check' AS mode, count(*) FILTER (bad) = 0 AS satisfied, count(*) FILTER (bad) AS n_violating, sum(n)::BIGINT AS n_relevant
FROM (SELECT count(*) AS n, count(DISTINCT l_linestatus) > 1 OR NOT bool_and(l_linestatus = 'O') AS bad FROM lineitem GROUP BY l_linenumber)
"""
_FILTERED = _fd_sql("x", "lineitem", ["l_linenumber"], ["l_linestatus"], "WHERE l_linestatus = 'O'")


@query("cfd_rhs_constant_modes", f"SELECT 'filter' AS mode, satisfied, n_violating, n_relevant FROM ({_FILTERED}) UNION ALL {_CHECKED}")
def _(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    each = [validate.cfd(line, ["l_linenumber"], ["l_linestatus"], {"l_linestatus": "O"}, m).select(F.lit(m).alias("mode"), "satisfied", "n_violating", "n_relevant") for m in ("filter", "check")]
    return each[0].union(each[1])


INDS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("part", "p_partkey", "supplier", "s_suppkey")]


_IND_SQL = "SELECT '{r}.{x}[={s}.{y}' AS dep, count(*) = 0 AS satisfied, count(*) AS n_missing FROM (SELECT {x}::BIGINT FROM {r} EXCEPT SELECT {y}::BIGINT FROM {s})"


@query("ind_matrix", " UNION ALL ".join(_IND_SQL.format(r=r, x=x, s=s, y=y) for r, x, s, y in INDS))
def _(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in sorted({t for r, _, s, _ in INDS for t in (r, s)})}
    return validate.ind_batch(tables, [(r, [x], s, [y]) for r, x, s, y in INDS])


@query("ind_composite", "SELECT 'composite' AS dep, count(*) = 0 AS satisfied, count(*) AS n_missing FROM (SELECT l_partkey, l_suppkey FROM lineitem EXCEPT SELECT p_partkey, p_size FROM part)")
def _(spark, sf_dir):
    return validate.ind(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], table(spark, sf_dir, "part"), ["p_partkey", "p_size"], "composite")


@query("ind_missing_values", "SELECT p_partkey::VARCHAR AS key FROM part EXCEPT SELECT s_suppkey::VARCHAR FROM supplier")
def _(spark, sf_dir):
    return validate.ind_missing(table(spark, sf_dir, "part"), ["p_partkey"], table(spark, sf_dir, "supplier"), ["s_suppkey"]).select(F.col("key")[0].alias("key"))


_ALL = [
    ("fd", "lineitem.l_returnflag->l_linestatus", _fd_sql("x", "lineitem", ["l_returnflag"], ["l_linestatus"])),
    ("fd", "part.p_partkey->p_name,p_size", _fd_sql("x", "part", ["p_partkey"], ["p_name", "p_size"])),
    ("cfd", "lineitem.l_linenumber->l_linestatus", _fd_sql("x", "lineitem", ["l_linenumber"], ["l_linestatus"], "WHERE l_returnflag = 'N' AND l_linestatus = 'O'")),
    ("ind", "lineitem.l_partkey[=part.p_partkey", _IND_SQL.format(r="lineitem", x="l_partkey", s="part", y="p_partkey")),
    ("ind", "part.p_partkey[=lineitem.l_suppkey", _IND_SQL.format(r="part", x="p_partkey", s="lineitem", y="l_suppkey")),
]


@query("validate_everything", " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{name}' AS dep, satisfied FROM ({sql})" for kind, name, sql in _ALL))
def _(spark, sf_dir):
    """FDs, CFDs and INDs of two tables: a scan and a shuffle for each table's FDs and CFDs, and for all INDs."""
    tables = {t: table(spark, sf_dir, t) for t in ("lineitem", "part")}
    fds = [("lineitem", ["l_returnflag"], ["l_linestatus"]), ("part", ["p_partkey"], ["p_name", "p_size"])]
    cfds = [("lineitem", ["l_linenumber"], ["l_linestatus"], {"l_returnflag": "N", "l_linestatus": "O"})]
    inds = [("lineitem", ["l_partkey"], "part", ["p_partkey"]), ("part", ["p_partkey"], "lineitem", ["l_suppkey"])]
    return validate.validate_all(spark, tables, fds, cfds, inds)


@query("fd_batch_empty", "SELECT 'p_partkey->p_name' AS dep, count(*) = 0 AS satisfied, count(*) AS n_groups, 0::BIGINT AS n_violating, count(*) AS n_relevant FROM part WHERE p_size < 0 UNION ALL SELECT 'p_brand->p_type', true, 0, 0, 0")
def _(spark, sf_dir):
    """FDs over no rows: satisfied, with no groups."""
    return validate.fd_batch(table(spark, sf_dir, "part").where("p_size < 0"), [(["p_partkey"], ["p_name"]), (["p_brand"], ["p_type"])])


@query(
    "fd_violation_pairs_part",
    """
WITH r AS (SELECT p_type, p_size::VARCHAR AS v, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k, first_value(p_size::VARCHAR) OVER (PARTITION BY p_type ORDER BY p_partkey) AS one FROM part)
SELECT p_type AS key, one, v AS other, k AS place FROM r WHERE k BETWEEN 2 AND 4 AND v <> one
""",
)
def _(spark, sf_dir):
    pairs = validate.fd_violation_pairs(table(spark, sf_dir, "part"), ["p_type"], ["p_size"], ["p_partkey"])
    return pairs.select(F.col("key")[0].alias("key"), F.col("one")[0].alias("one"), F.col("other")[0].alias("other"), "place")


# Attributes of part and of what refers to it, by number; candidate dependencies, of which the data keep some.
ATTRS = {0: ("part", "p_partkey"), 1: ("part", "p_name"), 2: ("part", "p_brand"), 3: ("part", "p_type"), 4: ("part", "p_size"), 5: ("part", "p_retailprice"), 6: ("lineitem", "l_partkey"), 7: ("supplier", "s_suppkey"), 8: ("lineitem", "l_suppkey")}
CANDIDATE_FDS = [([0], [1]), ([0, 1], [2]), ([0], [2, 3]), ([0], [3]), ([2], [3]), ([0, 2], [4]), ([0, 3], [4, 5]), ([1], [0]), ([4], [5]), ([3, 4], [2])]
CANDIDATE_INDS = [(6, 0), (8, 7), (0, 7), (7, 0)]


def _column(a: int) -> str:
    return ATTRS[a][1]


_HELD = "held AS (" + " UNION ALL ".join(f"SELECT {a} AS lhs, {b} AS rhs FROM ({_fd_sql('x', 'part', [_column(i) for i in a], [_column(i) for i in b])}) WHERE satisfied" for a, b in CANDIDATE_FDS) + ")"
_HELD_INDS = "held_inds AS (" + " UNION ALL ".join(f"SELECT {a} AS src, {b} AS dst FROM ({_IND_SQL.format(r=ATTRS[a][0], x=ATTRS[a][1], s=ATTRS[b][0], y=ATTRS[b][1])}) WHERE satisfied" for a, b in CANDIDATE_INDS) + ")"


def _held_fds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate FDs that hold in part: lhs, rhs."""
    names = {f"{','.join(map(_column, a))}->{','.join(map(_column, b))}": (a, b) for a, b in CANDIDATE_FDS}
    held = validate.fd_batch(table(spark, sf_dir, "part"), [([*map(_column, a)], [*map(_column, b)]) for a, b in names.values()])
    ids = values(spark, "dep string, lhs array<int>, rhs array<int>", *((n, a, b) for n, (a, b) in names.items()))
    return held.where("satisfied").join(ids, "dep").select("lhs", "rhs")


def _held_inds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier")}
    names = [f"{a} {b}" for a, b in CANDIDATE_INDS]
    held = validate.ind_batch(tables, [(ATTRS[a][0], [_column(a)], ATTRS[b][0], [_column(b)]) for a, b in CANDIDATE_INDS], names)
    ids = values(spark, "dep string, lhs array<int>, rhs array<int>", *((f"{a} {b}", [a], [b]) for a, b in CANDIDATE_INDS))
    return held.where("satisfied").join(ids, "dep").select("lhs", "rhs")


@query(
    "fd_minimise",
    f"""
WITH {_HELD}
SELECT array_to_string(lhs, ',') AS lhs, array_to_string(rhs, ',') AS rhs FROM held d
WHERE NOT EXISTS (SELECT 1 FROM held o WHERE len(o.lhs) < len(d.lhs) AND list_has_all(d.lhs, o.lhs) AND list_has_all(o.rhs, d.rhs))
""",
)
def _(spark, sf_dir):
    return _text(validate.minimise(_held_fds(spark, sf_dir)))


@query(
    "attr_closure",
    f"""
WITH RECURSIVE {_HELD}, f AS (SELECT lhs, unnest(rhs) AS b FROM held),
c AS (SELECT [1] AS s, 0 AS i UNION ALL SELECT list_sort(list_distinct(s || coalesce((SELECT list(b) FROM f WHERE list_has_all(s, lhs)), []))), i + 1 FROM c WHERE i < 6)
SELECT unnest(s)::BIGINT AS attr, list_has_all(s, [0, 1, 2, 3, 4, 5]) AS superkey FROM c WHERE i = 6
""",
)
def _(spark, sf_dir):
    """What the name of a part determines, by the FDs that hold, and whether that is everything."""
    got = validate.closures(values(spark, "start array<int>", ([1],)), _held_fds(spark, sf_dir))
    return got.select(F.explode(F.col("closure").cast("array<long>")).alias("attr"), (F.size("closure") >= 6).alias("superkey"))


@query(
    "candidate_keys",
    f"""
WITH RECURSIVE {_HELD}, f AS (SELECT lhs, unnest(rhs) AS b FROM held), a AS (SELECT unnest(range(6))::INTEGER AS x),
k AS (SELECT [x] AS s FROM a UNION ALL SELECT [a.x, b.x] FROM a, a b WHERE a.x < b.x UNION ALL SELECT [a.x, b.x, c.x] FROM a, a b, a c WHERE a.x < b.x AND b.x < c.x),
c AS (SELECT s AS s0, s, 0 AS i FROM k UNION ALL SELECT s0, list_sort(list_distinct(s || coalesce((SELECT list(b) FROM f WHERE list_has_all(s, lhs)), []))), i + 1 FROM c WHERE i < 6),
d AS (SELECT s0, s, len(s) = 6 AS superkey FROM c WHERE i = 6)
SELECT array_to_string(s0, ',') AS start, array_to_string(s, ',') AS closure, superkey,
  superkey AND NOT EXISTS (SELECT 1 FROM d o WHERE o.superkey AND len(o.s0) = len(d.s0) - 1 AND list_has_all(d.s0, o.s0)) AS minimal FROM d
""",
)
def _(spark, sf_dir):
    """The closures of all sets of up to three attributes of part, the superkeys and the minimal ones among them."""
    got = validate.keys(values(spark, "attr int", *((a,) for a in range(6))), _held_fds(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return got.select(text("start"), text("closure"), "superkey", "minimal")


# --- signals --------------------------------------------------------------------------------------
# Source columns, some of more values than are kept. Targets: ten customers by a hash of their keys, and a
# few rows by hand for booleans, null tokens and types that the tables don't have.

SOURCE = [("customer", "c_mktsegment"), ("customer", "c_nationkey"), ("nation", "n_name"), ("region", "r_name"), ("part", "p_size"), ("customer", "c_name"), ("customer", "c_acctbal"), ("part", "p_name")]
TARGET = [["BUILDING", "3", "10", "yes"], ["MACHINERY", "7", "20", "no"], ["BUILDING", "24", "30", "yes"], ["Asia", "5", "41.5", "na"]]
SAMPLED = ["c_name", "c_acctbal", "c_nationkey"]


def _signal_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    by_hand = values(spark, "t_attr int, raw string", *((j, v) for r in TARGET for j, v in enumerate(r)))
    some = evaluate.sample_rows(table(spark, sf_dir, "customer"), 10, "c_custkey").select(*SAMPLED)
    ids = values(spark, "col string, t_attr int", *((c, len(TARGET[0]) + j) for j, c in enumerate(SAMPLED)))
    target = by_hand.union(profile.cells(some, "t").join(F.broadcast(ids), "col").select("t_attr", "raw"))
    names = {t: [c for u, c in SOURCE if u == t] for t, _ in SOURCE}
    ids = values(spark, "tbl string, col string, s_attr int", *((t, c, i) for i, (t, c) in enumerate(SOURCE)))
    return target, profile.profile_tables({t: table(spark, sf_dir, t).select(*own) for t, own in names.items()}).join(F.broadcast(ids), ["tbl", "col"])


def _raw(c: str) -> str:
    return f"{c}::DECIMAL(18,6)::VARCHAR" if c == "c_acctbal" else f"{c}::VARCHAR"


_NUM = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
_TARGET_SQL = " UNION ALL ".join([f"SELECT {j} AS t_attr, '{v}' AS raw" for r in TARGET for j, v in enumerate(r)] + [f"SELECT {len(TARGET[0]) + j}, {_raw(c)} FROM sampled" for j, c in enumerate(SAMPLED)])
_SOURCE_SQL = " UNION ALL ".join(f"SELECT {i} AS s_attr, {_raw(c)} AS v FROM {t}" for i, (t, c) in enumerate(SOURCE))
_CLASS = r"""CASE WHEN count({v}) = 0 THEN 'mixed'
    WHEN bool_and(regexp_matches(regexp_replace({v}, '[ -]', '', 'g'), '^\p{{L}}+$')) THEN 'alpha'
    WHEN bool_and(regexp_matches({v}, '^\p{{Nd}}+$')) THEN 'digit'
    WHEN bool_and(regexp_matches(replace({v}, ' ', ''), '^[\p{{L}}\p{{Nd}}]+$')) THEN 'alnum' ELSE 'mixed' END"""
_KIND = r"""CASE WHEN coalesce(bool_and(regexp_matches({v}, '^-?[0-9]+$')), false) THEN 'int'
    WHEN coalesce(bool_and(regexp_matches({v}, '{num}')), false) THEN 'float'
    WHEN coalesce(bool_and(lower({v}) IN ('true','false','yes','no','0','1','t','f','y','n')), false) THEN 'bool' ELSE 'str' END"""
_SIGNALS = f"""
WITH sampled AS (SELECT * FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 10),
t AS ({_TARGET_SQL}), s AS ({_SOURCE_SQL}),
sd AS (SELECT DISTINCT s_attr, v FROM s),
sr AS (SELECT *, row_number() OVER (PARTITION BY s_attr ORDER BY md5(v), v) AS k, count(*) OVER (PARTITION BY s_attr) AS n FROM sd),
sv AS (SELECT s_attr, v FROM sr WHERE n <= 500 OR k <= 200),
sp AS (
  SELECT s_attr, {_KIND.format(v="v", num=_NUM)} AS dtype, count(DISTINCT v) AS n_unique, count(*) AS n_rows, avg(length(v)) AS slen, {_CLASS.format(v="v")} AS scl,
    CASE WHEN bool_and(regexp_matches(v, '{_NUM}')) THEN quantile_cont(try_cast(v AS DOUBLE), [0, 0.25, 0.75, 1]) END AS q
  FROM s GROUP BY s_attr),
tn AS (SELECT *, CASE WHEN lower(trim(raw)) IN {NULLS} THEN NULL ELSE trim(raw) END AS v, CASE WHEN regexp_matches(trim(raw), '{_NUM}') THEN trim(raw)::DOUBLE END AS x FROM t),
tp AS (
  SELECT t_attr, {_KIND.format(v="v", num=_NUM)} AS tt, count(DISTINCT raw) AS tc, avg(length(v)) AS tl, count(x) AS nx, min(x) AS lo, max(x) AS hi,
    list_sort(list(x) FILTER (x IS NOT NULL))[count(x) // 2 + 1] AS med, count(v) AS nv, {_CLASS.format(v="v")} AS tcl
  FROM tn GROUP BY t_attr),
td AS (SELECT DISTINCT t_attr, raw FROM t),
s1 AS (
  SELECT t_attr, s_attr, least(1.0, m / n + CASE WHEN n_unique <= 500 THEN 0 ELSE (n - m) / n * least(1.0, n_unique / n_rows) END) AS subset
  FROM (SELECT a.t_attr, sp.s_attr, n_unique, n_rows, count(*) AS n, count(sv.v) AS m FROM td a CROSS JOIN sp LEFT JOIN sv ON sv.s_attr = sp.s_attr AND sv.v = a.raw GROUP BY ALL)),
s4 AS (
  SELECT t_attr, s_attr, avg(best) AS semantic
  FROM (SELECT t_attr, s_attr, a, max(1 - levenshtein(a, lower(sv.v)) / greatest(length(a), length(sv.v), 1)) AS best FROM (SELECT DISTINCT t_attr, lower(v) AS a FROM tn WHERE v IS NOT NULL), sv GROUP BY ALL)
  GROUP BY ALL),
sc AS (
  SELECT t_attr, s_attr, subset,
    least(1.0, CASE WHEN tt = dtype THEN 1.0 WHEN tt IN ('int','float') AND dtype IN ('int','float') THEN 0.8 WHEN tt = 'bool' AND dtype IN ('int','float') THEN 0.5
        WHEN tt = 'str' OR dtype = 'str' THEN 0.3 ELSE 0.0 END + CASE WHEN tc / n_unique BETWEEN 0.05 AND 5 THEN 0.1 ELSE 0 END) AS type,
    CASE WHEN dtype IN ('int','float') THEN
        CASE WHEN nx = 0 THEN 0.1 WHEN hi < q[1] OR lo > q[4] THEN 0.0 ELSE
          0.6 * least(1.0, greatest(0, least(hi, q[4]) - greatest(lo, q[1])) / greatest(hi - lo, 1e-9))
          + 0.4 * greatest(0, 1 - greatest(0, least(abs(med - q[2]), abs(med - q[3])) - (q[3] - q[2])) / (q[3] - q[2] + 1e-9)) END
      ELSE CASE WHEN nv = 0 THEN 0.0 ELSE
          0.5 * (1 - abs(tl - slen) / greatest(tl, slen, 1e-9)) + 0.5 * CASE WHEN tcl = scl THEN 1.0 WHEN tcl IN ('alpha','alnum') AND scl IN ('alpha','alnum') THEN 0.5 ELSE 0.2 END END
      END AS dist,
    coalesce(semantic, 0) AS semantic
  FROM tp CROSS JOIN sp JOIN s1 USING (t_attr, s_attr) LEFT JOIN s4 USING (t_attr, s_attr)),
fin AS (SELECT *, 0.4 * subset + 0.2 * type + 0.2 * dist + 0.2 * semantic AS total FROM sc)
"""


@query("phi_fusion", _SIGNALS + "SELECT t_attr, s_attr, " + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in evaluate.SIGNALS) + " FROM fin")
def _(spark, sf_dir):
    return rounded(signals.score(*_signal_inputs(spark, sf_dir)))


for _c in ("subset", "type", "dist", "semantic"):
    query(f"signal_{_c}", _SIGNALS + f"SELECT t_attr, s_attr, round({_c}::DOUBLE, 6) AS {_c} FROM fin")(lambda spark, sf_dir, c=_c: rounded(signals.signal(c, *_signal_inputs(spark, sf_dir))))

OTHER_WEIGHTS = {"subset": 0.7, "semantic": 0.3}


@query("phi_weights", _SIGNALS + "SELECT t_attr, s_attr, round(0.7 * subset + 0.3 * semantic, 6) AS total FROM fin")
def _(spark, sf_dir):
    """Fusion with weights of one's own."""
    return rounded(signals.score(*_signal_inputs(spark, sf_dir), weights=OTHER_WEIGHTS).select("t_attr", "s_attr", "total"))


@query("bridge_topk", _SIGNALS + "SELECT t_attr, s_attr, row_number() OVER (PARTITION BY t_attr ORDER BY round(total, 6) DESC, s_attr) AS rank FROM fin QUALIFY rank <= 3")
def _(spark, sf_dir):
    return signals.top_k(rounded(signals.score(*_signal_inputs(spark, sf_dir))), 3).select("t_attr", "s_attr", F.col("rank").cast("long").alias("rank"))


_PAIRS = "(SELECT DISTINCT c_nationkey AS t FROM customer) a, (SELECT DISTINCT s_nationkey AS s FROM supplier) b"


def _nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers beside nations of suppliers, at most 25 of each."""
    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("t_attr")).distinct()
    return t.crossJoin(F.broadcast(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("s_attr")).distinct()))


@query("random_bridge", f"SELECT t AS t_attr, s AS s_attr, row_number() OVER (PARTITION BY t ORDER BY md5('42|' || t || '|' || s)) AS rank FROM {_PAIRS} QUALIFY rank <= 3")
def _(spark, sf_dir):
    return signals.random_bridge(_nation_pairs(spark, sf_dir), 3).select("t_attr", "s_attr", F.col("rank").cast("long").alias("rank"))


@query(
    "random_bridge_repeats",
    f"""
WITH r AS (SELECT t, s, seed, row_number() OVER (PARTITION BY seed, t ORDER BY md5(seed || '|' || t || '|' || s)) AS rank FROM {_PAIRS}, (SELECT unnest(range(42, 52)) AS seed)),
h AS (SELECT seed, t, max((t = s)::INTEGER) AS ok FROM r WHERE rank <= 3 AND t IN (SELECT s_nationkey FROM supplier) GROUP BY ALL)
SELECT seed::INTEGER AS seed, round(avg(ok), 6) AS hit FROM h GROUP BY seed
""",
)
def _(spark, sf_dir):
    """Ten random bridges, and how often a nation meets itself in each."""
    cells = _nation_pairs(spark, sf_dir)
    truth = cells.where("t_attr = s_attr").select(F.lit("r").alias("run_id"), "t_attr", "s_attr")
    return rounded(evaluate.bridge_hits(evaluate.random_bridges(cells), truth))


@query("sample_target", "SELECT c_custkey, c_name FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 10")
def _(spark, sf_dir):
    return evaluate.sample_rows(table(spark, sf_dir, "customer"), 10, "c_custkey").select("c_custkey", "c_name")


# --- remapping ------------------------------------------------------------------------------------
# The target: nations with their regions, a column of which is an attribute from 10 on. Sources are scored by
# the share of the target's values that they have, and each keeps its two best targets.

TARGET_COLUMNS = {10: "n_nationkey", 11: "n_name", 12: "n_regionkey", 13: "r_name"}
SOURCES = {0: ("customer", "c_nationkey"), 1: ("supplier", "s_nationkey"), 2: ("region", "r_name"), 3: ("nation", "n_regionkey")}
SOURCE_FDS, SOURCE_INDS, SOURCE_CFDS = [([0], [2]), ([0, 3], [2]), ([3], [0])], [([3], [0]), ([1], [0])], [([0], [2], {0: "3"}), ([3], [1], {3: "1"}), ([0], [2], {2: "ASIA"}), ([0], [2], {0: "nowhere"})]
_REMAP = (
    "w AS (" + " UNION ALL ".join(f"SELECT n_nationkey AS row_id, {k} AS t, {c}::VARCHAR AS v FROM nation JOIN region ON n_regionkey = r_regionkey" for k, c in TARGET_COLUMNS.items()) + "), "
    "sv AS (" + " UNION ALL ".join(f"SELECT DISTINCT {k} AS s, {c}::VARCHAR AS v FROM {t}" for k, (t, c) in SOURCES.items()) + "), "
    "sc AS (SELECT s, t, count(sv.v) / count(*) AS score FROM (SELECT DISTINCT t, v FROM w) a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS s) LEFT JOIN sv USING (s, v) GROUP BY ALL), "
    "c AS (SELECT s, t FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, t) AS k FROM sc) WHERE k <= 2), "
    "m AS (SELECT row_id, map_from_entries(list((t, v))) AS v FROM w GROUP BY row_id)"
)


def _remap_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """scores, candidates, target cells."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    texts = both.select(F.col("n_nationkey").alias("row_id"), *(F.col(c).cast("string").alias(str(k)) for k, c in TARGET_COLUMNS.items()))
    target = texts.unpivot("row_id", [str(k) for k in TARGET_COLUMNS], "t_attr", "raw").withColumn("t_attr", F.col("t_attr").cast("int"))
    ids = values(spark, "tbl string, col string, s_attr int", *((t, c, k) for k, (t, c) in SOURCES.items()))
    own = profile.value_lists({t: table(spark, sf_dir, t).select(c) for t, c in SOURCES.values()}).join(F.broadcast(ids), ["tbl", "col"])
    # A cell for each pair of columns, read by all that follows.
    scores = stored(signals.subset_signal(target, own).withColumn("total", F.col("subset")), "scores")
    return scores, remap.candidates(scores, 2), target


def _deps(spark: SparkSession, rows) -> DataFrame:
    return values(spark, "dep_id int, lhs array<int>, rhs array<int>", *((i, a, b) for i, (a, b) in enumerate(rows)))


def _cfds(spark: SparkSession) -> DataFrame:
    return values(spark, "dep_id int, lhs array<int>, rhs array<int>, pattern map<int,string>", *((i, *d) for i, d in enumerate(SOURCE_CFDS)))


def _text(df: DataFrame) -> DataFrame:
    return df.select(*(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("lhs", "rhs")))


def _assigned(deps: list[tuple], cand: str = "c") -> str:
    """dep, lhs, rhs, pattern, assign (source attributes) of every choice of candidates, filtered as mapped FDs are."""
    parts = []
    for i, (a, b, *p) in enumerate(deps):
        attrs = list(dict.fromkeys(a + b))
        side = lambda own: "[" + ", ".join(f"c{x}.t" for x in own) + "]"
        pattern = "[" + ", ".join(f"(c{k}.t, '{v}')" for k, v in (p[0] if p else {}).items()) + "]"
        at = " AND ".join(f"c{x}.s = {x}" for x in attrs)
        parts.append(f"SELECT {i} AS dep, {side(a)} AS lhs, {side(b)} AS rhs, {pattern}::STRUCT(k INTEGER, v VARCHAR)[] AS pattern, [{', '.join(f'({x}, c{x}.t)' for x in attrs)}]::STRUCT(s INTEGER, t INTEGER)[] AS assign FROM {', '.join(f'{cand} c{x}' for x in attrs)} WHERE {at}")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE len(lhs) = len(list_distinct(lhs)) AND NOT list_has_any(lhs, rhs)"


_HOLDS = """SELECT DISTINCT lhs, rhs, pattern FROM (
  SELECT lhs, rhs, pattern, [m.v[x] FOR x IN lhs] AS key, count(DISTINCT [m.v[x] FOR x IN rhs]) AS d
  FROM {mapped} a, m WHERE len([1 FOR e IN pattern IF m.v[e.k] <> e.v]) = 0 GROUP BY ALL)
  GROUP BY lhs, rhs, pattern HAVING max(d) = 1"""


@query("candidate_assignments", f"WITH {_REMAP} SELECT 0 AS dep_id, a.t AS a0, b.t AS a2, NULL::INTEGER AS a3 FROM c a, c b WHERE a.s = 0 AND b.s = 2 UNION ALL SELECT 1, a.t, b.t, d.t FROM c a, c b, c d WHERE a.s = 0 AND b.s = 2 AND d.s = 3 UNION ALL SELECT 2, a.t, NULL, d.t FROM c a, c d WHERE a.s = 0 AND d.s = 3")
def _(spark, sf_dir):
    _, cand, _ = _remap_inputs(spark, sf_dir)
    return remap.assignments(_deps(spark, SOURCE_FDS), cand).select("dep_id", *(F.try_element_at("assign", F.lit(i)).alias(f"a{i}") for i in (0, 2, 3)))


@query(
    "mapped_fds",
    f"""
WITH {_REMAP}, a AS (SELECT DISTINCT lhs, rhs, pattern FROM ({_assigned(SOURCE_FDS)})), h AS ({_HOLDS.format(mapped="a")})
SELECT array_to_string(lhs, ',') AS lhs, array_to_string(rhs, ',') AS rhs FROM h
WHERE NOT EXISTS (SELECT 1 FROM h o WHERE len(o.lhs) < len(h.lhs) AND list_has_all(h.lhs, o.lhs) AND list_has_all(o.rhs, h.rhs))
""",
)
def _(spark, sf_dir):
    _, cand, target = _remap_inputs(spark, sf_dir)
    return _text(validate.minimise(remap.holding_fds(remap.mapped_fds(_deps(spark, SOURCE_FDS), cand), target)))


_IND_MAPPED = " UNION ".join(f"SELECT a.t AS l, b.t AS r FROM {{c}} a, {{c}} b WHERE a.s = {a[0]} AND b.s = {b[0]} AND a.t <> b.t" for a, b in SOURCE_INDS)
_IND_HOLDS = "NOT EXISTS (SELECT 1 FROM w WHERE t = l AND v NOT IN (SELECT b.v FROM w b WHERE b.t = r))"


@query("mapped_inds", f"WITH {_REMAP} SELECT l::VARCHAR AS lhs, r::VARCHAR AS rhs FROM ({_IND_MAPPED.format(c='c')}) WHERE {_IND_HOLDS}")
def _(spark, sf_dir):
    _, cand, target = _remap_inputs(spark, sf_dir)
    return _text(remap.holding_inds(remap.mapped_inds(_deps(spark, SOURCE_INDS), cand), target))


@query(
    "mapped_cfds",
    f"""
WITH {_REMAP}, a AS ({_assigned(SOURCE_CFDS)}), h AS ({_HOLDS.format(mapped="a")})
SELECT array_to_string(lhs, ',') AS lhs, array_to_string(rhs, ',') AS rhs, array_to_string([e.k || '=' || e.v FOR e IN pattern], ',') AS pattern FROM h
""",
)
def _(spark, sf_dir):
    """CFDs carried over with their patterns; those that no target row is about are dropped."""
    _, cand, target = _remap_inputs(spark, sf_dir)
    held = remap.holding_cfds(remap.mapped_cfds(_cfds(spark), cand), target)
    pattern = F.array_join(F.transform(F.map_entries("pattern"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ",")
    return held.select(*(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("lhs", "rhs")), pattern.alias("pattern"))


# --- mediators ------------------------------------------------------------------------------------


@query("cfd_edges", "SELECT DISTINCT a AS attr_id, o_orderkey AS row_gid FROM orders, (SELECT unnest([1, 2, 5]) AS a) WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' UNION SELECT a, o_orderkey FROM orders, (SELECT unnest([1, 2]) AS a) WHERE o_orderstatus = 'P'")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_gid"), F.col("o_orderstatus").alias("2"), F.col("o_orderpriority").alias("5"))
    cell = orders.unpivot("row_gid", ["2", "5"], "attr_id", "raw").select(F.col("attr_id").cast("int").alias("attr_id"), "row_gid", "raw")
    rules = values(spark, "rule_id int, lhs array<int>, rhs array<int>, pattern map<int,string>", (0, [2, 5], [1], {2: "F", 5: "1-URGENT"}), (1, [1], [2], {2: "P"}))
    return mediator.expand(rules, cell)


@query("cfd_subset_nested", "WITH r AS (SELECT p_type AS rule, row_number() OVER (ORDER BY md5('42|' || p_type), p_type) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_type FROM part)) SELECT f AS fraction, rule FROM r, (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS f) WHERE k <= floor(f * n + 1e-9)")
def _(spark, sf_dir):
    return mediator.nested(table(spark, sf_dir, "part").select(F.col("p_type").alias("rule")), "rule", [0.25, 0.5, 0.75, 1.0])


_COUNTS = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem"]


@query("row_offsets", "SELECT tbl, n_rows, coalesce(sum(n_rows) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (" + " UNION ALL ".join(f"SELECT {i} AS ord, '{t}' AS tbl, count(*) AS n_rows FROM {t}" for i, t in enumerate(_COUNTS)) + ")")
def _(spark, sf_dir):
    out = None
    for i, t in enumerate(_COUNTS):
        one = table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(i).alias("ord"), F.lit(t).alias("tbl"), "n_rows")
        out = one if out is None else out.union(one)
    return mediator.offsets(out).select("tbl", "n_rows", "offset")


@query("cfd_subset_by_row", "WITH r AS (SELECT o_orderkey AS row_gid, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F')) SELECT f AS fraction, row_gid FROM r, (SELECT unnest([0.25, 0.5])::DOUBLE AS f) WHERE k <= floor(f * n + 1e-9)")
def _(spark, sf_dir):
    """Nested subsets by mediators: rows, of which there may be any number."""
    return mediator.nested(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("row_gid")), "row_gid", [0.25, 0.5])


@query(
    "nesting_assertion",
    """
WITH r AS (SELECT p_name AS rule, row_number() OVER (ORDER BY md5('42|' || p_name), p_name) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_name FROM part)),
s AS (SELECT f AS fraction, rule FROM r, (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS f) WHERE k <= floor(f * n + 1e-9))
SELECT fraction, count(*) AS n, count(*) FILTER (fraction < 1 AND NOT EXISTS (SELECT 1 FROM s o WHERE o.fraction = s.fraction + 0.25 AND o.rule = s.rule)) AS lacking, md5(string_agg(rule, '|' ORDER BY rule)) AS rules FROM s GROUP BY fraction
""",
)
def _(spark, sf_dir):
    """The items of each fraction, and how many of them the next larger one lacks."""
    subsets = mediator.nested(table(spark, sf_dir, "part").select(F.col("p_name").alias("rule")), "rule", [0.25, 0.5, 0.75, 1.0])
    lacking = mediator.not_nested(subsets, "rule").select((F.col("fraction") - 0.25).alias("fraction"), "rule").groupBy("fraction").agg(F.count(F.lit(1)).alias("lacking"))
    own = subsets.groupBy("fraction").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("rule")), "|").cast("binary")).alias("rules"))
    return own.join(lacking, "fraction", "left").na.fill(0, ["lacking"])


@query("row_ids", "SELECT l_orderkey, l_linenumber, 100 + row_number() OVER () - 1 AS row_gid FROM lineitem")
def _(spark, sf_dir):
    """Row numbers of a file scan: gapless from the offset on, in the order of the file."""
    return mediator.row_ids(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), offset=100)


RANGES = [("a", 0, 0, 2), ("b", 1, 3, 5), ("c", 2, 4, 9)]


@query(
    "rule_owners",
    """
WITH r AS (SELECT p_partkey AS rule_id, p_size % 11 AS a FROM part), t AS (SELECT * FROM (VALUES ('a', 0, 0, 2), ('b', 1, 3, 5), ('c', 2, 4, 9)) AS t(tbl, ord, lo, hi))
SELECT rule_id, coalesce(arg_min(tbl, ord) FILTER (a BETWEEN lo AND hi), max(CASE WHEN a = 10 THEN 'a' END)) AS tbl FROM r, t GROUP BY rule_id
""",
)
def _(spark, sf_dir):
    """The table that a rule's first attribute belongs to: by range, else by header."""
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.array(F.col("p_size") % 11).alias("lhs"))
    return mediator.owners(rules, values(spark, "tbl string, ord int, lo int, hi int", *RANGES), values(spark, "tbl string, attr_id int", ("a", 10)))


# --- graph and embedding --------------------------------------------------------------------------
# Edges of the FDs and INDs that hold, and bridges from two targets to the attributes that sizes of parts name.

_EDGES = f"""
{_HELD}, {_HELD_INDS}, bridge AS (SELECT DISTINCT 9 + p_size % 2 AS t, p_size % 6 AS s FROM part),
e AS (
  SELECT src, dst, kind, count(*)::DOUBLE AS weight FROM (
    SELECT l AS src, unnest(rhs) AS dst, 'fd' AS kind FROM (SELECT unnest(lhs) AS l, rhs FROM held)
    UNION ALL SELECT src, dst, 'ind' FROM held_inds UNION ALL SELECT dst, src, 'ind' FROM held_inds
    UNION ALL SELECT t, s, 'bridge' FROM bridge UNION ALL SELECT s, t, 'bridge' FROM bridge) GROUP BY ALL),
p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, sum(weight) AS w FROM e GROUP BY ALL))"""
NODES = 11


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridge = table(spark, sf_dir, "part").select((9 + F.col("p_size") % 2).alias("t_attr"), (F.col("p_size") % 6).alias("s_attr")).distinct()
    return graph.edges(_held_fds(spark, sf_dir), _held_inds(spark, sf_dir), bridge)


@query("graph_edges", f"WITH {_EDGES} SELECT * FROM e")
def _(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("graph_edges_crossed", f"WITH {_HELD} SELECT src, dst, 'ind' AS kind, count(*)::DOUBLE AS weight FROM (SELECT l AS src, unnest(rhs) AS dst FROM (SELECT unnest(lhs) AS l, rhs FROM held)) GROUP BY ALL UNION ALL SELECT dst, src, 'ind', count(*)::DOUBLE FROM (SELECT l AS src, unnest(rhs) AS dst FROM (SELECT unnest(lhs) AS l, rhs FROM held)) GROUP BY ALL")
def _(spark, sf_dir):
    """Composite sides paired all with all, both ways; no attribute stands on both sides of these."""
    return graph.edges(inds=_held_fds(spark, sf_dir), positional=False).select("src", "dst", "kind", "weight")


@query("graph_edges_none", f"WITH {_HELD} SELECT src, dst, 'fd' AS kind, count(*)::DOUBLE AS weight FROM (SELECT l AS src, unnest(rhs) AS dst FROM (SELECT unnest(lhs) AS l, rhs FROM held WHERE len(lhs) > 2)) GROUP BY ALL")
def _(spark, sf_dir):
    """Edges of the dependencies with a left side of three: none of the candidates."""
    return graph.edges(_held_fds(spark, sf_dir).where("size(lhs) > 2"))


@query("transition_matrix", f"WITH {_EDGES} SELECT src, dst, round(p, 6) AS p FROM p")
def _(spark, sf_dir):
    return rounded(graph.transition(_edges(spark, sf_dir)))


_START = "x0 AS (SELECT p_size % 6 AS a, p_brand AS col, count(*)::DOUBLE AS v FROM part GROUP BY ALL)"


def _start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts of each brand name each attribute by their size."""
    each = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 6).alias("attr_id"), F.col("p_brand").alias("col"))
    return each.agg(F.count(F.lit(1)).cast("double").alias("value"))


@query(
    "propagate_hops",
    f"""
WITH {_EDGES}, {_START}, x1 AS (SELECT src AS a, col, sum(p * v) AS v FROM p JOIN x0 ON dst = a GROUP BY ALL), x2 AS (SELECT src AS a, col, sum(p * v) AS v FROM p JOIN x1 ON dst = a GROUP BY ALL)
SELECT a AS attr_id, col, round(sum(v), 6) AS value FROM (SELECT a, col, 0.5 * v AS v FROM x0 UNION ALL SELECT a, col, 0.25 * v FROM x1 UNION ALL SELECT a, col, 0.125 * v FROM x2) GROUP BY ALL
""",
)
def _(spark, sf_dir):
    return rounded(graph.propagate(graph.transition(_edges(spark, sf_dir)), _start(spark, sf_dir), 2))


_FEATURE = "f AS (SELECT l_orderkey * 8 + l_linenumber AS row_gid, 1 AS attr_id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey * 8 + l_linenumber, 2 FROM lineitem WHERE l_linestatus = 'O' UNION SELECT l_orderkey * 8 + l_linenumber, 3 FROM lineitem WHERE l_quantity > 25), g AS (SELECT row_gid, list_sort(list(attr_id)) AS sig FROM f GROUP BY row_gid), s AS (SELECT array_to_string(sig, ',') AS sig, count(*) AS mult FROM g GROUP BY sig)"


def _feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_gid"), F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", 1), F.when(F.col("l_linestatus") == "O", 2), F.when(F.col("l_quantity") > 25, 3))).alias("a"))
    return line.select(F.explode("a").alias("attr_id"), "row_gid")


def _sig_text(df: DataFrame) -> DataFrame:
    return df.select(F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("sig"), "mult")


@query("feature_signatures", f"WITH {_FEATURE} SELECT * FROM s")
def _(spark, sf_dir):
    return _sig_text(graph.signatures(_feature(spark, sf_dir)))


@query("gram_matrix", f"WITH {_FEATURE}, z AS (SELECT unnest(string_split(sig, ','))::INTEGER AS a, sig, mult FROM s) SELECT x.a AS i, y.a AS j, sum(x.mult)::DOUBLE AS g FROM z x JOIN z y ON x.sig = y.sig AND x.a <= y.a GROUP BY ALL")
def _(spark, sf_dir):
    sig = graph.signatures(_feature(spark, sf_dir))
    z = sig.select(F.explode("sig").alias("attr_id"), F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("col"), "mult", F.lit(1.0).alias("value"))
    return graph.gram(z)


@query("log_affinity", f"WITH {_START} SELECT a AS attr_id, col, round(log2({NODES} * v / sum(v) OVER (PARTITION BY col) + 1), 6) AS value FROM x0")
def _(spark, sf_dir):
    return rounded(graph.log_affinity(_start(spark, sf_dir), NODES))


@query("log_affinity_many", f"WITH {_START} SELECT a AS attr_id, col, round(log2({NODES} * v + 1), 6) AS value FROM x0")
def _(spark, sf_dir):
    """As from a million nodes on: without normalising."""
    return rounded(graph.log_affinity(_start(spark, sf_dir), NODES, many=NODES))


@query("cosine_neighbours", "WITH e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e), q AS (SELECT * FROM n WHERE vec_id % 20 = 0), c AS (SELECT n.vec_id AS a, q.vec_id AS b, CASE WHEN n.n * q.n = 0 THEN 0 ELSE list_dot_product(n.v, q.v) / (n.n * q.n) END AS x FROM n, q) SELECT a, b, round(x, 4) AS cosine, row_number() OVER (PARTITION BY b ORDER BY round(x, 4) DESC, a) AS rank FROM c QUALIFY rank <= 5")
def _(spark, sf_dir):
    """Top five neighbours of every vector whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return graph.nearest(e, e.where("id % 20 = 0"))


# Features are the parts, by size, brand and type.
_PART_RULES = ["p_size <= 25", "p_size % 2 = 0", "p_retailprice > 1200", "p_brand > 'Brand#3'", "p_type < 'M'", "length(p_name) > 12"]
_COLUMNS = (
    "fr AS (" + " UNION ALL ".join(f"SELECT p_partkey AS r, {i} AS a FROM part WHERE {c}" for i, c in enumerate(_PART_RULES)) + "), "
    "fs AS (SELECT col, count(*) AS mult FROM (SELECT string_agg(a::VARCHAR, ',' ORDER BY a) AS col FROM fr GROUP BY r) GROUP BY col), "
    "f AS (SELECT unnest(string_split(col, ','))::INTEGER AS a, col, mult FROM fs), wt AS (SELECT a, sum(mult) AS w FROM f GROUP BY a), "
    "fn AS (SELECT f.a, col, 1 / w AS r FROM f JOIN wt USING (a))"
)


def _part_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array_compact(F.array(*(F.when(F.expr(c), i) for i, c in enumerate(_PART_RULES))))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_gid"), F.explode(rules).alias("attr_id"))


def _part_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sig, col (its text), mult."""
    return graph.signatures(_part_feature(spark, sf_dir)).withColumn("col", F.array_join(F.transform("sig", lambda x: x.cast("string")), ","))


def _walk_sql(start: str, forth: bool) -> str:
    """Two hops from x0 (a, col, v)."""
    to, at = ("src", "dst") if forth else ("dst", "src")
    hop = lambda i: f"x{i} AS (SELECT {to} AS a, col, sum(p * v) AS v FROM p JOIN x{i - 1} ON {at} = a GROUP BY ALL)"
    return f"x0 AS ({start}), {hop(1)}, {hop(2)}, x AS (SELECT a, col, sum(v) AS v FROM (SELECT a, col, 0.5 * v AS v FROM x0 UNION ALL SELECT a, col, 0.25 * v FROM x1 UNION ALL SELECT a, col, 0.125 * v FROM x2) GROUP BY ALL)"


_BACKWARD = f"WITH {_EDGES}, {_COLUMNS}, {_walk_sql('SELECT a, col, r / sum(r) OVER (PARTITION BY col) AS v FROM fn', False)}"


@query("propagate_backward", f"{_BACKWARD} SELECT a AS attr_id, col, round(v, 9) AS value FROM x")
def _(spark, sf_dir):
    """Walks along reversed edges to the features of parts, normalised by row and then by column."""
    return rounded(graph.backward(graph.transition(_edges(spark, sf_dir)), _part_columns(spark, sf_dir), 2), 9)


@query("log_affinity_backward", f"{_BACKWARD} SELECT a AS attr_id, col, round(log2((SELECT sum(mult) FROM fs) * v / sum(v * mult) OVER (PARTITION BY a) + 1), 6) AS value FROM x JOIN fs USING (col)")
def _(spark, sf_dir):
    columns = _part_columns(spark, sf_dir)
    return rounded(graph.log_affinity_backward(graph.backward(graph.transition(_edges(spark, sf_dir)), columns, 2), columns))


def _affinities(spark: SparkSession, sf_dir: str, hops: int) -> DataFrame:
    p = embed.transition_matrix(graph.transition(_edges(spark, sf_dir)), NODES)
    return stored(embed.affinities(p, stored(embed.columns_of(_part_feature(spark, sf_dir)), "columns"), hops), "affinity")


@query(
    "centred_gram",
    f"""
WITH {_EDGES}, {_COLUMNS}, {_walk_sql('SELECT a, col, r AS v FROM fn', True)},
z AS (SELECT a, col, log2({NODES} * v / sum(v) OVER (PARTITION BY col) + 1) AS z FROM x),
dense AS (SELECT i, fs.col, mult, coalesce(z, 0) AS z FROM (SELECT unnest(range({NODES}))::INTEGER AS i) CROSS JOIN fs LEFT JOIN z ON z.a = i AND z.col = fs.col),
c AS (SELECT i, col, mult, z - avg(z) OVER (PARTITION BY col) AS z FROM dense)
SELECT a.i, b.i AS j, round(sum(a.mult * a.z * b.z), 4) AS g FROM c a JOIN c b ON a.col = b.col AND a.i <= b.i GROUP BY ALL
""",
)
def _(spark, sf_dir):
    """The Gram matrix whose vectors are the forward factor: affinities less their mean over the nodes, two hops."""
    g = embed.centred_gram(_affinities(spark, sf_dir, 2), NODES)
    return values(spark, "i int, j int, g double", *((i, j, round(float(g[i, j]), 4) + 0.0) for i in range(NODES) for j in range(i, NODES)))


@query("forward_spectrum")
def _(spark, sf_dir):
    """Singular values of the forward affinities. No SQL: eigenvalues; their Gram matrix has SQL, and tests compare."""
    _, s = embed.leading(embed.centred_gram(_affinities(spark, sf_dir, 5), NODES), NODES - 1)
    return values(spark, "k int, s double", *((i, round(float(x), 6)) for i, x in enumerate(s)))


@query("feature_clusters")
def _(spark, sf_dir):
    """Columns of the features of parts in three clusters by their largest left singular component, summed up. No SQL:
    eigenvectors; tests compare with a dense computation."""
    columns = embed.columns_of(_part_feature(spark, sf_dir))
    own = embed.clustered(columns, NODES, 3)
    return own.select(F.array_join(F.transform("attrs", lambda x: x.cast("string")), ",").alias("sig"), "mult", "cluster")


_FACTORS = """
x AS (SELECT p_size % 6 AS a, p_brand AS col, count(*)::DOUBLE AS v FROM part WHERE p_size <= 25 GROUP BY ALL),
w AS (SELECT p_size % 6 AS a, avg(p_retailprice) / 1000 AS w1, avg(p_size) / 10 AS w2 FROM part GROUP BY ALL),
h AS (SELECT p_brand AS col, count(*) / 10 AS h1, avg(p_size) / 50 AS h2, 2 AS mult FROM part GROUP BY ALL),
c AS (SELECT mult, coalesce(v, 0) AS x, w1 * h1 + w2 * h2 AS y FROM w CROSS JOIN h LEFT JOIN x USING (a, col))"""


@query(
    "beta_divergence",
    f"""
WITH {_FACTORS}
SELECT 2.0::DOUBLE AS beta, round(sum(mult * (x - y) * (x - y)) / 2, 4) AS value FROM c
UNION ALL SELECT 1.0, round(sum(mult * (CASE WHEN x > 0 THEN x * ln(x / y) ELSE 0 END + y - x)), 4) FROM c
UNION ALL SELECT 0.0, round(sum(mult * CASE WHEN x > 0 THEN x / y - ln(x / y) ELSE 0 END) - sum(mult), 4) FROM c
""",
)
def _(spark, sf_dir):
    """How far counts of sizes and brands are from a product of two factors; only the stored counts meet them."""
    part, a = table(spark, sf_dir, "part"), (F.col("p_size") % 6).alias("attr_id")
    x = part.where("p_size <= 25").groupBy(a, F.col("p_brand").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    w = part.groupBy(a).agg(F.array(F.avg("p_retailprice") / 1000, F.avg("p_size") / 10).alias("v"))
    h = part.groupBy(F.col("p_brand").alias("col")).agg(F.array(F.count(F.lit(1)) / 10, F.avg("p_size") / 50).alias("v"), F.lit(2).alias("mult"))
    each = [embed.divergence(x, w, h, b).select(F.lit(float(b)).alias("beta"), F.round("value", 4).alias("value")) for b in (2, 1, 0)]
    return each[0].union(each[1]).union(each[2])


@query("embedding_full")
def _(spark, sf_dir):
    """Cosines of the two targets with the nine attributes. No SQL: eigenvectors and coordinate descent; tests
    compare with a dense computation."""
    p = graph.transition(_edges(spark, sf_dir))
    own = embed.vectors(spark, *embed.embed_graph(p, _part_feature(spark, sf_dir), NODES))
    return rounded(evaluate.embedding_sim(own, 9).select("t_attr", "s_attr", "score"))


# --- refinement -----------------------------------------------------------------------------------
# The matrix is that of the remapping's scores, on all rows of its target.


def _source_dependencies(spark: SparkSession) -> DataFrame:
    """case_id, kind, place, lhs, rhs, pattern of the source's dependencies."""
    rows = [("remap", kind, i, d[0], d[1], sorted(d[2].items()) if kind == "cfd" else []) for kind, own in (("fd", SOURCE_FDS), ("ind", SOURCE_INDS), ("cfd", SOURCE_CFDS)) for i, d in enumerate(own)]
    return values(spark, "case_id string, kind string, place int, lhs array<int>, rhs array<int>, pattern array<struct<attr:int,value:string>>", *rows)


def _refined(spark: SparkSession, sf_dir: str, configs: dict[str, refine.Config]) -> DataFrame:
    scores, _, target = _remap_inputs(spark, sf_dir)
    case, at = F.lit("remap").alias("case_id"), (F.col("t_attr") - 10).alias("t_attr")
    scores = scores.select(case, at, "s_attr", F.round("subset", 9).alias("score"))
    runs = refine.runs(scores, _source_dependencies(spark), configs)
    out = refine.refine_runs(runs, target.select(case, "row_id", at, "raw"))
    return rounded(out.withColumn("run_id", F.element_at(F.split("run_id", r"\|"), -1)), 9)


@query("refine_iterative")
def _(spark, sf_dir):
    """No SQL: rounds depend on the rewards of the rounds before; tests hold the published results and an
    independent computation."""
    return _refined(spark, sf_dir, {mode: refine.Config(dep_mode=mode) for mode in ("all", "fd", "ind", "every")})


def _fixed_sql(name: str, kinds: tuple[str, ...]) -> str:
    """A cell gets the reward once for every mapping that holds and has it; ties among candidates go to the higher target."""
    parts = {"fd": f"SELECT a.assign FROM ({_assigned(SOURCE_FDS, 'cc')}) a SEMI JOIN (SELECT * FROM hf) h ON a.lhs = h.lhs AND a.rhs = h.rhs", "cfd": f"SELECT a.assign FROM ({_assigned(SOURCE_CFDS, 'cc')}) a SEMI JOIN (SELECT * FROM hc) h ON a.lhs = h.lhs AND a.rhs = h.rhs AND a.pattern = h.pattern"}
    inds = " UNION ALL ".join(f"SELECT [({a[0]}, l), ({b[0]}, r)]::STRUCT(s INTEGER, t INTEGER)[] AS assign FROM (SELECT a.t AS l, b.t AS r FROM cc a, cc b WHERE a.s = {a[0]} AND b.s = {b[0]} AND a.t <> b.t) WHERE {_IND_HOLDS}" for a, b in SOURCE_INDS)
    parts["ind"] = inds
    gives = " UNION ALL ".join(parts[k] for k in kinds)
    return f"SELECT '{name}' AS run_id, t - 10 AS t_attr, s AS s_attr, round(score + 0.01 * (SELECT count(*) FROM (SELECT unnest(assign) AS x FROM ({gives})) WHERE x.s = sc.s AND x.t = sc.t), 9) AS score FROM sc"


_FIXED = f"""
WITH {_REMAP}, cc AS (SELECT s, t FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, t DESC) AS k FROM sc) WHERE k <= 2),
hf AS ({_HOLDS.format(mapped=f"({_assigned(SOURCE_FDS, 'cc')})")}), hc AS ({_HOLDS.format(mapped=f"({_assigned(SOURCE_CFDS, 'cc')})")})
"""
FIXED_MODES = {"all": ("fd", "ind"), "cfd": ("cfd",), "every": ("fd", "ind", "cfd")}


@query("refine_fixed", _FIXED + " UNION ALL ".join(_fixed_sql(m, k) for m, k in FIXED_MODES.items()))
def _(spark, sf_dir):
    """One round with fixed rewards and no ceiling; also for CFDs."""
    fixed = {m: refine.Config(dep_mode=m, k_max=2, fixed=dict.fromkeys(refine.KINDS, 0.01)) for m in FIXED_MODES}
    return _refined(spark, sf_dir, fixed)


_VERDICT = """SELECT '{kind}' AS kind, lhs, rhs, pattern, bool_and(d = 1) AS holds, max(n) AS support FROM (
  SELECT lhs, rhs, pattern, [m.v[x] FOR x IN lhs] AS key, count(DISTINCT [m.v[x] FOR x IN rhs]) AS d, count(*) AS n
  FROM ({mapped}) a, m WHERE len([1 FOR e IN pattern IF m.v[e.k] <> e.v]) = 0 GROUP BY ALL) GROUP BY ALL"""
_EVERY = "SELECT s, t FROM sc"


@query(
    "dependency_validity",
    f"""
WITH {_REMAP}, every AS ({_EVERY}), fa AS (SELECT DISTINCT lhs, rhs, pattern FROM ({_assigned(SOURCE_FDS, 'every')})), ca AS (SELECT DISTINCT lhs, rhs, pattern FROM ({_assigned(SOURCE_CFDS, 'every')})),
v AS (
  SELECT f.* FROM ({_VERDICT.format(kind='fd', mapped='SELECT * FROM fa')}) f
  UNION ALL SELECT 'cfd', ca.lhs, ca.rhs, ca.pattern, coalesce(holds, false), coalesce(support, 0) FROM ca LEFT JOIN ({_VERDICT.format(kind='cfd', mapped='SELECT * FROM ca')}) c ON c.lhs = ca.lhs AND c.rhs = ca.rhs AND c.pattern = ca.pattern
  UNION ALL SELECT 'ind', [l], [r], [], {_IND_HOLDS}, NULL FROM ({_IND_MAPPED.format(c='every')}))
SELECT kind, array_to_string(lhs, ',') AS lhs, array_to_string(rhs, ',') AS rhs, array_to_string([e.k || '=' || e.v FOR e IN pattern], ',') AS pattern, holds, support FROM v
""",
)
def _(spark, sf_dir):
    """The relation that refinement looks up: every dependency of the source under every assignment of targets, with
    its verdict on the target rows and its largest group."""
    scores, _, target = _remap_inputs(spark, sf_dir)
    case, every = F.lit("remap").alias("case_id"), scores.select("s_attr", "t_attr")
    none = F.array().cast("array<struct<attr:int,value:string>>").alias("pattern")
    asks = remap.mapped_fds(_deps(spark, SOURCE_FDS), every).select(case, F.lit("fd").alias("kind"), "lhs", "rhs", none)
    asks = asks.union(remap.mapped_inds(_deps(spark, SOURCE_INDS), every).select(case, F.lit("ind"), "lhs", "rhs", none))
    entries = F.transform(F.map_entries("pattern"), lambda e: F.struct(e["key"].alias("attr"), e["value"].alias("value")))
    asks = asks.union(remap.mapped_cfds(_cfds(spark), every).select(case, F.lit("cfd"), "lhs", "rhs", entries))
    held = validity.relation(asks, target.withColumn("case_id", F.lit("remap")))
    pattern = F.array_join(F.transform("pattern", lambda e: F.concat_ws("=", e["attr"].cast("string"), e["value"])), ",").alias("pattern")
    return held.select("kind", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("lhs", "rhs")), pattern, "holds", "support")


# --- metrics --------------------------------------------------------------------------------------
# A run for each priority and status of orders: nations (or regions) by market segments, scored by their share of
# prices, or coarsely, with many ties, of orders. Truths are a nation's largest segments, where it has enough orders.

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _cells_sql(by: str, joined: str = "") -> str:
    return f"""
w AS (
  SELECT o_orderpriority || '|' || o_orderstatus AS run_id, {by} AS t_attr, (list_position({SEGMENTS}, c_mktsegment) - 1)::INTEGER AS s_attr, count(*) AS n, sum(o_totalprice) AS p
  FROM orders JOIN customer ON o_custkey = c_custkey {joined} GROUP BY ALL),
m AS (SELECT run_id, t_attr, s_attr, round(p / sum(p) OVER k, 6) AS score, round(n / sum(n) OVER k, 1) AS coarse FROM w WINDOW k AS (PARTITION BY run_id, t_attr)),
tn AS (SELECT t_attr, s_attr, sum(n) AS n FROM w GROUP BY ALL),
tt AS (
  SELECT t_attr, s_attr FROM (SELECT *, max(n) OVER q AS most, sum(n) OVER q AS whole FROM tn WINDOW q AS (PARTITION BY t_attr))
  WHERE n >= 0.9 * most AND whole >= (SELECT sum(n) / count(DISTINCT t_attr) FROM tn)),
g AS (SELECT run_id, t_attr, s_attr FROM (SELECT DISTINCT run_id FROM w), tt)"""


_REGIONS = "JOIN nation ON c_nationkey = n_nationkey"
_NATION_CELLS = _cells_sql("c_nationkey")
_REGION_CELLS = _cells_sql("n_regionkey", _REGIONS)


def _matches(spark: SparkSession, sf_dir: str, by: str = "c_nationkey") -> tuple[DataFrame, DataFrame, DataFrame]:
    """sim by prices, sim by coarse shares, truth."""
    from pyspark.sql import Window as W

    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if by == "n_regionkey":
        both = both.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    segment = (F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1).cast("int")
    key = (F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("run_id"), F.col(by).alias("t_attr"), segment.alias("s_attr"))
    w = both.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("p"))
    k, q = W.partitionBy("run_id", "t_attr"), W.partitionBy("t_attr")
    share = lambda c, digits: F.round(F.col(c) / F.sum(c).over(k), digits).alias("score")
    n = w.groupBy("t_attr", "s_attr").agg(F.sum("n").alias("n")).withColumns({"most": F.max("n").over(q), "whole": F.sum("n").over(q)})
    mean = n.agg((F.sum("n") / F.count_distinct("t_attr")).alias("mean"))
    large = n.crossJoin(F.broadcast(mean)).where("n >= 0.9 * most and whole >= mean").select("t_attr", "s_attr")  # one number
    truth = w.select("run_id").distinct().crossJoin(F.broadcast(large))  # 25 by 5 at most
    key = ("run_id", "t_attr", "s_attr")
    return w.select(*key, share("p", 6)), w.select(*key, share("n", 1)), truth


def _rank_sql(score: str = "score") -> str:
    return f"""{_NATION_CELLS},
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, t_attr ORDER BY {score} DESC, s_attr) AS k, EXISTS (SELECT 1 FROM g WHERE g.run_id = m.run_id AND g.t_attr = m.t_attr AND g.s_attr = m.s_attr) AS hit FROM m),
f AS (SELECT c.run_id, c.t_attr, min(k) FILTER (hit) AS first FROM (SELECT DISTINCT run_id, t_attr FROM g) c LEFT JOIN r ON r.run_id = c.run_id AND r.t_attr = c.t_attr GROUP BY ALL)"""


_HITS = "SELECT run_id, k, avg(coalesce(first <= k, false)::INTEGER) AS hit FROM f, (SELECT unnest([1, 3, 5])::INTEGER AS k) GROUP BY ALL"
_MRR = "SELECT run_id, avg(coalesce(1 / first, 0)) AS mrr FROM f GROUP BY run_id"
_RECALL = """
SELECT s.run_id, coalesce(n, 0) / gs AS recall FROM (SELECT run_id, count(*) AS gs FROM g GROUP BY run_id) s LEFT JOIN (
  SELECT t.run_id, count(*) FILTER (hit) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {score} DESC, t_attr, s_attr) AS o FROM r) t
  JOIN (SELECT run_id, count(*) AS c FROM g GROUP BY run_id) x ON x.run_id = t.run_id AND o <= c GROUP BY t.run_id) z USING (run_id)"""


@query("hit_at_k", f"WITH {_rank_sql()} SELECT run_id, k, round(hit, 6) AS hit FROM ({_HITS})")
def _(spark, sf_dir):
    sim, _, truth = _matches(spark, sf_dir)
    return rounded(metrics.hit_at_k(sim, truth))


@query("mrr", f"WITH {_rank_sql()} SELECT run_id, round(mrr, 6) AS mrr FROM ({_MRR})")
def _(spark, sf_dir):
    sim, _, truth = _matches(spark, sf_dir)
    return rounded(metrics.mrr(sim, truth))


@query("recall_at_gt", f"WITH {_rank_sql()} SELECT run_id, round(recall, 6) AS recall FROM ({_RECALL.format(score='score')})")
def _(spark, sf_dir):
    sim, _, truth = _matches(spark, sf_dir)
    return rounded(metrics.recall_at_gt(sim, truth))


_TIES = f"""
WITH {_NATION_CELLS},
l AS (SELECT m.run_id, m.t_attr, coarse, count(*) AS n, count(g.s_attr) AS h FROM m LEFT JOIN g ON g.run_id = m.run_id AND g.t_attr = m.t_attr AND g.s_attr = m.s_attr GROUP BY ALL),
a AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY run_id, t_attr ORDER BY coarse DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l),
x AS (SELECT c.run_id, c.t_attr, n, h, b FROM (SELECT DISTINCT run_id, t_attr FROM g) c LEFT JOIN (SELECT * FROM a WHERE h > 0 QUALIFY row_number() OVER (PARTITION BY run_id, t_attr ORDER BY coarse DESC) = 1) a USING (run_id, t_attr)),
perm AS (SELECT i, j FROM (SELECT unnest(range(0, 6)) AS i), (SELECT unnest(range(0, 6)) AS j)),
c AS (SELECT i, j, CASE WHEN j <= i THEN factorial(i::INTEGER) / factorial(j::INTEGER) / factorial((i - j)::INTEGER) ELSE 0 END AS c FROM perm),
miss AS (SELECT x.run_id, x.t_attr, k, 1 - coalesce(p.c / q.c, 1) AS hit FROM x CROSS JOIN (SELECT unnest([1, 3, 5]) AS k)
  LEFT JOIN c p ON p.i = n - h AND p.j = least(n, greatest(0, k - b)) LEFT JOIN c q ON q.i = n AND q.j = least(n, greatest(0, k - b))),
recip AS (SELECT run_id, t_attr, sum(1 / (b + r) * p.c / q.c) AS rr FROM x CROSS JOIN (SELECT unnest(range(1, 6)) AS r) JOIN c p ON p.i = n - r AND p.j = h - 1 JOIN c q ON q.i = n AND q.j = h GROUP BY ALL),
lv AS (SELECT run_id, coarse, sum(n) AS n, sum(h) AS h FROM l GROUP BY ALL),
lw AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY run_id ORDER BY coarse DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lv),
rc AS (SELECT run_id, sum(h * greatest(0, least(n, gs - b)) / n) / max(gs) AS recall FROM lw JOIN (SELECT run_id, count(*) AS gs FROM g GROUP BY run_id) USING (run_id) GROUP BY run_id)
SELECT run_id, round(p1, 6) AS p1, round(p3, 6) AS p3, round(p5, 6) AS p5, round(mrr, 6) AS mrr, round(recall, 6) AS recall FROM
  (SELECT run_id, avg(hit) FILTER (k = 1) AS p1, avg(hit) FILTER (k = 3) AS p3, avg(hit) FILTER (k = 5) AS p5 FROM miss GROUP BY run_id)
  JOIN (SELECT x.run_id, avg(coalesce(rr, 0)) AS mrr FROM x LEFT JOIN recip USING (run_id, t_attr) GROUP BY x.run_id) USING (run_id) JOIN rc USING (run_id)
"""


@query("expected_under_ties", _TIES)
def _(spark, sf_dir):
    """Metrics of the coarse scores as expected when ties are broken at random."""
    _, coarse, truth = _matches(spark, sf_dir)
    return rounded(metrics.expected(coarse, truth))


@query("threshold_hits", f"WITH {_rank_sql()} SELECT run_id, round(avg(ok::INTEGER), 6) AS hit FROM (SELECT run_id, t_attr, bool_or(hit AND score > 0.24) AS ok FROM r SEMI JOIN g USING (run_id, t_attr) GROUP BY ALL) GROUP BY run_id")
def _(spark, sf_dir):
    sim, _, truth = _matches(spark, sf_dir)
    return rounded(metrics.threshold_hits(sim, truth, 0.24))


_FIRST_TRUTH = "(SELECT run_id, t_attr, min(s_attr) AS s_attr FROM g GROUP BY ALL)"


@query(
    "top1_f1",
    f"""
WITH {_rank_sql()}, n AS (SELECT run_id, count(*) AS said, count(z.s_attr) AS hits FROM r LEFT JOIN {_FIRST_TRUTH} z USING (run_id, t_attr, s_attr) WHERE k = 1 GROUP BY run_id),
q AS (SELECT run_id, hits / said AS p, hits / want AS q FROM n JOIN (SELECT run_id, count(*) AS want FROM {_FIRST_TRUTH} GROUP BY run_id) USING (run_id))
SELECT run_id, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM q
""",
)
def _(spark, sf_dir):
    """Every nation has a prediction, also those without a truth."""
    sim, _, truth = _matches(spark, sf_dir)
    return rounded(metrics.top1_f1(sim, truth))


_BEST_ASSIGNMENT = f"""
WITH {_REGION_CELLS},
d AS (SELECT run_id, list(t ORDER BY t) AS ts FROM (SELECT DISTINCT run_id, t_attr AS t FROM m) GROUP BY run_id),
z AS (SELECT r.run_id, t, s, coalesce(score, 0) AS x FROM (SELECT run_id, unnest(ts) AS t FROM d) r CROSS JOIN (SELECT unnest(range(0, 5)) AS s) LEFT JOIN m ON m.run_id = r.run_id AND m.t_attr = t AND m.s_attr = s),
v AS (
  SELECT a.run_id, [a.s, b.s, c.s, e.s, f.s] AS pick, a.x + b.x + c.x + e.x + f.x AS total, [a.x, b.x, c.x, e.x, f.x] AS xs
  FROM z a JOIN z b USING (run_id) JOIN z c USING (run_id) JOIN z e USING (run_id) JOIN z f USING (run_id)
  WHERE a.t = 0 AND b.t = 1 AND c.t = 2 AND e.t = 3 AND f.t = 4 AND len(list_distinct([a.s, b.s, c.s, e.s, f.s])) = 5),
best AS (SELECT run_id, arg_max(pick, total) AS pick, arg_max(xs, total) AS xs FROM v GROUP BY run_id),
chosen AS (SELECT run_id, unnest(range(0, 5)) AS t_attr, unnest(pick) AS s_attr, unnest(xs) AS x FROM best),
k AS (SELECT run_id, thr, count(*) AS said, count(y.s_attr) AS hits FROM chosen CROSS JOIN (SELECT unnest(range(0, 111)) / 100 AS thr) LEFT JOIN {_FIRST_TRUTH} y USING (run_id, t_attr, s_attr) WHERE x >= thr GROUP BY ALL),
q AS (SELECT run_id, thr, 2 * hits / (said + want) AS f1 FROM k JOIN (SELECT run_id, count(*) AS want FROM {_FIRST_TRUTH} GROUP BY run_id) USING (run_id))
SELECT d.run_id, coalesce(CASE WHEN max(f1) > 0 THEN arg_max(thr, f1 - thr * 1e-9) END, 0.0)::DOUBLE AS threshold, round(coalesce(max(f1), 0), 6) AS f1 FROM d LEFT JOIN q USING (run_id) GROUP BY d.run_id
"""


@query("hungarian_f1", _BEST_ASSIGNMENT)
def _(spark, sf_dir):
    """Regions to segments, one to one, and the best threshold; the SQL tries every permutation."""
    sim, _, truth = _matches(spark, sf_dir, "n_regionkey")
    return rounded(metrics.assignment_f1(sim, truth))


_COMB = "CASE WHEN {k} <= {n} THEN factorial(({n})::INTEGER) / factorial(({k})::INTEGER) / factorial(({n} - ({k}))::INTEGER) ELSE 0 END"


@query(
    "analytic_random",
    f"""
WITH {_NATION_CELLS}, c AS (SELECT run_id, t_attr, count(DISTINCT s_attr) AS h FROM g GROUP BY ALL),
v AS (SELECT run_id, t_attr, h, 1 - ({_COMB.format(n='5 - h', k='1')}) / 5 AS p1, 1 - ({_COMB.format(n='5 - h', k='3')}) / 10 AS p3, 1 - ({_COMB.format(n='5 - h', k='5')}) AS p5 FROM c),
mr AS (SELECT run_id, t_attr, sum(1 / r * ({_COMB.format(n='5 - r', k='h - 1')}) / ({_COMB.format(n='5', k='h')})) AS rr FROM c, (SELECT unnest(range(1, 6)) AS r) WHERE h - 1 <= 5 - r GROUP BY ALL)
SELECT run_id, round(avg(p1), 6) AS p1, round(avg(p3), 6) AS p3, round(avg(p5), 6) AS p5, round(avg(rr), 6) AS mrr, round(sum(h) / (count(*) * 5), 6) AS recall FROM v JOIN mr USING (run_id, t_attr) GROUP BY run_id
""",
)
def _(spark, sf_dir):
    return rounded(metrics.analytic_random(_matches(spark, sf_dir)[2], len(SEGMENTS)))


_HIT1 = "SELECT f.run_id, f.t_attr, coalesce(min(k) FILTER (hit) <= 1, false) AS hit FROM (SELECT DISTINCT run_id, t_attr FROM g) f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, t_attr ORDER BY {score} DESC, s_attr) AS k, EXISTS (SELECT 1 FROM g WHERE g.run_id = m.run_id AND g.t_attr = m.t_attr AND g.s_attr = m.s_attr) AS hit FROM m) USING (run_id, t_attr) GROUP BY ALL"


@query("hit_transitions", f"WITH {_NATION_CELLS}, a AS ({_HIT1.format(score='coarse')}), b AS ({_HIT1.format(score='score')}) SELECT run_id, t_attr, CASE WHEN a.hit AND b.hit THEN 'kept' WHEN b.hit THEN 'improved' WHEN a.hit THEN 'dropped' ELSE 'missed' END AS change FROM a JOIN b USING (run_id, t_attr)")
def _(spark, sf_dir):
    sim, coarse, truth = _matches(spark, sf_dir)
    return metrics.transitions(coarse, sim, truth)


@query(
    "hit_detail",
    f"""
WITH {_rank_sql()}, d AS (SELECT run_id, t_attr, list(s_attr ORDER BY k) FILTER (k <= 3) AS p, list(s_attr ORDER BY s_attr) FILTER (k <= 3 AND hit) AS h FROM r SEMI JOIN g USING (run_id, t_attr) GROUP BY ALL),
t AS (SELECT run_id, t_attr, list(s_attr ORDER BY s_attr) AS t FROM g GROUP BY ALL)
SELECT run_id, t_attr, array_to_string(p, ',') AS predicted, coalesce(array_to_string(h, ','), '') AS matched, array_to_string(t, ',') AS truth, h IS NOT NULL AS hit FROM d JOIN t USING (run_id, t_attr)
""",
)
def _(spark, sf_dir):
    """The three best segments of each nation beside its truths."""
    sim, _, truth = _matches(spark, sf_dir)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return metrics.detail(sim, truth, 3).select("run_id", "t_attr", text("predicted"), text("matched"), text("truth"), "hit")


def _metric_sql() -> str:
    """stage, dataset (priority), n_inst (status), name, value."""
    parts = []
    for stage, score in (("emb", "coarse"), ("ref", "score")):
        head = f"WITH {_rank_sql(score)} "
        each = f"SELECT run_id, 'p' || k AS name, hit AS value FROM ({_HITS}) UNION ALL SELECT run_id, 'mrr', mrr FROM ({_MRR}) UNION ALL SELECT run_id, 'recall', recall FROM ({_RECALL.format(score=score)})"
        parts.append(f"SELECT '{stage}' AS stage, split_part(run_id, '|', 1) AS dataset, split_part(run_id, '|', 2) AS n_inst, name, value FROM ({head}{each})")
    return "(" + " UNION ALL ".join(parts) + ")"


_METRIC = _metric_sql()


def _metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim, coarse, truth = _matches(spark, sf_dir)
    rows = [evaluate.scores_of(m, truth).withColumn("stage", F.lit(stage)) for stage, m in (("emb", coarse), ("ref", sim))]
    run = F.split("run_id", r"\|")
    return rows[0].union(rows[1]).select("stage", run[0].alias("dataset"), run[1].alias("n_inst"), "name", "value")


@query("summary_rollup", f"SELECT stage, name, dataset, n_inst, round(avg(value), 6) AS value FROM {_METRIC} GROUP BY ROLLUP (stage, name, dataset, n_inst) HAVING stage IS NOT NULL AND name IS NOT NULL")
def _(spark, sf_dir):
    return rounded(metrics.summary(_metric(spark, sf_dir)))


@query("summary_pivot", f"SELECT stage, dataset, n_inst, " + ", ".join(f"round(avg(value) FILTER (name = '{n}'), 6) AS {n}" for n in ("p1", "p3", "mrr", "recall")) + f" FROM {_METRIC} GROUP BY ALL")
def _(spark, sf_dir):
    return rounded(metrics.pivoted(_metric(spark, sf_dir), ["p1", "p3", "mrr", "recall"]))


@query("multi_run_stats", f"SELECT stage, name, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM {_METRIC} GROUP BY ALL")
def _(spark, sf_dir):
    return rounded(metrics.multi_run(_metric(spark, sf_dir)))


_DOSE = f"(SELECT stage, dataset, name, CASE n_inst WHEN 'F' THEN 0.25 WHEN 'O' THEN 0.5 ELSE 1.0 END::DOUBLE AS fraction, value FROM {_METRIC})"


@query("dose_response", f"WITH e AS (SELECT dataset, stage, name, fraction, count(*) AS targets, avg(value) AS v FROM {_DOSE} GROUP BY ALL) SELECT e.dataset, e.stage, e.name, e.fraction, e.targets, round(e.v, 6) AS value, round(e.v - o.v, 6) AS change FROM e LEFT JOIN e o ON o.dataset = e.dataset AND o.stage = e.stage AND o.name = e.name AND o.fraction = 1.0")
def _(spark, sf_dir):
    """Statuses stand for fractions of rules."""
    fraction = F.when(F.col("n_inst") == "F", 0.25).when(F.col("n_inst") == "O", 0.5).otherwise(1.0)
    return rounded(metrics.dose_response(_metric(spark, sf_dir).withColumn("fraction", fraction)))


@query(
    "variants_with_fallback",
    f"""
WITH {_NATION_CELLS}, a AS (SELECT split_part(run_id, '|', 1) AS dataset, split_part(run_id, '|', 2) AS v, t_attr, s_attr, score FROM m),
s AS (SELECT dataset, CASE v WHEN 'F' THEN 'V0' WHEN 'O' THEN 'V1' ELSE 'V2' END AS variant, t_attr, s_attr, score FROM a WHERE NOT (v = 'P' AND dataset < '3'))
SELECT dataset, variant, used, t_attr, s_attr, score FROM (
  SELECT dataset, variant, variant AS used, t_attr, s_attr, score FROM s UNION ALL
  SELECT dataset, 'V2', 'V1', t_attr, s_attr, score FROM s WHERE variant = 'V1' AND dataset < '3' UNION ALL
  SELECT dataset, 'V5', 'V1', t_attr, s_attr, score FROM s WHERE variant = 'V1' AND dataset < '3')
""",
)
def _(spark, sf_dir):
    """Priorities stand for data sets, of which the first two have no INDs and lack a variant; statuses for variants."""
    sim, _, _ = _matches(spark, sf_dir)
    run = F.split("run_id", r"\|")
    v = F.when(run[1] == "F", "V0").when(run[1] == "O", "V1").otherwise("V2")
    sim = sim.select(run[0].alias("dataset"), F.lit("t").alias("target"), v.alias("variant"), "t_attr", "s_attr", "score").where("not (variant = 'V2' and dataset < '3')")
    wanted = sim.select("dataset", "target").distinct().withColumn("variant", F.explode(F.array(*map(F.lit, ("V0", "V1", "V2", "V5"))))).withColumn("no_ind", F.col("dataset") < "3")
    return metrics.with_fallback(sim, wanted, evaluate.FALLBACK).select("dataset", "variant", "used", "t_attr", "s_attr", "score")


@query("same_as_before", f"WITH {_NATION_CELLS} SELECT run_id, round(max(abs(score - coarse)), 6) AS off, max(abs(score - coarse)) <= 0.05 AS same FROM m GROUP BY run_id")
def _(spark, sf_dir):
    sim, coarse, _ = _matches(spark, sf_dir)
    return rounded(metrics.same(sim, coarse, 0.05))


@query(
    "signal_rankings",
    _SIGNALS
    + """, l AS (UNPIVOT (SELECT t_attr, s_attr, round(subset::DOUBLE, 6) AS subset, round(type::DOUBLE, 6) AS type, round(dist::DOUBLE, 6) AS dist, round(semantic::DOUBLE, 6) AS semantic, round(total::DOUBLE, 6) AS total FROM fin) ON subset, type, dist, semantic, total INTO NAME run_id VALUE score),
g AS (SELECT * FROM (VALUES (0, 0), (4, 5), (5, 6), (6, 1)) AS g(t, s)),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, t_attr ORDER BY score DESC, s_attr) AS k FROM l)
SELECT run_id, k::INTEGER AS k, round(avg(coalesce(p <= k, false)::INTEGER), 6) AS hit FROM (SELECT run_id, t_attr, min(r.k) AS p FROM r JOIN g ON t = t_attr AND s = s_attr GROUP BY ALL), (SELECT unnest([1, 3, 5]) AS k) GROUP BY ALL
""",
)
def _(spark, sf_dir):
    """Each signal by itself: how often the column that a sampled one was taken from ranks first."""
    sim = evaluate.signal_rankings(rounded(signals.score(*_signal_inputs(spark, sf_dir))))
    truth = sim.select("run_id").distinct().crossJoin(F.broadcast(values(spark, "t_attr int, s_attr int", (0, 0), (4, 5), (5, 6), (6, 1))))
    return rounded(metrics.hit_at_k(sim, truth))

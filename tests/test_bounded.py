"""Steps that must not hold in one task what grows with the table."""

import re
from itertools import takewhile

from schemaloom.operators import combine, validate


def lines(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def before_shuffle(df, keys):
    """Whether groups by these keys are held before the rows are dealt out by them."""
    own = [re.sub(r"#\d+L?", "", x) for x in lines(df)]
    depth = lambda x: re.search(r"[A-Za-z*]", x).start() if re.search(r"[A-Za-z*]", x) else 0
    dealt = [i for i, x in enumerate(own) if re.search(rf"Exchange hashpartitioning\({keys}, \d+\)", x)]
    assert dealt
    below = lambda i: takewhile(lambda x: depth(x) > depth(own[i]), own[i + 1 :])
    return any("Aggregate(keys=[i" in x for i in dealt for x in below(i))


def partitions(df, keys):
    return int(re.search(rf"Exchange hashpartitioning\({keys}, (\d+)\)", re.sub(r"#\d+L?", "", "\n".join(lines(df)))).group(1))


def test_fd_batch_deals_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(combine, "SHARE", 1000)
    df = spark.range(10_000).selectExpr("id AS a", "id % 7 AS b", "id * 2 AS c", "id % 7 + 1 AS d")
    got = validate.fd_batch(df, [(["a"], ["c"]), (["b"], ["c"]), (["b"], ["d"])])
    assert not before_shuffle(got, "i, k0, k1") and partitions(got, "i, k0, k1") == 30
    assert sorted(map(tuple, got.collect())) == [("a->c", True, 10_000, 0, 10_000), ("b->c", False, 7, 7, 10_000), ("b->d", True, 7, 0, 10_000)]


def test_ind_batch_deals_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(combine, "SHARE", 1000)
    r, s = spark.range(6_000).selectExpr("id AS x"), spark.range(4_000).selectExpr("id AS y")
    got = validate.ind_batch({"r": r, "s": s}, [("r", ["x"], "s", ["y"]), ("s", ["y"], "r", ["x"])])
    assert not before_shuffle(got, "i, k0, k1") and partitions(got, "i, k0, k1") == 20
    assert sorted(map(tuple, got.collect())) == [("r.x[=s.y", False, 2_000), ("s.y[=r.x", True, 0)]


def test_chunks_are_bounded():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([0] * 10)], ["k"]) for _ in range(25)]
    seen = []
    list(combine.chunks(lambda t: seen.append(t.num_rows) or t.slice(0, 1), size=100)(iter(batches)))
    assert seen == [100, 100, 50]


def test_profile_holds_no_column_in_a_task(spark, monkeypatch):
    from schemaloom.operators import profile

    monkeypatch.setattr(combine, "SHARE", 1000)
    df = spark.range(3_000).selectExpr("id AS a", "CASE WHEN id % 3 > 0 THEN id / 4D WHEN id % 2 = 0 THEN -0D ELSE double('nan') END AS x", "concat(' v', id) AS s")
    domain = profile._domain(df, "t")
    assert not before_shuffle(domain, "i, raw") and not before_shuffle(domain, "i, v") and partitions(domain, "i, raw") == 3
    got = {r["col"]: r for r in profile.profile_tables({"t": df}, exact=10, sample=5).collect()}
    assert [(c, got[c]["n_rows"], got[c]["n_unique"]) for c in "asx"] == [("a", 3_000, 3_000), ("s", 3_000, 3_000), ("x", 3_000, 2_001)]
    assert round(got["x"]["null_rate"] * 3_000) == 500 and got["x"]["num_min"] == 0.0 and got["a"]["num_p50"] == 1499.5
    import hashlib

    first = sorted((f"v{i}" for i in range(3_000)), key=lambda v: hashlib.md5(v.encode()).hexdigest())[:5]
    assert got["s"]["unique_vals"] == sorted(first)


def test_profile_sorts_no_values(spark):
    from schemaloom.operators import profile

    got = lines(profile.profile_tables({"t": spark.range(100).selectExpr("id AS a", "string(id) AS s")}))
    sorted_by = [x for x in got if "SortAggregate(key=[tbl" in x and "kind" in x]
    assert not sorted_by, sorted_by


def test_row_sample_orders_equal_keys(spark):
    from schemaloom.operators import sketch

    rows = [(7, f"v{i}") for i in range(50)]
    for own in (rows, rows[::-1]):
        got = sketch.row_sample(spark.createDataFrame(own, "id int, s string"), ["s"], ["id"], k=20).orderBy("place").collect()
        assert [r["v"] for r in got] == sorted((v for _, v in rows), reverse=True)[:20]


def test_quantity_sample_leaves_equal_keys_in_the_tables_order(spark, tmp_path):
    """Rows that share identity and quantity, in two files: smaller dates first for one key, greater first for the other."""
    from datetime import datetime

    from schemaloom.plans import catalogue

    days = [datetime(2001, 1, d) for d in (5, 9, 2, 7, 1)]
    for i, part in enumerate((days[:3], days[3:])):
        rows = [(1, 1, 30.0, d) for d in part] + [(2, 1, 30.0, d) for d in part[::-1]]
        df = spark.createDataFrame(rows, "l_orderkey int, l_linenumber int, l_quantity double, l_shipdate timestamp").coalesce(1)
        df.write.parquet(str(tmp_path / f"part{i}"))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"part{i}").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{i}.parquet")
    got = [r["v"][:10] for r in catalogue.QUERIES["row_weighted_sample_by_quantity"](spark, str(tmp_path)).orderBy("place").collect()]
    one, two = days, days[2::-1] + days[:2:-1]
    assert got in ([str(d)[:10] for d in first + second] for first, second in ((one, two), (two, one)))

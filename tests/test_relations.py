"""Relations in Spark against plain computations, and at sizes that a driver wouldn't take."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import Rows

from schemaloom.operators import mediator, profile, refine, remap, signals, sketch, validate, validity

CELLS = "case_id string, row_id int, t_attr int, raw string"
DEPS = "case_id string, kind string, place int, lhs array<int>, rhs array<int>, pattern array<struct<attr:int,value:string>>"


def cells_of(case, rows):
    return [(case, i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)]


def test_validity_by_loops(spark):
    rng = random.Random(2)
    cases = {c: [[rng.choice(["a", "b", "c", None, ""]) for _ in range(4)] for _ in range(n)] for c, n in (("x", 7), ("y", 3), ("z", 1))}
    asks = []
    for case in [*cases, "none"]:
        for x, y in itertools.permutations(range(4), 2):
            asks += [(case, "fd", [x], [y], []), (case, "ind", [x], [y], []), (case, "cfd", [x], [y], [(x, "a")]), (case, "cfd", [x], [y], [(x, "_"), (y, "b")])]
        asks += [(case, "fd", [0, 1], [2, 3], []), (case, "ind", [0, 1], [2, 3], []), (case, "fd", [1, 0], [3], []), (case, "fd", [0], [9], [])]
    target = spark.createDataFrame([c for case, rows in cases.items() for c in cells_of(case, rows)], CELLS).repartition(3)
    got = validity.relation(spark.createDataFrame(asks, validity.ASK), target, (0, 2)).collect()
    assert len(got) == 2 * len(asks)
    for r in got:
        own, pattern = cases.get(r["case_id"], []), [(e["attr"], e["value"]) for e in r["pattern"]]
        own = [[*row, *[None] * 6] for row in own]
        met = [row for row in own if all(v == "_" and row[i] is not None or row[i] == v or v == "_" for i, v in pattern)]
        groups = {}
        for row in met:
            groups.setdefault(tuple(row[i] for i in r["lhs"]), []).append(tuple(row[i] for i in r["rhs"]))
        if r["kind"] == "ind":
            want = {tuple(row[i] for i in r["lhs"]) for row in own} <= {tuple(row[i] for i in r["rhs"]) for row in own}
        else:
            want = (bool(groups) or not pattern) and all(len(set(g[: r["first_rows"] or None])) == 1 for g in groups.values())
        assert r["holds"] == want, r
        assert r["support"] == (None if r["kind"] == "ind" else max(map(len, groups.values()), default=0))


def test_runs_refine_as_by_hand(spark):
    """Several targets and configurations at once; the relation grows until nothing is asked."""
    rng = np.random.default_rng(5)
    fds, inds, cfds = [((0,), (1,)), ((0, 2), (3,))], [((1,), (4,)), ((0, 1), (2, 3))], [((0,), (3,), ((0, "1"),)), ((2,), (1,), ((1, "0"),))]
    deps, cells, scores, cases = [], [], [], {}
    for case in ("p", "q", "r"):
        m = np.round(rng.random((4, 5)), 1).tolist()
        rows = [[str(v) for v in r] for r in rng.integers(0, 3, (6, 4))]
        cases[case] = m, rows
        cells += cells_of(case, rows)
        scores += [(case, i, j, v) for i, r in enumerate(m) for j, v in enumerate(r)]
        for kind, own in (("fd", fds), ("ind", inds), ("cfd", cfds)):
            deps += [(case, kind, i, list(d[0]), list(d[1]), list(d[2]) if kind == "cfd" else []) for i, d in enumerate(own)]
    configs = {"all": refine.Config(), "every": refine.Config(dep_mode="every", max_iter=8), "first": refine.Config(first_rows=1, dep_mode="fd"), "fixed": refine.Config(dep_mode="every", fixed={"fd": 0.1})}
    runs = refine.runs(spark.createDataFrame(scores, "case_id string, t_attr int, s_attr int, score double"), spark.createDataFrame(deps, DEPS), configs)
    got = {}
    for r in refine.refine_runs(runs, spark.createDataFrame(cells, CELLS)).collect():
        got.setdefault(r["run_id"], np.zeros((4, 5)))[r["t_attr"], r["s_attr"]] = r["score"]
    assert set(got) == {f"{c}|{n}" for c in cases for n in configs}
    for name, m in got.items():
        case, config = name.split("|")
        want = refine.refine(cases[case][0], Rows(cases[case][1], configs[config].first_rows), fds, inds, configs[config], cfds)
        assert np.allclose(m, want), name


def test_validity_of_many_rows(spark):
    """100,000 target rows, one left side of which is the same in all rows, and a config that looks at first rows."""
    rows = spark.range(100_000).select(F.lit("t").alias("case_id"), F.col("id").alias("row_id"), *(x.cast("string").alias(str(i)) for i, x in enumerate((F.col("id"), F.col("id") % 1000, F.lit("same"), F.col("id") % 1000 % 10))))
    target = rows.unpivot(["case_id", "row_id"], list("0123"), "t_attr", "raw").withColumn("t_attr", F.col("t_attr").cast("int"))
    asks = [("t", "fd", [1], [3], []), ("t", "fd", [2], [1], []), ("t", "fd", [2, 1], [3], []), ("t", "ind", [1], [0], []), ("t", "ind", [0], [1], []), ("t", "cfd", [2], [3], [(1, "7")])]
    got = {(r["kind"], tuple(r["lhs"]), tuple(r["rhs"]), r["first_rows"]): (r["holds"], r["support"]) for r in validity.relation(spark.createDataFrame(asks, validity.ASK), target, (0, 1)).collect()}
    assert got["fd", (1,), (3,), 0] == (True, 100) and got["fd", (2,), (1,), 0] == (False, 100_000) and got["fd", (2,), (1,), 1] == (True, 100_000)
    assert got["fd", (2, 1), (3,), 0] == (True, 100) and got["ind", (1,), (0,), 0] == (True, None) and got["ind", (0,), (1,), 0] == (False, None)
    assert got["cfd", (2,), (3,), 0] == (True, 100)
    plan = validity.relation(spark.createDataFrame(asks, validity.ASK), target)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Python" not in plan and "BuildLeft" not in plan  # rows are never what is broadcast


def test_only_plain_scans_are_numbered(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 AS k").repartition(4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["row_gid"] for r in mediator.row_ids(df.select("k").where("k < 3"), offset=5).collect()) == list(range(5, 105))
    for other in (df.repartition(3), df.distinct(), df.join(df.withColumnRenamed("k", "j"), "id"), df.orderBy("id"), df.limit(7)):
        with pytest.raises(ValueError):
            mediator.row_ids(other)


# Remapping, closures, minimisation.


def test_assignments_are_products(spark):
    cand = [(0, 10), (0, 11), (0, 12), (1, 10), (2, 11), (2, 13)]
    deps = [(0, [0], [1]), (1, [0, 2], [0]), (2, [2], [2]), (3, [0], [9]), (4, [2, 0, 1], [0])]
    own = {a: sorted(t for s, t in cand if s == a) for a in range(10)}
    want = sorted((d, tuple(sorted(zip(attrs, pick)))) for d, x, y in deps for attrs in [list(dict.fromkeys(x + y))] for pick in itertools.product(*(own[a] for a in attrs)))
    out = remap.assignments(spark.createDataFrame(deps, "dep_id int, lhs array<int>, rhs array<int>"), spark.createDataFrame(cand, "s_attr int, t_attr int"))
    assert sorted((r["dep_id"], tuple(sorted(r["assign"].items()))) for r in out.collect()) == want


def test_remapping_plans_are_linear(spark):
    """A longer dependency makes no larger plan, and the query scans little."""
    from schemaloom.plans import catalogue

    cand = spark.createDataFrame([(i, 100 + i) for i in range(8)], "s_attr int, t_attr int")
    size = [remap.assignments(spark.createDataFrame([(0, list(range(k)), [7])], "dep_id int, lhs array<int>, rhs array<int>"), cand)._jdf.queryExecution().executedPlan().toString().count("\n") for k in (1, 6)]
    assert size[0] == size[1]
    plan = catalogue.QUERIES["mapped_fds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 15


def test_closures_by_loops(spark):
    rng = random.Random(8)
    fds = [(rng.sample(range(8), rng.randrange(1, 3)), rng.sample(range(8), rng.randrange(1, 3))) for _ in range(7)] + [([], [3])]
    frame = spark.createDataFrame(fds, "lhs array<int>, rhs array<int>")
    own = [validate.Dependency(tuple(a), tuple(b)) for a, b in fds]
    got = validate.keys(spark.createDataFrame([(i,) for i in range(8)], "attr int"), frame).collect()
    sets = {s for k in (1, 2, 3) for s in itertools.combinations(range(8), k)}
    whole = {s for s in sets if validate.is_superkey(s, range(8), own)}
    assert {tuple(r["start"]) for r in got} == sets
    for r in got:
        s = tuple(r["start"])
        assert set(r["closure"]) == validate.closure(s, own) and r["superkey"] == (s in whole)
        assert r["minimal"] == (s in whole and not any(tuple(x for x in s if x != a) in whole for a in s if len(s) > 1))
    chain = spark.createDataFrame([([i], [i + 1]) for i in range(30)], "lhs array<int>, rhs array<int>")
    assert validate.closures(spark.createDataFrame([([0],)], "start array<int>"), chain).first()["closure"] == list(range(31))
    none = spark.createDataFrame([], "lhs array<int>, rhs array<int>")
    assert validate.closures(spark.createDataFrame([([2, 1, 1],)], "start array<int>"), none).first()["closure"] == [1, 2]


def test_minimise_by_loops_and_many(spark):
    rng = random.Random(3)
    deps = {(tuple(rng.sample(range(6), rng.randrange(0, 4))), tuple(rng.sample(range(6), rng.randrange(0, 3)))) for _ in range(150)} | {((1, 1), (2,)), ((1,), (2,))}
    want = sorted(d for d in deps if not any(len(o[0]) < len(d[0]) and set(o[0]) <= set(d[0]) and set(d[1]) <= set(o[1]) for o in deps))
    frame = spark.createDataFrame([(list(a), list(b)) for a, b in deps], "lhs array<int>, rhs array<int>")
    assert sorted((tuple(r["lhs"]), tuple(r["rhs"])) for r in validate.minimise(frame).collect()) == want
    # Pairs of attributes that one of the pair alone determines in a tenth of the cases.
    many = spark.range(100_000).select(F.array(F.col("id") % 1000, 1000 + F.col("id")).cast("array<int>").alias("lhs"), F.array((F.col("id") % 7).cast("int")).alias("rhs"))
    small = spark.range(1000, 11_000).select(F.array(F.col("id").cast("int")).alias("lhs"), F.array(((F.col("id") - 1000) % 7).cast("int")).alias("rhs"))
    began = time.time()
    assert validate.minimise(many.union(small)).count() == 100_000 and time.time() - began < 60


# Profiles.


def odd_table(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, rng.random() * 100 if i % 11 else None, rng.choice(["x", "y", " z ", "", "NA", None]), str(rng.randrange(5000)), f"name {i % 700}", bool(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "i int, d double, s string, t string, u string, b boolean")


def test_merged_states_are_those_of_the_whole(spark):
    df = odd_table(spark).repartition(5)
    whole = sketch.states(df, "t")
    parts = [df.where(F.pmod("i", F.lit(3)) == k) for k in range(3)]
    merged = sketch.merged(sketch.states(parts[0], "t").unionByName(sketch.states(parts[1], "t")).unionByName(sketch.states(parts[2], "t")))
    drop = ("num_p25", "num_p50", "num_p75")
    own, other = sketch.finished(whole).orderBy("col").collect(), sketch.finished(merged).orderBy("col").collect()
    plain = lambda r: {k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items() if k not in drop}
    assert [plain(r) for r in own] == [plain(r) for r in other]
    exact = {r["col"]: r for r in profile.profile_tables({"t": df}).collect()}
    assert set(exact) == {r["col"] for r in own}
    for rows in (own, other):
        for r in rows:
            e = exact[r["col"]]
            for c in ("dtype", "n_rows", "null_rate", "num_min", "num_max", "str_avg_len", "str_char_class", "exact_unique", "unique_vals"):
                assert r[c] == pytest.approx(e[c]) if isinstance(e[c], float) else r[c] == e[c], (r["col"], c)
            assert abs(r["n_unique"] - e["n_unique"]) <= (0 if e["exact_unique"] else 0.05 * e["n_unique"])
            if e["num_p50"] is not None:
                x = sorted(float(v["x"]) for v in df.select(F.col(r["col"]).cast("double").alias("x")).where("x is not null").collect())
                for q, c in zip((0.25, 0.5, 0.75), drop):
                    assert np.searchsorted(x, r[c], "left") / len(x) <= q + 0.01 and np.searchsorted(x, r[c], "right") / len(x) >= q - 0.01
    empty = sketch.profile_sketched({"e": df.limit(0)}).collect()
    assert {r["col"] for r in empty} == set(exact) and all(r["n_rows"] == 0 and r["n_unique"] == 0 and r["unique_vals"] == [] for r in empty)


def test_samples_are_weighted_by_rows(spark):
    """Of values with 1, 9 and 90 % of the rows, and with weights instead of rows."""
    rows = spark.range(200_000).select("id", F.when(F.col("id") % 100 < 1, "rare").when(F.col("id") % 100 < 10, "some").otherwise("often").alias("v"), F.when(F.col("id") % 100 < 1, 99.0).otherwise(1.0).alias("w"), F.lit(0).alias("zero"))
    share = lambda df: {r["v"]: r["count"] / 4000 for r in df.groupBy("v").count().collect()}
    got = share(sketch.row_sample(rows, ["v"], ["id"], 4000))
    assert abs(got["rare"] - 0.01) < 0.006 and abs(got["some"] - 0.09) < 0.018 and abs(got["often"] - 0.9) < 0.02
    heavy = share(sketch.row_sample(rows, ["v"], ["id"], 4000, weight="w"))
    assert abs(heavy["rare"] - 0.5) < 0.35 and heavy["rare"] > 0.2  # 2,000 rare rows have half the weight, and run out
    again = sketch.row_sample(rows.repartition(7), ["v"], ["id"], 50)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sketch.row_sample(rows, ["v"], ["id"], 50).collect()))
    # The sample of the whole is drawn from those of the parts.
    parts = [rows.where(f"id % 2 = {k}") for k in (0, 1)]
    ids = lambda df: {r["v"] for r in sketch.row_sample(df.withColumn("x", F.col("id").cast("string")), ["x"], ["id"], 50).collect()}
    assert ids(rows) <= ids(parts[0]) | ids(parts[1])
    assert sketch.row_sample(rows, ["v"], ["id"], 5, weight="zero").count() == 0
    drawn = sketch.profile_sketched({"t": rows.withColumn("x", F.col("id").cast("string"))}, identity={"t": ["id"]}).where("col = 'x'").first()
    assert len(drawn["unique_vals"]) == 200 and not drawn["exact_unique"]


def test_quantiles_outside_a_wrong_bracket(spark, monkeypatch):
    """Where a sketch errs by more than its bracket, the column is ranked."""
    monkeypatch.setattr(profile, "_edges", lambda x: F.array(*(F.min(x) * 0 + v for v in (5.0, 6.0, 5.0, 6.0, 5.0, 6.0))))
    x = np.round(np.random.default_rng(1).random(500) * 100, 3)
    r = profile.profile_tables({"t": spark.createDataFrame([(float(v),) for v in x], "d double").repartition(3)}).first()
    assert np.allclose([r["num_p25"], r["num_p50"], r["num_p75"]], np.quantile(x, [0.25, 0.5, 0.75]))


# Edit similarity.


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_best_similarity_by_loops(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdé日 ") for _ in range(n))
    values = [(s, word(rng.randrange(0, 24))) for s in range(3) for _ in range(25)] + [(3, "x" * 90), (3, None)]
    own = {word(rng.randrange(0, 24)) for _ in range(40)} | {"", "x", "x" * 300, values[0][1], values[7][1]}
    got = signals.best_similarity(spark.createDataFrame([(a,) for a in own for _ in range(2)], "a string"), spark.createDataFrame(values + values[:9], "s_attr int, b string")).collect()
    want = {}
    for a in own:
        for s, b in values:
            if b is not None:
                want[a, s] = max(want.get((a, s), 0.0), 1 - plain_distance(a, b) / max(len(a), len(b), 1))
    assert {(r["a"], r["s_attr"]): pytest.approx(r["best"]) for r in got} == want and len(got) == len(want)
    assert signals.best_similarity(spark.createDataFrame([("a",)], "a string"), spark.createDataFrame([], "s_attr int, b string")).count() == 0


def test_best_similarity_of_many_values(spark):
    own = spark.range(100_000).select(F.concat(F.lit("customer "), F.format_string("%06d", "id")).alias("a"))
    values = spark.range(300).select((F.col("id") % 2).cast("int").alias("s_attr"), F.concat(F.lit("customer "), F.format_string("%06d", F.col("id") * 331)).alias("b"))
    began = time.time()
    got = signals.best_similarity(own, values)
    assert got.count() == 200_000 and got.where("best = 1").count() == 300 and time.time() - began < 120
    assert got.agg(F.min("best")).first()[0] >= 1 - 6 / 15

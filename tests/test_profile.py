import numpy as np
import pytest
from pyspark.sql import functions as F

from featureflow.config import Config
from featureflow.operators.categories import category_ratios, category_stats
from featureflow.operators.derive import derive
from featureflow.operators.joins import attach_columns, lookup
from featureflow.operators.profile import Profile, normal_or_log, profile


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(i, *[None if c[i] is None else float(c[i]) for c in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in columns))


def test_every_branch(spark):
    n = 400
    rng = np.random.default_rng(0)
    columns = {
        "plain": [i % 4 for i in range(n)],
        "rare": [i % 4 if i > 1 else 90 + i for i in range(n)],
        "lopsided": [0 if i > 20 else 3 for i in range(n)],
        "outliers": rng.exponential(size=n),
        "flat": [(i % 7) + 0.25 for i in range(n)],
        "zeros": [0] * n,
        "constant": [0.25] * n,
    }
    train, test = frame(spark, **columns), frame(spark, **columns)
    found = profile(train, test, list(columns))
    kinds = {p.column_name: p.kind for p in found.columns}
    assert kinds == {
        "plain": "cat", "rare": "trunc_cat", "lopsided": "binarized", "outliers": "state",
        "flat": "N", "zeros": "cat", "constant": "LN",
    }
    assert found["rare"].rare == (90.0, 91.0) and found["rare"].replacement == 90.5
    out = derive(test, found, "test", ["id"])
    assert out.columns == [
        "id", "plain_cat", "rare_trunc_cat", "lopsided_binarized", "outliers_state", "outliers_st_inter",
        "flat_N", "zeros_cat", "constant_LN",
    ]
    rows = out.orderBy("id").collect()
    x = np.array(columns["outliers"])
    state = np.where(abs((x - x.mean()) / x.std(ddof=1)) >= 1.645, np.sign(x - x.mean()), 0)
    assert [r["outliers_state"] for r in rows] == list(state)
    assert [r["outliers_st_inter"] for r in rows] == pytest.approx(list(np.where(state == 0, x, 0)))
    assert [r["rare_trunc_cat"] for r in rows][:3] == [90.5, 90.5, 2.0]
    used = {r["derived_name"]: r["used"] for r in found.usage(spark).collect()}
    assert used["rare_trunc_cat"] and not used["rare_cat"] and not used["lopsided_categorical"]


def test_derivation_is_one_projection(spark):
    df = frame(spark, a=[1, 2, 3, 4], b=[0.25, 1.3, 2.77, 9.11])
    out = derive(df, profile(df, df, ["a", "b"]), "train", ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_each_table_uses_its_own_statistics(spark):
    rng = np.random.default_rng(1)
    a, b = rng.exponential(size=300), rng.exponential(size=200) * 10 + 5
    found = profile(frame(spark, x=a), frame(spark, x=b), ["x"])
    rows = derive(frame(spark, x=b), found, "test", ["id"]).orderBy("id").collect()
    z = (b - b.mean()) / b.std(ddof=1)
    assert [r["x_state"] for r in rows] == list(np.where(abs(z) >= 1.645, np.sign(z), 0))


def test_ratio_at_the_threshold_is_rare(spark):
    df = spark.createDataFrame([(1.0, 10_000), (2.0, 100), (3.0, 101)], "v double, n int")
    df = df.select("v", F.explode(F.sequence(F.lit(1), F.col("n"))))
    stats, rare = category_stats(df, ["v"], {"train": F.lit(True), "test": F.lit(False)}, 0.01)
    assert stats["v"].rare == (2.0,) and stats["v"].n_distinct == 3
    assert [r["value"] for r in rare.collect()] == [2.0]


def test_long_rare_lists_stay_distributed(spark):
    values = [i % 3 for i in range(600)] + [100 + i for i in range(40)]
    df = frame(spark, v=values + [None])
    short = profile(df, df, ["v"])
    long = profile(df, df, ["v"], Config(inline_rare=5))
    assert len(short["v"].rare) == 40 and long["v"].rare == () and long["v"].n_rare == 40
    a = derive(df, short, "train", ["id"]).orderBy("id").collect()
    b = derive(df, long, "train", ["id"]).orderBy("id").collect()
    assert a == b and a[-1]["v_trunc_cat"] is None


def test_lookup_with_hot_values_and_nulls(spark):
    keys = [7] * 500 + [None] * 300 + list(range(1000, 1800))
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k int")
    right = spark.createDataFrame([(7, "hot")] + [(k, str(k)) for k in range(1000, 1500)], "k int, s string")
    want = sorted(map(tuple, lookup(df, "k", right).select("i", "k", "s").collect()), key=lambda r: r[0])
    got = lookup(df, "k", right, small_rows=10).select("i", "k", "s")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert len(want) == len(keys)
    plain = attach_columns(df, right, "k").select("i", "k", "s").collect()
    marked = attach_columns(df, right, "k", hot_keys=True).select("i", "k", "s").collect()
    assert set(map(tuple, plain)) == set(map(tuple, marked)) == set(want)


def test_mismatches(spark):
    a = frame(spark, v=[1, 1, 2, 2])
    b = frame(spark, v=[1, 2, 3, 3])
    report = profile(a, b, ["v"]).report(spark).collect()
    assert [(r["column_name"], r["kind"]) for r in report] == [("v", "category")]
    same = profile(a, a, ["v"]).report(spark)
    assert same.count() == 0


def test_stored_profile_gives_the_same_columns(spark, tmp_path):
    rng = np.random.default_rng(4)
    df = frame(spark, x=rng.normal(size=200), c=[i % 5 for i in range(198)] + [40, 41])
    found = profile(df, df, ["x", "c"], Config(category_trunc_threshold=0.05))
    path = str(tmp_path / "profile")
    found.to_frame(spark).write.parquet(path)
    again = Profile.from_frame(spark.read.parquet(path))
    key = lambda r: r["id"]
    want = sorted(derive(df, found, "train", ["id"]).select("id", "x_state", "c_trunc_cat").collect(), key=key)
    got = sorted(derive(df, again, "train", ["id"]).select("id", "x_state", "c_trunc_cat").collect(), key=key)
    assert want == got


def test_ties_go_to_log_normal(spark):
    assert normal_or_log(0.7, 0.7) == "log-normal"
    assert normal_or_log(0.7 + 1e-12, 0.7) == "log-normal"
    assert normal_or_log(0.9, 0.7) == "normal"
    assert normal_or_log(None, None) == "log-normal"
    two = frame(spark, x=[0.25, 0.75] * 20)
    assert profile(two, two, ["x"])["x"].choice == "log-normal"


def test_ratios_count_train_only(spark):
    df = spark.createDataFrame([("train", 1.0)] * 4 + [("train", 2.0), ("test", 3.0)], "name string, v double")
    flags = {p: F.col("name") == p for p in ("train", "test")}
    got = {r["value"]: (r["n_train"], r["n_test"], r["ratio"]) for r in category_ratios(df, ["v"], flags).collect()}
    assert got == {1.0: (4, 0, 1.0), 2.0: (1, 0, 0.25), 3.0: (0, 1, None)}


@pytest.mark.parametrize("values", [[3.4567], [2.5432, 2.5432], [1.2345, 3.4567]])
def test_sides_without_a_defined_shape_get_the_moments_of_what_is_derived(spark, values):
    train = spark.createDataFrame([(i, 0.0, 1.0 + float(np.exp(0.013 * i)) + 0.0001) for i in range(300)], "id long, label double, x double")
    test = spark.createDataFrame([(1000 + i, v) for i, v in enumerate(values)], "id long, x double")
    config = Config(log_eps=0.01)
    found = profile(train, test, ["x"], config)
    p = found["x"]
    rows = sorted(derive(test, found, "test", ["id"], config).collect())
    logs = [np.log(v - min(values) + 0.01) if p.choice != "normal" else v for v in values]
    assert p.mean_test == pytest.approx(np.mean(logs))
    if len(set(values)) > 1:
        assert p.sd_test == pytest.approx(np.std(logs, ddof=1))
    else:
        assert ("constant", "test does not vary") in p.mismatches()
    if p.kind == "state":
        assert [r.x_state for r in rows] == [0.0] * len(values)
        assert [r.x_st_inter for r in rows] == pytest.approx(logs)


def test_a_stored_profile_keeps_long_lists_of_rare_values(spark, tmp_path):
    rows = [(i, float(i % 3)) for i in range(3000)] + [(9000 + i, 100.0 + i) for i in range(20)]
    table = spark.createDataFrame(rows, "id long, c double")
    short, long = (profile(table, table, ["c"], Config(inline_rare=n)) for n in (1000, 2))
    assert short["c"].kind == "trunc_cat" and long["c"].long_list() and not short["c"].long_list()
    want = sorted(derive(table, short, "train", ["id"]).collect())
    assert sorted(derive(table, long, "train", ["id"]).collect()) == want
    long.write(spark, str(tmp_path / "p"))
    stored = Profile.read(spark, str(tmp_path / "p"))
    assert stored.columns == long.columns
    assert sorted(derive(table, stored, "train", ["id"]).collect()) == want
    with pytest.raises(ValueError, match="rare values of c"):
        derive(table, Profile.from_frame(long.to_frame(spark)), "train", ["id"])

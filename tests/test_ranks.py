import numpy as np
import pytest
from pyspark.sql import functions as F

from featureflow.operators import ranks
from featureflow.operators.ranks import (
    bucket_count,
    number_sorted,
    ordered_counts,
    read_numbered,
    with_row_num,
)


@pytest.mark.parametrize("per_bucket", [10**6, 100, 7])
def test_ordered_counts_of_skewed_columns(spark, per_bucket):
    rng = np.random.default_rng(1)
    a = np.where(rng.random(2000) < 0.4, 5.0, rng.integers(0, 300, 2000).astype(float))
    b = rng.normal(size=2000)
    rows = [(float(p), None if i % 50 == 0 else float(q), i % 3 == 0) for i, (p, q) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, third boolean")
    flags = {"third": F.col("third"), "rest": ~F.col("third")}
    got = ordered_counts(df, ["a", "b"], flags, 2000, per_bucket).collect()
    for item, column in enumerate(("a", "b")):
        for flag, chosen in (("third", True), ("rest", False)):
            xs = [r[item] for r in rows if r[2] == chosen and r[item] is not None]
            upto = 0
            for r in sorted((g for g in got if g["item"] == item), key=lambda g: g["value"]):
                assert r[f"n_{flag}"] == xs.count(r["value"])
                upto += r[f"n_{flag}"]
                assert r[f"upto_{flag}"] == upto
            assert upto == len(xs)


def test_bucket_count():
    assert bucket_count(0) == 1
    assert bucket_count(2_000_001) == 2
    assert bucket_count(10**15) == 20_000


@pytest.mark.parametrize("per_bucket", [10**6, 50])
def test_row_num_is_dense_and_ordered(spark, per_bucket):
    keys = np.random.default_rng(3).permutation(1000) * 17 - 4000
    df = spark.createDataFrame([(int(k), str(k)) for k in keys], "k bigint, v string").repartition(5)
    got = with_row_num(df, "k", rows_per_bucket=per_bucket)
    assert got.columns == ["k", "v", "row_num"]
    rows = sorted(got.collect(), key=lambda r: r["k"])
    assert [r["row_num"] for r in rows] == list(range(1000))


def test_row_num_by_time_and_text_and_not_by_truth(spark):
    df = spark.range(20).select(F.timestamp_seconds(F.lit(100) - F.col("id")).alias("at"), F.col("id").cast("string").alias("s"))
    rows = with_row_num(df, "at", rows_per_bucket=4).orderBy("row_num").collect()
    assert [r["s"] for r in rows] == [str(i) for i in range(19, -1, -1)]
    rows = with_row_num(df, "s", rows_per_bucket=4).orderBy("row_num").collect()
    assert [r["s"] for r in rows] == sorted(map(str, range(20)))
    with pytest.raises(TypeError):
        with_row_num(df.withColumn("yes", F.col("s") == "1"), "yes")
    assert with_row_num(df.filter("false"), "at").count() == 0


def test_file_numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 4).write.parquet(path)
    rows = read_numbered(spark, path).orderBy("row_num").collect()
    assert [r["row_num"] for r in rows] == list(range(1000))
    # Rows of one file stay together and in order.
    ids = [r["id"] for r in rows]
    assert sum(b != a + 1 for a, b in zip(ids, ids[1:])) <= 3


def test_sorted_numbers_of_text(spark):
    words = [f"w{i % 7}-{i}" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(6)
    rows = number_sorted(df, [F.desc("w")]).collect()
    assert [r["w"] for r in sorted(rows, key=lambda r: r["row_num"])] == sorted(words, reverse=True)
    assert sorted(r["row_num"] for r in rows) == list(range(300))


@pytest.mark.parametrize("rows_per_bucket", [2_000_000, 7])
def test_row_numbers_refuse_null_keys_at_every_size(spark, rows_per_bucket):
    rows = spark.createDataFrame([(i if i != 50 else None,) for i in range(100)], "k long")
    with pytest.raises(ValueError, match="1 rows have no k"):
        with_row_num(rows, "k", rows_per_bucket=rows_per_bucket)


@pytest.mark.parametrize("most", [2, 5, 20_000])
def test_results_do_not_depend_on_the_number_of_borders(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "MAX_BUCKETS", most)
    values = [float((i * 37) % 101) ** 2 for i in range(400)]
    rows = spark.createDataFrame([(v, i * 3 - 50) for i, v in enumerate(values)], "x double, k long")
    got = {r.value: (r.n_all, r.upto_all) for r in ranks.ordered_counts(rows, ["x"], {"all": F.lit(True)}, 400, 10).collect()}
    assert got == {v: (values.count(v), sum(x <= v for x in values)) for v in set(values)}
    numbered = with_row_num(rows, "k", rows_per_bucket=10).collect()
    assert all(r.row_num == (r.k + 50) // 3 for r in numbered)

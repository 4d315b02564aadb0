"""Centroid clustering against plain rounds in Python integers, and the geometry of its bounds."""

import hashlib
import random

import brute
import numpy as np
import pytest
from featureflow.llm import clustering, queries


def rounds(rows, clusters=8, turns=10, scale=1024, seed=3):
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of (id, components) rows."""
    whole = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows]
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centroids = [[int(np.floor(scale * x)) for x in v] for _, v in first]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(turns):
        groups = {}
        for _, v in whole:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centroids)]
    told = [(i, *nearest(v)[::-1]) for i, v in whole]
    inertia = {k: sum(d for _, c, d in told if c == k) for k in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in told), key=str)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_query_against_plain_python(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{brute.FOLDER}/embeddings.parquet").collect()]
    got = queries.op12_centroids(spark, brute.FOLDER)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found(got) == rounds(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_ties_repeats_and_small_blocks(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, i, i // 3]), [r.randint(-4, 4) / 1024 for _ in range(3)]) for i in range(400)] + [(7, [0.0, 0.0, 0.0])] * 50
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    fitted = clustering.fit(frame, 3, block=16)
    assert found(fitted.rows("vec_id")) == rounds(rows)


def test_odd_vectors_and_columns(spark):
    schema = "id int, v array<float>, cluster string, block int, vectors string"
    good = [(5, [1.0, -0.5], "x", 1, "y"), (6, [1.0, 2.0], None, None, None), (6, [1.0, 2.0], None, None, None), (None, [0.0, 0.0], None, None, None)]
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (7, [1.0, float("nan")]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(good + [(i, v, "", 0, "") for i, v in odd], schema)
    got = clustering.cluster(frame, 2, "id", "v")
    assert got.columns[0] == "id" and found(got) == rounds([(i, v) for i, v, *_ in good])
    none = clustering.cluster(frame.where("id = 1"), 2, "id", "v")
    assert none.columns == got.columns and none.count() == 0
    with pytest.raises(Exception, match="long"):
        clustering.cluster(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), 1).collect()


def test_no_point_of_the_sphere_comes_nearer_than_the_loosening():
    r = np.random.default_rng(5)
    tightened = full = 0
    for _ in range(300):
        size = int(r.integers(2, 6))
        old = r.normal(size=(4, size)) * r.choice([1, 10])
        new = old + r.normal(size=(4, size)) * r.choice([0.01, 0.3, 3], (4, 1))
        new[0] = old[0] if r.random() < 0.2 else new[0]
        radius = r.exponential(1.0, 4) * r.choice([0.01, 1, 20])
        bound = clustering.loosening(old, new, radius)
        for a in range(4):
            points = r.normal(size=(2000, size))
            points *= (radius[a] * r.random((2000, 1)) ** 0.2) / np.linalg.norm(points, axis=1, keepdims=True)
            points += old[a]
            others = [j for j in range(4) if j != a]
            shrinks = np.stack([np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1) for j in others])
            assert shrinks.max() <= bound[a] + 1e-9
            tightened += bound[a]
            full += max(np.linalg.norm(new[j] - old[j]) for j in others)
    assert tightened < 0.95 * full


def test_few_vectors_are_scanned(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(8, 16)) * 3
    rows = [(i, (centres[i % 8] + r.normal(size=16)).tolist()) for i in range(4000)]
    fitted = clustering.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 16, block=512)
    assert fitted.scanned[0] == 4000 and sum(fitted.scanned[1:]) < 0.6 * 4000 * 10
    assert found(fitted.rows("vec_id")) == rounds(rows)


def test_blocks_stay_where_they_are(spark):
    frame = spark.read.parquet(f"{brute.FOLDER}/embeddings.parquet")
    fitted = clustering.fit(frame, 64, rounds=1)
    with clustering._in_place(spark):
        joined = clustering._joined(fitted.blocks, fitted.state)
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange") == 1, plan

"""Centroid clustering of integer vectors with geometric drift tightening: exact rounds that scan few vectors.

Every vector holds its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to
every other one. After centroids have moved, the upper bound grows by the full drift of its own centroid, but the lower
bound is loosened by less than the full drift of the others: the vectors of a cluster in a block lie in a sphere about
the old centroid, and for a point x of it, a centroid that moves from p to q comes nearer by at most
|q - p| cos(phi), phi being the angle at the midpoint of p and q between q - p and x (from
|x - p| - |x - q| = 2 (x - m)(q - p) / (|x - p| + |x - q|) and |x - p| + |x - q| >= 2 |x - m|). In the plane through
p, q and the centre of the sphere the least such angle is the centre's less that of the tangent. Vectors whose
bounds do not part are scanned exactly, in integers; the others cannot have changed, ties included.

Vectors are packed into blocks once. A round joins the blocks, which stay where they are, with their state (a few bytes
a vector), works every block by numpy and adds up its sums; the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featureflow.sources.storage import checkpointed

CLUSTERS, ROUNDS, SCALE, SEED = 8, 10, 1024, 3
# Vectors of one block.
BLOCK = 4096
# Blocks of one partition, about.
BLOCKS_TOGETHER = 64
# Components up to this have squared distances that fit a long, up to 512 of them.
LARGEST = 1 << 26
# Bounds are held wider than they are by this share, far above what doubles and angles near the tangent lose.
SLACK = 1e-6

PACKED = "ids binary, nulls binary, vectors binary"
STATE = "block long, clusters binary, upper binary, lower binary, sums binary, counts array<long>, scanned long"


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the distance to any other centroid may shrink, for the vectors of each cluster: within `radius` of its old centroid."""
    drift = np.linalg.norm(new - old, axis=1)
    to_middle = (old + new) / 2 - old[:, None, :]  # from cluster a's old centroid to the midpoint of centroid j's move
    far = np.linalg.norm(to_middle, axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        toward = -np.einsum("ajd,jd->aj", to_middle, new - old) / (far * drift)
        angle = np.arccos(np.clip(toward, -1, 1)) - np.arcsin(np.clip(radius[:, None] / far, 0, 1))
    # no angle is known inside the sphere's own reach; beyond a right angle the centroid only moves away
    angle = np.where((far > radius[:, None]) & np.isfinite(angle), np.clip(angle, 0, np.pi / 2), 0)
    nearer = np.where(drift > 0, drift * np.cos(angle), 0)
    np.fill_diagonal(nearer, 0)
    return nearer.max(axis=1) * (1 + SLACK) + SLACK


def _squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def assign(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of several), and bounds of the distance to it and to all others."""
    found = _squares(vectors, centroids)
    nearest = found.argmin(axis=1)
    rows = np.arange(len(vectors))
    upper = np.sqrt(found[rows, nearest].astype(float))
    rest = found.astype(float)
    rest[rows, nearest] = np.inf
    return nearest.astype(np.int32), upper, np.sqrt(rest.min(axis=1))


def moved(vectors: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray], old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The state after the centroids moved, and how many vectors were scanned."""
    nearest, upper, lower = (x.copy() for x in state)
    radius = np.zeros(len(old))
    np.maximum.at(radius, nearest, upper)
    a, b = old.astype(float), new.astype(float)
    lower -= loosening(a, b, radius * (1 + SLACK) + SLACK)[nearest]
    upper += np.linalg.norm(b - a, axis=1)[nearest]
    unclear = np.nonzero(upper * (1 + SLACK) + SLACK >= lower)[0]
    own = ((vectors[unclear] - new[nearest[unclear]]) ** 2).sum(axis=1)
    upper[unclear] = np.sqrt(own.astype(float))
    unclear = unclear[upper[unclear] * (1 + SLACK) + SLACK >= lower[unclear]]
    nearest[unclear], upper[unclear], lower[unclear] = assign(vectors[unclear], new)
    return nearest, upper, lower, len(unclear)


def _matrix(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, size).astype(np.int64)


def _packer(size: int, scale: int, block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kept, held = [], [], 0

        def packed() -> pa.RecordBatch:
            told = np.concatenate(ids)
            missing = np.array([x is None for x in told])
            named = np.array([0 if x is None else x for x in told], "<i8")
            row = [named.tobytes(), missing.tobytes(), np.concatenate(kept).astype("<i4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["ids", "nulls", "vectors"])

        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size) if len(lists) else np.zeros((0, size))
            with np.errstate(over="ignore"):
                whole = np.floor(flat * scale)
            if len(whole) and np.abs(whole).max() > LARGEST:
                raise ValueError(f"a component exceeds {LARGEST} after scaling, so squared distances would not fit a long")
            ids.append(np.array(batch.column("id").to_pylist(), object))
            kept.append(whole.astype(np.int64))
            held += len(whole)
            if held >= block:
                yield packed()
                ids, kept, held = [], [], 0
        if held:
            yield packed()

    return pack


def _worker(size: int, old: np.ndarray | None, new: np.ndarray):
    """One round over blocks with their state: without old centroids every vector is scanned."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                vectors = _matrix(row["vectors"], size)
                if old is None or row["clusters"] is None:
                    nearest, upper, lower = assign(vectors, new)
                    scanned = len(vectors)
                else:
                    state = np.frombuffer(row["clusters"], "<i4"), np.frombuffer(row["upper"], "<f8"), np.frombuffer(row["lower"], "<f8")
                    nearest, upper, lower, scanned = moved(vectors, state, old, new)
                sums = np.zeros((len(new), size), np.int64)
                np.add.at(sums, nearest, vectors)
                out.append((row["block"], nearest.astype("<i4").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes(),
                            sums.astype("<i8").tobytes(), np.bincount(nearest, minlength=len(new)).tolist(), scanned))
            columns = zip(*out) if out else [[]] * 7
            types = [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in STATE.split(", ")])

    return work


def _told(size: int, centroids: np.ndarray):
    """(id, cluster, distance) of every vector, distances exact."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors, nearest = _matrix(row["vectors"], size), np.frombuffer(row["clusters"], "<i4")
                ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["nulls"], bool))
                distance = ((vectors - centroids[nearest]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(nearest, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return tell


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _in_place(spark: SparkSession):
    """Within it, a join never sends one side to all: blocks dealt out by their number stay where they are."""
    return _set(spark, "spark.sql.autoBroadcastJoinThreshold", "-1")


def _added(state: DataFrame, count: int, size: int) -> tuple[list[list[int]], list[int], int]:
    """Sums and counts of each cluster over all blocks, and scanned vectors; sums are exact beyond a long."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sums = np.frombuffer(row["sums"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["place", "part"])

    parts = state.select("sums").mapInArrow(unpacked, "place long, part long")
    added = {r.place: int(r.whole) for r in parts.groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("whole")).collect()}
    counts = state.agg(*[F.sum(F.get("counts", F.lit(c))).alias(f"n{c}") for c in range(count)], F.sum("scanned").alias("scanned")).first()
    return [[added[c * size + d] for d in range(size)] for c in range(count)], [int(counts[c]) for c in range(count)], int(counts["scanned"])


class Clustering:
    """Blocks, their last state and the centroids of every round; `rows()` has one row per vector.

    `scanned` lists how many vectors each assignment scanned: all in the first, those with unclear bounds afterwards.
    """

    def __init__(self, blocks: DataFrame, state: DataFrame, centroids: list[np.ndarray], scanned: list[int], size: int):
        self.blocks, self.state, self.centroids, self.scanned, self.size = blocks, state, centroids, scanned, size

    def rows(self, vec_id: str) -> DataFrame:
        """vec_id, cluster, squared distance, cluster_inertia, inertia and centroid_sha256 of every vector."""
        last = self.centroids[-1]
        with _in_place(self.blocks.sparkSession):
            told = checkpointed(_joined(self.blocks, self.state).mapInArrow(_told(self.size, last), "id long, cluster int, distance long"))
        each = {r.cluster: int(r.whole) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("whole")).collect()}
        whole = sum(each.values())
        pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("cluster"))
        hashes = {c: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for c, row in enumerate(last)}
        return told.select(
            F.col("id").alias(vec_id), "cluster", "distance", pick(each or {0: 0}).cast("long").alias("cluster_inertia"),
            F.lit(whole).cast("long").alias("inertia"), pick(hashes).alias("centroid_sha256"),
        )


def _joined(blocks: DataFrame, state: DataFrame | None) -> DataFrame:
    if state is None:
        return blocks.select("block", "ids", "nulls", "vectors", *(F.lit(None).cast("binary").alias(c) for c in ("clusters", "upper", "lower")))
    return blocks.join(state.select("block", "clusters", "upper", "lower").hint("shuffle_hash"), "block")


def _started(kept: DataFrame, clusters: int, scale: int, seed: int) -> list[list[int]]:
    """The first centroids: vectors by the sha256 of `seed:id`, then by components; a null id counts as none."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    return [np.floor(np.array(r.v, float) * scale).astype(np.int64).tolist() for r in rows]


def fit(vectors: DataFrame, size: int, vec_id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
        scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> Clustering | None:
    """Cluster the vectors of exactly `size` components, none null or non-finite; None if there is none.

    A component x becomes floor(scale x). The first centroids are the vectors with the least sha256 of `seed:id` (fewer, if
    there are fewer vectors; repeated rows may give equal ones, of which the smaller number wins). Each round assigns
    every vector to the nearest centroid and moves every centroid that has vectors to floor(sum / count). A null id stays null;
    repeated rows are clustered as often as they occur; other columns are not read. Components beyond LARGEST raise an
    error, since their squared distances do not fit a long.
    """
    double = F.col(vector).cast("array<double>")
    whole = F.size(F.col(vector)) == size
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(vec_id).cast("long").alias("id"), F.when(whole & finite, double).alias("v")).where("v IS NOT NULL")
    first = _started(kept, clusters, scale, seed)
    if not first:
        return None
    spark = vectors.sparkSession
    # the block numbers are fixed by the first checkpoint, their places by the second
    packed = checkpointed(kept.mapInArrow(_packer(size, scale, block), PACKED).withColumn("block", F.monotonically_increasing_id()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-packed.count() // BLOCKS_TOGETHER))
    with _set(spark, "spark.sql.adaptive.enabled", "false"):  # a plan that is fixed beforehand tells the checkpoint how rows are dealt out
        blocks = checkpointed(packed.repartition(parts, "block"))
    centroids, state, scanned = [np.array(first, np.int64)], None, []
    with _in_place(spark):
        for turn in range(rounds + 1):
            before = centroids[-2] if turn else None
            state = checkpointed(_joined(blocks, state).mapInArrow(_worker(size, before, centroids[-1]), STATE))
            sums, counts, seen = _added(state, len(first), size)
            scanned.append(seen)
            if turn < rounds:
                now = [[s // n for s in row] if n else old for row, n, old in zip(sums, counts, centroids[-1].tolist())]
                centroids.append(np.array(now, np.int64))
    return Clustering(blocks, state, centroids, scanned, size)


def cluster(vectors: DataFrame, size: int, vec_id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per clustered vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Rules as in `fit`.

    Vectors that are null, of another size or hold a null or non-finite component have no row; an empty table gives none.
    """
    found = fit(vectors, size, vec_id, vector, clusters, rounds, scale, seed)
    if found is None:
        schema = f"`{vec_id}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    return found.rows(vec_id)

"""Near-duplicate vectors by collision counting over one-dimensional projections.

Distinct vectors are dealt to cells of a few coarse tables, each cell named by the signs of random
projections; their number follows the number of vectors, so that a cell keeps about CELL of them. Inside a cell many
one-dimensional projections are sorted; every vector is the centre of a window on each, and a pair
collects one collision for each window it falls into. Pairs with enough collisions have their cosine
verified in double precision. The number of tables and the count are set so that a pair at exactly the
threshold is found with the stated recall; closer pairs are found more often.

A pair that meets in several tables is judged in the first only, so each cell can report sums: how many
links each vector has, and edges that span what is linked. No pair leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.llm.graph import components
from featureflow.sources.storage import checkpointed

COSINE = 0.9
# Of pairs at the threshold: the share that meets in a cell, and the share of those that collide often enough.
MEET = 0.98
COUNT = 0.99
PROJECTIONS = 32
CELL = 1024
# A larger cell is split into blocks of at most this many vectors, compared two by two.
BLOCK = 2048
SEED = 20_24


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def window(cosine: float) -> float:
    """Half width: 1.5 standard deviations of the projected difference of two unit vectors at the threshold."""
    return 1.5 * math.sqrt(2 - 2 * cosine)


def least_collisions(cosine: float, projections: int = PROJECTIONS, share: float = COUNT) -> int:
    """The largest count that pairs at the threshold reach with the given probability."""
    p = 2 * _normal_cdf(window(cosine) / math.sqrt(2 - 2 * cosine)) - 1
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > 1 - share:
            return count
    return projections


def tables(cosine: float, bits: int, share: float = MEET) -> int:
    """Coarse tables needed so that a pair at the threshold shares a cell of one with the given probability."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if bits == 0 else math.ceil(math.log(1 - share) / math.log(1 - same))


def _planes(size: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([SEED, seed, size]).standard_normal((size, count))


def _codes(unit: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Cell of each vector in each coarse table."""
    if bits == 0:
        return np.zeros((len(unit), count), np.int64)
    signs = (unit @ _planes(unit.shape[1], bits * count, 0) > 0).reshape(len(unit), count, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _collisions(mine: np.ndarray, others: np.ndarray, width: float) -> np.ndarray:
    """How many of the projections of each pair of rows lie in each other's window."""
    count = np.zeros((len(mine), len(others)), np.uint8)
    for k in range(mine.shape[1]):
        order = np.argsort(others[:, k], kind="stable")
        line = others[order, k]
        low = np.searchsorted(line, mine[:, k] - width, "left")
        high = np.searchsorted(line, mine[:, k] + width, "right")
        place = np.empty(len(line), np.int64)
        place[order] = np.arange(len(line))
        count += (place[None, :] >= low[:, None]) & (place[None, :] < high[:, None])
    return count


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(flat.to_pylist()), "<f8").reshape(-1, size) if size else np.zeros((len(flat), 0))


def _cell(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Links of one cell, or of two blocks of one: rows (a, b, n); b is null in a row that counts n links of a."""
    table, _, i, j, bits, count, cosine, _ = (k.as_py() for k in key)
    block = rows.column("block").to_numpy()
    size = len(rows.column("v")[0].as_py()) // 8
    ids, weight = rows.column("id").to_numpy(), rows.column("weight").to_numpy()
    vectors = _matrix(rows.column("v"), size)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    codes = _codes(unit, bits, count)[:, :table]
    lines = unit @ _planes(size, PROJECTIONS, 1)
    least, width = least_collisions(cosine), window(cosine)
    left, right = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
    links, roots = np.zeros(len(ids), np.int64), np.arange(len(ids))
    near = np.zeros((len(left), len(right)), bool)
    step = max(1, (1 << 22) // max(1, len(right)))
    for s in range(0, len(left), step):
        part = left[s : s + step]
        a, b = np.nonzero(_collisions(lines[part], lines[right], width) >= least)
        a, b = part[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        for t in range(0, len(a), 1 << 16):
            x, y = a[t : t + (1 << 16)], b[t : t + (1 << 16)]
            first = ~(codes[x] == codes[y]).any(axis=1)
            x, y = x[first], y[first]
            norms = np.linalg.norm(vectors[x], axis=1) * np.linalg.norm(vectors[y], axis=1)
            good = np.einsum("ij,ij->i", vectors[x], vectors[y]) / norms >= cosine
            x, y = x[good], y[good]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            near[np.searchsorted(left, x), np.searchsorted(right, y)] = True
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    while len(a):  # smallest place reachable, over the links found here
        before = roots.copy()
        np.minimum.at(roots, a, roots[b])
        np.minimum.at(roots, b, roots[a])
        roots = roots[roots]
        if (roots == before).all():
            break
    some, moved = np.nonzero(links)[0], np.nonzero(roots != np.arange(len(ids)))[0]
    return pa.table(
        {
            "a": pa.array(np.concatenate([ids[some], ids[moved]]), pa.int64()),
            "b": pa.array([None] * len(some) + ids[roots[moved]].tolist(), pa.int64()),
            "n": pa.array(np.concatenate([links[some], np.zeros(len(moved), np.int64)]), pa.int64()),
        }
    )


def _packed(rows: DataFrame, vector: str) -> DataFrame:
    """(id, v): the vector as packed doubles, scaled to about one; null where it links with nothing."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                values = None
                if v.is_valid and len(v) and v.values.null_count == 0:
                    values = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                    most = np.abs(values).max()
                    # a power of two changes no cosine and keeps squares from overflowing
                    values = np.ldexp(values, -np.frexp(most)[1]).tobytes() if 0 < most < np.inf else None
                out.append(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    return rows.select("id", vector).mapInArrow(pack, "id long, v binary")


def _codes_of(distinct: DataFrame, bits: int, count: int) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).to_pylist()
            codes: list[list[int]] = [[] for _ in data]
            for size in {len(d) for d in data}:
                some = [k for k, d in enumerate(data) if len(d) == size]
                vectors = np.frombuffer(b"".join(data[k] for k in some), "<f8").reshape(len(some), -1)
                for k, row in zip(some, _codes(vectors / np.linalg.norm(vectors, axis=1)[:, None], bits, count)):
                    codes[k] = row.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])

    return distinct.mapInArrow(code, T.StructType([*distinct.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))]))


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of `cosine` (above 0) or more, in double precision, whatever else their rows say. n_links
    counts the other rows linked directly, equal vectors included; component_id is the smallest vec_id
    reachable, the row's own included; kept is whether the row names its component. Equal vectors
    collapse first and are not expanded into pairs. Null, empty and zero vectors and those with null or non-finite
    components link with nothing; neither do vectors of different lengths. Repeated rows with one id
    count as rows. A null id is returned with null component and is not kept unless a linked id names
    the component. Other columns are not returned; an empty table gives an empty result.
    """
    source = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    packed = checkpointed(_packed(source, "vector"))
    groups = packed.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"))
    distinct = checkpointed(groups.select(F.xxhash64("v").alias("id"), "first", "v", "weight"))
    total = distinct.count()
    bits = max(0, round(math.log2(max(1, total) / CELL)))
    count = tables(cosine, bits)

    coded = _codes_of(distinct.select("id", "weight", "v"), bits, count)
    dealt = coded.select("id", "weight", "v", F.posexplode("codes").alias("table", "cell"))
    sizes = dealt.groupBy("table", "cell", F.length("v").alias("size")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = dealt.withColumn("size", F.length("v")).join(sizes, ["table", "cell", "size"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = {"i": F.least("block", "other"), "j": F.greatest("block", "other"), "bits": F.lit(bits), "count": F.lit(count), "cosine": F.lit(cosine)}
    cells = placed.withColumns(keys).groupBy("table", "cell", "i", "j", "bits", "count", "cosine", "size")
    found = checkpointed(cells.applyInArrow(_cell, "a long, b long, n long"))

    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL")).select(F.col("node").alias("id"), "root")
    classes = distinct.drop("v").join(counts, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(names, "root").select("id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    return (
        packed.select(F.col("id").alias("vec_id"), F.xxhash64("v").alias("id"), F.col("v").isNull().alias("alone"))
        .join(classes, "id", "left")
        .select(
            "vec_id",
            F.when(F.col("alone"), 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
            F.when(F.col("alone"), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )

"""Near duplicates by 64-bit SimHash fingerprints and multi-index hashing.

Two fingerprints at Hamming distance 3 or less agree up to one bit in one of their two 32-bit halves.
Each distinct fingerprint is stored in a table under both halves, and asks the table for each half
itself and for each half with one of its zero bits set. Of two halves that differ in one bit, one has
a zero there, so asking upwards only finds every pair, with half of the Hamming ball. Every answer is
verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.llm.graph import components
from featureflow.sources.storage import checkpointed

SEED = 42
WORDS = 5
DISTANCE = 3
# A table entry with more fingerprints than this is compared in blocks inside tasks instead of by the join.
JOINED = 64
# Fingerprints of each side of one block.
BLOCK = 2048
# Shingle hashes whose bits are unpacked at once.
_CHUNK = 1 << 16


def simhash(text: str | None, words: int = WORDS) -> int:
    """Unsigned fingerprint of a text; zero for null and for a text without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) <= words:
        grams = [b" ".join(found)]
    else:
        grams = map(b" ".join, zip(*(found[i:] for i in range(words))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _CHUNK):
        part = hashes[start : start + _CHUNK].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str, name: str, words: int = WORDS) -> DataFrame:
    """Append the fingerprint of a text column as a (signed) long, whole text, ASCII case folded."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t.as_py(), words) for t in batch.column(text)]
            column = pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _halves(prints: DataFrame) -> DataFrame:
    low, high = F.col("f").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("f", 32)
    halves = F.array(F.struct(F.lit(0).alias("seg"), low.alias("val")), F.struct(F.lit(1).alias("seg"), high.alias("val")))
    return prints.select("f", F.explode(halves).alias("h")).select("f", "h.seg", "h.val")


def _asked(table: DataFrame) -> DataFrame:
    """Each half itself and with each of its zero bits set."""
    flips = F.expr("filter(transform(sequence(0, 31), i -> val | shiftleft(1L, i)), x -> x != val)")
    return table.select("seg", "f", F.explode(F.concat(F.array("val"), flips)).alias("val"))


def _forest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Edges that connect what is linked between the two sides of one block, at most one per row."""
    values = table.column("f").to_numpy().view(np.uint64)
    asked = table.column("asked").to_numpy(zero_copy_only=False)
    left, right = np.unique(values[asked]), np.unique(values[~asked])
    if not (len(left) and len(right)):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= key[4].as_py()
    far = len(left)
    mine = np.where(near.any(axis=1), np.arange(far), far)
    while True:
        theirs = np.where(near, mine[:, None], far).min(axis=0)
        again = np.minimum(mine, np.where(near, theirs[None, :], far).min(axis=1))
        if (again == mine).all():
            break
        mine = again
    ends = np.concatenate([left[mine < far], right[theirs < far]])
    roots = left[np.concatenate([mine[mine < far], theirs[theirs < far]])]
    return pa.table({"a": ends.view(np.int64), "b": roots.view(np.int64)})


def links(prints: DataFrame, column: str, distance: int = DISTANCE) -> DataFrame:
    """(a, b) edges between distinct fingerprints that connect exactly those within the distance.

    Every link is found; in a large table entry the edges span what is linked there rather than
    listing all its pairs. The distance is 0 to 3, which two halves with one flipped bit cover.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one flipped bit cover distances 0 to 3")
    # merge: Spark takes an exploded table for as small as what it came from and would send it, and with 33 rows for each what it asks, to all
    table = _halves(prints.select(F.col(column).alias("f")).where("f IS NOT NULL").distinct()).hint("merge")
    sizes = table.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > JOINED)
    small = sizes.where((F.col("n") <= JOINED))
    entries = table.join(small, ["seg", "val"]).select("seg", "val", F.col("f").alias("g"), F.lit(0).cast("long").alias("n"))
    entries = entries.unionByName(large.select("seg", "val", F.lit(None).cast("long").alias("g"), "n"))
    close = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= distance
    answers = checkpointed(
        _asked(table).join(entries, ["seg", "val"]).where(F.col("g").isNull() | (close & (F.col("f") != F.col("g"))))
    )
    found = answers.where("g IS NOT NULL").select(F.col("f").alias("a"), F.col("g").alias("b"))

    asked = answers.where("g IS NULL").select("seg", "val", "f")
    stored = table.join(large, ["seg", "val"])
    blocks = asked.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("asked")).join(large, ["seg", "val"])
    blocks = blocks.select("seg", "val", F.ceil(F.col("asked") / BLOCK).alias("ja"), F.ceil(F.col("n") / BLOCK).alias("jb"))
    mine = F.pmod(F.xxhash64("f"), F.col("ja")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("jb") - 1)).alias("j")
    yours = F.explode(F.sequence(F.lit(0).cast("long"), F.col("ja") - 1)).alias("i"), F.pmod(F.xxhash64("f"), F.col("jb")).alias("j")
    rows = asked.join(blocks, ["seg", "val"]).select("seg", "val", *mine, "f", F.lit(True).alias("asked"))
    rows = rows.unionByName(stored.join(blocks, ["seg", "val"]).select("seg", "val", *yours, "f", F.lit(False).alias("asked")))
    spans = rows.withColumn("d", F.lit(distance)).groupBy("seg", "val", "i", "j", "d").applyInArrow(_forest, "a long, b long")
    return found.unionByName(spans)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                    distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most `distance`
    bits, the document's own included. Equal fingerprints collapse first, so a group of copies is one
    entry. Null and wordless texts have fingerprint zero and link like any other; fewer words than a
    shingle make one shingle. Rows with a null doc_id are returned; their id never names a component
    (null if nobody else is there). Repeated rows are returned as often as they occur. Other columns of
    the input are not returned. An empty table gives an empty result.
    """
    found = _classes(docs, doc_id, text, words, distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(docs: DataFrame, doc_id: str, text: str, words: int, distance: int) -> DataFrame:
    """(doc_id, version, f, component_id) per row; version is a hash of the text."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("version"), F.col(text).cast("string").alias("text"))
    prints = checkpointed(with_fingerprint(source, "text", "f", words).select("doc_id", "version", "f"))
    distinct = prints.groupBy("f").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints, "f", distance)).select(F.col("node").alias("f"), "root")
    rooted = distinct.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("f", "component_id")
    return prints.join(classes, "f").select("doc_id", "version", "f", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One document of each component, all columns kept: the one that names it, of several with that id one text's.

    Rows with a null doc_id stay. Of rows with equal id and text one stays.
    """
    found = checkpointed(_classes(docs, doc_id, text, words, distance).where("doc_id IS NOT NULL"))
    named = found.where("doc_id = component_id").groupBy("component_id").agg(F.min("version").alias("keeper"))
    judged = found.join(named, "component_id").select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("version") == F.col("keeper"))).alias("stays"))
    copies = judged.where("NOT stays").select("__id", "__version").distinct()
    version = F.xxhash64(F.col(text).cast("string"))
    kept = docs.join(copies, (F.col(doc_id) == F.col("__id")) & (version == F.col("__version")), "left_anti")
    if found.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return kept
    some = kept.where(F.col(doc_id).isNotNull()).withColumn("__version", version).dropDuplicates([doc_id, "__version"]).drop("__version")
    return some.unionByName(kept.where(F.col(doc_id).isNull()))

"""Conversation structure repair: cheapest edits to a legal sequence of roles, by Four-Russians block tables.

A legal sequence of role initials is `(s?(ua)+)?`, read by a machine of four states. What the rest of a conversation
costs from each state is a vector of four numbers; divided into its least number and what exceeds it (the normalised
vector) only a few dozen vectors occur. For every block of BLOCK symbols and every such vector a table holds the vector
before the block and what is added, so a conversation is worked through from its end by one look-up per block. Edits are
then read from its start: a block is expanded backward from the vector behind it, and of the edits that keep the least
cost the first in the alphabet is taken.

A conversation of any length is cut into chunks of consecutive rows. A chunk maps vectors by a 4 x 4 matrix of costs
(least sums) and states by a table of four, so vectors and states at the borders come from products in groups of chunks,
level by level. Only keys, digests and flags are sorted; a text moves once, for the digest of the repaired conversation,
which is read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featureflow.operators.joins import lookup
from featureflow.sources.storage import checkpointed

# Fixed values of the repair problem.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
STATES, START = 4, 0
LEGAL_ENDS = (0, 3)
# The role an inserted or changed row takes in each state, and the state after it.
TURN = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
# (state, role symbol) -> state; role symbols are 0 system, 1 user, 2 assistant, 3 any other.
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
# Four roles, four roles of truncated rows, one row that must go.
SYMBOLS, GOES = 9, 8
BLOCK = 4
# Rows of a chunk, and chunks combined at once, as powers of two.
CHUNK_BITS, FAN_BITS = 12, 10
FAR = 1 << 40

SPACES = r"[\x20\x09-\x0D]"


def _closed(v: list[int]) -> list[int]:
    """Costs with insertions allowed before what follows."""
    for _ in range(STATES):
        v = [min(v[q], INSERT + v[AFTER[q]]) for q in range(STATES)]
    return v


def _before(symbol: int, v: tuple[int, ...]) -> list[int]:
    """Costs before a row of this symbol, from those after it."""
    if symbol == GOES:
        return _closed([DELETE + v[q] for q in range(STATES)])
    role, cut = symbol % 4, CUT * (symbol >= 4)
    kept = [KEEP + cut + v[KEPT[q, role]] if (q, role) in KEPT else FAR for q in range(STATES)]
    return _closed([min(DELETE + v[q], kept[q], REROLE + cut + v[AFTER[q]]) for q in range(STATES)])


def _normal(v: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(v)
    return tuple(x - least if x < FAR else FAR for x in v), least


END = tuple(_closed([0 if q in LEGAL_ENDS else FAR for q in range(STATES)]))


class Tables:
    """Every normalised vector that can occur, and its transitions by symbol and by block of BLOCK symbols."""

    def __init__(self):
        units = [tuple(0 if q == j else FAR for q in range(STATES)) for j in range(STATES)]
        self.vectors = list(dict.fromkeys([_normal(list(END))[0], *units]))
        self.number = {v: i for i, v in enumerate(self.vectors)}
        steps = []
        for v in self.vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                w, more = _normal(_before(symbol, v))
                if w not in self.number:
                    self.number[w] = len(self.vectors)
                    self.vectors.append(w)
                row.append((self.number[w], more))
            steps.append(row)
        to, cost = (np.array([[x[k] for x in row] for row in steps], np.int64) for k in (0, 1))
        self.to, self.cost = to.tolist(), cost.tolist()
        # a block's number has its first symbol as the highest digit; the last symbol is worked first
        block_to, block_cost = to, cost
        for _ in range(BLOCK - 1):
            block_cost = (block_cost[:, None, :] + cost[block_to].transpose(0, 2, 1)).reshape(len(to), -1)
            block_to = to[block_to].transpose(0, 2, 1).reshape(len(to), -1)
        self.block_to, self.block_cost = block_to, block_cost

    def back(self, codes: np.ndarray, number: int) -> tuple[list[int], int, int]:
        """(vector number behind each block, vector number before all, cost added) from the vector behind all.

        Blocks end where the symbols end; what is left over in front is less than a block.
        """
        rest = len(codes) % BLOCK
        digits = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
        blocks = codes[rest:].reshape(-1, BLOCK) @ digits
        behind, added = [], 0
        for block in blocks[::-1].tolist():
            behind.append(number)
            added += int(self.block_cost[number, block])
            number = int(self.block_to[number, block])
        behind.append(number)
        for symbol in codes[:rest][::-1].tolist():
            added += self.cost[number][symbol]
            number = self.to[number][symbol]
        return behind[::-1], number, added

    def trace(self, codes: np.ndarray, number: int, state: int, last: bool) -> tuple[str, list[tuple[int, str, bool]], int, int]:
        """(edits, lines (row, role, own text), state behind, cost) of the cheapest edits, the first in the alphabet of several."""
        rest = len(codes) % BLOCK
        behind, _, _ = self.back(codes, number)
        symbols, edits, lines, cost, start = codes.tolist(), [], [], 0, 0
        for k, end in enumerate(range(rest, len(symbols) + 1, BLOCK)):
            inner = [(behind[k], 0)]
            for symbol in reversed(symbols[start:end]):
                now, added = inner[-1]
                inner.append((self.to[now][symbol], added + self.cost[now][symbol]))
            vectors = [[x + added for x in self.vectors[now]] for now, added in reversed(inner)]
            for at in range(start, end):
                here, after, symbol = vectors[at - start], vectors[at - start + 1], symbols[at]
                cut = CUT * (4 <= symbol < GOES)
                while True:
                    if DELETE + after[state] == here[state]:
                        edits.append("D")
                        cost += DELETE
                        break
                    if INSERT + here[AFTER[state]] == here[state]:
                        edits.append("I")
                        lines.append((at, TURN[state], False))
                        cost, state = cost + INSERT, AFTER[state]
                        continue
                    to = KEPT.get((state, symbol % 4))
                    if to is not None and KEEP + cut + after[to] == here[state]:
                        edits.append("K")
                        lines.append((at, "", True))
                        cost, state = cost + KEEP + cut, to
                    else:
                        edits.append("R")
                        lines.append((at, TURN[state], True))
                        cost, state = cost + REROLE + cut, AFTER[state]
                    break
            start = end
        while last and END[state] > 0:
            edits.append("I")
            lines.append((len(symbols) - 1, TURN[state], False))
            cost, state = cost + INSERT, AFTER[state]
        return "".join(edits), lines, state, cost


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def _key(conv_id: str) -> Column:
    """A string that tells all ids and null apart."""
    return F.when(F.col(conv_id).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv_id).cast("string")))


def _rows(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    whole = rows.select(
        _key(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    return whole.withColumn("told", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _faulted(rows: DataFrame) -> DataFrame:
    """Rows in order (at), without texts, with their fault: blank, duplicate, truncated or none."""
    shown = F.regexp_replace("text", SPACES + r"+\z", "")
    light = rows.select(
        "conv", "turn", "role", "told", (F.length(shown) == 0).alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("salt"),  # lets equal rows of a conversation stand in several tasks
    )
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("told"), F.col("salt")]
    placed = light.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").withColumn("at", F.monotonically_increasing_id())
    placed = checkpointed(placed)
    # the place of the first of several equal rows, under a digest of conversation, role and text
    same = F.md5(F.concat(F.hex("told"), F.lit(":"), F.col("conv")))
    keyed = placed.withColumn("same", F.when(~F.col("blank"), same))
    firsts = keyed.where("same IS NOT NULL").groupBy("same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = checkpointed(firsts.where("n > 1").select("same", "first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("at"), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return lookup(keyed, "same", firsts).select("conv", "at", "turn", "role", "told", fault.alias("fault"))


def _chunks(rows: DataFrame, chunk_bits: int) -> DataFrame:
    """One row per chunk: its counts, and its rows in order with their symbol."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GOES).when(F.col("fault") == "truncated", role + 4).otherwise(role)
    row = F.struct("at", "turn", "role", "told", symbol.alias("symbol"))
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    grouped = rows.groupBy("conv", F.shiftright("at", chunk_bits).alias("chunk")).agg(
        F.sort_array(F.collect_list(row)).alias("rows"), *map(count, ("blank", "duplicate", "truncated")),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"),
    )
    heads = F.transform("rows", lambda x: F.substring(x["role"], 1, 1))
    pairs = F.zip_with(F.slice("heads", 1, F.size("heads") - 1), F.slice("heads", 2, F.size("heads")), lambda a, b: F.concat(a, b))
    wrong = F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au"))).cast("long")
    return checkpointed(grouped.withColumn("heads", heads).withColumn("illegal", wrong).withColumn("head", F.element_at("heads", 1)).withColumn("tail", F.element_at("heads", -1)).drop("heads"))


def _times(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.minimum((m[:, :, None] + n[None, :, :]).min(axis=1), FAR)


def _arrivals(steps: DataFrame, start: tuple[int, ...], backward: bool, fan_bits: int) -> DataFrame:
    """(conv, chunk, v): the vector that arrives at each step; it leaves as m x v (least sums) and arrives at the next.

    Steps are combined in groups by the upper bits of their numbers, the groups likewise, until each conversation has one.
    """

    def ordered(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values("chunk", ascending=not backward)

    def product(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for m in ordered(frame)["m"]:
            m = np.asarray(m, np.int64).reshape(STATES, STATES)
            whole = m if whole is None else _times(m, whole)
        return pd.DataFrame({"conv": [key[0]], "chunk": [key[1]], "m": [whole.ravel().tolist()]})

    def passed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = ordered(frame)
        v, out = np.asarray(frame["v"].iloc[0], np.int64), []
        for m in frame["m"]:
            out.append(v.tolist())
            v = np.minimum((np.asarray(m, np.int64).reshape(STATES, STATES) + v).min(axis=1), FAR)
        return pd.DataFrame({"conv": key[0], "chunk": frame["chunk"].to_numpy(), "v": out})

    grouped = steps.withColumn("group", F.shiftright("chunk", fan_bits))
    whole = checkpointed(grouped.groupBy("conv", "group").applyInPandas(product, "conv string, chunk long, m array<long>"))
    if whole.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        known = whole.select("conv", F.col("chunk").alias("group"), F.lit(list(start)).cast("array<long>").alias("v"))
    else:
        known = _arrivals(whole, start, backward, fan_bits).withColumnRenamed("chunk", "group")
    both = grouped.join(known, ["conv", "group"])
    return checkpointed(both.groupBy("conv", "group").applyInPandas(passed, "conv string, chunk long, v array<long>"))


def _codes(rows: pa.ListScalar) -> np.ndarray:
    return rows.values.field("symbol").to_numpy(zero_copy_only=False).astype(np.int64)


def _backward_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of each chunk: costs from every state before it to every state behind it."""
    known = tables()
    for batch in batches:
        out = []
        for rows in batch.column("rows"):
            codes, m = _codes(rows), np.empty((STATES, STATES), np.int64)
            for j in range(STATES):
                unit = known.number[tuple(0 if q == j else FAR for q in range(STATES))]
                _, before, added = known.back(codes, unit)
                m[:, j] = [min(x + added, FAR) for x in known.vectors[before]]
            out.append(m.ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(out, pa.list_(pa.int64()))], ["conv", "chunk", "m"])


def _behind(v: list[int] | None) -> tuple[int, bool]:
    """(number of the vector behind a chunk, whether nothing follows); null is the only chunk of its conversation."""
    known = tables()
    return (known.number[_normal(list(END))[0]], True) if v is None else (known.number[_normal(v)[0]], False)


def _forward_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states behind each chunk as a matrix: the state behind it is the row of a zero in the column of the state before it."""
    for batch in batches:
        out = []
        for rows, v in zip(batch.column("rows"), batch.column("v")):
            codes, m = _codes(rows), np.full((STATES, STATES), FAR)
            number, _ = _behind(v.as_py())
            for q in range(STATES):
                m[tables().trace(codes, number, q, False)[2], q] = 0
            out.append(m.ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(out, pa.list_(pa.int64()))], ["conv", "chunk", "m"])


TRACED = "conv string, chunk long, audit string, cost long, lines array<struct<at:long,n:int,turn:long,role:string,told:binary,out:string,own:boolean>>"
LINE = pa.struct(
    [("at", pa.int64()), ("n", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("told", pa.binary()), ("out", pa.string()), ("own", pa.bool_())]
)


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        audits, costs, lines = [], [], []
        for rows, v, state, last in zip(batch.column("rows"), batch.column("v"), batch.column("state"), batch.column("last")):
            told = rows.as_py()
            number, _ = _behind(v.as_py())
            audit, found, _, cost = tables().trace(_codes(rows), number, state.as_py(), last.as_py())
            audits.append(audit)
            costs.append(cost)
            lines.append([
                {"at": told[at]["at"], "n": n, "turn": told[at]["turn"], "role": told[at]["role"], "told": told[at]["told"], "out": role or told[at]["role"], "own": own}
                for n, (at, role, own) in enumerate(found)
            ])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("chunk"), pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(lines, pa.list_(LINE))],
            ["conv", "chunk", "audit", "cost", "lines"],
        )


def _edited(chunks: DataFrame, fan_bits: int) -> DataFrame:
    """(conv, chunk, audit, cost, lines) of every chunk."""
    step = "conv string, chunk long, m array<long>"
    several = checkpointed(chunks.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max("chunk").alias("final")).where("n > 1"))
    if several.isEmpty():
        placed = chunks.select("conv", "chunk", "rows", F.lit(None).cast("array<long>").alias("v"), F.lit(START).alias("state"), F.lit(True).alias("last"))
        return checkpointed(placed.mapInArrow(_traced, TRACED))
    cut = chunks.select("conv", "chunk", "rows").join(several, "conv")
    behind = _arrivals(cut.select("conv", "chunk", "rows").mapInArrow(_backward_steps, step), END, True, fan_bits)
    known = checkpointed(cut.join(behind, ["conv", "chunk"]))
    begin = tuple(0 if q == START else FAR for q in range(STATES))
    states = _arrivals(known.select("conv", "chunk", "rows", "v").mapInArrow(_forward_steps, step), begin, False, fan_bits)
    states = states.select("conv", "chunk", (F.array_position("v", F.lit(0).cast("long")) - 1).cast("int").alias("state"))
    parts = known.join(states, ["conv", "chunk"]).select("conv", "chunk", "rows", "v", "state", (F.col("chunk") == F.col("final")).alias("last"))
    alone = chunks.join(several, "conv", "left_anti")
    alone = alone.select("conv", "chunk", "rows", F.lit(None).cast("array<long>").alias("v"), F.lit(START).alias("state"), F.lit(True).alias("last"))
    return checkpointed(alone.unionByName(parts).mapInArrow(_traced, TRACED))


def _counted(chunks: DataFrame, edited: DataFrame) -> DataFrame:
    """One row per conversation that has rows: gaps, counts of faults, cost and audit; chunk borders are counted here."""
    order = Window.partitionBy("conv").orderBy("chunk")
    seam = F.concat(F.lag("tail").over(order), F.col("head"))
    both = chunks.drop("rows").withColumn("seam", (~seam.isin("su", "ua", "au")).cast("long")).withColumn("again", (F.lag("high").over(order) == F.col("low")).cast("long"))
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    span = F.max("high").cast("decimal(38,0)") - F.min("low") + 1 - add("turns") + add("again")
    counts = both.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), add("blank").alias("blank"), add("duplicate").alias("duplicate"),
        add("truncated").alias("truncated"), (add("illegal") + add("seam")).alias("illegal"),
    )
    pieces = edited.groupBy("conv").agg(add("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("chunk", "audit"))).alias("pieces"))
    return counts.join(pieces.select("conv", "cost", F.array_join("pieces.audit", "").alias("audit")), "conv")


def _streamed(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """Texts and the lines made of them, by conversation in order: a text stands before the lines that need it."""
    texts = rows.select("conv", "turn", "role", "told", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("out"), F.lit(False).alias("own"), "text")
    lines = edited.select("conv", F.explode("lines").alias("x")).select("conv", "x.turn", "x.role", "x.told", "x.at", "x.n", "x.out", "x.own", F.lit(None).cast("string").alias("text"))
    both = texts.unionByName(lines).repartition("conv")
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "told", "at", "n"]
    return both.sortWithinPartitions(*order).select("conv", "out", "own", "text")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, str, str]]]:
    """(conv, role, text) of the repaired lines, per batch."""
    text = ""
    for batch in batches:
        found = []
        for conv, out, own, here in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if out is None:
                text = here
            else:
                found.append((conv, out, text if own else ""))
        yield found


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None
    for found in _lines(batches):
        ended = []
        for conv, role, text in found:
            if conv != now:
                if now is not None:
                    ended.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in ended], pa.string()) for k in (0, 1)], ["conv", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, place = None, 0
    for found in _lines(batches):
        places = []
        for conv, _, _ in found:
            now, place = conv, place + 1 if conv == now else 0
            places.append(place)
        columns = [pa.array([x[0] for x in found], pa.string()), pa.array(places, pa.int64()), *(pa.array([x[k] for x in found], pa.string()) for k in (1, 2))]
        yield pa.RecordBatch.from_arrays(columns, ["conv", "place", "role", "text"])


def _named(found: DataFrame, ids: DataFrame, conv_id: str) -> DataFrame:
    """Every conversation of ids, with what was found for it."""
    listed = ids.select(F.col(conv_id).alias("__id")).distinct().withColumn("conv", _key("__id"))
    return listed.join(found, "conv", "left")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", ids: DataFrame | None = None,
           chunk_bits: int = CHUNK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    A conversation's rows stand by turn (null first), then role and a digest of role and text, so ties have one order; repeated
    rows count as often as they occur. The first fault of a row counts: blank (white space only), duplicate (role and
    text stand earlier), truncated (its last character is no `.`, `!` or `?`). gaps are turns that no row has between the
    least and the largest, illegal are neighbours whose initials are not su, ua or au. The edits Keep (0), Rerole to user or
    assistant (2), Delete (3, for every blank or duplicate row) and Insert of an empty user or assistant row (2), with 1
    for each truncated row that stays, give initials `(s?(ua)+)?` at the least cost; audit has their initials, of several
    cheapest the least by ASCII. repaired_sha256 is of the repaired `role:text` lines joined by newlines.

    A null role or text is one space; a null conv_id is a conversation of its own. `ids` names conversations that are
    returned even without rows: zeros, an empty audit and the hash of the empty string. An empty table gives an empty result
    (or ids alone). Other columns of the input are not read. A conversation may hold any number of rows: its chunks are
    worked in parallel. Only its digest, which has to be read in order, is made by one task, as a stream.
    """
    whole = _rows(rows, conv_id, turn, role, text)
    chunks = _chunks(_faulted(whole), chunk_bits)
    edited = _edited(chunks, fan_bits)
    digests = _streamed(whole, edited).mapInArrow(_digested, "conv string, repaired_sha256 string")
    found = _named(_counted(chunks, edited).join(digests, "conv", "left"), rows if ids is None else ids, conv_id)
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        F.col("__id").alias(conv_id), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in longs), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             chunk_bits: int = CHUNK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """The repaired conversations: (conv_id, place, role, text), places from 0 without gaps. Rules as in `repair`."""
    whole = _rows(rows, conv_id, turn, role, text)
    edited = _edited(_chunks(_faulted(whole), chunk_bits), fan_bits)
    lines = _streamed(whole, edited).mapInArrow(_numbered, "conv string, place long, role string, text string")
    return _named(lines, rows, conv_id).where("place IS NOT NULL").select(F.col("__id").alias(conv_id), "place", "role", "text")


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults planted by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2 removes its `.`, `!` and
    `?`, 3 repeats it, 4 sets its role to user. Nulls count as one space, in the key and as role or text; ids and turns stay null."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told(conv_id), F.lit(":"), told(turn))) % 20
    body = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(told(text), "[.!?]", "")).otherwise(told(text))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    hurt = rows.where(fault != 0).select(conv_id, turn, F.when(fault == 4, "user").otherwise(told(role)).alias(role), body.alias(text), F.explode(copies))
    return hurt.drop("col")

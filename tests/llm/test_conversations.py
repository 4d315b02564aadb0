"""Conversation repair against a plain forward search, on the table and on odd, tied and long conversations."""

import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pytest
from featureflow.llm import conversation_repair, queries

SHOWN = re.compile(r"[^\x20\x09-\x0D]")


def hurt(rows):
    """Rows (conv_id, turn, role, text) with the contract's faults."""
    told = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", told(text)) if fault == 2 else told(text)
        out += [(conv, turn, "user" if fault == 4 else told(role), text)] * (2 if fault == 3 else 1)
    return out


def repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, lines of one conversation, by all states forward."""
    told = [(turn, " " if role is None else role, " " if text is None else text) for turn, role, text in rows]
    told.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
    turns, seen, faults = [t for t, _, _ in told if t is not None], set(), []
    for _, role, text in told:
        shown = SHOWN.findall(text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    following = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                role = following[state]
                new = (cost + 2, audit + "I", [*lines, f"{role}:"])
                if role[0] not in best or new[:2] < best[role[0]][:2]:
                    best[role[0]] = new
        return best

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(told, faults):
        now = {}
        for state, (cost, audit, lines) in inserted(best).items():
            cut = fault == "truncated"
            ways = [(state, cost + 3, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                if (state, role[:1]) in legal:
                    ways.append((legal[state, role[:1]], cost + cut, audit + "K", [*lines, f"{role}:{text}"]))
                ways.append((following[state][0], cost + 2 + cut, audit + "R", [*lines, f"{following[state]}:{text}"]))
            for to, *way in ways:
                if to not in now or tuple(way[:2]) < now[to][:2]:
                    now[to] = tuple(way)
        best = now
    cost, audit, lines = min(v for k, v in inserted(best).items() if k in ("", "a"))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(told, told[1:])]
    count = lambda f: faults.count(f)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, lines


def expected(rows, ids):
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(row)
    out = {}
    for conv in ids:
        *numbers, lines = repair(by.get(conv, []))
        out[conv] = (*numbers, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def test_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{brute.FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversations(spark, brute.FOLDER)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found(got) == expected(hurt(rows), {r[0] for r in rows})


def _odd(seed, conversations, most):
    r = random.Random(seed)
    texts = ["", " \t", None, "Yes.", "No", "What? ", "a\n.", "long " * 50 + "!", "é", "日本。", "k!"]
    rows = []
    for conv in [*range(conversations), None]:
        for i in range(r.randint(0, most)):
            rows.append((conv, r.choice([None, i, i, i // 2, -3 * i]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"]), r.choice(texts)))
    return rows


@pytest.mark.parametrize(("chunk_bits", "fan_bits"), [(12, 10), (1, 1), (0, 2), (3, 1)])
def test_odd_conversations(spark, chunk_bits, fan_bits):
    rows = _odd(chunk_bits, 60, 30)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = found(conversation_repair.repair(frame, chunk_bits=chunk_bits, fan_bits=fan_bits))
    assert got == expected(rows, {r[0] for r in rows})


def test_one_conversation_of_all_rows(spark):
    rows = [(7, *r[1:]) for r in _odd(5, 40, 60)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert found(conversation_repair.repair(frame, chunk_bits=4, fan_bits=2)) == expected(rows, {7})


def test_damage(spark):
    rows = _odd(9, 80, 12)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, map(tuple, conversation_repair.damaged(frame).collect()))) == sorted(map(str, hurt(rows)))


def test_columns_ids_and_empty_tables(spark):
    schema = "conv string, turn int, role string, text string, at long, chunk string, col int, conv_id int"
    rows = [("a b", 0, "user", "Hi.", 1, "x", 2, 3), ("", 0, "assistant", "Yes", 1, "x", 2, 3), (None, None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    ids = frame.select("conv").union(spark.createDataFrame([("gone",)], "conv string"))
    got = found(conversation_repair.repair(frame, conv_id="conv", ids=ids))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got["gone"] == (0, 0, 0, 0, 0, 0, "", nothing) and got[None] == (0, 1, 0, 0, 0, 3, "D", nothing)
    assert got["a b"][5:7] == (2, "KI") and got[""][3:] == (1, 0, 3, "D", nothing)
    lines = conversation_repair.repaired(frame, conv_id="conv")
    assert lines.columns == ["conv", "place", "role", "text"]
    assert sorted(map(tuple, lines.collect())) == [("a b", 0, "user", "Hi."), ("a b", 1, "assistant", "")]
    assert conversation_repair.repair(frame.limit(0), conv_id="conv").count() == 0
    assert conversation_repair.repaired(frame.limit(0), conv_id="conv").count() == 0


def test_block_tables_equal_single_steps():
    known, r = conversation_repair.tables(), np.random.default_rng(3)
    for n in range(60):
        codes = r.integers(0, conversation_repair.SYMBOLS, n)
        number, added = 0, 0
        for symbol in codes[::-1]:
            added, number = added + known.cost[number][symbol], known.to[number][symbol]
        assert known.back(codes, 0)[1:] == (number, added)

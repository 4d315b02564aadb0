"""Fingerprints, quality rules, secrets and lines against plain Python."""

import random

import brute
import pytest
from featureflow.llm import graph, line_dedup, quality, queries, secret_scan, simhash

SCHEMA = "doc_id long, text string, lang string, f int, row string, kept string, dropped int"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{brute.FOLDER}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties and columns named like those the operators use."""
    long = " ".join(f"word{i % 700}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (4, "one two"), (5, "one two"), (None, "one two"), (None, None),
        (6, long), (7, long + "\nsome other line that is here only once"), (8, "ÀÉ ß İ Σ x\n" * 3), (9, "a a a a a a a a a a a a a a a a a a a a a a a"),
    ]
    return spark.createDataFrame([(*r, "en", 1, "r", "k", 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5), (None, 7)]
    edges += [(1000, 1001 + i) for i in range(500)]
    sets = brute.Sets()
    for a, b in edges:
        if a is not None and a != b:
            sets.join(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for x in sets.up}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_query(spark, documents):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op1_simhash(spark, brute.FOLDER).collect()}
    assert got == brute.near(documents, 3)


@pytest.mark.parametrize("joined,block", [(64, 2048), (1, 16)])
def test_large_entries_give_the_same_links(spark, monkeypatch, joined, block):
    monkeypatch.setattr(simhash, "JOINED", joined)
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(1)
    centre = [r.getrandbits(64) for _ in range(4)] + [0, 2**64 - 1]
    values = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for c in centre for _ in range(60)})
    sets = brute.Sets()
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                sets.join(a, b)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    edges = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "p long"), "p")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    want = {}
    for v in values:
        want.setdefault(sets.find(v), set()).add(signed(v))
    got = {}
    for v in map(signed, values):
        got.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_asked_halves_are_not_sent_to_all(spark, monkeypatch):
    plans = []

    def seen(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return spark.createDataFrame(rows, df.schema)

    monkeypatch.setattr(simhash, "checkpointed", seen)
    edges = simhash.links(spark.range(3000).select((2654435761 * graph.F.col("id")).alias("p")), "p")
    assert edges.columns == ["a", "b"] and len(plans) == 1
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_simhash_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd, words=3).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert by[(1, zero)] == by[(2, zero)] == by[(3, zero)] == by[(None, zero)] == 1
    pair = f"{brute.fingerprint('one two', 3):016x}"
    assert by[(4, pair)] == by[(5, pair)] == by[(None, pair)] == 4
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(odd, words=3).collect()]
    assert sorted(x for x in kept if x) == [1, 4, 6, 8, 9] and kept.count(None) == 2
    assert simhash.keep_one(empty).columns == empty.columns


def test_quality_query(spark, documents):
    got = {r.doc_id: r.asDict() for r in queries.op3_quality(spark, brute.FOLDER).collect()}
    assert len(got) == len(documents)
    for i, text in documents:
        m = brute.measures(text)
        failed, kept = brute.verdict(m)
        want = {k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        assert got[i] == {"doc_id": i, **want, "base_failed": failed, "kept": kept}


def test_quality_odd_rows(odd, empty):
    r = random.Random(2)
    texts = [" ".join(r.choice("ab") for _ in range(n)) for n in (7, 8, 9, 16, 40, 200)]
    more = odd.sparkSession.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = quality.assess(odd.select("doc_id", "text", "kept")).collect() + quality.assess(more).collect()
    for row in rows:
        m = brute.measures(row.text)
        assert {k: row[k] for k in m} == m
        assert (row.base_failed, row.kept) == brute.verdict(m)
    assert quality.passing(odd).columns == odd.columns
    assert quality.assess(empty).count() == 0
    assert quality.assess(odd).where("n_repeat_words > 3").count() == sum(brute.measures(r.text)["n_repeat_words"] > 3 for r in odd.collect())


def _told(spans):
    return ",".join(f"{secret_scan.KINDS[k].name}:{s}:{e}" for s, k, e in spans)


def test_secrets_query(spark, documents):
    got = {r.doc_id: r for r in queries.op5_secrets(spark, brute.FOLDER).collect()}
    assert len(got) == len(documents)
    for i, text in documents:
        base, row = brute.base_spans(text), got[i]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert row.base_sha256 == brute.sha(_told(base))
        assert row.spans == _told(brute.all_spans(text))


def test_secrets_odd_rows(spark, odd, empty):
    key = "AKIA" + "Q7" * 8
    texts = [
        f"é {key} then secret = 'abcdef' and user: bob", f"{key}X token=abc passwd:abcdefgh PASSWORD=\"x.y-z_9\"", "secret:token:abcdefgh secret:token=abcdefgh",
        "0123456789abcdef01234567 x 0123456789abcdef0123456", f"{'Ab1' * 12} alone", f"login=ada {'Ab1' * 12} https://api.example.com/x",
        f"login=ada{' ' * 400}{'Ab1' * 12}", "https://api.example.com only", "user=abc " * 50 + "deadbeef" * 4, None, "", "😀 token: aaaaaaaa " * 30,
    ]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z"), (None, texts[1], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    found = secret_scan.scan(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [(x.start, x.kind, x.end) for x in r.secret_spans] == brute.all_spans(r.text)
    clean = secret_scan.redacted(docs)
    assert clean.columns == docs.columns
    assert sorted(map(repr, clean.select("doc_id", "text").collect())) == sorted(
        map(repr, spark.createDataFrame([(i, brute.redact(t)) for i, t, _ in rows], "doc_id long, text string").collect())
    )
    assert secret_scan.scan(empty).count() == 0 and secret_scan.redacted(odd).count() == odd.count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark, odd):
    for df in (secret_scan.scan(odd), line_dedup.dedup(odd)):
        assert "Python" not in _plan(df) and "Arrow" not in _plan(df) and "Pandas" not in _plan(df)


def test_line_blocks(spark):
    r = random.Random(5)
    lists = [[f"w{r.randrange(900)}" for _ in range(n)] for n in (2, 4, 5, 7, 8, 9, 16, 17, 63, 126, 254, 255, 700)]
    lists += [["a", "b", "c", "d", "e"], ["word"] * 9, [chr(0x4E00 + r.randrange(3000)) * 3 for _ in range(30)]]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lists)] * 3, "line long, norm string")
    got = [(r.key, r.line) for r in line_dedup.blocks(rows).collect()]
    assert len(got) == len(set(got))
    same = {}
    for key, line in got:
        same.setdefault(key, set()).add(line)
    for i, w in enumerate(lists):
        assert sum(line == i for _, line in got) == len(brute.line_blocks(w))
    want = {}
    for i, w in enumerate(lists):
        for key in brute.line_blocks(w):
            want.setdefault(key, set()).add(i)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, want.values()))


def test_line_runs(spark):
    r = random.Random(6)
    lists = [["".join(r.choice("abcé") for _ in range(r.randint(1, 9))) for _ in range(n)] for n in (4, 5, 6, 7, 8, 9, 10, 11, 12, 40, 300) for _ in range(4)]
    lists += [["a", "b", "c", "d", "e"], ["word"] * 9, ["x" * 90] * 5, [chr(0x4E00 + r.randrange(3000)) * 3 for _ in range(30)]]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lists)] * 3, "line long, norm string")
    got = sorted((r.line, r.key) for r in line_dedup.runs(rows).collect())
    assert got == sorted((i, k) for i, w in enumerate(lists) for k in brute.line_runs(w))


def _fuzzy_documents():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    base = [[r.choice(words) for _ in range(n)] for n in (5, 12, 40, 90, 150, 500) for _ in range(6)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(3):
            line = list(r.choice(base))
            if r.random() < 0.6:
                at = r.randrange(len(line))
                line[at] = line[at][:-1] + r.choice("xyz")
            lines.append(" ".join(line).capitalize() + r.choice([".", "!", " 12", ""]))
        rows.append((i, "\n".join([*lines, "short line", ""])))
    return rows


def test_lines_against_plain_python(spark, documents):
    for rows in (documents, _fuzzy_documents()):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
        assert got == brute.dedup_lines(rows)


def test_lines_query(spark, documents):
    want = brute.dedup_lines(documents)
    count = lambda t: len(t.split("\n")) if t else 0
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text_sha256) for r in queries.op6_lines(spark, brute.FOLDER).collect()}
    assert got == {i: (count(t), count(want[i]), brute.sha(want[i]) if want[i] is not None else None) for i, t in documents}


def test_lines_odd_rows(spark, odd, empty):
    out = line_dedup.dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    by = {r.doc_id: r.text for r in out.where("doc_id IS NOT NULL").collect()}
    assert by[1] is None and by[2] == "" and by[4] == by[5] == ""  # the line stays where it is first: with the null id
    assert sorted(r.text or "" for r in out.where("doc_id IS NULL").collect()) == ["", "one two"]
    assert by[6] and by[7] == "some other line that is here only once"
    assert line_dedup.dedup(empty).count() == 0
    twice = spark.createDataFrame([(None, "these five words stand here"), (3, "These five words, stand here!"), (3, "These five words, stand here!")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup(twice).collect()) == [(0, "these five words stand here"), (3, ""), (3, "")]

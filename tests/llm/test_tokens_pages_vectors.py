"""Archives, tokens, packing, page text, licenses and vectors."""

import gzip
import random
import sys
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from checks import difference, duck
from tokenizers import Tokenizer

from featureflow.llm import bpe, html_text, licenses, packing, queries, vectors, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = [
    None, "", " ", "\n\n  x  ", "a  b\t\tc  d", "it's WE'LL they'Re", "Ünïcödé ΣΑΣ İstanbul ǅ ﬁ é Å", "日本語テキスト 한국어", "👩‍👩‍👧 ok🙂",
    "<|endoftext|>", "a <|endoftext|>  b<|startoftext|>c <|endoftex", "1234567890 ½ ² x2y", "\x00\x01\x1c\x1d\x85 end", "a" * 5000, "ab" * 3000 + "!" * 40, "x" * 999 + " " + "y" * 1001,
    "foo\r\nbar　baz", "''''s 's't", "ſecret K",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{brute.FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


def test_warc_matches_sql(spark):
    assert difference(queries.op2_warc(spark, brute.FOLDER), duck(brute.FOLDER), queries.ORACLE["op2_warc"]) is None


def test_warc_ranges_and_odd_rows(spark, tmp_path):
    r = random.Random(4)
    noise = "".join(chr(r.randrange(32, 0x2FF)) for _ in range(200_000))
    rows = [(1, "http://x/ é\r\nInjected: y", "<p>a</p>", 9), (2, None, None, 9), (3, "u", "", 9), (4, "u", "<p>a</p>", 9), (None, "u", "<p>a</p>", 9),
            (4, "u", "<p>a</p>", 9), (5, "u", noise, 9), (6, "v", noise, 9), (None, None, "only without id", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, keeper int")
    files = warc.write_warc(pages, str(tmp_path / "w"), file_bytes=150_000)
    whole = sorted(map(repr, warc.read_warc(files).drop("file").collect()))
    assert len(whole) == len(rows) and files.agg({"records": "sum"}).first()[0] == len(rows)
    for size in (97, 5000):
        assert sorted(map(repr, warc.read_warc(files, range_bytes=size).drop("file").collect())) == whole
    by = {}
    for x in warc.read_warc(files).collect():
        by.setdefault(x.fields.get("page"), []).append(x)
    assert [x.record_type for x in by["4"]] == ["response"] * 2 and by["1"][0].record_type == "revisit"
    assert by["1"][0].fields["refers-to-page"] == "4" and by["1"][0].payload_bytes == 8 and "injected" not in by["1"][0].fields
    assert by["6"][0].payload.decode() == noise and by["5"][0].payload_digest == warc.payload_digest(noise.encode())
    assert by["2"][0].payload_bytes == 0 and sorted(x.record_type for x in by[None]) == ["response", "revisit"]
    small = warc.read_warc(warc.write_warc(pages, str(tmp_path / "s"), min_bytes=100))
    assert small.where("record_type = 'revisit'").count() == 1
    assert warc.read_warc(warc.write_warc(pages.limit(0), str(tmp_path / "e"))).count() == 0
    listed = warc.archives(spark, str(tmp_path / "w"))
    assert warc.read_warc(listed).count() == len(rows)


def test_warc_false_magic_and_damage(spark, tmp_path):
    inner = warc.member(warc.record("9", "u", b"inner", "D", None, None, "k", "d"))
    assert warc.is_head(inner) and not warc.is_head(b"\x1f\x8b\x08 not a member") and not warc.is_head(gzip.compress(b"other"))
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = warc.record("1", "u", inner, "D", None, None, "k", "d")
    assert inner in stored.compress(outer) + stored.flush()
    packed = warc.member(outer, level=0)
    assert inner not in packed
    good = warc.member(warc.record("2", "u", b"good", "D", None, None, "k", "d"))
    (tmp_path / "x.warc.gz").write_bytes(packed + b"\x1f\x8b\x08junk" + good + good[: len(good) - 9])
    rows = warc.read_warc(warc.archives(spark, str(tmp_path))).orderBy("offset").collect()
    assert [r.fields and r.fields["page"] for r in rows] == ["1", "2", None] and rows[2].error and rows[0].payload == inner


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_librarys(texts, path, monkeypatch):
    library, own = Tokenizer.from_file(path), bpe.Bpe(path)
    r = random.Random(6)
    rows = ODD_TEXTS + [t for _, t in texts] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x20, 0x600), 32, 10])) for _ in range(80)) for _ in range(300)]
    for text in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert own.encode(text or "").tolist() == want, text
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) or path == WORD
    monkeypatch.setattr(bpe, "TOGETHER", 7)
    for text in ODD_TEXTS[:13]:
        assert own.encode(text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_letters_are_the_librarys():
    """Every letter of the basic plane is split as by the library."""
    library, own = Tokenizer.from_file(BYTE), bpe.Bpe(BYTE)
    for start in range(0, 0x10000, 0x400):
        text = "".join(f"a{chr(c)}1" for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000)
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(start)


def test_plain_words_are_joined_without_a_step_for_each():
    own, text = bpe.Bpe(WORD), "the cat sat on a mat " * 2000
    own.encode(text)
    calls = []
    sys.setprofile(lambda *event: calls.append(event[1]))
    try:
        own.encode(text)
    finally:
        sys.setprofile(None)
    assert len(calls) < 1000
    assert own.encode(f"{text}<|endoftext|>a").tolist() == Tokenizer.from_file(WORD).encode(f"{text}<|endoftext|>a", add_special_tokens=False).ids


def test_bpe_query_and_odd_rows(spark, texts):
    library = Tokenizer.from_file(BYTE)
    odd = [(i, t, "x") for i, t in enumerate(ODD_TEXTS)] + [(None, "again", "y"), (0, None, "z")]
    frame = spark.createDataFrame(odd, "doc_id long, text string, ids string")
    got = bpe.round_trip(frame, BYTE).collect() + queries.op4_bpe(spark, brute.FOLDER).collect()
    assert [r.doc_id for r in got[: len(odd)]] == [i for i, _, _ in odd]
    known = dict(texts)
    for row, text in zip(got, [t for _, t, _ in odd] + [known[r.doc_id] for r in got[len(odd) :]]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), brute.sha(",".join(map(str, ids))))
        assert row.decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False))
    back = bpe.with_decoded(bpe.with_tokens(frame, BYTE), BYTE).collect()
    assert [r.text for r in back] == [t or "" for _, t, _ in odd]
    assert bpe.round_trip(frame.limit(0), BYTE).count() == 0


def _held(rows, texts, length):
    """Checks the pieces of (doc_id, text) rows with distinct ids; returns the tokens missing in sequences."""
    library = Tokenizer.from_file(WORD)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts}
    by, windows = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(ids)
    for i, pieces in by.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            part = np.array(ids[i][p.start : p.start + p.length], "<u4").tobytes()
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[i]) and p.ids_crc32 == zlib.crc32(part)
            at += p.length
        assert at == len(ids[i])
    missing = 0
    for pieces in windows.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        missing += length - at
    return missing, len(windows)


def test_packing_query(spark, texts):
    missing, sequences = _held(queries.op9_packing(spark, brute.FOLDER).collect(), texts, 4096)
    assert missing < 0.02 * 4096 * sequences + 4096


def test_packing_many_tasks_and_odd_rows(spark, texts):
    rows = [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + texts
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    missing, sequences = _held(packing.pack(frame, WORD, 2, length=256, windows=3, least_cut=8).collect(), rows, 256)
    assert missing < 0.01 * 256 * sequences + 256
    twice = spark.createDataFrame([(None, None, 1), (None, None, 1), (5, "a b", 2)], "doc_id long, text string, offset int")
    got = packing.pack(twice, WORD, 2)
    assert "offset" in got.columns and sorted((r.doc_id or 0, r.length, r.doc_tokens) for r in got.collect()) == [(0, 1, 1), (0, 1, 1), (5, 3, 3)]
    assert packing.pack(twice.limit(0), WORD, 2).count() == 0


def test_page_text_on_unseen_layouts(spark):
    r = random.Random(77)
    model, right, total = html_text.default_model(), 0, 0
    for _ in range(200):
        found, labels = html_text.labelled(*html_text.labelled_page(r))
        got = model.decode(found)
        right, total = right + sum(a == b for a, b in zip(labels, got)), total + len(labels)
    assert right > 0.98 * total


def test_page_text_is_the_article(spark):
    rows = {r.page_id: r for r in queries.op10_html(spark, brute.FOLDER).collect()}
    for page in spark.read.parquet(f"{brute.FOLDER}/pages.parquet").collect():
        body = page.html.partition("<article>")[2].partition("</article>")[0]
        want = [b.text for b in html_text.blocks(body)]
        assert rows[page.page_id].text == "\n\n".join(want) and rows[page.page_id].n_chars == len("\n\n".join(want))


def test_viterbi_is_the_best_path():
    model = html_text.default_model()
    found, _ = html_text.labelled(*html_text.labelled_page(random.Random(12)))
    found = found[:9]
    own = [sum(model.weights.get(f, 0.0) for f in row) for row in html_text.features(found)]

    def score(path):
        total = model.start[path[0]]
        return total + sum(own[t] for t, y in enumerate(path) if y) + sum(model.moves[a][b] for a, b in zip(path, path[1:]))

    paths = [[n >> t & 1 for t in range(len(found))] for n in range(1 << len(found))]
    assert score(model.decode(found)) == pytest.approx(max(map(score, paths)))


def test_odd_pages(spark):
    cases = {
        "": [], "plain": ["plain"], "<p>a<p>b &amp; c &amp &#233;&nbsp;d": ["a", "b & c & é d"], "<ul><li>x<li>y</ul>": ["x", "y"],
        "<p>a<br>b<b>c</b>d<!-- <p>no --> e</p><script>if (a<b) '</p>'</script><style>x{}</style>": ["a bcd e"],
        "<div>1 < 2 and <a href='>'>link</a></div": ["1 < 2 and link"], "<title>t</title><p>x<textarea>no</textarea>": ["x"], "<p>cut <a hre": ["cut"],
        "<!DOCTYPE html><table><tr><td>a<td>b<tr><td>c</table>": ["a", "b", "c"],
    }
    for page, want in cases.items():
        assert [b.text for b in html_text.blocks(page)] == want
    frame = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (None, "<article><p>Some words stand here, and here.</p></article>" + "<div>" * 3000, "t")], "page_id long, html string, text string")
    got = html_text.extract(frame)
    assert sorted(got.columns) == ["html", "n_chars", "page_id", "text"]
    assert sorted(r.text for r in got.collect()) == ["", "", "Some words stand here, and here."]
    assert html_text.extract(frame.limit(0)).count() == 0


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"]
    changed = mit.replace("without restriction", "with no limits at all").replace("sell copies", "sell")
    rows = [
        (1, f"é İ Intro. {mit} Outro", "x"), (2, f"{changed}\n\nReleased under the MIT License.", "x"), (3, mit[: len(mit) // 2], "x"), (4, None, "x"), (5, "", "x"),
        (6, "Licensed under CC BY-NC 4.0. " * 3, "x"), (6, "Licensed under CC BY-NC 4.0. " * 3, "x"), (None, licenses.TEMPLATES["bsd-3-clause"], "x"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [m.license for m in by[1]] == ["mit"] and by[1][0].coverage == 1.0
    assert rows[0][1][by[1][0].start_pos : by[1][0].end_pos] == mit.strip(".")
    assert [m.license for m in by[2]] == ["mit", "mit-notice"] and 0.8 < by[2][0].coverage < 1
    assert set(by) == {1, 2, 6, None} and [m.license for m in by[6]] == ["cc-by-nc-4.0-notice"] * 6
    assert [m.license for m in by[None]] == ["bsd-3-clause"]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_alignment_against_plain_subsequence():
    r = random.Random(9)
    for _ in range(40):
        template = np.array([r.randrange(1, 9) for _ in range(12)])
        text = [x for x in template.tolist() if r.random() < 0.85]
        for _ in range(2):
            text.insert(r.randrange(len(text) + 1), r.randrange(1, 9))
        table = np.zeros((13, len(text) + 1), int)
        for i, a in enumerate(template):
            for j, b in enumerate(text):
                table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
        assert licenses.align(template, np.array(text), 0, 20)[0] == table[-1, -1]


def test_license_query_finds_every_notice(spark, texts):
    rows = queries.op7_licenses(spark, brute.FOLDER).collect()
    scanner = licenses.Scanner(licenses.TEMPLATES)
    want = {(i, m.license, m.start, m.end) for i, t in texts for m in scanner.scan(t)}
    assert {(r.doc_id, r.license, r.start_pos, r.end_pos) for r in rows} == want
    notices = ("Released under the MIT License", "Licensed under the Apache License, Version 2.0", "GNU General Public License, version 3", "Licensed under CC BY-NC 4.0")
    assert {i for i, t in texts if t and any(n in t for n in notices)} <= {r.doc_id for r in rows}


def _links(rows, cosine):
    ok = {i: np.array(v, np.float64) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(ok)
    unit = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    return ids, (unit @ unit.T >= cosine) & ~np.eye(len(ids), dtype=bool)


@pytest.mark.parametrize("cell,block", [(1024, 2048), (64, 40)])
def test_vectors_against_all_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = np.random.default_rng(3)
    base = r.standard_normal((150, 64))
    near = np.concatenate([base[i] + 0.25 * r.standard_normal((6, 64)) for i in range(60)])
    dense = base[0] + 0.1 * r.standard_normal((200, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, dense]))]
    copies = [(5000 + i, rows[3][1]) for i in range(30)]
    ids, linked = _links(rows + copies, 0.9)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows + copies, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows) + len(copies)
    want = linked.sum(axis=1)
    found = np.array([got[i].n_links for i in ids])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    sets = brute.Sets()
    for a, b in zip(*np.nonzero(linked)):
        sets.join(ids[a], ids[b])
    same = sum(got[i].component_id == sets.find(i) for i in ids)
    assert same >= 0.97 * len(ids) and all(got[i].component_id >= sets.find(i) for i in ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vector_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{brute.FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, linked = _links(rows, 0.9)
    got = {r.vec_id: r.n_links for r in queries.op8_vectors(spark, brute.FOLDER).collect()}
    assert set(got) == {i for i, _ in rows} and sum(got.values()) >= 0.9 * linked.sum()


def test_odd_vectors(spark):
    one, nan = [1.0, 0.0], float("nan")
    rows = [(1, one, 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [1.0, None], 1), (8, [float("inf"), 1.0], 1),
            (None, one, 1), (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 1.0], 1), (11, [1e300, 1e300], 1)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, weight int")).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[None] == (3, 1, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)) and by[10][1] == 10
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0

"""Personal data against the contract's patterns and a plain count of all word positions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import brute
from featureflow.llm import pii, queries

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def holds(kind, found):
    digits = [int(x) for x in re.findall("[0-9]", found)]
    if kind == 1:
        return all(int(x) <= 255 for x in found.split("."))
    if kind == 2:
        doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if holds(k, m[0]))


def name(kind, found):
    if kind == 0:
        return "email:" + found.lower()
    return f"{pii.KINDS[kind]}:" + (".".join(str(int(x)) for x in found.split(".")) if kind == 1 else "".join(re.findall("[0-9]", found)))


def plain_words(text):
    covered = {i for s, _, e in base(text) for i in range(s, e)}
    return [m for m in re.finditer(r"[^\W_]{2,}", text or "") if not covered & set(range(m.start(), m.end()))]


def disclosed(texts, reach=10, support=3):
    """{(entity, term): disclosure} over all positions of all texts."""
    total, single, both, covered, evidence = 0, Counter(), Counter(), Counter(), defaultdict(set)
    forms = lambda w: [w, *(w[:n] + "*" * (len(w) - n) for n in range(1, len(w)) if re.search("[0-9]", w))]
    for text in texts:
        told = plain_words(text)
        total += len(told)
        lower = [m[0].lower() for m in told]
        for w in lower:
            single.update(forms(w))
        near = defaultdict(set)
        for s, k, e in base(text):
            before = [i for i, m in enumerate(told) if m.end() <= s][-reach:]
            near[name(k, text[s:e])] |= {*before, *[i for i, m in enumerate(told) if m.start() >= e][:reach]}
        for c, places in near.items():
            covered[c] += len(places)
            runs, last = [], None
            for i in sorted(places):
                runs = runs + [[i]] if last is None or i != last + 1 else runs[:-1] + [runs[-1] + [i]]
                last = i
            for run in runs:
                context = tuple(lower[i] for i in run)
                for w in context:
                    for t in forms(w):
                        both[c, t] += 1
                        evidence[c, t].add(context)
    out = {}
    for (c, t), n in both.items():
        own = math.log(total / covered[c])
        if len(evidence[c, t]) >= support:
            out[c, t] = math.log(n * total / (single[t] * covered[c])) / own if own > 0 else 0.0
    return out


def spans(text, found, least=0.97):
    text = text or ""
    out = base(text)
    here = {name(k, text[s:e]) for s, k, e in out}
    telling = {t for (c, t), d in found.items() if c in here and d >= least}
    return sorted(out + [(m.start(), 4, m.end()) for m in plain_words(text) if m[0].lower() in telling])


def test_patterns_on_random_texts():
    r = random.Random(2)
    parts = ["1", "22", "255", "256", "0003", ".", ".", " ", "-", "@", "a", "b.c", "%", "+", "(", ")", "4111111111111111", "\n", "é", "x@y.z", "+1 (555) 123", "\t", "_", "٣"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert pii.base_spans(text) == base(text), text
    for text in ("9" * 200_000, "1." * 100_000, "a@" * 100_000, "+" * 100_000, "a" * 200_000 + "@", "1 " * 100_000):
        pii.base_spans(text)


def test_query_against_plain_python(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{brute.FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    found = disclosed([t for _, t in rows])
    names = (*pii.KINDS, "term")
    want = {}
    for i, t in rows:
        all_spans = spans(t, found)
        told = lambda x: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in x)
        counts = [sum(k == n for _, k, _ in all_spans) for n in range(4)]
        want[i] = (*counts, hashlib.sha256(told(base(t or "")).encode()).hexdigest(), told(all_spans))
    got = queries.op11_pii(spark, brute.FOLDER)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def corpus():
    r = random.Random(6)
    plain = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(plain) for _ in range(n))
    rows = [(i, line(r.randint(0, 60))) for i in range(400)]
    for i in range(12):  # Kellermann and flat 8817 are told near one address only, Weber everywhere
        rows.append((1000 + i, f"{line(20)} Kellermann {line(3)} flat 8817 anna.k@mail.example.org {line(4)} Weber {line(30)}"))
        rows.append((2000 + i, f"{line(15)} Weber {line(15)}"))
        rows.append((4000 + i, f"{line(9)} user{i}@mail.example.org {line(9)}"))
    rows += [(3000 + i, "once xylophone qwertz 10.0.0.1 copied copied") for i in range(50)]  # copies are one piece of evidence
    return rows + [(None, None), (None, ""), (7, rows[7][1]), (1003, rows[400 + 3][1])]


def test_terms_that_reveal(spark):
    rows = corpus()
    found = disclosed([t for _, t in rows])
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, kind int").repartition(6)
    got = sorted(((r.doc_id, r.text, [tuple(s) for s in r.spans]) for r in pii.scan(frame).collect()), key=str)
    assert got == sorted(((i, t or "", spans(t, found)) for i, t in rows), key=str)
    terms = {(i, t[s:e]) for i, t, x in got for s, k, e in x if k == 4}
    assert {"Kellermann", "8817", "flat"} <= {t for _, t in terms} and not {"Weber", "xylophone"} & {t for _, t in terms}
    assert all(1000 <= i < 1012 for i, _ in terms)
    told = {(r.entity, r.term): r.disclosure for r in pii.disclosures(frame).collect()}
    assert told.keys() == found.keys() and all(abs(told[k] - found[k]) < 1e-9 for k in told)
    assert pii.scan(frame.limit(0)).count() == 0


def test_counting_without_a_list_of_terms(spark, monkeypatch):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string")
    few = sorted(map(str, pii.disclosures(frame).collect()))
    monkeypatch.setattr(pii, "SENT", 0)
    assert sorted(map(str, pii.disclosures(frame).collect())) == few


def test_sanitised(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, general string, terms int")
    out = pii.sanitised(frame, generality=0.95)
    assert out.columns == frame.columns and out.count() == len(rows)
    by = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    hidden = by[1003]
    assert "Kellermann" not in hidden and "anna.k" not in hidden and "8817" not in hidden and "[TERM]" in hidden
    assert "*@mail.example.org" in hidden and "Weber" in hidden
    assert by[3000] == "once xylophone qwertz [IP] copied copied"
    assert by[5] == rows[5][1] and sorted(str(r.text) for r in out.where("doc_id IS NULL").collect()) == ["", "None"]

"""Plain Python versions of the operators on small tables, written from their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

from featureflow.llm.quality import STOP_WORDS

FOLDER = "/root/testdata/sf0.001"
SPACES = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    """Union-find with the smallest member as root."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def fingerprint(text, n):
    words = re.findall(SPACES, (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, n, distance=3):
    """{doc_id: (fingerprint, component)} for (doc_id, text) rows with distinct ids."""
    prints = {i: fingerprint(t, n) for i, t in rows}
    sets, ids = Sets(), sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    for a, i in enumerate(ids):
        for b in np.nonzero(np.bitwise_count(values ^ values[a]) <= distance)[0]:
            sets.join(i, ids[b])
    return {i: (prints[i], sets.find(i)) for i in ids}


def measures(text):
    text = text or ""
    words, lines = re.findall(SPACES, text), [x for x in text.split("\n") if re.search(SPACES, x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_stop_words": sum(w.lower() in STOP_WORDS for w in words),
        "n_bullet_lines": sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines),
        "n_open_lines": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines),
    }


def verdict(m):
    failed = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
    n, lines = m["n_words"], m["n_lines"]
    if failed:
        return True, False
    good = (
        2 <= m["word_chars"] / n <= 14 and m["n_symbols"] / n <= 0.1 and m["n_stop_words"] / n >= 0.02
        and m["n_dup_lines"] / lines <= 0.3 and m["n_bullet_lines"] / lines <= 0.9 and m["n_open_lines"] / lines <= 0.3
    )
    return False, good


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def all_spans(text, scope=300):
    """Base spans and linked weak ones: (start, kind, end)."""
    text = text or ""
    base = base_spans(text)
    weak = [(m.start(), 3, m.end()) for m in re.finditer(
        r"""(?<![A-Za-z0-9])(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", text)]
    weak += [(m.start(), 4, m.end()) for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}", text)
             if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0])]
    weak += [(m.start(), 5, m.end()) for m in re.finditer(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._~:@%-]{3,}", text)]
    part = {0: "s", 1: "i", 2: "s", 3: "i", 4: "s", 5: "e"}
    for s, k, e in weak:
        near_parts = {part[k2] for s2, k2, _ in base + weak if abs(s2 - s) <= scope and part[k2] != part[k]}
        if (part[k] == "e" and {"s", "i"} <= near_parts) or (part[k] == "s" and "i" in near_parts) or (part[k] == "i" and "s" in near_parts):
            base = base + [(s, k, e)]
    return sorted(base)


def redact(text, mark="[SECRET]"):
    if text is None:
        return None
    out, at = [], 0
    for s, _, e in all_spans(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def spark_hash(value):
    return xxhash.xxh64_intdigest(value.encode(), 42)


def normal(line):
    """Words of a line as they are compared; none if it has no letter or digit."""
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", re.sub("[0-9]+", "0", line.lower())) if w]


def line_blocks(words):
    """The keys of a line: (blocks, block, SimHash of the block's words)."""
    import regex

    letter = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*"
    if any(c >= "\u0e00" for w in words for c in w):
        words = [w for x in words for w in regex.sub(f"({letter})", r" \1 ", x).split()]
    if len(words) < 5:
        return set()
    told, keys = sorted(set(words)), set()
    size = lambda found: sum(len(w.encode()) + 1 for w in found)
    for n in (len(told), (11 * len(told) + 9) // 10):
        bits, shares = max(1, ((n - 1) // 6).bit_length()), {}
        for w in told:
            shares.setdefault(spark_hash(w) >> 20 & ((1 << bits) - 1), []).append(w)
        for k, found in shares.items():
            weight = size(found) + sum(4 for w in found if len(w.encode()) >= 3 * len(w))
            if weight >= min(26, (size(told) + 1) // 2):
                hashes = [spark_hash(w) & ((1 << 56) - 1) for w in found]
                print_ = sum(1 << b for b in range(56) if 2 * sum(h >> b & 1 for h in hashes) > len(found))
                keys.add((bits, k, print_))
    return keys


def line_runs(words):
    """The keys of a line by runs: the six smallest hashes (signed) of runs of whole words of 26 characters, or of 14 in short lines."""
    import regex

    letter = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*"
    if any(c >= "\u0e00" for w in words for c in w):
        words = [w for x in words for w in regex.sub(f"({letter})", r" \1 ", x).split()]
    text, keys = " ".join(words), set()
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == " ")]
    for least, use in ((26, len(text) >= 52), (14, len(text) < 65)):
        ends = [(i, text.find(" ", i + least)) for i in starts if len(text) - i >= least]
        hashes = {spark_hash(text[i : e if e >= 0 else None]) for i, e in ends}
        keys |= set(sorted(h - (h >> 63 << 64) for h in hashes)[:6]) if use and len(words) >= 5 else set()
    return keys


def dedup_lines(rows):
    """{doc_id: text} for (doc_id, text) rows with distinct ids."""
    places, sets, blocks, runs = [], Sets(), {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        for at, line in enumerate((text or "").split("\n")):
            if words := normal(line):
                places.append((" ".join(words), i, at))
                for key in line_blocks(words):
                    blocks.setdefault(key, set()).add(places[-1][0])
                for key in line_runs(words):
                    runs.setdefault(key, set()).add(places[-1][0])
    pairs = {(x, y) for found in blocks.values() for x in found for y in found if x < y}
    for found in runs.values():  # the line with the smallest hash meets the others
        first = min(found, key=lambda x: spark_hash(x) - (spark_hash(x) >> 63 << 64))
        pairs |= {(min(first, y), max(first, y)) for y in found if y != first}
    for x, y in edits(pairs):
        sets.join(x, y)
    seen, gone = set(), set()
    for norm, i, at in places:
        root = sets.find(norm)
        if root in seen:
            gone.add((i, at))
        seen.add(root)
    return {i: t if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone) for i, t in rows}


def edits(pairs):
    """The pairs within a fifth of the longer length in edit distance, by DuckDB."""
    import duckdb
    import pandas as pd

    told = pd.DataFrame(sorted(pairs), columns=["x", "y"])  # noqa: F841
    near = "levenshtein(x, y) <= floor(0.2 * greatest(length(x), length(y)) + 1e-9)"
    return duckdb.sql(f"SELECT x, y FROM told WHERE {near}").fetchall() if len(pairs) else []


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()

"""Byte-level BPE: batches of words merged in numpy rounds, and decoding back.

The symbols of many distinct words lie in one flat array. A round finds the rank of every adjacent pair
by binary search over the sorted pair keys, the lowest rank of each word by a segmented minimum, merges
all its occurrences from the left, and drops words that have nothing left to merge.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The split before merging of a byte-level pre-tokenizer that names no pattern; a fixed value of the format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Distinct words whose ids a process remembers, and words it handles at once.
REMEMBERED = 400_000
TOGETHER = 200_000
# Longer words are merged one by one with a heap: their rounds would be as many as their pairs.
LONG = 1000
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _folding(spec: dict | None, pattern: regex.Pattern) -> Callable[[str], str] | None:
    """The normaliser of a tokenizer file, for the kinds known here.

    Making white space one space changes no word if the pattern of words matches none of it, and is left out then.
    """
    if spec is None:
        return None
    steps = []
    for part in spec["normalizers"] if spec["type"] == "Sequence" else [spec]:
        if part["type"] == "NFC":
            steps.append(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))
        elif part["type"] == "Lowercase":  # letter by letter: a final sigma is not a case of its own
            steps.append(lambda t: t.replace("Σ", "σ").lower())
        elif part["type"] == "Replace" and part["pattern"] == {"Regex": "\\s+"}:
            spaces = "".join(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
            if part["content"] != " " or pattern.search(spaces):
                steps.append(lambda t, s=part["content"], p=regex.compile(r"\s+"): p.sub(s, t))
        else:
            raise ValueError(f"unknown normaliser {part}")

    def fold(text: str) -> str:
        for step in steps:
            text = step(text)
        return text

    return fold


class Bpe:
    """A tokenizer file's merges; `encode` and `decode` give what the tokenizers library gives for it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.size = max(vocab.values()) + 1
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        parts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        named = [p["pattern"]["Regex"] for p in parts if p["type"] == "Split"]
        self.pattern = regex.compile(named[0] if named else BYTE_LEVEL)
        self.fold = _folding(spec["normalizer"], self.pattern)
        # A named pattern knows code points of its own Unicode version; texts with others go to the library.
        self.path, self.library, self.usual = (path if named else None), None, set()
        back = {c: i for i, c in enumerate(letters)}
        table = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes = [table.get(i, b"") for i in range(max(table) + 1)]
        self.known: dict[str, bytes] = {}

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each (non-empty) word, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.first[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        for w in np.nonzero(sizes > LONG)[0]:
            out[w] = self._one(symbols[ends[w] - sizes[w] : ends[w]].tolist())
        word = np.repeat(np.arange(len(words)), sizes)
        symbols, word = symbols[(short := sizes[word] <= LONG)], word[short]
        while len(symbols):
            starts = np.nonzero(np.diff(word, prepend=-1))[0]
            at = self._lookup(symbols[:-1] * self.size + symbols[1:])
            at = np.append(np.where(word[:-1] == word[1:], at, -1), -1)
            rank = np.where(at >= 0, self.ranks[at], _NONE)
            lengths = np.diff(starts, append=len(symbols))
            best = np.minimum.reduceat(rank, starts)
            if (over := best == _NONE).any():
                flat = symbols.astype("<u4")
                for s, n in zip(starts[over].tolist(), lengths[over].tolist()):
                    out[word[s]] = flat[s : s + n].tobytes()
            alive = np.repeat(~over, lengths)
            hit = (rank == np.repeat(best, lengths)) & alive
            where = np.nonzero(hit)[0]
            if len(where) > 1:  # of overlapping equal pairs every second one merges
                fresh = np.diff(where, prepend=-2) != 1
                run = np.arange(len(where)) - np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
                where = where[run % 2 == 0]
            symbols[where] = self.made[at[where]]
            alive[where + 1] = False
            symbols, word = symbols[alive], word[alive]
        return out

    def _one(self, symbols: list[int]) -> bytes:
        """One long word: pairs leave a heap by rank and place."""
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def push(places: list[int]) -> None:
            keys = np.array([symbols[p] * self.size + symbols[after[p]] for p in places], np.int64)
            for p, i in zip(places, self._lookup(keys).tolist()):
                if i >= 0:
                    heapq.heappush(heap, (int(self.ranks[i]), p, symbols[p], symbols[after[p]]))

        push(list(range(len(symbols) - 1)))
        while heap:
            _, p, left, right = heapq.heappop(heap)
            q = after[p]
            if symbols[p] != left or q < 0 or symbols[q] != right:
                continue
            symbols[p] = int(self.made[self._lookup(np.array([left * self.size + right]))[0]])
            symbols[q], after[p] = -1, after[q]
            if after[p] >= 0:
                before[after[p]] = p
            push([x for x in (before[p], p) if x >= 0 and after[x] >= 0])
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()

    def packed(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word; distinct words are merged once and remembered."""
        known = self.known
        if new := list(set(words).difference(known)):
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(words))
            known.update(zip(new, self.merge([w.encode() for w in new])))
        return list(map(known.__getitem__, words))

    def words(self, text: str) -> Iterator[str | int]:
        """Words in order; a special token's text is its id."""
        pieces: list[str | int] = [text]
        if self.cut and (found := list(self.cut.finditer(text))):
            borders = [0, *itertools.chain.from_iterable(m.span() for m in found), len(text)]
            pieces = []
            for i, m in enumerate([*found, None]):
                pieces.append(text[borders[2 * i] : borders[2 * i + 1]])
                if m:
                    pieces.append(self.special[m[0]])
        for piece in pieces:
            if isinstance(piece, int):
                yield piece
            else:
                yield from map(_whole, self.pattern.finditer(self.fold(piece) if self.fold else piece))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(p for _, p in self.encode_many([text])), "<u4")

    def encode_many(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """(index of the text, packed ids of its next words), in order, at most TOGETHER words at once."""
        chunks = ((i, w) for i, t in enumerate(texts) for w in ([_Ids(self._library(t))] if self._strange(t) else self._chunks(t)))
        for group in _grouped(chunks):
            flat = iter(self.packed([w for _, ws in group for w in (filter(_is_word, ws) if type(ws) is _Ids else ws)]))
            for i, ws in group:
                if type(ws) is _Ids:
                    yield i, b"".join(next(flat) if _is_word(w) else w.to_bytes(4, "little") for w in ws)
                else:
                    yield i, b"".join(itertools.islice(flat, len(ws)))

    def _strange(self, text: str) -> bool:
        """Whether a text has code points without a category, which pattern and library may class differently."""
        if self.path is None or text.isascii():
            return False
        new = set(text) - self.usual
        strange = {c for c in new if unicodedata.category(c) == "Cn"}
        self.usual |= new - strange
        return bool(strange)

    def _library(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids

    def _chunks(self, text: str) -> Iterator[list[str | int]]:
        if len(text) <= TOGETHER and not (self.cut and self.cut.search(text)):
            yield self.pattern.findall(self.fold(text) if self.fold else text)
            return
        words = self.words(text)
        while chunk := _Ids(itertools.islice(words, TOGETHER)):
            yield chunk

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Ids(list):
    """Words among which there may be ids; a plain list of words has none."""


def _is_word(word: str | int) -> bool:
    return not isinstance(word, int)


def _whole(match) -> str:
    return match[0]


def _grouped(chunks: Iterable[tuple[int, list]]) -> Iterator[list[tuple[int, list]]]:
    group, held = [], 0
    for i, words in chunks:
        group.append((i, words))
        held += len(words)
        if held >= TOGETHER:
            yield group
            group, held = [], 0
    if group:
        yield group


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The tokenizer of a file, once per process."""
    return Bpe(path)


def with_tokens(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append the ids of a text column as array<int>; null text gives an empty array. No shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            parts: list[list[bytes]] = [[] for _ in texts]
            for i, packed in load(path).encode_many(texts):
                parts[i].append(packed)
            column = pa.array([np.frombuffer(b"".join(p), "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, ids])

    rows = docs.drop(ids)
    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def with_decoded(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Append the text of an array of ids (null: empty text), special tokens kept."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids))
            column = pa.array([load(path).decode(r.values.to_pylist() if r.is_valid else ()) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, text])

    rows = docs.drop(text)
    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text; per row doc_id, n_tokens and digests of both results.

    ids_sha256: hex SHA-256 of the decimal ids joined by commas; decoded_sha256: of the decoded text in
    UTF-8. Null text counts as empty (no ids, empty text). A special token's text is its id. One pass
    without a shuffle, in which a task holds the words of a few texts; repeated rows and null ids are
    returned as they are, other columns are not, and an empty table stays empty.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        decimal = [str(i) for i in range(len(bpe.bytes))]
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(1))
            count = [0] * batch.num_rows
            coded = [hashlib.sha256() for _ in count]
            parts: list[list[bytes]] = [[] for _ in count]
            done, decoded = 0, [hashlib.sha256(b"").hexdigest()] * batch.num_rows
            for i, packed in bpe.encode_many(texts):
                ids = np.frombuffer(packed, "<u4").tolist()
                if ids:
                    coded[i].update(("," * bool(count[i]) + ",".join(map(decimal.__getitem__, ids))).encode())
                    count[i] += len(ids)
                if i != done:
                    decoded[done], parts[done], done = _text_digest(parts[done]), [], i
                parts[i].append(b"".join(map(bpe.bytes.__getitem__, ids)))
            if parts:
                decoded[done] = _text_digest(parts[done])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array([c.hexdigest() for c in coded]), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    fields = [rows.schema["doc_id"], T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")]
    return rows.mapInArrow(digest, T.StructType(fields))


def _text_digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b"".join(parts).decode("utf-8", "replace").encode()).hexdigest()

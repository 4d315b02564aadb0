"""Personal data: certain spans by pattern, and terms that reveal them by information-theoretic sanitisation.

What a pattern finds (addresses, numbers) are the protected entities. Words within REACH words of a mention of an entity c
are its context, over the whole corpus. With word positions as events, p(c) is the share of positions in a context of
c, p(t) the share that holds the term t, and the disclosure of c by t is PMI(c, t) / IC(c) = log(p(c, t) / p(c) p(t)) / -log p(c):
1 if t stands nowhere but near c, 0 if it says nothing about c. Terms whose disclosure reaches a threshold are
reported in the texts that mention c, where they would name it again after c itself has gone. Equal contexts, as in copies of
a text, count as one piece of evidence, and an estimate needs some of them.

`sanitised` generalises before it removes: numbers lose their last digits, and entities their most telling parts, until
the general form discloses little enough by the corpus's own counts.

Each text is read by patterns in Arrow batches; contexts, terms and counts are grouped by Spark, equal contexts first.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.operators.joins import lookup
from featureflow.sources.storage import checkpointed

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Words to each side of a mention that are its context.
REACH = 10
# Different contexts of one entity that a term must stand in before its disclosure is estimated.
SUPPORT = 3
# The disclosure from which a term is reported.
DISCLOSURE = 0.97
# The share of an entity's information that its general form may still carry.
GENERALITY = 0.8
# Candidate terms up to this many are sent to the tasks that count terms; with more, all terms are counted and joined.
SENT = 200_000

# Digits before a number cannot belong to it: a run of digits is matched as a whole or not at all.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
WORD = re.compile(r"[^\W_]{2,}")
DIGITS = re.compile("[0-9]")

FOUND = "array<struct<start:int,kind:int,end:int>>"


def _digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def _luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = (2 * int(x) for x in digits[-2::-2])
    return (sum(map(int, odd)) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from their at signs: each takes what precedes it as far as the pattern allows."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _card(found: str) -> bool:
    digits = _digits(found)
    return 12 <= len(digits) <= 19 and _luhn(digits)


def _ip(found: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in found.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind: leftmost matches of each kind that do not overlap, less those that fail its test."""
    spans = [(start, 0, end) for start, end in _emails(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _ip(m[0])]
    spans += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if _card(m[0])]
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans)


def entity(kind: int, found: str) -> str:
    """One form for all ways to write an entity."""
    told = found.lower() if kind == 0 else ".".join(x.lstrip("0") or "0" for x in found.split(".")) if kind == 1 else _digits(found)
    return f"{KINDS[kind]}:{told}"


def general_terms(word: str) -> list[str]:
    """A word with digits, less and less exact; other words have no general form."""
    if not DIGITS.search(word):
        return []
    return [word[:n] + "*" * (len(word) - n) for n in range(len(word) - 1, 0, -1)]


def general_entities(name: str) -> list[str]:
    """General forms of an entity, the most telling first."""
    kind, told = name.split(":", 1)
    if kind == "email":
        labels = told.split("@", 1)[1].split(".")
        return ["*@" + ("*." if n else "") + ".".join(labels[n:]) for n in range(len(labels))]
    if kind == "ip":
        parts = told.split(".")
        return [".".join(parts[:n] + ["*"] * (4 - n)) for n in (3, 2, 1)]
    return [told[:n] + "*" * (len(told) - n) for n in ((6, 4, 1) if kind == "card" else (len(told) // 2, 3, 1))]


def words(text: str, spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """(start, lower-case word) of the words outside the spans."""
    ends, out = sorted((start, end) for start, _, end in spans), []
    at = reach = 0
    for m in WORD.finditer(text):
        while at < len(ends) and ends[at][0] < m.end():
            reach = max(reach, ends[at][1])
            at += 1
        if m.start() >= reach:
            out.append((m.start(), m[0].lower()))
    return out


def contexts(text: str, spans: list[tuple[int, int, int]], reach: int) -> list[tuple[str, list[str]]]:
    """(entity, words) of the stretches of words near its mentions; no position counts twice for an entity."""
    told = words(text, spans)
    starts, near = [start for start, _ in told], {}
    for start, kind, end in spans:
        low, high = max(0, bisect_left(starts, start) - reach), min(len(told), bisect_left(starts, end) + reach)
        if low < high:
            parts = near.setdefault(entity(kind, text[start:end]), [])
            if parts and parts[-1][1] >= low:
                parts[-1][1] = max(parts[-1][1], high)
            else:
                parts.append([low, high])
    return [(name, [w for _, w in told[low:high]]) for name, parts in near.items() for low, high in parts]


def _read(text: str, reach: int):
    """Batches of (key, text) to the texts with entities: their entities as often as they occur, and contexts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mentions, near = pa.list_(pa.string()), pa.list_(pa.struct([("entity", pa.string()), ("words", pa.list_(pa.string()))]))
        for batch in batches:
            out = []
            for key, body in zip(batch.column("key").to_pylist(), batch.column(text).to_pylist()):
                spans = base_spans(body)
                if spans:
                    names = [entity(kind, body[start:end]) for start, kind, end in spans]
                    out.append((key, names, [{"entity": e, "words": w} for e, w in contexts(body, spans, reach)]))
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), mentions, near))], ["key", "entities", "contexts"])

    return read


def _counter(text: str, wanted: frozenset[str] | None):
    """Batches of texts to (term, n); the empty term counts all words. None wants every term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, total = Counter(), 0
            for body in batch.column(text).to_pylist():
                told = words(body, base_spans(body))
                total += len(told)
                for _, word in told:
                    for term in (word, *general_terms(word)):
                        if wanted is None or term in wanted:
                            found[term] += 1
            found[""] = total
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    return count


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _mentions(docs: DataFrame, text: str, reach: int) -> DataFrame:
    """(key, entities, contexts) of every row that mentions an entity; key is a hash of its text."""
    rows = docs.select(F.sha2(_text(text), 256).alias("key"), _text(text).alias("__text"))
    return checkpointed(rows.mapInArrow(_read("__text", reach), "key string, entities array<string>, contexts array<struct<entity:string,words:array<string>>>"))


def _near(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, covered) positions in contexts, and (entity, term, both, support); equal contexts are grouped first."""
    told = mentions.select(F.explode("contexts").alias("c")).groupBy("c.entity", "c.words").agg(F.count(F.lit(1)).alias("m"))
    told = checkpointed(told.withColumn("context", F.monotonically_increasing_id()))
    covered = told.groupBy("entity").agg(F.sum(F.col("m") * F.size("words")).alias("covered"))
    # a word with digits stands for its general forms too: each keeps one digit less
    cut = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.concat(F.substring("word", F.lit(1), n), F.repeat(F.lit("*"), F.length("word") - n)))
    each = told.select("entity", "context", "m", F.explode("words").alias("word"))
    terms = F.when(F.col("word").rlike("[0-9]"), F.concat(F.array("word"), cut)).otherwise(F.array("word"))
    each = each.select("entity", "context", "m", F.explode(terms).alias("term"))
    once = each.groupBy("entity", "term", "context").agg(F.sum("m").alias("m"))
    return covered, once.groupBy("entity", "term").agg(F.sum("m").alias("both"), F.count(F.lit(1)).alias("support"))


def _counts(docs: DataFrame, text: str, terms: DataFrame) -> tuple[DataFrame, int]:
    """(term, n) over all texts for at least the given terms, and the number of all words."""
    few = terms.limit(SENT + 1).count() <= SENT
    wanted = frozenset(r.term for r in terms.collect()) if few else None
    parts = docs.select(_text(text).alias("__text")).mapInArrow(_counter("__text", wanted), "term string, n long")
    counted = checkpointed(parts.groupBy("term").agg(F.sum("n").alias("n")))
    total = counted.where("term = ''").agg(F.sum("n")).first()[0] or 0
    return counted.where("term != ''"), int(total)


def disclosures(docs: DataFrame, text: str = "text", reach: int = REACH, support: int = SUPPORT, mentions: DataFrame | None = None) -> DataFrame:
    """(entity, term, both, n, support, disclosure) of every pair with enough contexts; terms with `*` are general forms."""
    covered, pairs = _near(_mentions(docs, text, reach) if mentions is None else mentions)
    pairs = checkpointed(pairs.where(F.col("support") >= support))
    if pairs.isEmpty():
        return pairs.select("entity", "term", "both", F.lit(0).cast("long").alias("n"), "support", F.lit(0.0).alias("disclosure"))
    counted, total = _counts(docs, text, pairs.select("term").distinct())
    whole = F.lit(float(total))
    told = pairs.join(covered, "entity").join(counted, "term")
    mutual = F.ln(F.col("both") * whole / (F.col("n") * F.col("covered")))
    own = F.ln(whole / F.col("covered"))
    return told.select("entity", "term", "both", "n", "support", F.when(own > 0, mutual / own).otherwise(0.0).alias("disclosure"))


def _revealing(mentions: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(key, terms): the terms that disclose an entity the text mentions."""
    telling = found.where(F.col("disclosure") >= least).groupBy("entity").agg(F.collect_set("term").alias("terms"))
    telling = checkpointed(telling)
    if telling.isEmpty():
        return mentions.select("key", F.lit(None).cast("array<string>").alias("terms")).limit(0)
    named = mentions.select("key", F.explode("entities").alias("entity")).distinct()
    both = lookup(named, "entity", telling).where("terms IS NOT NULL")
    return checkpointed(both.select("key", F.explode("terms").alias("term")).groupBy("key").agg(F.collect_set("term").alias("terms")))


def _spanned(text: str, name: str, schema: T.StructType):
    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for body, terms in zip(batch.column("__text").to_pylist(), batch.column("__terms").to_pylist()):
                spans = base_spans(body)
                if terms:
                    known = set(terms)
                    spans = sorted(spans + [(start, len(KINDS), start + len(w)) for start, w in _exact(body, spans) if w.lower() in known])
                out.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            kept = [batch.column(f) for f in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, kind)], names=schema.names)

    return span


def _exact(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, str]]:
    """(start, word as written) of the words outside the spans; a lower-case form may have another length."""
    for start, _ in words(text, spans):
        yield start, WORD.match(text, start)[0]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH, support: int = SUPPORT, least: float = DISCLOSURE) -> DataFrame:
    """(doc_id, text, spans) of every row; spans are (start, kind, end) by start, then kind, positions in code points.

    Kinds are numbers into KINDS; the number after them is a term that discloses an entity of the same text: it stands
    in at least `support` different contexts of the entity, and its disclosure is at least `least`. Texts without an entity
    have no spans. Null text counts as empty and is returned as such, with no spans; repeated rows and null ids are rows of
    their own; other columns are not read. An empty table gives an empty result. Rows stay where they are unless texts with
    revealing terms are too many to be sent to every task.
    """
    mentions = _mentions(docs, text, reach)
    telling = _revealing(mentions, disclosures(docs, text, reach, support, mentions), least)
    rows = docs.select(F.col(doc_id).alias("doc_id"), _text(text).alias("__text"), F.sha2(_text(text), 256).alias("key"))
    both = lookup(rows, "key", telling).select("doc_id", "__text", F.col("terms").alias("__terms"))
    schema = T.StructType([both.schema["doc_id"], T.StructField("__text", T.StringType()), T._parse_datatype_string(f"spans {FOUND}").fields[0]])
    return both.mapInArrow(_spanned("__text", "spans", schema), schema).withColumnsRenamed({"doc_id": doc_id, "__text": text})


def _general(mentions: DataFrame, total: int, generality: float) -> DataFrame:
    """(entity, general): the first general form that carries at most `generality` of the entity's information, if any."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(e, n, k, e.split(":")[0] + ":" + g) for e, n in zip(*(batch.column(c).to_pylist() for c in ("entity", "n"))) for k, g in enumerate(general_entities(e))]
            columns = zip(*told) if told else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()))], ["entity", "n", "level", "general"]
            )

    counted = mentions.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    each = checkpointed(counted.mapInArrow(forms, "entity string, n long, level int, general string"))
    shared = each.groupBy("general").agg(F.sum("n").alias("shared"))
    whole = F.lit(float(max(total, 1)))
    enough = F.ln(F.greatest(whole / F.col("shared"), F.lit(1.0))) <= generality * F.ln(F.greatest(whole / F.col("n"), F.lit(1.0)))
    chosen = each.join(shared, "general").where(enough).groupBy("entity").agg(F.min_by("general", "level").alias("general"))
    return chosen.select("entity", F.substring_index("general", ":", -1).alias("general"))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for body, terms, general in zip(*(batch.column(c).to_pylist() for c in ("__text", "__terms", "__general"))):
            spans, known, forms = base_spans(body), set(terms or ()), {x["entity"]: x["general"] for x in general or ()}
            marks = [(s, e, forms.get(entity(k, body[s:e]), f"[{KINDS[k].upper()}]")) for s, k, e in spans]
            for start, word in _exact(body, spans) if known else ():
                if word.lower() in known:
                    marks.append((start, start + len(word), next((g for g in general_terms(word.lower()) if g not in known), "[TERM]")))
            parts, at = [], 0
            for start, end, mark in sorted(marks, key=lambda x: (x[0], -x[1])):
                if start >= at:
                    parts += [body[at:start], mark]
                at = max(at, end)
            out.append("".join(parts) + body[at:])
        yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(out, pa.string())], ["__row", "__clean"])


def sanitised(docs: DataFrame, text: str = "text", reach: int = REACH, support: int = SUPPORT, least: float = DISCLOSURE,
              generality: float = GENERALITY) -> DataFrame:
    """The documents with every span of `scan` generalised, or replaced by a mark where no general form is safe.

    An entity takes its first general form that carries at most `generality` of its information by the corpus's counts; a
    term with digits its first form that discloses too little. Of spans that overlap the first (the longest, if several
    start together) is replaced and the others go. Null texts stay null; other columns and all rows are kept.
    """
    mentions = _mentions(docs, text, reach)
    telling = _revealing(mentions, disclosures(docs, text, reach, support, mentions), least)
    _, total = _counts(docs, text, mentions.select(F.lit("").alias("term")).limit(0))
    named = mentions.select("key", F.explode("entities").alias("entity")).distinct()
    general = lookup(named, "entity", checkpointed(_general(mentions, total, generality))).where("general IS NOT NULL")
    general = checkpointed(general.groupBy("key").agg(F.collect_list(F.struct("entity", "general")).alias("general")))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), _text(text).alias("__text"), F.sha2(_text(text), 256).alias("key"))
    both = lookup(lookup(rows, "key", telling), "key", general).select("__row", "__text", F.col("terms").alias("__terms"), F.col("general").alias("__general"))
    clean = both.mapInArrow(_cleaned, T.StructType([both.schema["__row"], T.StructField("__clean", T.StringType())]))
    return clean.select(*[F.when(F.col("__row")[c].isNotNull(), F.col("__clean")).alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns])
